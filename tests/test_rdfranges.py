"""Files read by ranges: triples of a whole file, in its order, wherever it is cut."""

import random
from io import BytesIO

import pytest

from ontoloom.sources import rdf, rdfranges

XML = """<?xml version="1.0" encoding="{encoding}"?>
<!DOCTYPE rdf:RDF [ <!ENTITY t "http://t/"> ]>
<!-- <t:A rdf:about="no"/> -->
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:t="http://t/" xml:base="http://base/" xml:lang="de">
{body}<!-- </rdf:RDF> --></rdf:RDF>
<!-- after -->"""
ELEMENT = """<t:A rdf:about="&t;a{i}" t:short="é"><t:p>v{i} &lt; <![CDATA[<t:A>]]></t:p><t:q rdf:nodeID="shared"/><!-- <x> -->
<t:r><t:B><t:p xml:lang="en">in{i}</t:p></t:B></t:r><t:s rdf:parseType="Collection"><t:C rdf:about="rel{i}"/><t:C/></t:s></t:A>
<rdf:Description rdf:nodeID="shared"><t:p rdf:resource="#x{i}"/></rdf:Description>
"""
TURTLE = [
    '@prefix : <http://t/> .', 'PREFIX x: <http://x/>', 'x:a.b :p 1.5, .5, 12 .', ':a :p "dot . here" ; :q """long . "quote" . \n# no comment @prefix : <http://no/> . """@en-GB.',
    "# it's . a comment <\n", ":c :p [ :q ( 1 2 :d.e ) ; :r 'it . \\' s' ] .", "@base <http://base/> .", "<rel> :p <a.b#c.d> .", "@prefix : <sub/> .", ":e :p true .",
    'BASE <http://other/>', ":f a x:G; x:esc x:a\\.b\\'c .", "_:b1 x:p _:b1.", '<r2> x:p "a\\"b . c", "é😀 ." .', "[] x:p () .", "prefix y: <http://y/> y:g y:p y:h.", ' y:k y:p """""" , "" .',
    "@prefix z: # why . not\n <http://z/\\u00e9#> .", "z:a z:b z:c .",
]


def canonical(triples):
    """Made-up blank nodes by the order they come up in."""
    names = {}

    def name(x):
        return names.setdefault(x, f"_:{len(names)}") if x.startswith("_:") and "-n-" not in x else x

    return [(name(s), p, kind, name(o) if kind == "bnode" else o, *rest) for s, p, kind, o, *rest in triples]


def by_ranges(data, found):
    out = []
    for part, (start, stop, head) in enumerate(found):
        out += rdf.parse(data[start:stop], "http://doc", "t-0", head, part)
    return canonical(out)


@pytest.mark.parametrize("encoding", ["utf-8", "utf-16", "iso-8859-1"])
def test_xml_is_cut_at_any_size(encoding, monkeypatch):
    data = XML.format(encoding=encoding, body="".join(ELEMENT.format(i=i) for i in range(40))).encode(encoding)
    want = canonical(rdf.parse(data, "http://doc", "t-0"))
    assert len(want) > 500
    for size, read in ((1, 7), (1, 1 << 20), (700, 64), (5000, 999), (1 << 30, 100)):
        monkeypatch.setattr(rdfranges, "READ_BYTES", read)
        found = list(rdfranges.xml_ranges(BytesIO(data), size))
        assert by_ranges(data, found) == want
        assert all(a[1] == b[0] for a, b in zip(found, found[1:]))
        assert len(found) == 80 if size == 1 else (len(found) == 1) == (size == 1 << 30)


def test_xml_without_elements_or_without_a_list(monkeypatch):
    empty = XML.format(encoding="utf-8", body="").encode()
    assert list(rdfranges.xml_ranges(BytesIO(empty), 1)) == []
    one = b'<?xml version="1.0"?><t:A xmlns:t="http://t/" xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" rdf:about="http://t/a"><t:p><t:B/></t:p></t:A>'
    assert by_ranges(one, rdfranges.xml_ranges(BytesIO(one), 1)) == canonical(rdf.rdf_xml(one, "http://doc", "t-0"))


def turtle_cuts(data, size):
    return list(rdfranges.turtle_ranges(BytesIO(data), size, "http://doc"))


def test_turtle_is_cut_wherever_reads_end(monkeypatch):
    data = "\n".join(TURTLE).encode()
    want = canonical(rdf.turtle(data, "http://doc", "t-0"))
    assert len(want) == 26 and ("http://z/é#a", "http://z/é#b", "uri", "http://z/é#c", "", "") in want
    for read in range(1, len(data) + 1, 3):
        monkeypatch.setattr(rdfranges, "READ_BYTES", read)
        for size in (1, 150):
            assert by_ranges(data, turtle_cuts(data, size)) == want


def test_turtle_in_any_order(monkeypatch):
    rng = random.Random(7)
    for _ in range(150):
        body = [rng.choice([*TURTLE[2:6], *TURTLE[6:]]) for _ in range(30)]
        data = rng.choice(["\n", " "]).join(["@prefix : <http://t/> . PREFIX x: <http://x/> PREFIX y: <http://y/> PREFIX z: <z/>", *body]).encode()
        data = b"\xef\xbb\xbf" + data if rng.random() < 0.3 else data
        try:
            want = canonical(rdf.turtle(data, "http://doc", "t-0"))
        except ValueError:  # a comment may have swallowed a statement's end
            continue
        monkeypatch.setattr(rdfranges, "READ_BYTES", rng.randrange(1, 400))
        found = turtle_cuts(data, rng.randrange(1, 300))
        assert by_ranges(data, found) == want
        assert all(a[1] == b[0] for a, b in zip(found, found[1:])) and found[-1][1] == len(data)


def test_an_unfinished_statement_raises(monkeypatch):
    for text in (":a :p \"open .", "@prefix : <http://t/> . :a :p \"\"\"open . :b :p :c .", "@prefix : <http://t/> . :a :p (1 . "):
        data = text.encode()
        with pytest.raises((ValueError, KeyError, IndexError)):
            by_ranges(data, turtle_cuts(data, 1))


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    large, small = tmp_path / "large one.ttl", tmp_path / "small.ttl"
    large.write_text("@prefix : <http://t/> .\n" + "".join(f':a{i} :p "{i}" ; :q [ :r _:b ] .\n' for i in range(3000)))
    small.write_text("@prefix : <http://t/> . :s :p 1 .")
    xml = tmp_path / "large.owl"
    xml.write_text(XML.format(encoding="utf-8", body="".join(ELEMENT.format(i=i) for i in range(300))))
    files = spark.createDataFrame([("t", 0, str(large)), ("u", 0, f"file://{xml}"), ("t", 1, str(small)), ("v", 2, str(large))], "ontology_id string, file_rank int, path string")
    monkeypatch.setattr(rdfranges.read, "__defaults__", (10_000,))
    want = rdf.triples(spark, files)
    got = rdf.triples(spark, files, whole_bytes=1000)

    def of(df, ontology, rank):
        rows = df.where(f"ontology_id = '{ontology}' and file_rank = {rank}").orderBy("seq").collect()
        return canonical((r["s"], r["p"], r["o_kind"], r["o"], r["datatype"], r["lang"]) for r in rows)

    for key in (("t", 0), ("u", 0), ("t", 1), ("v", 2)):
        assert of(got, *key) == of(want, *key) != []
    ranges = rdfranges.cut(files, 10_000).where("ontology_id = 't' and file_rank = 0")
    assert ranges.count() > 5
    used = got.selectExpr("spark_partition_id() as k", "ontology_id", "file_rank").where("ontology_id = 't' and file_rank = 0").distinct()
    assert used.count() > 5
