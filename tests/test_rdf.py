"""RDF files: N-Triples by line against the Turtle reader, statements, members of containers, memory of large documents."""

import tracemalloc

import pytest

from ontoloom.functions import vocabulary as V
from ontoloom.sources import rdf

LINES = r"""# a comment
<http://t/a> <http://t/p> <http://t/b> .
_:x1 <http://t/p> "plain" .
<http://t/a> <http://t/q> _:x1 . # said of it

<http://t/a> <http://t/p> "a \"quoted\" \\u0041 tab\t é \U0001F600 end\n"@en-GB .
<http://t/a>	<http://t/p>	"1"^^<http://www.w3.org/2001/XMLSchema#integer>.
<http://t/é> <http://t/p> "" .
<http://t/a> <http://t/q> _:x1.
"""


def rows(df):
    return [(r["s"], r["s_bnode"], r["p"], r["o_kind"], r["o"], r["datatype"], r["lang"]) for r in df.orderBy("seq").collect()]


def files(spark, *paths):
    return spark.createDataFrame([("t", i, str(p)) for i, p in enumerate(paths)], "ontology_id string, file_rank int, path string")


def test_lines_are_read_like_turtle(spark, tmp_path):
    path = tmp_path / "a +b.nt"
    path.write_text(LINES)
    got = rows(rdf.triples(spark, files(spark, path)))
    want = [(s, s.startswith("_:"), *rest) for s, *rest in rdf.turtle(LINES.encode(), "", "t-0")]
    assert got == want and len(got) == 7
    assert got[3][4] == 'a "quoted" \\u0041 tab\t é 😀 end\n' and got[3][6] == "en-GB" and got[0][3] == "uri"


def test_many_parts_keep_the_order_of_lines(spark, tmp_path):
    path = tmp_path / "many.nt"
    path.write_text("".join(f'<http://t/{i}> <http://t/p> "{i}" .\n' for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        df = rdf.triples(spark, files(spark, path))
        assert df.rdd.getNumPartitions() > 5
        assert [r["o"] for r in df.orderBy("seq").collect()] == [str(i) for i in range(20_000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_kinds_of_files_side_by_side(spark, tmp_path):
    (tmp_path / "a.nt").write_text("<http://t/a> <http://t/p> <http://t/b> .\n")
    (tmp_path / "b.ttl").write_text("@prefix : <http://t/> . :c :p 1.\nPREFIX x: <http://x/>\nx:d x:p ( 1 [ x:q 2.5 ] ) .")
    got = rdf.triples(spark, files(spark, tmp_path / "a.nt", tmp_path / "b.ttl"))
    assert {(r["file_rank"], r["s"]) for r in got.where("not s_bnode").collect()} == {(0, "http://t/a"), (1, "http://t/c"), (1, "http://x/d")}
    assert {r["o"]: r["datatype"].rsplit("#")[-1] for r in got.where("o_kind = 'literal'").collect()} == {"1": "integer", "2.5": "decimal"}


def test_what_is_no_triple_raises(spark, tmp_path):
    (tmp_path / "bad.nt").write_text("<http://t/a> <http://t/p> <http://t/b> .\n<http://t/a> http://t/p <http://t/b> .\n")
    with pytest.raises(Exception, match="no triple"):
        rdf.triples(spark, files(spark, tmp_path / "bad.nt")).collect()
    for text in ("<http://t/a> <http://t/p> ! .", "<http://t/a> <http://t/p> <http://t/b>"):
        with pytest.raises(ValueError):
            list(rdf.turtle(text.encode(), "here", "t"))


def test_members_of_containers_are_counted():
    text = f'<rdf:RDF xmlns:rdf="{V.RDF}" xmlns:x="http://x/"><rdf:Seq rdf:about="http://t/s"><x:name>n</x:name><rdf:li>a</rdf:li><rdf:li>b</rdf:li></rdf:Seq></rdf:RDF>'
    got = {(p, o) for _, p, _, o, _, _ in rdf.rdf_xml(text.encode(), "http://t/", "t")}
    assert {(V.RDF + "_1", "a"), (V.RDF + "_2", "b"), ("http://x/name", "n")} <= got


def test_memory_follows_elements_not_the_document():
    def peak(n):
        body = b"".join(b'<x:T rdf:about="http://t/%d"><x:p>value %d</x:p></x:T>' % (i, i) for i in range(n))
        data = f'<rdf:RDF xmlns:rdf="{V.RDF}" xmlns:x="http://x/">'.encode() + body + b"</rdf:RDF>"
        tracemalloc.start()
        assert sum(1 for _ in rdf.rdf_xml(data, "http://t/", "t")) == 2 * n
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return top

    assert peak(20_000) < 2 * peak(2_000)


def test_empty_collections_are_nil():
    text = f'<rdf:RDF xmlns:rdf="{V.RDF}" xmlns:t="http://t/"><rdf:Description rdf:about="http://t/a"><t:p rdf:parseType="Collection"/></rdf:Description></rdf:RDF>'
    want = [("http://t/a", "http://t/p", "uri", V.NIL, "", "")]
    assert list(rdf.parse(text.encode(), "http://t/", "t")) == list(rdf.parse(b"<http://t/a> <http://t/p> () .", "http://t/", "t")) == want


def test_namespaces_keep_an_empty_fragment():
    text = b"@base <http://t/x> . @prefix n: <http://n/m#> . @prefix r: <#> . n:a r:p <s#> ."
    assert list(rdf.turtle(text, "http://t/", "t")) == [("http://n/m#a", "http://t/x#p", "uri", "http://t/s#", "", "")]
