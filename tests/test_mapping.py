"""Mapping sets: prefixes, rows, files, and those of a load."""

from ontoloom.functions import vocabulary as V
from ontoloom.operators import link, mapping

EXACT, XREF, KEY_OF = V.SKOS + "exactMatch", V.OIO + "hasDbXref", V.OBO + "chebi/inchikey"


def test_prefixes(spark):
    uses = [("A", "x", 1), ("A", "x", 9), ("B", "y", 2), ("B", "x", 3), ("B", "z", 4), ("A", "z", 5), ("A", "w", 6), ("A_2", "q", 7), ("A", "v", 8)]
    got = {(r["prefix"], r["namespace"]): (r["name"], r["n"]) for r in mapping.allocated_prefixes(spark.createDataFrame(uses, "prefix string, namespace string, seen int")).collect()}
    # x belongs to A, z is first met under B, w and v need names of their own, and A_2 is a prefix itself
    assert got == {
        ("A", "x"): ("A", 2), ("B", "y"): ("B", 1), ("B", "x"): ("A", 1), ("B", "z"): ("B_2", 1), ("A", "z"): ("B_2", 1),
        ("A", "w"): ("A_3", 1), ("A_2", "q"): ("A_2", 1), ("A", "v"): ("A_4", 1),
    }
    assert mapping.allocated_prefixes(spark.createDataFrame([], "prefix string, namespace string, seen int")).count() == 0


def made(spark):
    values = [("o", "http://a/1", EXACT, "http://b/2"), ("o", "http://a/1", EXACT, "http://b/2"), ("o", "http://a/1", XREF, "B:3"), ("o", "http://a/1", XREF, "unknown"), ("o", "http://a/1", XREF, None),
              ("o", "http://a/1", KEY_OF, "ABC"), ("o", "http://odd/1", EXACT, "http://b/2"), ("o", "http://plain/1", EXACT, "http://c/2"), ("o", "http://other/1", EXACT, "http://b/2"), ("o", "http://a/1", V.LABEL, "http://b/2"),
              ("p", "http://z\t'/1", EXACT, "http://b/2")]
    subjects = [("o", "http://a/1", "one", "A:1"), ("o", "http://odd/1", "odd", "A:7"), ("o", "http://plain/1", "plain", None), ("p", "http://z\t'/1", "tab\tbed", "Z:1")]
    linked = [("o", "http://b/2", "http://b/2", None, "B:2", "two"), ("o", "B:3", None, "http://bb/3", "B:3", None), ("o", "http://c/2", "http://c/2", None, "C_2", "no"), ("p", "http://b/2", "http://b/2", None, None, "two")]
    return mapping.mappings(
        spark.createDataFrame(values, "ontology_id string, id string, predicate string, value string"),
        spark.createDataFrame(subjects, "ontology_id string, id string, label string, curie string"),
        spark.createDataFrame(linked, "ontology_id string, s string, iri string, url string, curie string, label string"),
    )


def test_rows(spark):
    rows, prefixes = made(spark)
    assert {tuple(r) for r in rows.drop("mapping_justification").collect()} == {
        ("o", "A:1", "skos:exactMatch", "B:2", "one", "two"), ("o", "A:1", "oboInOwl:hasDbXref", "B_2:3", "one", None),
        ("o", "A:1", "oboInOwl:hasDbXref", "inchikey:ABC", "one", "ABC"), ("p", "Z:1", "skos:exactMatch", "http://b/2", "tab\tbed", "two"),
    }
    names = {(r["ontology_id"], r["prefix"]): r["namespace"] for r in prefixes.collect()}
    assert names == {(o, p): n for o in "op" for p, n in mapping.PREFIXES.items()} | {("o", "A"): "http://a/", ("o", "B"): "http://b/", ("o", "B_2"): "http://bb/", ("p", "Z"): "http://z\t'/"}


def test_files_are_whole_sets(spark, tmp_path):
    rows, prefixes = made(spark)
    mapping.write(rows, prefixes, str(tmp_path / "sets"), "http://sets/", file_rows=1)
    files = list((tmp_path / "sets").rglob("*.txt"))
    assert len(files) >= 2
    for file in files:
        lines = file.read_text().splitlines()
        assert lines[0].startswith("# mapping_set_id: 'http://sets/") and lines[1] == "# curie_map:" and "#   skos: '" + V.SKOS + "'" in lines
        body = [x for x in lines if not x.startswith("#")]
        assert body[0].split("\t") == list(mapping.COLUMNS)
    back = spark.read.option("sep", "\t").option("header", True).option("comment", "#").csv(str(tmp_path / "sets"))
    want = {tuple(r) for r in rows.select(*mapping.COLUMNS).collect()}
    assert {tuple(r[c] for c in mapping.COLUMNS) for r in back.collect()} == want


def test_gathered_values(spark):
    rows = [("o", "a", "p", "literal", "see GO:1 at http://x/y now"), ("o", "a", "rel+http://p/1", "uri", "http://b"), ("o", "a", "p", "bnode", "_:1"), ("o", "a", "p", "literal", None)]
    got = {r["s"] for r in link.gathered_values(spark.createDataFrame(rows, "ontology_id string, id string, predicate string, kind string, value string")).collect()}
    assert got == {"see GO:1 at http://x/y now", "GO:1", "http://x/y", "p", "http://p/1", "http://b"}
