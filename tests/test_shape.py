"""Parts of legacy records from reified statements and properties."""

from ontoloom.functions import vocabulary as V
from ontoloom.operators import derive, shape


def test_parts_of_records(spark):
    schema = "ontology_id string, id string, predicate string, pos int, kind string, value string, datatype string, lang string"
    notes = {
        "_:1": (V.DEFINITIONS[1], "what it is", {V.OIO + "hasDbXref": ["PMID:1", "PMID:2"]}),
        "_:2": (V.OIO + "hasDbXref", "DB:7", {V.OIO + "source": ["old", "new"], V.OIO + "url": ["http://db/7"]}),
        "_:3": (V.OIO + "hasDbXref", "http://x/1", {V.LABEL: ["a page"]}),
        "_:4": (V.OIO + "hasNarrowSynonym", "thin", {V.OIO + "hasSynonymType": ["http://t/abbr"]}),
    }
    rows = [("o", "a", V.OIO + "inSubset", i, "uri", f"http://s#{n}", "", "") for i, n in enumerate(("zeta", "alpha", "zeta"))]
    rows += [("o", "a", V.OBO + "IAO_0100001", 0, "uri", "http://x/NEW_1", "", ""), ("o", "b", V.OBO + "IAO_0100001", 0, "literal", "see elsewhere", "", "")]
    for node, (predicate, value, more) in notes.items():
        rows += [("o", node, V.OWL + "annotatedSource", 0, "uri", "a", "", ""), ("o", node, V.OWL + "annotatedProperty", 0, "uri", predicate, "", ""), ("o", node, V.OWL + "annotatedTarget", 0, "literal", value, "", "")]
        rows += [("o", node, p, i, "literal", v, "", "") for p, values in more.items() for i, v in enumerate(values)]
    props = spark.createDataFrame(rows, schema)
    found = derive.axioms(props)
    assert [tuple(r) for r in shape.subsets(props).collect()] == [("o", "a", ["alpha", "zeta"])]
    assert {(r["id"], r["term_replaced_by"]) for r in shape.replaced_by(props).collect()} == {("a", "NEW_1"), ("b", "see elsewhere")}
    assert {(r["definition"], r["xref"]) for r in shape.definition_citations(found).collect()} == {("what it is", "PMID:1"), ("what it is", "PMID:2")}
    assert {(r["database"], r["xref_id"], r["description"], r["url"]) for r in shape.xrefs(found).collect()} == {("DB", "7", "new", "http://db/7"), (None, "http://x/1", "a page", "http://x/1")}
    assert [(r["name"], r["scope"], r["type"], r["xrefs"]) for r in shape.synonyms(found).collect()] == [("thin", "Narrow", "http://t/abbr", None)]
