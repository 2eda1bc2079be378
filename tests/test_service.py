"""The service's answers over a small load, and walks from given nodes."""

import pytest
from pyspark.sql import functions as F

from ontoloom.functions.vocabulary import TYPE
from ontoloom.operators import graph
from ontoloom.operators.search import EDGES, LOWER_TOKENS, SPACE_EDGES, v1_field
from ontoloom.service import Service

DOCS = "id string, iri string, ontologyId string, type array<string>, label array<string>, synonym array<string>, shortForm string, curie string, isObsolete boolean, isDefiningOntology boolean, imported boolean, isPreferredRoot boolean, hasDirectParents boolean, hasHierarchicalParents boolean, hasDirectChildren boolean, hasHierarchicalChildren boolean"
EDGE = "src string, edge_type string, dst string, props map<string,array<string>>"


def doc(onto, kind, name, label, obsolete=False, defining=True, preferred=False, parents=True, children=False, synonym=None):
    return (f"{onto}+{kind}+{name}", name, onto, [kind], label, synonym, f"S_{name}", f"S:{name}", obsolete, defining, not defining, preferred, parents, parents, children, children)


@pytest.fixture(scope="module")
def service(spark):
    docs = [
        doc("o", "ontology", "o", ["the onto"], parents=False), doc("o", "class", "a", ["heart"], parents=False, children=True, preferred=True), doc("o", "class", "b", ["heart valve", "Herzklappe"], children=True, synonym=["cardiac valve"]),
        doc("o", "class", "c", ["old heart"], obsolete=True), doc("o", "individual", "i", ["my heart"]), doc("p", "class", "b", ["heart valve"], defining=False), doc("o", "property", "r", ["in"], parents=False), doc("o", "class", "n", None, parents=False),
    ]
    edges = [("o+class+b", "directParent", "o+class+a", None), ("o+class+b", "hierarchicalParent", "o+class+a", None), ("o+class+c", "directParent", "o+class+b", None), ("o+class+c", "hierarchicalParent", "o+class+b", None)]
    edges += [("o+individual+i", TYPE, "o+class+b", None), ("o+class+b", "relatedTo", "o+class+c", {"property": ["r"]})]
    return Service(spark.createDataFrame(docs, DOCS).cache(), spark.createDataFrame(edges, EDGE).cache())


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_stats_and_lookups(service):
    assert {r["type"]: r["n"] for r in service.stats().collect()} == {"ontology": 1, "class": 5, "individual": 1, "property": 1}
    assert service.healthy()
    assert service.entity("class", "o", "b")["shortForm"] == "S_b"
    for bad in (lambda: service.entity("class", "o", "zz"), lambda: service.entity("class", "p", "a")):
        with pytest.raises(LookupError):
            bad()
    with pytest.raises(ValueError):
        service.entities("class", "o;x")
    assert ids(service.find("class", any_id="S:b")) == ["o+class+b", "p+class+b"]
    assert ids(service.find("class", short_form="S_b", defining=True)) == ["o+class+b"]
    assert ids(service.find("class", iri="b", ontology="p")) == ["p+class+b"]
    assert ids(service.find("class")) == [] and ids(service.find("class", any_id="zz")) == []
    assert ids(service.roots("class", "o")) == ["o+class+a", "o+class+n"]
    assert ids(service.roots("class", "o", preferred=True)) == ["o+class+a"]


def test_roots_of_individuals_without_the_optional_flag(service):
    bare = Service(service.documents.drop("isObsolete"), service.edges)
    assert ids(bare.individual_roots("o")) == ids(service.individual_roots("o")) == ["o+class+b"]


def test_entities(service):
    assert ids(service.entities("class").hits) == ["o+class+a", "o+class+b", "o+class+n", "p+class+b"]
    assert len(ids(service.entities("class", obsolete=True).hits)) == 5
    assert ids(service.entities("class", isObsolete=["true"]).hits) == ["o+class+c"]
    found = service.entities("entity", text="heart", facets=("type",), type=["class"], ontologyId=["o,p"])
    assert ids(found.hits) == ["o+class+a", "o+class+b", "p+class+b"] and found.total() == 3
    assert {(r["value"], r["n"]) for r in found.facets.collect()} == {("class", 3), ("individual", 1)}
    assert [r["id"] for r in found.page(0, 1).collect()] == ["o+class+a"]
    assert ids(service.entities("entity", text="heart valve", exact=True).hits) == ["o+class+b", "p+class+b"]


def test_relations(service):
    want = {
        "parents": ["o+class+a"], "hierarchicalParents": ["o+class+a"], "ancestors": ["o+class+a"], "children": ["o+class+c"], "hierarchicalChildren": ["o+class+c"],
        "descendants": ["o+class+c"], "hierarchicalDescendants": ["o+class+c"], "individuals": ["o+individual+i"], "types": [],
    }
    assert {name: ids(service.related("class", "o", "b", name)) for name in want} == want
    assert ids(service.related("individual", "o", "i", "alltypes")) == ["o+class+b"]
    assert ids(service.by_property("o", "b", "r")) == ["o+class+c"] and ids(service.by_property("o", "b", "x")) == []
    around = {(r["src"], r["edge_type"], r["dst"]) for r in service.neighbours("o", "b").collect()}
    assert around == {("o+class+b", "directParent", "o+class+a"), ("o+class+c", "directParent", "o+class+b"), ("o+class+b", "relatedTo", "o+class+c")}
    assert sorted((r["id"], r["depth"]) for r in service.js_tree("class", "o", "c").collect()) == [("o+class+a", 1), ("o+class+b", 2), ("o+class+c", 3)]


def test_legacy_searches(service):
    assert ids(service.search("heart").hits) == ["o+class+a", "o+class+b", "o+individual+i", "p+class+b"]
    grouped = service.search("heart valve", group=True, facets=True)
    assert ids(grouped.hits) == ["o+class+b"]
    assert {(r["field"], r["value"], r["n"]) for r in grouped.facets.collect()} >= {("ontologyId", "o", 1), ("ontologyId", "p", 1), ("type", "class", 2)}
    assert ids(service.search("heart", obsolete=True).hits) == ["o+class+c"]
    assert ids(service.search("heart", below=("a",), inclusive=True).hits) == ["o+class+a", "o+class+b"]
    assert ids(service.search("heart", leaf=True, local=True).hits) == ["o+individual+i"]
    assert ids(service.search("*", ontologies=("p",)).hits) == ["p+class+b"]
    assert ids(service.search("S_b", fields="short_form,nonsense").hits) == ["o+class+b", "p+class+b"]
    chosen = {r["id"]: (r["label_autosuggest"], r["synonym_autosuggest"]) for r in service.select("val he", local=True).hits.collect()}
    assert chosen == {"o+class+b": (["<b>he</b>art <b>val</b>ve", "<b>He</b>rzklappe"], ["cardiac <b>val</b>ve"])}
    assert ids(service.select("  ").hits) == []
    assert {(r["label"], r["score"]) for r in service.suggest("heart").collect()} == {("heart", 10.0), ("heart valve", 2.0), ("old heart", 1.0), ("my heart", 1.0)}


def test_walks_over_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), (None, "a"), ("d", "d")], "src string, dst string").withColumn("edge_type", F.lit("e"))
    focus = spark.createDataFrame([("a",), ("d",), ("zz",)], "id string")
    assert {tuple(r) for r in graph.reach_from(edges, focus, ["e"]).collect()} == {("a", x) for x in "abc"} | {("d", x) for x in "abcd"}
    assert {tuple(r) for r in graph.reach_from(edges, focus, ["e"], incoming=True).collect()} == {("a", x) for x in "abcd"} | {("d", "d")}
    assert graph.reach_from(edges, focus, ["other"]).count() == 0


def test_tree_children_and_roots_of_individuals(service):
    node = {r["id"]: r["node_id"] for r in service.js_tree("class", "o", "b").collect()}
    under = {r["id"]: r for r in service.js_tree("class", "o", "c").collect()}
    kids = service.js_tree_children("class", "o", "b", node["o+class+b"]).collect()
    assert [(r["id"], r["parent_id"], r["has_children"]) for r in kids] == [("o+class+c", node["o+class+b"], False)]
    assert kids[0]["node_id"] == under["o+class+c"]["node_id"]
    assert service.js_tree_children("class", "o", "zz", node["o+class+a"]).count() == 0
    assert ids(service.individual_roots("o")) == ["o+class+b"]
    assert ids(service.individual_roots("p")) == []


def test_loads_that_lack_flags_and_properties(service, spark):
    """An unknown property matches nothing; flags that a load lacks are those of no document."""
    assert ids(service.entities("class", foo=["bar"]).hits) == []
    bare = Service(service.documents.drop("isObsolete", "isDefiningOntology", "imported"), service.edges)
    assert ids(bare.search("heart").hits) == ids(bare.documents.where(F.exists("label", lambda v: v.contains("heart"))))
    assert ids(bare.find("class", iri="b", defining=True)) == []
    assert "o+class+a" in ids(bare.roots("class", "o"))


def test_legacy_field_names():
    assert v1_field("label_s^5") == ("label", 5.0, LOWER_TOKENS) and v1_field("label_e") == ("label", 1.0, EDGES)
    assert v1_field("short_form") == ("shortForm", 1.0, SPACE_EDGES)
    for dropped in ("id", "ontologyId", "logical_description", "nothing_s"):
        assert v1_field(dropped) is None


def test_term_graph(spark):
    docs = [(f"o+class+{n}", n, "o", ["class"], [f"label {n}"]) for n in "abcde"] + [("o+property+p", "p", "o", ["property"], ["part of", "Part"]), ("z+property+p", "p", "z", ["property"], ["another"]), ("z+property+q", "q", "z", ["property"], ["near"])]
    edges = [("o+class+b", "directParent", "o+class+a", None), ("o+class+c", "directParent", "o+class+b", None), ("o+class+b", "relatedTo", "o+class+d", {"property": ["p"]}), ("o+class+e", "relatedTo", "o+class+b", {"property": ["q"]}), ("o+class+e", "relatedTo", "o+class+b", {"property": ["r"]}), ("o+class+d", "directParent", "o+class+a", None), ("o+class+b", "hierarchicalParent", "o+class+a", None)]
    service = Service(spark.createDataFrame(docs, "id string, iri string, ontologyId string, type array<string>, label array<string>"), spark.createDataFrame(edges, "src string, edge_type string, dst string, props map<string, array<string>>"))
    nodes, around = service.term_graph("O", "b")
    assert {tuple(r) for r in nodes.collect()} == {(n, f"label {n}") for n in "abcde"}
    up = "http://www.w3.org/2000/01/rdf-schema#subClassOf"
    assert sorted(tuple(r) for r in around.collect()) == [("b", "a", up, "is a"), ("b", "d", "p", "Part"), ("c", "b", up, "is a"), ("e", "b", "q", "near"), ("e", "b", "r", "is a")]
    nodes, around = service.term_graph("o", "nothing")
    assert nodes.isEmpty() and around.isEmpty()
