"""Registries, the cascade of links, class expressions, trees and records on small tables."""

import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from ontoloom.functions import vocabulary as V
from ontoloom.operators import derive, display, link, shape
from ontoloom.sources import rdf, registries

HEAD = "@prefix owl: <%s> . @prefix rdfs: <%s> . @prefix xsd: <%s> . @prefix : <http://t/o#> .\n" % (V.OWL, V.RDFS, V.XSD)
EXPRESSIONS = HEAD + """
<http://t/o> a owl:Ontology ; owl:versionInfo "7" ; <http://purl.org/dc/elements/1.1/title> "Stated" .
:A a owl:Class ; rdfs:label "alpha" . :B a owl:Class . :i a owl:NamedIndividual . :p a owl:ObjectProperty ; rdfs:label "part of" . :q a owl:DatatypeProperty .
:x1 a owl:Class ; rdfs:subClassOf [ a owl:Restriction ; owl:onProperty :p ; owl:someValuesFrom [ a owl:Class ; owl:intersectionOf ( :A [ owl:complementOf :B ] ) ] ] .
:x2 a owl:Class ; rdfs:subClassOf [ owl:unionOf ( :A :B ) ] , [ owl:oneOf ( :i ) ] .
:x3 a owl:Class ; rdfs:subClassOf [ owl:onProperty :p ; owl:maxQualifiedCardinality 2 ; owl:onClass :A ] , [ owl:onProperty [ owl:inverseOf :p ] ; owl:hasSelf true ] .
:x4 a owl:Class ; rdfs:subClassOf [ owl:onProperty :q ; owl:allValuesFrom [ owl:onDatatype xsd:integer ; owl:withRestrictions ( [ xsd:minInclusive 1 ] [ xsd:maxExclusive 9 ] ) ] ] .
:x5 a owl:Class ; rdfs:subClassOf [ rdfs:comment "nothing" ] , [ owl:onProperty :p ; owl:hasValue :i ] , [ owl:onProperty :p ; owl:cardinality 0 ] .
"""


@pytest.fixture(scope="module")
def onto(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("display")
    (top / "x.ttl").write_text(EXPRESSIONS)
    triples = rdf.triples(spark, spark.createDataFrame([("t", 0, str(top / "x.ttl"))], "ontology_id string, file_rank int, path string")).cache()
    return triples, derive.node_table(triples).cache(), derive.prop_table(triples).cache()


def test_class_expressions(onto):
    _, nodes, props = onto
    names = props.where(F.col("predicate") == V.LABEL).select("ontology_id", "id", F.col("value").alias("label"))
    texts = display.class_expressions(props, names).select("ontology_id", F.col("id").alias("value"), "text")
    own = props.where(F.col("predicate") == V.SUBCLASS).join(texts, ["ontology_id", "value"])
    got = {(r["id"].rsplit("#", 1)[1], r["text"]) for r in own.collect()}
    assert got == {
        ("x1", "part of some (alpha and not B)"), ("x2", "(alpha or B)"), ("x2", "{i}"), ("x3", "part of max 2 alpha"), ("x3", "inverse (part of) Self"),
        ("x4", "q only integer[≥ 1, < 9]"), ("x5", display.UNKNOWN), ("x5", "part of value i"), ("x5", "part of exactly 0"),
    }


def test_class_expressions_of_nothing(spark, onto):
    _, _, props = onto
    none = spark.createDataFrame([], "ontology_id string, id string, label string")
    assert display.class_expressions(props.where("false"), none).count() == 0


def test_annotation_predicates(spark, onto):
    _, nodes, _ = onto
    rows = [("t", "http://t/o#A", p) for p in ("http://t/o#p", "http://n/note", V.LABEL, V.RDFS + "comment", "plain", V.OIO + "inSubset", "http://n/hidden")]
    props = spark.createDataFrame(rows, "ontology_id string, id string, predicate string")
    got = {r["predicate"] for r in display.annotation_predicates(props, nodes, ("http://n/hidden",)).collect()}
    assert got == {"http://n/note", V.RDFS + "comment"}


def test_merged_axioms(spark):
    rows = [("t", "a", "p", "v", [{"x": ["2", "1"]}, {"x": ["1"], "y": ["3"]}]), ("t", "b", "p", "v", None)]
    got = display.merged_axioms(spark.createDataFrame(rows, "ontology_id string, id string, predicate string, value string, axioms array<map<string,array<string>>>"))
    assert [(r["id"], r["annotations"]) for r in got.collect()] == [("a", {"x": ["1", "2"], "y": ["3"]})]


def test_tree(spark):
    nodes = spark.createDataFrame([("a", False, 0, 2), ("b", True, 3, 1), ("c", False, 0, 0), ("d", False, 0, 0)], "id string, preferred boolean, num_hierarchical_descendants long, num_descendants long")
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("a", V.THING), ("d", "gone")], "src string, dst string")
    places = lambda df: sorted((r["id"], r["depth"], r["n_below"]) for r in df.collect())
    assert places(display.tree(nodes, edges)) == [("a", 1, 2), ("b", 2, 3), ("c", 2, 0), ("c", 3, 0), ("d", 1, 0)]
    assert places(display.tree(nodes, edges, preferred="preferred")) == [("b", 1, 3), ("c", 2, 0)]
    assert places(display.tree(nodes, edges, root="c")) == [("c", 1, 0)]
    around = spark.createDataFrame([("b", "a"), ("a", "b")], "src string, dst string")
    assert places(display.tree(nodes, around, root="a")) == [("a", 1, 2), ("b", 2, 3)]


def test_registries(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"go": {"preferred_prefix": "GO", "synonyms": ["G.O", "gene-ont"], "pattern": r"\d{3}", "uri_format": "http://go/$1"}, "odd": {"uri_format": "http://odd/$1/x", "pattern": ".*"}, "bare": {}}))
    (tmp_path / "x.yaml").write_text("- database: PMID\n  name: papers\n  entity_types:\n    - type_name: entity\n      url_syntax: 'http://pm/[example_id]'\n- database: NONE\n  name: none\n- database: Two\n  entity_types:\n    - url_syntax: http://a/[example_id]\n    - url_syntax: http://b/[example_id]\n")
    registry = registries.prefix_registry(spark, str(tmp_path / "r.json")).cache()
    assert {(r["prefix"], r["database"], r["uri_prefix"]) for r in registry.collect()} == {("go", "go", "http://go/"), ("geneont", "go", "http://go/"), ("odd", "odd", None), ("bare", "bare", None)}
    databases = registries.database_urls(spark, str(tmp_path / "x.yaml")).cache()
    assert {tuple(r) for r in databases.collect()} == {("pmid", "http://pm/[example_id]"), ("two", "http://b/[example_id]")}
    curies = spark.createDataFrame([("GO:123",), ("GO:12x",), ("odd:7",), ("bare:7",), ("pmid:5",), ("G.O:999",), ("none",), (None,)], "c string")
    urls = {r["c"]: (r["url"], r["source"]) for r in link.curie_to_url(curies, "c", registry, databases).collect()}
    assert urls == {"GO:123": ("http://go/123", "registry"), "odd:7": ("http://odd/7/x", "registry"), "pmid:5": ("http://pm/5", "databases"), "G.O:999": ("http://go/999", "registry")}


def test_people(spark, tmp_path):
    def record(key, family, given):
        name = f"<p:name><g:given-names xmlns:g='g'>{given}</g:given-names>" + (f"<g:family-name xmlns:g='g'>{family}</g:family-name>" if family else "") + "</p:name>"
        return f"<r:record xmlns:r='r' xmlns:p='p'><c:orcid-identifier xmlns:c='c'><c:uri>{key}</c:uri></c:orcid-identifier><p:person>{name}</p:person></r:record>".encode()

    packed = io.BytesIO()
    with tarfile.open(fileobj=packed, mode="w:gz") as tar:
        for name, data in (("a/1.xml", record("http://p/1", "Doe", "Jo")), ("a/2.xml", record("http://p/2", "", "Mono")), ("a/3.xml", b"<other/>"), ("a/readme.txt", b"x")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as outer:
        outer.writestr("x_summaries.tar.gz", packed.getvalue())
        outer.writestr("other.txt", "x")
    (tmp_path / "one.xml").write_bytes(record("http://p/1", "Doe", "Jo"))
    got = {tuple(r) for r in registries.people(spark, str(tmp_path)).collect()}
    assert got == {("http://p/1", "ORCID", "http://p/1", "Doe, Jo"), ("http://p/2", "ORCID", "http://p/2", "Mono")}


def test_linked_entities(spark):
    entities = spark.createDataFrame(
        [("http://go/1", "o1", "class", "one", "GO:1"), ("http://go/1", "o2", "class", "eins", "GO_1"), ("http://go/1", "o2", "individual", "eins", "GO_1"), ("http://x/2", "o2", "class", "two", "x2"), ("http://y/3", "o1", "class", "b", "y"), ("http://y/3", "o2", "class", "c", "y")],
        "iri string, ontology_id string, type string, label string, curie string",
    )
    definers = spark.createDataFrame([("http://go/1", "o1")], "iri string, ontology_id string")
    registry = spark.createDataFrame([("go", "go", r"\d+", "http://go/$1", "http://go/"), ("ex", "ex", r"\d+", "http://ex/$1", "http://ex/")], "database string, prefix string, pattern string, uri_format string, uri_prefix string")
    bases = spark.createDataFrame([("GO", "http://go/")], "prefix string, base string")
    links = spark.createDataFrame([("key1", "ORCID", "http://p/1", "Doe, Jo")], "key string, source string, url string, label string")
    strings = spark.createDataFrame([("o3", s) for s in ("http://go/1", "http://x/2", "http://y/3", "GO:1", "http://ex/5", "ex:abc", "key1", "nothing at all", "  ", None, V.OWL + "Class")] + [("o2", "http://y/3")], "ontology_id string, s string")
    got = {(r["ontology_id"], r["s"]): r.asDict() for r in link.linked_entities(strings, entities, definers, registry, bases, links=links).collect()}
    assert set(got) == {("o3", s) for s in ("http://go/1", "http://x/2", "http://y/3", "GO:1", "http://ex/5", "key1")} | {("o2", "http://y/3")}
    take = lambda o, s, *names: tuple(got[o, s][n] for n in names)
    assert take("o3", "http://go/1", "defined_by", "num_appears_in", "has_local_definition", "label", "curie", "types") == (["o1"], 3, False, "one", "GO:1", ["class"])
    assert take("o3", "http://x/2", "defined_by", "label") == (["o2"], "two")
    assert take("o3", "http://y/3", "defined_by", "label", "has_local_definition") == (None, "b", False)
    assert take("o2", "http://y/3", "label", "has_local_definition") == ("c", True)
    assert take("o3", "GO:1", "iri", "url", "source", "curie", "label") == ("http://go/1", "http://go/1", "registry", "GO:1", "one")
    assert take("o3", "http://ex/5", "iri", "url", "curie") == (None, "http://ex/5", "ex:5")
    assert take("o3", "key1", "url", "label", "source") == ("http://p/1", "Doe, Jo", "ORCID")
    fixed = {(r["iri"], r["ontology_id"], r["type"]): r["curie"] for r in link.repaired_curies(entities, definers).collect()}
    assert fixed["http://go/1", "o2", "individual"] == "GO:1" and fixed["http://x/2", "o2", "class"] == "x2" and len(fixed) == 6
    props = spark.createDataFrame([("o2", "http://x/2", V.RDFS + "isDefinedBy", "http://o/1"), ("o2", "http://x/2", V.RDFS + "isDefinedBy", "http://unknown")], "ontology_id string, id string, predicate string, value string")
    known = spark.createDataFrame([("http://o/1", "o1")], "iri string, ontology_id string")
    assert [tuple(r) for r in link.stated_definers(props, known).collect()] == [("http://x/2", "o1")]


def test_ontology_nodes_and_records(spark, onto):
    triples, nodes, props = onto
    config = spark.createDataFrame([("t", ["http://base#"], "/p"), ("u", ["http://base#"], "/p"), ("v", None, "/p")], "ontology_id string, base_uris array<string>, path string")
    found = derive.ontology_nodes(nodes, props, config)
    assert {tuple(r) for r in found.collect()} == {("t", "http://t/o", True), ("u", "http://base#", False), ("v", "/p", False)}
    configs = spark.createDataFrame([("t", {"title": '"Configured"', "description": '"from config"', "preferredPrefix": '"T"'}), ("u", {"title": '"U"'})], "ontology_id string, config map<string,string>")
    rows = {r["ontology_id"]: r for r in shape.ontologies(configs, found, props, derive.counters(triples)).collect()}
    assert (rows["t"]["title"], rows["t"]["description"], rows["t"]["version"], rows["t"]["number_of_properties"], rows["t"]["preferred_prefix"]) == ("Stated", "from config", "7", 2, "T")
    assert (rows["u"]["title"], rows["u"]["number_of_terms"], rows["u"]["label_property"]) == ("U", 0, V.LABEL)
    shorts = derive.short_forms(nodes, config.select("ontology_id", F.lit("T_X").alias("prefix"), F.array(F.lit("http://t/o#")).alias("base_uris")))
    labels = derive.labels(nodes, props, shorts)
    flags = spark.createDataFrame([("t", "http://t/o#p", True, False)], "ontology_id string, id string, has_parents boolean, has_children boolean")
    own = {r["iri"]: r for r in shape.properties(labels, shorts, flags, synonyms=labels).collect()}
    p = own["http://t/o#p"]
    assert (p["label"], p["short_form"], p["obo_id"], p["is_root"], p["has_children"], p["synonyms"]) == ("part of", "T_X_p", "T:X:p", False, False, ["part of"])
    assert own["http://t/o#q"]["is_root"]
    assert "has_children" not in shape.individuals(labels, shorts).columns
