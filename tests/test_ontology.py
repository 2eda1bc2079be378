"""RDF reading and derivations on small ontologies written for these tests."""

import json

import pytest
from pyspark.sql import functions as F

from ontoloom.functions import vocabulary as V
from ontoloom.operators import derive, export, shape
from ontoloom.sources import rdf

HEAD = '<?xml version="1.0"?><rdf:RDF xmlns="http://t/o#" xml:base="http://t/o" xmlns:rdf="%s" xmlns:rdfs="%s" xmlns:owl="%s" xmlns:oio="%s" xmlns:obo="%s">' % (V.RDF, V.RDFS, V.OWL, V.OIO, V.OBO)
MAIN = HEAD + """
<owl:Ontology rdf:about="http://t/o"><owl:imports rdf:resource="http://t/imported"/><obo:IAO_0000700 rdf:resource="#A"/></owl:Ontology>
<owl:Class rdf:about="#A"><rdfs:label>alpha</rdfs:label><rdfs:label xml:lang="de">Alpha</rdfs:label><oio:hasExactSynonym>first</oio:hasExactSynonym></owl:Class>
<owl:Class rdf:about="#B"><rdfs:subClassOf rdf:resource="#A"/><rdfs:label xml:lang="de">nur deutsch</rdfs:label>
  <rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="http://purl.obolibrary.org/obo/BFO_0000050"/><owl:someValuesFrom rdf:resource="#C"/></owl:Restriction></rdfs:subClassOf></owl:Class>
<owl:Class rdf:about="#C"><owl:equivalentClass rdf:resource="#A"/><owl:deprecated rdf:datatype="http://www.w3.org/2001/XMLSchema#boolean">TRUE</owl:deprecated></owl:Class>
<owl:Class rdf:about="#D"><rdfs:subClassOf><owl:Class><owl:intersectionOf rdf:parseType="Collection"><owl:Class rdf:about="#A"/><owl:Class rdf:about="#B"/></owl:intersectionOf></owl:Class></rdfs:subClassOf></owl:Class>
<owl:Class rdf:about="#E"><rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="#p"/><owl:hasValue rdf:resource="#i"/></owl:Restriction></rdfs:subClassOf><rdfs:subClassOf rdf:resource="http://t/imported#X"/></owl:Class>
<owl:ObjectProperty rdf:about="#p"><owl:inverseOf rdf:resource="#q"/></owl:ObjectProperty><owl:ObjectProperty rdf:about="#q"/>
<owl:NamedIndividual rdf:about="#i"><rdf:type rdf:resource="#A"/></owl:NamedIndividual><owl:NamedIndividual rdf:about="#j"/>
<owl:Class rdf:about="#j"/>
<rdf:Description><rdf:type rdf:resource="http://www.w3.org/2002/07/owl#AllDisjointClasses"/><owl:members rdf:parseType="Collection"><rdf:Description rdf:about="#A"/><rdf:Description rdf:about="#B"/><rdf:Description rdf:about="#D"/></owl:members></rdf:Description>
<owl:Axiom><owl:annotatedSource rdf:resource="#A"/><owl:annotatedProperty rdf:resource="http://www.geneontology.org/formats/oboInOwl#hasExactSynonym"/><owl:annotatedTarget>first</owl:annotatedTarget><oio:hasDbXref>PMID:1</oio:hasDbXref></owl:Axiom>
<owl:NegativePropertyAssertion><owl:sourceIndividual rdf:resource="#i"/><owl:assertionProperty rdf:resource="#p"/><owl:targetIndividual rdf:resource="#j"/></owl:NegativePropertyAssertion>
</rdf:RDF>"""
IMPORTED = """@prefix owl: <%s> . @prefix rdfs: <%s> . @prefix : <http://t/imported#> .
:X a owl:Class ; rdfs:label "ex"@en , 'why'@fr ; rdfs:subClassOf [ a owl:Restriction ; owl:onProperty :r ; owl:maxCardinality 2 ] .
:Y a owl:Class ; owl:unionOf ( :X :X ) ; rdfs:comment \"\"\"long "text" \\u00e9\"\"\" ; rdfs:seeAlso true , 1.5 , 2e3 .
<http://t/imported> a owl:Ontology ; owl:imports <http://t/o> .
""" % (V.OWL, V.RDFS)


@pytest.fixture(scope="module")
def onto(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("rdf")
    (top / "main.owl").write_text(MAIN)
    (top / "imported.ttl").write_text(IMPORTED)
    first = spark.createDataFrame([("t", 0, str(top / "main.owl"))], "ontology_id string, file_rank int, path string")
    files = rdf.imports_closure(spark, first, {"http://t/imported": str(top / "imported.ttl"), "http://t/o": str(top / "main.owl")})
    # relative IRIs resolve against xml:base, which the main file states
    triples = rdf.triples(spark, files).cache()
    nodes, props = derive.node_table(triples).cache(), derive.prop_table(triples).cache()
    return triples, nodes, props


def name(iri):
    return iri.rsplit("#", 1)[-1].rsplit("/", 1)[-1]


def pairs(df, a, b):
    return {(name(r[a]), name(r[b])) for r in df.collect()}


def test_reading(onto):
    triples, nodes, props = onto
    assert {r["file_rank"] for r in triples.select("file_rank").distinct().collect()} == {0, 1}
    imported = {name(r["id"]): r["imported"] for r in nodes.where("not bnode").collect()}
    assert imported["X"] and imported["Y"] and not imported["A"]
    y = props.where(F.col("id") == "http://t/imported#Y").collect()
    assert [r["value"] for r in y if name(r["predicate"]) == "comment"] == ['long "text" é']
    assert {(r["value"], name(r["datatype"])) for r in y if name(r["predicate"]) == "seeAlso"} == {("true", "boolean"), ("1.5", "decimal"), ("2e3", "double")}
    count = derive.counters(triples).first()
    assert (count["classes"], count["properties"], count["individuals"]) == (10, 2, 2)
    assert count["languages"] == ["de", "en", "fr"]


def test_hierarchy(onto):
    _, nodes, props = onto
    parents = derive.direct_parents(nodes, props)
    assert pairs(parents, "id", "parent") == {("B", "A"), ("E", "X"), ("i", "A")}
    relations = derive.related(nodes, props)
    got = {(name(r["id"]), name(r["property"]), name(r["value"])) for r in relations.collect()}
    assert got == {("B", "BFO_0000050", "C"), ("D", "subClassOf", "A"), ("D", "subClassOf", "B"), ("i", "p", "E")}
    up = derive.hierarchical_parents(nodes, props, relations)
    assert pairs(up, "id", "parent") == {("B", "A"), ("B", "C"), ("E", "X")}
    assert pairs(derive.ancestors(up), "id", "ancestor") == {("B", "A"), ("B", "C"), ("E", "X")}


def test_symmetry_and_lists(onto):
    _, nodes, props = onto
    assert pairs(derive.equivalents(nodes, props), "id", "value") == {("C", "A"), ("A", "C")}
    assert pairs(derive.symmetric(nodes, props, V.OWL + "inverseOf", "property"), "id", "value") == {("p", "q"), ("q", "p")}
    disjoint = derive.pairwise(nodes, props)
    assert pairs(disjoint, "id", "value") == {(a, b) for a in "ABD" for b in "ABD" if a != b}
    union = [r for r in derive.list_members(props).collect() if name(r["member"]) == "X"]
    assert sorted(r["pos"] for r in union) == [0, 1]
    negative = derive.negative_assertions(props).collect()
    assert [(name(r["id"]), r["predicate"].split("+")[0], name(r["value"])) for r in negative] == [("i", "negativePropertyAssertion", "j")]


def test_labels_flags_and_axioms(onto):
    _, nodes, props = onto
    config = nodes.select("ontology_id").distinct().withColumns({"prefix": F.lit("T"), "base_uris": F.array(F.lit("http://t/o#")), "preferred_root_term": F.array(F.lit("http://t/o#C"))})
    shorts = derive.short_forms(nodes, config)
    assert {name(r["id"]): r["short_form"] for r in shorts.collect()}["A"] == "T_A"
    labels = derive.labels(nodes, props, shorts)
    by_id = {}
    for r in labels.orderBy("pos").collect():
        by_id.setdefault(name(r["id"]), []).append(r["value"])
    assert by_id["A"] == ["alpha", "Alpha"] and by_id["B"] == ["nur deutsch", "T_B"] and by_id["C"] == ["T_C"]
    assert {name(r["id"]) for r in derive.obsolete(nodes, props).where("is_obsolete").collect()} == {"C"}
    assert {name(r["id"]) for r in derive.preferred_roots(nodes, props, config).where("is_preferred_root").collect()} == {"A", "C"}
    assert {name(r["id"]) for r in derive.has_individuals(nodes, props).collect()} == {"A"}
    found = derive.axioms(props)
    assert [r["annotations"] for r in found.collect()] == [{V.OIO + "hasDbXref": ["PMID:1"]}]
    with_axioms = derive.reified(props, found).where("axioms is not null").collect()
    assert [(name(r["id"]), r["value"], r["pos"]) for r in with_axioms] == [("A", "first", 0)]
    assert [(r["name"], r["scope"], r["xrefs"]) for r in shape.synonyms(found).collect()] == [("first", "Exact", ["PMID:1"])]


def test_exports_and_rendering(onto):
    _, nodes, props = onto
    kinds = export.entity_types(nodes)
    assert {r["type"] for r in kinds.where(F.col("id") == "http://t/o#j").collect()} == {"class", "individual"}
    edges = export.graph_edges(props, kinds)
    assert ("t+class+http://t/o#B", "t+class+http://t/o#A") in {(r["src"], r["dst"]) for r in edges.collect()}
    docs = {r["doc_id"]: r["fields"] for r in export.search_documents(props, kinds).collect()}
    assert docs["t+class+http://t/o#A"]["http__//www.w3.org/2000/01/rdf-schema#label"] == ["alpha", "Alpha"]
    german = shape.localised(props.where(F.col("predicate") == V.LABEL), "de")
    assert {(name(r["id"]), r["value"]) for r in german.collect()} == {("A", "Alpha"), ("B", "nur deutsch"), ("X", "ex")}
    text = {name(r["id"]): json.loads(r["json"]) for r in shape.rendered(props).collect()}
    assert text["D"][V.SUBCLASS][V.OWL + "intersectionOf"] == ["http://t/o#A", "http://t/o#B"]
    assert text["X"][V.SUBCLASS][V.OWL + "maxCardinality"] == 2
    assert derive.expression_hashes(props).count() > 5
