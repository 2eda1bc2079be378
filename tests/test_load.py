"""A load of two small ontologies written for this test, from configurations to the service's answers."""

import json

import pytest
from pyspark.sql import functions as F

from ontoloom.functions import vocabulary as V
from ontoloom.operators import derive, shape
from ontoloom.plans.load import load, role_predicates
from ontoloom.service import Service
from ontoloom.sources import config

HEAD = '<?xml version="1.0"?><rdf:RDF xmlns="http://t/%%s#" xml:base="http://t/%%s" xmlns:rdf="%s" xmlns:rdfs="%s" xmlns:owl="%s" xmlns:oio="%s" xmlns:obo="%s" xmlns:dc="%s">' % (V.RDF, V.RDFS, V.OWL, V.OIO, V.OBO, V.DC)
SOME = '<owl:Restriction><owl:onProperty rdf:resource="#r"/><owl:someValuesFrom rdf:resource="#C"/></owl:Restriction>'
LISTED = '<owl:Class><owl:unionOf rdf:parseType="Collection"><rdf:Description rdf:about="#A"/><rdf:Description rdf:about="#B"/><rdf:Description rdf:about="#C"/></owl:unionOf></owl:Class>'


def axiom(target):
    return f'<owl:Axiom><owl:annotatedSource rdf:resource="#B"/><owl:annotatedProperty rdf:resource="{V.SUBCLASS}"/><owl:annotatedTarget>{target}</owl:annotatedTarget><rdfs:comment>why</rdfs:comment></owl:Axiom>'


FIRST = HEAD % ("one", "one") + f"""
<owl:Ontology rdf:about="http://t/one"><dc:title>First</dc:title></owl:Ontology>
<owl:Class rdf:about="#A"><rdfs:label>alpha</rdfs:label><rdfs:label xml:lang="de">Alpha</rdfs:label><oio:hasExactSynonym>leading</oio:hasExactSynonym><obo:note>a note</obo:note></owl:Class>
<owl:Class rdf:about="#B"><rdfs:label>beta</rdfs:label><rdfs:subClassOf rdf:resource="#A"/><rdfs:subClassOf>{SOME}</rdfs:subClassOf><rdfs:subClassOf>{LISTED}</rdfs:subClassOf><obo:told>what it is</obo:told></owl:Class>
<owl:Class rdf:about="#C"><owl:deprecated>true</owl:deprecated></owl:Class>
<owl:ObjectProperty rdf:about="#r"/>
<owl:NamedIndividual rdf:about="#i"><rdf:type rdf:resource="#B"/></owl:NamedIndividual>
{axiom(SOME)}{axiom(LISTED)}
</rdf:RDF>"""
SECOND = HEAD % ("two", "two") + """
<owl:Ontology rdf:about="http://t/two"><owl:imports rdf:resource="http://t/one"/></owl:Ontology>
<owl:Class rdf:about="#Z"><rdfs:subClassOf rdf:resource="http://t/one#B"/></owl:Class>
</rdf:RDF>"""
CONFIG = [
    {"id": "One", "ontology_purl": None, "preferredPrefix": "ONE", "base_uri": ["http://t/one#"], "hierarchical_property": "http://t/one#r", "definition_property": [V.OBO + "told"], "preferred_root_term": ["http://t/one#A"]},
    {"id": "two", "ontology_purl": None, "base_uri": ["http://t/two#"]},
    {"id": "none"},
]


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("load")
    items = [dict(c) for c in CONFIG]
    for item, text in zip(items, (FIRST, SECOND)):
        path = top / f"{item['id'].lower()}.owl"
        path.write_text(text)
        item["ontology_purl"] = str(path)
    (top / "config.json").write_text(json.dumps({"ontologies": items}))
    configs = config.with_sources(config.merged_configs(spark, [str(top / "config.json")]))
    return load(spark, configs, {"http://t/one": str(top / "one.owl"), "http://t/two": str(top / "two.owl")})


def docs(loaded):
    return {r["id"]: r for r in loaded.documents.collect()}


def test_documents(loaded):
    by_id = docs(loaded)
    own = {k for k in by_id if k.startswith("one+")}
    assert own == {"one+ontology+http://t/one"} | {f"one+{k}+http://t/one#{n}" for k, n in (("class", "A"), ("class", "B"), ("class", "C"), ("property", "r"), ("individual", "i"))}
    assert {k for k in by_id if k.startswith("two+ontology")} == {"two+ontology+http://t/two"} and not any(k.startswith("none") for k in by_id)
    a, b, c, z = (by_id[f"{k}+class+http://t/{n}"] for k, n in (("one", "one#A"), ("one", "one#B"), ("one", "one#C"), ("two", "two#Z")))
    assert (a["label"], a["synonym"], a["curie"], a["shortForm"]) == (["alpha", "Alpha"], ["leading"], "ONE_A", "ONE_A")
    assert (a["ontologyId"], a["ontologyIri"], a["ontologyPreferredPrefix"], a["type"]) == ("one", "http://t/one", "ONE", ["class"])
    assert a["searchableAnnotationValues"] == ["a note", "leading"] and a["isPreferredRoot"] and a["hasDirectChildren"] and not a["hasDirectParents"]
    assert b["definition"] == ["what it is"] and b["definitionProperty"] == [V.OBO + "told"] and b["hasIndividuals"] and b["isDefiningOntology"]
    assert c["isObsolete"] and c["label"] == ["ONE_C"] and c["hasHierarchicalChildren"] and not c["hasDirectChildren"]
    assert by_id["one+property+http://t/one#r"]["type"] == ["property", "objectProperty"]
    assert by_id["one+ontology+http://t/one"]["label"] == ["First"]
    copy = by_id["two+class+http://t/one#B"]
    assert (copy["imported"], copy["isDefiningOntology"], copy["definedBy"], copy["appearsIn"]) == (True, False, ["one"], ["one", "two"])
    assert copy["curie"] == "ONE_B" and z["definedBy"] == ["two"] and z["appearsIn"] == ["two"] and not z["imported"]
    assert {tuple(r) for r in loaded.imports.collect()} == {("two", "one")}
    counts = {r["ontology_id"]: r["classes"] for r in loaded.ontologies.collect()}
    assert counts == {"one": 3, "two": 4}


def test_service_over_a_load(loaded):
    service = Service(loaded.documents, loaded.edges)
    assert service.healthy()
    iris = lambda df: sorted(r["iri"].split("#")[-1] for r in df.collect())
    assert iris(service.related("class", "two", "http://t/two#Z", "ancestors")) == ["A", "B"]
    assert iris(service.related("class", "one", "http://t/one#B", "hierarchicalParents")) == ["A", "C"]
    assert iris(service.related("class", "one", "http://t/one#B", "individuals")) == ["i"]
    assert iris(service.by_property("one", "http://t/one#B", "http://t/one#r")) == ["C"]
    assert iris(service.roots("class", "one", preferred=True)) == ["A"]
    assert iris(service.entities("class", "one", text="beta").hits) == ["B"]


def test_fields_of_legacy_answers(loaded):
    service = Service(loaded.documents, loaded.edges)
    answer = service.search("alpha", facets=True)
    (got,) = service.listed(answer.hits.where("ontologyId = 'one'")).collect()
    assert got.asDict() == {"id": "one+class+http://t/one#A", "iri": "http://t/one#A", "ontology_name": "one", "label": "Alpha", "description": None, "short_form": "ONE_A", "obo_id": "ONE_A", "type": "class", "ontology_prefix": "ONE"}
    (got,) = service.listed(answer.hits.where("ontologyId = 'one'"), ("note_annotation", "score", "is_defining_ontology", "synonym", "nothing", "ontology_iri", "odd_annotation")).collect()
    assert list(got.asDict()) == ["note_annotation", "score", "is_defining_ontology", "synonym", "ontology_iri", "odd_annotation"]
    assert (got["note_annotation"], got["is_defining_ontology"], got["synonym"], got["ontology_iri"], got["odd_annotation"]) == (["a note"], True, ["leading"], "http://t/one", None)
    flat = {r["field"]: r["counts"] for r in service.flat_facets(answer.facets).collect()}
    assert flat["ontologyId"] == ["one", "1", "two", "1"] and flat["type"] == ["class", "2"]


def test_axioms_on_blank_nodes_fold_onto_equal_values(loaded):
    own = loaded.values.where((F.col("ontology_id") == "one") & (F.col("id") == "http://t/one#B") & (F.col("predicate") == V.SUBCLASS)).collect()
    assert len(own) == 3 and sorted(r["axioms"] is not None for r in own) == [False, True, True]
    props = derive.prop_table(loaded.triples).where("ontology_id = 'one'")
    assert derive.reified(props, derive.axioms(props)).where(F.col("id") == "http://t/one#B").where(F.col("predicate") == V.SUBCLASS).count() == 5
    shown = {r["id"]: json.loads(r["json"]) for r in shape.rendered(loaded.values.where("ontology_id = 'one'")).where("id like 'http%'").collect()}
    up = shown["http://t/one#B"][V.SUBCLASS]
    assert up[0] == "http://t/one#A" and [x["axioms"][0][V.RDFS + "comment"] for x in up[1:]] == [["why"]] * 2
    assert up[2]["value"][V.OWL + "unionOf"] == [f"http://t/one#{n}" for n in "ABC"]


def test_plain_answers(spark):
    rows = [
        ("o", "a", V.LABEL, 0, "literal", "zwei", "", "de"), ("o", "a", V.LABEL, 1, "literal", "two", "", "en"), ("o", "a", "type", 0, "literal", "class", "", ""), ("o", "a", "curie", 0, "literal", None, "", ""),
        ("o", "a", "http://x/n", 0, "literal", "5", V.XSD + "integer", ""), ("o", "a", "zeta", 0, "uri", "b", None, None),
    ]
    props = spark.createDataFrame(rows, "ontology_id string, id string, predicate string, pos int, kind string, value string, datatype string, lang string")
    (got,) = shape.rendered(shape.localised(props, "de"), plain=True).collect()
    assert list(json.loads(got["json"]).items()) == [("type", "class"), ("zeta", "b"), (V.LABEL, "zwei"), ("http://x/n", 5)]
    assert json.loads(shape.rendered(props).first()["json"])[V.LABEL][1] == {"type": ["literal"], "value": "two", "lang": "en"}


def test_roles_of_configurations(spark):
    rows = [("a", {"hierarchical_property": '"p"', "synonym_property": '["s"]'}), ("b", {})]
    roles = role_predicates(spark.createDataFrame(rows, "ontology_id string, config map<string,string>")).collect()
    of = lambda o, role: [r["predicate"] for r in roles if (r["ontology_id"], r["role"]) == (o, role)]
    assert of("a", "hierarchical_property") == ["p"] and of("b", "hierarchical_property") == [V.PART_OF]
    assert of("a", "synonym_property") == ["s", *V.SYNONYMS] and of("b", "label_property") == list(V.LABELS)


def test_written_load(loaded, spark, tmp_path):
    loaded.write(str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out" / "documents"))
    assert back.count() == loaded.documents.count() and {"ontology", "kind"} <= set(back.columns)
    assert spark.read.json(str(tmp_path / "out" / "edges")).count() == loaded.edges.count()


def test_mapping_sets(spark, loaded):
    from ontoloom.plans.load import mapping_sets

    registry = spark.createDataFrame([("ex", "ex", r"\d+", "http://ex/$1", "http://ex/")], "database string, prefix string, pattern string, uri_format string, uri_prefix string")
    rows, prefixes = mapping_sets(loaded, registry)
    assert rows.count() == 0 and prefixes.count() == 0
    extra = [("one", "http://t/one#i", V.SKOS + "exactMatch", "literal", "ex:5"), ("two", "http://t/one#i", V.SKOS + "exactMatch", "literal", "ex:5"), ("two", "http://t/two#Z", V.OIO + "hasDbXref", "uri", "http://nowhere/1")]
    values = spark.createDataFrame(extra, "ontology_id string, id string, predicate string, kind string, value string")
    more = type(loaded)(**{**loaded.__dict__, "values": values, "documents": loaded.documents.withColumn("curie", F.regexp_replace("curie", "_", ":"))})
    rows, prefixes = mapping_sets(more, registry)
    # only the ontology that defines an entity maps it
    assert [(r["ontology_id"], r["subject_id"], r["object_id"]) for r in rows.collect()] == [("one", "ONE:i", "ex:5")]
    assert {r["prefix"]: r["namespace"] for r in prefixes.collect()}["ONE"] == "http://t/one#"


def test_term_records(loaded):
    from ontoloom.plans.records import terms

    by_id = {(r["ontology_name"], r["iri"].split("#")[-1]): r for r in terms(loaded, "de").collect()}
    assert set(by_id) == {("one", n) for n in "ABC"} | {("two", n) for n in "ABCZ"}
    a, b, c = (by_id["one", n] for n in "ABC")
    assert (a["label"], a["synonyms"], a["obo_id"], a["short_form"], a["ontology_prefix"], a["ontology_iri"], a["lang"]) == ("Alpha", ["leading"], "ONE:A", "ONE_A", "ONE", "http://t/one", "de")
    assert a["is_root"] and a["has_children"] and not a["is_preferred_root"] and a["annotation"] == {"note": ["a note"]} and a["related"] is None
    assert (b["label"], b["description"], b["is_root"], c["is_obsolete"], c["label"]) == ("beta", ["what it is"], False, True, "ONE_C")
    assert [tuple(x) for x in b["related"]] == [("http://t/one#r", "ONE_r", "one", "http://t/one#B", "http://t/one#C")]
    assert {r["label"] for r in terms(loaded, "en").collect() if r["iri"].endswith("#A")} == {"alpha"}


THIRD = HEAD % ("three", "three") + """
<owl:Ontology rdf:about="http://t/three"/>
<owl:Class rdf:about="#A"><rdfs:label>alpha, see EX:77</rdfs:label></owl:Class>
<owl:Class rdf:about="#B"><rdfs:subClassOf rdf:resource="#A"/><owl:equivalentClass rdf:resource="#E"/></owl:Class>
<owl:Class rdf:about="#C"><rdfs:subClassOf rdf:resource="#B"/><rdfs:subClassOf rdf:resource="#D"/><obo:see>http://ex/5</obo:see><obo:near rdf:resource="#A"/></owl:Class>
<owl:Class rdf:about="#D"><rdfs:subClassOf rdf:resource="#C"/><owl:disjointWith rdf:resource="#A"/></owl:Class>
<owl:Class rdf:about="#E"><rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="#p"/><owl:someValuesFrom rdf:resource="#C"/></owl:Restriction></rdfs:subClassOf></owl:Class>
<owl:ObjectProperty rdf:about="#p"><owl:inverseOf rdf:resource="#q"/></owl:ObjectProperty>
<owl:ObjectProperty rdf:about="#q"><rdfs:subPropertyOf rdf:resource="#p"/></owl:ObjectProperty>
<owl:NamedIndividual rdf:about="#i"><rdf:type rdf:resource="#C"/></owl:NamedIndividual>
<owl:NamedIndividual rdf:about="#j"/><owl:NamedIndividual rdf:about="#k"/>
<owl:AllDisjointClasses><owl:members rdf:parseType="Collection"><rdf:Description rdf:about="#A"/><rdf:Description rdf:about="#B"/><rdf:Description rdf:about="#E"/></owl:members></owl:AllDisjointClasses>
<owl:AllDifferent><owl:distinctMembers rdf:parseType="Collection"><rdf:Description rdf:about="#i"/><rdf:Description rdf:about="#j"/></owl:distinctMembers></owl:AllDifferent>
<owl:NegativePropertyAssertion><owl:sourceIndividual rdf:resource="#i"/><owl:assertionProperty rdf:resource="#p"/><owl:targetIndividual rdf:resource="#j"/></owl:NegativePropertyAssertion>
</rdf:RDF>"""


@pytest.fixture(scope="module")
def derived(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("derived")
    (top / "three.owl").write_text(THIRD)
    (top / "c.json").write_text(json.dumps({"ontologies": [{"id": "three", "ontology_purl": str(top / "three.owl"), "preferredPrefix": "THREE", "base_uri": ["http://t/three#"], "hierarchical_property": "http://t/three#p"}]}))
    registry = spark.createDataFrame([("ex", "ex", r"\d+", "http://ex/$1", "http://ex/")], "database string, prefix string, pattern string, uri_format string, uri_prefix string")
    return load(spark, config.with_sources(config.merged_configs(spark, [str(top / "c.json")])), registry=registry)


def test_derived_fields_of_documents(derived):
    by = {r["iri"].split("#")[-1]: r for r in derived.documents.where("type[0] <> 'ontology'").collect()}
    names = lambda n, f: [x.split("#")[-1] for x in by[n][f] or []]
    # ancestors: C and D are on a cycle, so each is above itself; individuals by their types; only classes have hierarchical ones
    assert names("C", "directAncestor") == ["A", "B", "C", "D"] and names("i", "directAncestor") == ["A", "B", "C", "D"] and names("A", "directAncestor") == []
    assert names("E", "hierarchicalAncestor") == ["A", "B", "C", "D"] and names("E", "directAncestor") == [] and names("i", "hierarchicalAncestor") == [] and names("q", "directAncestor") == ["p"]
    # every named node below counts, individuals too where they have parents of that kind
    assert {n: (by[n]["numDescendants"], by[n]["numHierarchicalDescendants"]) for n in "ABCDEpi"} == {"A": (4, 4), "B": (3, 3), "C": (3, 3), "D": (3, 3), "E": (0, 0), "p": (1, 0), "i": (0, 0)}
    assert names("p", "inverseOf") == ["q"] and names("q", "inverseOf") == ["p"]
    assert names("B", "equivalentClass") == ["E"] and names("E", "equivalentClass") == ["B"] and names("C", "equivalentClass") == []
    assert names("A", "disjointWith") == ["B", "E"] and names("D", "disjointWith") == ["A"] and names("E", "disjointWith") == ["A", "B"]
    assert names("i", "differentFrom") == ["j"] and names("j", "differentFrom") == ["i"] and names("k", "differentFrom") == []
    assert by["i"]["negativePropertyAssertions"] == {"http://t/three#p": ["http://t/three#j"]} and not by["j"]["negativePropertyAssertions"]


def test_linked_entities_of_documents(derived):
    rows = derived.with_links()
    assert rows.count() == derived.documents.count() and rows.columns == [*derived.documents.columns, "linkedEntities"]
    by = {r["iri"].split("#")[-1]: {x["s"]: x for x in r["linkedEntities"]} for r in rows.collect()}
    c = by["C"]
    assert "http://t/three#C" not in c and {"http://t/three#A", "http://t/three#B", "http://t/three#D", "http://ex/5"} <= set(c)
    assert (c["http://t/three#A"]["label"], c["http://t/three#A"]["defined_by"], c["http://t/three#A"]["types"], c["http://t/three#A"]["has_local_definition"]) == ("alpha, see EX:77", ["three"], ["class"], True)
    assert (c["http://ex/5"]["url"], c["http://ex/5"]["curie"]) == ("http://ex/5", "ex:5")
    assert by["A"]["EX:77"]["url"] == "http://ex/77" and by["k"] == {}


def test_times_of_a_load(derived):
    (row,) = derived.ontologies.collect()
    assert row["loaded"] >= row["sourceFileTimestamp"] and row["classes"] == 5
    configs = derived.ontologies.select("ontology_id", "config")
    counts = derived.ontologies.select("ontology_id", "classes", "properties", "individuals", "entities", "languages")
    nodes = derived.ontologies.select("ontology_id", "iri", "stated")
    (got,) = shape.ontologies(configs, nodes, derive.prop_table(derived.triples), counts, derived.ontologies).collect()
    assert (got["loaded"], got["updated"], got["number_of_terms"], got["preferred_prefix"]) == (row["loaded"], row["sourceFileTimestamp"], 5, "THREE")
    (got,) = shape.ontologies(configs, nodes, derive.prop_table(derived.triples), counts).collect()
    assert got["loaded"] is None and got["updated"] is None
