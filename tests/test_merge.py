"""Loads over loads: the outcome is that of loading all ontologies at once."""

import json

from ontoloom.functions import vocabulary as V
from ontoloom.plans.load import load, merged
from ontoloom.sources import config

HEAD = f"@prefix owl: <{V.OWL}> . @prefix rdfs: <{V.RDFS}> . @prefix one: <http://t/one#> . @prefix two: <http://t/two#> .\n"
ONE = HEAD + '<http://t/one> a owl:Ontology . one:A a owl:Class ; rdfs:label "alpha" . one:B a owl:Class ; rdfs:subClassOf one:A ; rdfs:comment "see http://t/two#Z" .'
#: ``two`` before and after: a class that ``one`` defines comes up, another goes, and a statement makes ``two`` a definer.
BEFORE = HEAD + "<http://t/two> a owl:Ontology . two:Y a owl:Class ; rdfs:subClassOf one:A . one:A a owl:Class ."
AFTER = HEAD + '<http://t/two> a owl:Ontology . two:Z a owl:Class ; rdfs:label "zeta" ; rdfs:subClassOf one:B . one:B a owl:Class ; rdfs:isDefinedBy <http://t/two> .'


def loaded(spark, top, **texts):
    top.mkdir()
    items = []
    for name, text in texts.items():
        (top / f"{name}.ttl").write_text(text)
        items.append({"id": name, "ontology_purl": str(top / f"{name}.ttl"), "preferredPrefix": name.upper(), "base_uri": [f"http://t/{name}#"]})
    (top / "config.json").write_text(json.dumps({"ontologies": items}))
    return load(spark, config.with_sources(config.merged_configs(spark, [str(top / "config.json")])))


def rows(df):
    return sorted(json.dumps(r.asDict(recursive=True), sort_keys=True, default=str) for r in df.select(sorted(df.columns)).collect())


def test_a_load_over_a_load(spark, tmp_path):
    before = loaded(spark, tmp_path / "a", one=ONE, two=BEFORE)
    got = merged(before, loaded(spark, tmp_path / "b", two=AFTER))
    want = loaded(spark, tmp_path / "c", one=ONE, two=AFTER)
    assert rows(got.documents) == rows(want.documents)
    for name in ("edges", "kinds", "definers", "imports", "linked", "mentions"):
        assert rows(getattr(got, name)) == rows(getattr(want, name)), name
    b = {(r["ontologyId"], r["iri"]): r for r in got.documents.collect()}["one", "http://t/one#B"]
    assert b["appearsIn"] == ["one", "two"] and b["definedBy"] == ["one", "two"] and b["isDefiningOntology"]
    assert rows(got.imports) == [] and rows(before.imports) != []
