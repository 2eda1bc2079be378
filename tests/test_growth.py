"""What must not grow faster than the input: how rows travel, read from plans."""

import re
from functools import reduce

from pyspark.sql import DataFrame

from ontoloom.functions import vocabulary as V
from ontoloom.operators import closure, derive, export, link, linkdelta, reach
from ontoloom.plans import catalogue, spread


def dealt_by(df):
    """The keys of a plan's shuffles, without the numbers of columns."""
    found = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", df._jdf.queryExecution().executedPlan().toString())
    return [re.sub(r"#\d+L?", "", keys) for keys in found]


def test_pairs_of_imports_do_not_travel(spark):
    """an IRI that m ontologies use and n define is m rows on the way, not m times n; nulls link nothing, repeats count once."""
    entities = spark.createDataFrame([("i", f"u{k}") for k in range(5)] + [("i", f"d{k}") for k in range(3)] + [("i", "u0"), ("j", "u0"), (None, "u1"), ("i", None)], "iri string, ontology_id string")
    definers = spark.createDataFrame([("i", f"d{k}") for k in range(3)] + [("j", "d0"), (None, "d0")], "iri string, ontology_id string")
    counts = linkdelta.import_counts(entities, definers)
    assert all("imports_from" not in keys for keys in dealt_by(counts))
    want = {(f"u{u}", f"d{d}"): 1 for u in range(5) for d in range(3)} | {("u0", "d0"): 2}
    assert {(r["ontology_id"], r["imports_from"]): r["n"] for r in counts.collect()} == want


def test_lists_meet_in_two_shuffles_and_pairs_are_counted_once(spark, small, monkeypatch):
    """rows are not dealt by ontology to learn its bases or whether it changed, held lists meet the changes where they are, and no pair is counted before the merge."""
    seen, plain = {}, linkdelta.staged
    monkeypatch.setattr(linkdelta, "staged", lambda df, tag="stage": seen.update({tag: df}) or plain(df, tag))
    limit = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(limit, "-1")
    try:
        found = catalogue.queries()["incremental_imports"](spark, small)
        assert sorted(seen) == ["doubt", "lists"] and dealt_by(seen["lists"]).count("iri") == 2
        assert re.findall(r"MergeJoin \[(\w+)#", seen["lists"]._jdf.queryExecution().executedPlan().toString()) == ["iri"]
        assert dealt_by(found) == [] and found._jdf.queryExecution().executedPlan().toString().count("Exchange rangepartitioning(ontology_id") == 1
    finally:
        spark.conf.unset(limit)


def test_a_table_is_broadcast_by_its_bytes(spark, monkeypatch):
    """what is small beside the rows that meet it is sent to them, and what is not stays a shuffle."""
    names = spark.createDataFrame([("a", None), ("ä" * 50, "b")], "k string, v string")
    hinted = lambda: "broadcast" in spread.small(names)._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr(spread, "SMALL_BYTES", 2 * spread.ROW_BYTES + 102)
    assert hinted() and "broadcast" in spread.small(names.groupBy("k").count(), names)._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr(spread, "SMALL_BYTES", 2 * spread.ROW_BYTES + 101)
    assert not hinted()
    spread.small(names.where("false"))


def test_entities_are_dealt_once_for_all_links(spark):
    """definers, definitions and curies of an IRI come from one shuffle of entities and statements."""
    entities = spark.createDataFrame([("a", "xy1", "class", "a_1"), ("b", "xy1", "class", "b:1"), ("b", "xy1", "class", "b:1"), ("c", "xy1", "class", None), ("c", "xy1", "property", "c:1"), ("a", "z", "class", None)], "ontology_id string, iri string, type string, curie string")
    bases = spark.createDataFrame([("a", "xy"), ("a", "x"), ("a", ""), ("b", None), ("z", "xy")], "ontology_id string, base string")
    stated = spark.createDataFrame([("xy1", "c"), ("xy1", "e"), ("q", "a"), (None, "a")], "iri string, ontology_id string")
    whole = link.by_iri(entities, bases, stated)
    assert len([k for k in dealt_by(whole) if "iri" in k]) == 1
    got = {r["iri"]: tuple(r)[1:] for r in whole.collect()}
    assert got == {"xy1": (4, ["a", "b", "c"], ["a", "c"], "c:1"), "z": (1, ["a"], [], None)}
    assert link.defined_by(entities, bases, stated).count() == 2


def test_roots_of_a_union_of_tables_meet_the_edges_once(spark):
    """node tables of several kinds are not joined to the edges one by one."""
    nodes = reduce(DataFrame.union, [spark.createDataFrame([(f"{k}{i}", f"l{i}") for i in range(4)], "id string, label string") for k in "abc"])
    edges = spark.createDataFrame([("a0", "b0"), ("a0", "b1"), ("b0", "c0"), (None, "a1"), ("a2", None)], "src string, dst string")
    top, alone = closure.roots(nodes, edges), closure.orphans(nodes, edges)
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (top, alone)]
    assert [len(re.findall(r"\bJoin ", p)) for p in plans] == [1, 2]
    want = {f"{k}{i}" for k in "abc" for i in range(4)} - {"a0", "a2", "b0"}
    assert sorted(r["id"] for r in top.collect()) == sorted(want) and top.columns == ["id", "label"]
    assert sorted(r["id"] for r in alone.collect()) == sorted(want - {"a1", "b1", "c0"})


def test_rows_of_edges_are_joined_once_and_not_sorted(spark):
    """the edge file reads its edges from a table, and wide rows are not sorted to meet their ends."""
    axioms = "array(map('k', array(value)), map('l', array('x')))"
    props = spark.createDataFrame([("o", "a", "p", "b"), ("o", "b", "p", "a"), ("o", "a", "p", "z")], "ontology_id string, id string, predicate string, value string").selectExpr("*", "'uri' as kind", f"{axioms} as axioms")
    kinds = spark.createDataFrame([("o", "a", "class"), ("o", "b", "class"), ("o", "b", "individual")], "ontology_id string, id string, type string")
    edges = export.graph_edges(props, kinds)
    assert "Sort" not in edges._jdf.queryExecution().sparkPlan().toString()
    out = export.edge_rows(edges)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.columns[-2:] == ["k:string[]", "l:string[]"] and out.count() == 8


def test_axioms_come_from_one_pass(spark):
    """an axiom's parts and notes meet in one shuffle, and values and axioms in one join."""
    rows = [("s", "annotatedSource", "a"), ("s", "annotatedProperty", "p"), ("s", "annotatedTarget", "v"), ("half", "annotatedSource", "a"), ("half", "annotatedProperty", "p")]
    rows = [("o", n, V.OWL + p, 0, "literal", v, "", "") for n, p, v in rows]
    rows += [("o", "s", "note", 1, "literal", "2", "", ""), ("o", "s", "note", 0, "literal", "9", "", ""), ("o", "s", "b", 0, "literal", None, "", ""), ("o", "s", V.TYPE, 0, "uri", "x", "", ""), ("o", "half", "note", 0, "literal", "1", "", "")]
    props = spark.createDataFrame(rows, "ontology_id string, id string, predicate string, pos int, kind string, value string, datatype string, lang string")
    found = derive.axioms(props)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [("o", "a", "p", "literal", "v", "s", {"b": [None], "note": ["9", "2"]})]
    values = spark.createDataFrame([("o", "a", "p", 0, "literal", "w", "d", "en"), ("o", "a", "p", 1, "literal", None, "d", "en")], props.schema)
    both = derive.reified(values, found)
    assert len(re.findall(r"\bJoin ", both._jdf.queryExecution().optimizedPlan().toString())) == 1
    assert sorted(((r["value"], r["pos"], r["datatype"], r["axioms"]) for r in both.collect()), key=str) == sorted([("w", 0, "d", None), (None, 1, "d", None), ("v", 1 << 30, None, [{"b": [None], "note": ["9", "2"]}])], key=str)


def test_only_nodes_with_something_below_go_through_rounds(spark, monkeypatch):
    """leaves are numbered once, under their parents; levels are sought for the others alone."""
    seen, plain = [], reach._levels
    monkeypatch.setattr(reach, "_levels", lambda up, ids: seen.append(ids.count()) or plain(up, ids))
    edges = [("a", "top"), ("b", "top"), *[(f"l{i}", "ab"[i % 2]) for i in range(20)]]
    index = reach.build(spark.createDataFrame([("alone",)], "id string"), spark.createDataFrame(edges, "src string, dst string"))
    assert seen == [3]
    got = {r["id"]: r["n"] for r in index.descendant_counts().collect()}
    assert (got["top"], got["a"], got["b"], got["alone"], got["l3"], len(got)) == (22, 10, 10, 0, 0, 24)
