"""Paths by page against all paths, exponential numbers of paths, and cycles."""

import random

import pytest

from ontoloom.operators import closure, treepage
from ontoloom.service import Service


def plain_paths(edges):
    up, nodes = {}, {x for e in edges for x in e}
    for s, d in edges:
        up.setdefault(s, set()).add(d)

    def of(x):
        return [[x]] if x not in up else [[x, *p] for d in sorted(up[x]) for p in of(d)]

    return {x: [p[::-1] for p in of(x)] for x in nodes}


@pytest.mark.parametrize("seed", [1])
def test_pages_equal_all_paths(spark, seed):
    rnd = random.Random(seed)
    edges = sorted({(f"n{i:02}", f"n{rnd.randrange(max(0, i - 8), i):02}") for i in range(1, 16) for _ in range(rnd.choice([1, 1, 2, 3]))})
    want = plain_paths(edges)
    frame = spark.createDataFrame([*edges, edges[0], (None, "n01"), ("n03", "n03")], "src string, dst string")
    dag = treepage.acyclic(frame)
    nodes = spark.createDataFrame([(x,) for x in [*want, "alone"]], "id string")
    counts = treepage.path_counts(nodes, dag)
    assert {r["id"]: int(r["n"]) for r in counts.collect()} == {k: len(v) for k, v in want.items()} | {"alone": 1}
    for start, size in ((0, 3), (2, 50)):
        got = {(r["focus"], r["k"]): r["path"] for r in treepage.paths(nodes, dag, counts, start, size).collect()}
        assert got == {(x, k): p for x, ps in (want | {"alone": [["alone"]]}).items() for k, p in enumerate(ps) if start <= k < start + size}
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    whole = treepage.tree_rows(treepage.paths(nodes, dag, counts, 0, 10**6))
    every = closure.root_paths(nodes, dag)
    assert rows(whole) == rows(treepage.tree_rows(every.select("path")))


def test_diamonds_and_cycles(spark):
    """Diamonds in a row double the paths; a page of them takes a page."""
    edges = [(f"a{i + 1}", f"{s}{i}") for i in range(40) for s in "bc"] + [(f"{s}{i}", f"a{i}") for i in range(40) for s in "bc"]
    docs = spark.createDataFrame([(f"{s}{i}", f"{s}{i}", "o", ["class"], ["x"]) for i in range(41) for s in "abc"], "id string, iri string, ontologyId string, type array<string>, label array<string>")
    service = Service(docs, spark.createDataFrame([(s, "hierarchicalParent", d, None) for s, d in [*edges[:8], *edges[80:88]]], "src string, edge_type string, dst string, props map<string, array<string>>"))
    total, rows = service.js_tree_page("class", "o", "a4", start=10, size=10)
    assert total == 2**4 and [r["id"] for r in rows.where("depth = 9").collect()] == ["a4"] * 6
    dag = treepage.acyclic(spark.createDataFrame(edges[: 2 * 5] + edges[80 : 80 + 2 * 5], "src string, dst string"))
    nodes = dag.selectExpr("explode(array(src, dst)) as id").distinct()
    counts = treepage.path_counts(nodes, dag)
    assert int(counts.where("id = 'a5'").first()["n"]) == 2**5
    found = treepage.paths(spark.createDataFrame([("a5",)], "id string"), dag, counts, 26, 100).collect()
    assert sorted(r["k"] for r in found) == list(range(26, 32)) and all(len(r["path"]) == 11 and r["path"][0] == "a0" for r in found)
    ring = spark.createDataFrame([("m", "root"), ("x", "m"), ("y", "x"), ("m", "y"), ("z", "y"), ("p", "q"), ("q", "p")], "src string, dst string")
    dag = treepage.acyclic(ring)
    counts = treepage.path_counts(ring.selectExpr("explode(array(src, dst)) as id").distinct(), dag)
    assert {r["id"]: int(r["n"]) for r in counts.collect()} == {"root": 1, "m": 1, "x": 1, "y": 1, "z": 1}  # what no root is above is not shown
