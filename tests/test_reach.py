"""Reachability by intervals against plain walks over random graphs with cycles and several parents."""

import random

import pytest

from ontoloom.operators import reach


def plain_below(edges):
    """top -> nodes below it."""
    kids, nodes = {}, set()
    for s, d in edges:
        kids.setdefault(d, set()).add(s)
        nodes |= {s, d}
    out = {}
    for top in nodes:
        seen, todo = set(), [top]
        while todo:
            for k in kids.get(todo.pop(), ()):
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        out[top] = seen
    return out


GRAPHS = {
    "tree": lambda r: [(f"n{i}", f"n{r.randrange(i)}") for i in range(1, 60)],
    "dag": lambda r: [(f"n{i}", f"n{r.randrange(i)}") for i in range(1, 40) for _ in range(r.choice([1, 1, 1, 2, 3]))],
    "cycles": lambda r: [(f"n{r.randrange(40)}", f"n{r.randrange(40)}") for _ in range(45)],
}


@pytest.mark.parametrize("kind", list(GRAPHS))
def test_against_plain_walks(spark, kind):
    rnd = random.Random(kind)
    edges = GRAPHS[kind](rnd)
    want = plain_below(edges) | {"alone": set()}
    index = reach.build(spark.createDataFrame([("alone",), ("n0",), (None,)], "id string"), spark.createDataFrame([*edges, *edges[:3], (None, "n1"), ("n2", None)], "src string, dst string"))
    assert {r["id"]: r["n"] for r in index.descendant_counts().collect()} == {k: len(v) for k, v in want.items()}
    got = [(r["top"], r["id"]) for r in index.below(index.nodes).collect()]
    assert len(got) == len(set(got)) and set(got) == {(t, x) for t, v in want.items() for x in v}
    for top in ("n0", "n7", "alone"):
        one = [r["id"] for r in index.below_one(top).collect()]
        assert len(one) == len(set(one)) and set(one) == want.get(top, set())
    if kind == "tree":
        assert index.extra.isEmpty()  # a tree needs no pairs at all


def test_strong_components(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("f", "f"), ("g", "a"), ("h", "i")]
    got = {r["id"]: r["comp"] for r in reach.strong_components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}
