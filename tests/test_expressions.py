"""Hashes of blank nodes on cycles: the same under any names, different for different graphs."""

import random

from ontoloom.operators import derive

SCHEMA = "ontology_id string, id string, predicate string, pos int, kind string, value string, datatype string, lang string"
CYCLES = {
    "three": [("a", "p", "b"), ("b", "p", "c"), ("c", "p", "a")],
    "six": [(x, "p", y) for x, y in zip("abcdef", "bcdefa")],
    "odd": [("a", "p", "b"), ("b", "q", "c"), ("c", "p", "a")],
    "chord": [("a", "p", "b"), ("b", "p", "c"), ("c", "p", "a"), ("a", "p", "c")],
    "self": [("a", "p", "a")],
    "two": [("a", "p", "b"), ("b", "p", "a"), ("b", "p", "c"), ("c", "q", "d"), ("d", "q", "c")],
    "eight": [("a", "p", "b"), ("b", "p", "a"), ("a", "p", "c"), ("c", "p", "a")],
}


def rows(name, edges, rnd, leaf="x"):
    nodes = sorted({n for a, _, b in edges for n in (a, b)})
    ids = dict(zip(nodes, rnd.sample(range(1000), len(nodes))))
    of = lambda n: f"_:{name}{ids[n]}"
    out = [(name, of(a), p, k, "bnode", of(b), None, None) for k, (a, p, b) in enumerate(sorted(edges, key=lambda _: rnd.random()))]
    out += [(name, of("a"), "says", 0, "literal", leaf, "", ""), (name, f"_:{name}top", "of", 0, "bnode", of("a"), None, None), (name, f"_:{name}flat", "says", 0, "literal", leaf, "", "")]
    return [(*r[:3], 0, *r[4:]) for r in out], of


def test_relabelled_cycles_agree_and_others_differ(spark):
    rnd = random.Random(3)
    table, names = [], {}
    for kind, edges in CYCLES.items():
        for copy in range(2):
            own, of = rows(f"{kind}{copy}", edges, rnd)
            table += own
            names[kind, copy] = of
    own, of = rows("three9", CYCLES["three"], rnd, leaf="other")
    table += own + [("three9", "_:lost", "p", 0, "bnode", "_:nowhere", None, None)]
    rnd.shuffle(table)
    got = {r["id"]: r["canonical"] for r in derive.expression_hashes(spark.createDataFrame(table, SCHEMA)).collect()}
    assert len(got) == len({r[1] for r in table}) - 1 and "_:lost" not in got
    for kind, edges in CYCLES.items():
        for n in {x for a, _, b in edges for x in (a, b)}:
            assert got[names[kind, 0](n)] == got[names[kind, 1](n)], (kind, n)
        assert got[f"_:{kind}0top"] == got[f"_:{kind}1top"]
    tops = [got[f"_:{kind}0top"] for kind in CYCLES] + [got["_:three9top"], got["_:three0flat"]]
    assert len(set(tops)) == len(tops)
    # the places of a cycle that a leaf marks are told apart
    assert len({got[names["six", 0](n)] for n in "abcdef"}) == 6
    assert got[names["eight", 0]("b")] == got[names["eight", 0]("c")]
