"""Every ontology query against its SQL, and the closure on random graphs with cycles."""

import random

import duckdb
import pytest

from ontoloom.operators.closure import closure, list_positions
from ontoloom.operators.search import checked_lang, dynamic_filters, field_specs
from ontoloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{small}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, small, duck, name):
    df = catalogue.queries()[name](spark, small)
    found = duck.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == sorted(str(list(r)) for r in found.fetchall())


def test_closure_on_random_graphs(spark):
    rnd = random.Random(0)
    edges = {(rnd.randrange(25), rnd.randrange(25)) for _ in range(30)}
    want = set(edges)
    while more := {(a, d) for a, b in want for c, d in edges if b == c} - want:
        want |= more
    got = closure(spark.createDataFrame([*edges, (None, 1)], "src long, dst long"))
    assert {(r["src"], r["dst"]) for r in got.collect()} == want


def test_list_positions(spark):
    cells = [(f"a{i}", f"a{i + 1}" if i < 36 else None) for i in range(37)] + [("b0", None), ("r1", "r2"), ("r2", "r3"), ("r3", "r1")]
    got = {r["id"]: (r["head"], r["pos"]) for r in list_positions(spark.createDataFrame(cells, "id string, rest string")).collect()}
    assert got == {f"a{i}": ("a0", i) for i in range(37)} | {"b0": ("b0", 0)}


def test_small_languages():
    assert field_specs('label^100 type:"class"') == [("label", None, 100.0), ("type", "class", 1.0)]
    with pytest.raises(ValueError):
        field_specs("a^1^2")
    with pytest.raises(ValueError):
        checked_lang("de;x")
    assert dynamic_filters({"type": ["a,b", "c"], "size": ["3"]}) == {"isObsolete": [["false"]], "type": [["a", "b"], ["c"]]}


def test_closure_depths_on_sparse_graphs(spark):
    """Most nodes have one edge, some two, some lie on cycles or lead into them; depths are shortest distances, by key."""
    rnd = random.Random(5)
    edges = {(k, a, rnd.randrange(30)) for k in ("x", "y") for a in range(30) for _ in range(rnd.choice([0, 1, 1, 1, 2]))}
    want = {}
    for k, a, b in edges:
        want[k, a, b] = 1
    for depth in range(2, 62):
        for (k, a, m), d in list(want.items()):
            if d == depth - 1:
                for k2, m2, b in edges:
                    if (k, m) == (k2, m2):
                        want.setdefault((k, a, b), depth)
    got = closure(spark.createDataFrame(sorted(edges), "k string, src long, dst long"), keys=("k",)).collect()
    assert sorted(tuple(r) for r in got) == sorted((*p, d) for p, d in want.items()) and any(p[1] == p[2] for p in want)
    with pytest.raises(RuntimeError):
        closure(spark.createDataFrame([(i, i + 1) for i in range(6)], "src long, dst long"), max_rounds=3)
