import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from ontoloom.llm import negatives, queries
from pyspark.sql import functions as F


def plain(rows, anchors=lambda i: i % 100 == 0):
    """Every anchor against every row. rows: (vec_id, label, vector)."""
    use = []
    for i, c, v in rows:
        if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            use.append((i, c, tuple(math.floor(256 * x) for x in v)))
    out = []
    for i, c, v in dict.fromkeys(r for r in use if anchors(r[0])):
        scored = sorted((-max(-(2**63) + 1, min(2**63 - 1, sum(x * y for x, y in zip(v, w, strict=False)))), j, d) for j, d, w in use if j != i)
        for k, (p, j, _) in enumerate([s for s in scored if s[2] == c][:5]):
            fit = [s for s in scored if s[2] != c and 80 * -p <= 100 * -s[0] <= 100 * -p][:5]
            out += [(i, j, r + 1, m, -p, -s, k + 1) for r, (s, m, _) in enumerate(fit)]
    return Counter(out)


SCHEMA = "vec_id long, label int, embedding array<double>"


def found(spark, rows, schema=SCHEMA):
    frame = spark.createDataFrame(rows, schema).repartition(3)
    return Counter(tuple(r) for r in negatives.hard_negatives(frame, F.col("vec_id") % 100 == 0).collect())


def test_query_against_plain_version_and_sql(spark, small):
    rows = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], r["embedding"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    got = queries.op13_hard_negatives(spark, small)
    assert dict(got.dtypes) | {"rank": "int", "anchor_id": "bigint", "negative_score": "bigint"} == dict(got.dtypes)
    assert Counter(tuple(r) for r in got.collect()) == plain(rows)
    duckdb.sql(f"create or replace view embeddings as from '{small}/embeddings.parquet'")
    assert Counter(duckdb.sql(queries.oracle_sql()["op13_hard_negatives"]).fetchall()) == plain(rows)


def clustered(rnd, n, dim, spread, scale=1.0):
    centres = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    return [(i, rnd.randrange(4), [scale * (x + rnd.gauss(0, spread)) for x in rnd.choice(centres)]) for i in range(0, n * 10, 10)]


@pytest.mark.parametrize("spread,scale", [(0.01, 1.0), (0.6, 30.0), (0.3, 1e5), (0.2, 3e7)])
def test_clusters_norms_and_wide_components(spark, monkeypatch, spread, scale):
    """Single, double and unbounded arithmetic; many chunks, blocks and groups."""
    for name, value in (("BLOCK_ROWS", 16), ("CHUNK_ROWS", 20), ("TILE", 8), ("HELD_BYTES", 4000)):
        monkeypatch.setattr(negatives, name, value)
    rows = clustered(random.Random(int(scale)), 400, 7, spread, scale)
    want = plain(rows)
    assert want and found(spark, rows) == want


def test_ties_repeats_and_odd_rows(spark):
    rnd = random.Random(4)
    same = [0.5, 0.25, -0.125]
    rows = [(i, i % 3, same) for i in range(0, 900, 3)] + [(100, 1, same)] * 3 + [(100, 2, same), (100, 1, [1.0, 1.0, 1.0])]
    rows += [(None, 1, same), (200, None, same), (300, 1, None), (400, 1, [0.5, None, 1.0]), (500, 1, [0.5, float("nan"), 1.0]), (600, 1, [float("inf"), 0.0, 0.0])]
    rows += [(700, 1, []), (701, 2, []), (800, 1, [0.0, 0.0, 0.0]), (801, 1, [0.0] * 3), (802, 2, [0.0] * 3), (900, 8, same), (1000, 1, [1.0, 2.0, 3.0, 4.0, 5.0]), (1001, 1, [9.0])]
    rows += [(1100, 7, [-1.0, 0.0, 0.0]), (1101, 7, [1.0, 0.0, 0.0]), (1102, 6, [0.9, 0.0, 0.0])]  # its only positive is negative
    rnd.shuffle(rows)
    assert found(spark, rows) == plain(rows)
    beyond = [(0, 1, [1e300, 1.0]), (1, 1, [1e300, 2.0]), (2, 2, [1e300, 0.5]), (3, 2, [1e308, 0.0]), (4, 2, [0.5, 0.5])]
    cut = [(i, c, [min(x, 2.0**55) for x in v]) for i, c, v in beyond]  # components stop at the ends of long, and so do scores
    assert found(spark, beyond) == plain(cut)
    assert not found(spark, [])
    assert not found(spark, [(1, 1, same)])
    clash = [(i, 1 if i % 2 else 2, same, i, "c", {"k": 1}) for i in range(0, 60, 5)]
    got = found(spark, clash, SCHEMA + ", chunk int, cell string, anchor map<string, int>")
    assert got == plain([r[:3] for r in clash])


def test_bounds_hold_and_prune(monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 16))
    rows = np.floor(256 * (centres[rng.integers(0, 8, 600)] + rng.normal(scale=0.05, size=(600, 16))) * rng.uniform(0.5, 2, 600)[:, None])
    directions = negatives.fit_directions(rows)
    norms, angles = negatives._angles(rows, directions)
    pack = negatives._Pack(negatives._packed(np.arange(600), np.zeros(600), rows, norms, angles))
    scores = rows @ rows.T
    seen = 0
    for a in range(0, 600, 60):
        own = slice(a, a + 3)
        for low, high in ((scores[a].max() * 0.8, scores[a].max()), (-50, 50), (float(np.median(scores[a])), float(scores[a].max()))):
            able = negatives.reachable(pack, own, pack, low, high)
            inside = np.flatnonzero(((scores[own] >= low) & (scores[own] <= high)).any(axis=0))
            assert set(inside) <= set(able)
        seen += len(negatives.reachable(pack, slice(a, a + 1), pack, scores[a].max() * 0.8, scores[a].max()))
    assert seen < 10 * 600 / 2  # most rows of other clusters are never scored


def test_best_keeps_order():
    rnd, best = random.Random(2), negatives.Best(5, 3)
    seen = []
    for _ in range(40):
        new = [(rnd.randrange(5), rnd.randrange(-5, 6), rnd.randrange(100)) for _ in range(rnd.randrange(12))]
        seen += new
        best.add(*(np.array([r[k] for r in new], dtype=np.int64) for k in range(3)))
    for s in range(5):
        want = sorted((-v, i) for slot, v, i in seen if slot == s)[:3]
        assert [(-v, i) for v, i in zip(best.score[s].tolist(), best.id[s].tolist(), strict=True)] == want
