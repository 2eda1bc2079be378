import re
from collections import Counter, defaultdict
from hashlib import md5

import duckdb
import pytest

from ontoloom.llm import mixing, queries
from ontoloom.plans import spread
from tests.llm.edge import empty, frame, rows


def count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes, share=1.5, cap=2.0, weights=(5, 2, 1)):
    """Give everyone by weight what is left, cut at the cap, again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, full = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set()
    while left > 1e-6 and len(full) < len(names):
        each = left / sum(weight[s] for s in names if s not in full)
        left = 0.0
        for s in [s for s in names if s not in full]:
            target[s] += each * weight[s]
            if target[s] >= cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                full.add(s)
    return target


def plain_mix(docs, seed=7):
    """(doc_id, source, size) -> rows (doc_id, source, size, copies), one document after another."""
    by = defaultdict(list)
    for doc_id, source, size in docs:
        by[source].append((size, doc_id is None, doc_id or 0, doc_id))
    sizes = {s: sum(d[0] for d in own) for s, own in by.items()}
    target, out = plain_targets(sizes), []
    for s, own in by.items():
        at = int(md5((f"{seed}" + ("" if s is None else f":{s}")).encode()).hexdigest()[:8], 16) / 2**32
        expected = target[s] / sizes[s] if sizes[s] else 0.0
        for size, _, _, doc_id in sorted(own):
            to = at + expected
            out.append((doc_id, s, size, int(to + 1e-9) - int(at + 1e-9)))
            at = to
    return out, target, sizes


def test_water_level_against_plain_rounds(spark):
    for sizes in ([10, 10, 10], [1, 1000, 3, 500, 0, 7], [0, 0], [5], [1000, 1, 1, 1, 1, 1, 1], []):
        frame_ = spark.createDataFrame([(f"{i:03}", (5, 2, 1)[i % 3], s) for i, s in enumerate(sizes)], "source string, weight int, source_size long")
        level = mixing.water_level(frame_, 1.5, 2.0)
        want = plain_targets({f"{i:03}": s for i, s in enumerate(sizes)})
        for i, s in enumerate(sizes):
            assert min(level * (5, 2, 1)[i % 3], 2.0 * s) == pytest.approx(want[f"{i:03}"], abs=1e-5)


def test_query_against_plain_version_and_sql(spark, small):
    docs = [(r["doc_id"], r["source"], count(r["text"])) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want, target, sizes = plain_mix(docs)
    source = {d[0]: d[1] for d in docs}
    got = queries.op12_mixing(spark, small).collect()
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in got) == Counter((d, n, n * c) for d, _, n, c in want)
    for r in got:
        assert r["source_size"] == sizes[source[r["doc_id"]]] and r["target"] == pytest.approx(target[source[r["doc_id"]]])
        assert r["taken"] <= 2 * r["size"]
    for s, words in target.items():
        own = [r for r in got if source[r["doc_id"]] == s]
        assert abs(sum(r["taken"] for r in own) - words) <= max(r["size"] for r in own)
    duckdb.sql(f"create or replace view documents as from '{small}/documents.parquet'")
    said = duckdb.sql(queries.oracle_sql()["op12_mixing"])
    assert said.columns == queries.op12_mixing(spark, small).columns
    assert sorted(said.fetchall()) == sorted(tuple(r) for r in got)
    assert sorted(got) == sorted(queries.op12_mixing(spark, small).collect())  # reruns agree


def test_odd_rows(spark):
    want, target, sizes = plain_mix([(r[0], r[3], count(r[1])) for r in rows()])
    got = mixing.mix(frame(spark)).collect()
    assert Counter((r["doc_id"], r["source"], r["size"], r["copies"]) for r in got) == Counter(want)
    assert {r["source"]: (r["source_size"], round(r["target"], 6)) for r in got} == {s: (sizes[s], round(t, 6)) for s, t in target.items()}
    assert mixing.mix(empty(spark)).count() == 0
    nothing = spark.createDataFrame([(1, None, None), (2, "", "b"), (None, " ", "b")], "doc_id int, text string, source string")
    assert {(r["doc_id"], r["target"], r["taken"]) for r in mixing.mix(nothing).collect()} == {(1, 0.0, 0), (2, 0.0, 0), (None, 0.0, 0)}
    with pytest.raises(ValueError):
        mixing.mix(nothing, share=3.0)


def test_hot_source_is_dealt(spark, monkeypatch):
    """One source with most rows, past the bound of a broadcast, and equal rows by the hundred."""
    monkeypatch.setattr(spread, "SMALL_ROWS", 2)
    docs = [(i % 50 if i % 2 else None, "w " * (i % 5), "hot") for i in range(900)] + [(i, "x y z " * (i % 7), f"s{i % 6}") for i in range(120)]
    want, _, _ = plain_mix([(d, s, count(t)) for d, t, s in docs])
    got = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5)).collect()
    assert Counter((r["doc_id"], r["source"], r["size"], r["copies"]) for r in got) == Counter(want)


def test_emitted_table(spark):
    docs = spark.createDataFrame([(i, f"a{i} " * (1 + i % 9), "big" if i % 3 else "small", {"k": i}) for i in range(200)], "doc_id long, text string, source string, size map<string, int>")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    out = mixing.emit(docs)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({k: n for k, n in copies.items() if n})
    assert all(r["size"] == {"k": r["doc_id"]} for r in out.collect())
