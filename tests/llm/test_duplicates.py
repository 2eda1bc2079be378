import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import xxhash

from ontoloom.llm import exact, queries, simhash
from tests.llm.edge import empty, frame, rows


def plain_fp(text):
    words, grams = [], []
    for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" "):
        if w:
            words.append(w)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if hs and 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(docs):
    fps = {i: plain_fp(t) for i, t in enumerate(t for _, t in docs)}
    ids = [d for d, _ in docs]
    left, comp = set(fps), {}
    while left:
        queue = [left.pop()]
        group = set(queue)
        while queue:
            x = queue.pop()
            near = {y for y in left if (fps[x] ^ fps[y]).bit_count() <= 3}
            left -= near
            group |= near
            queue += near
        least = min((ids[i] for i in group if ids[i] is not None), default=None)
        comp |= dict.fromkeys(group, least)
    return Counter((ids[i], f"{fps[i]:016x}", comp[i]) for i in fps)


def test_simhash_against_all_pairs(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in queries.op1_simhash(spark, small).collect())
    assert got == plain_components(docs)


def test_simhash_edge_cases(spark):
    got = simhash.near_duplicates(frame(spark)).collect()
    want = plain_components([(r[0], r[1]) for r in rows()])
    assert Counter((r["doc_id"], f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in got) == want
    assert simhash.near_duplicates(empty(spark)).count() == 0
    kept = simhash.drop_near_duplicates(frame(spark))
    assert kept.columns == frame(spark).columns
    assert {r["doc_id"] for r in kept.collect()} <= {r[0] for r in rows()}


def test_links_connect_crowded_cells(spark, monkeypatch):
    """Chains and dense groups, with blocks so small that cells are split."""
    monkeypatch.setattr(simhash, "BLOCK", 4)
    rnd = random.Random(3)
    values = {rnd.getrandbits(64) for _ in range(50)}
    for _ in range(3):
        x = rnd.getrandbits(64)
        for _ in range(60):
            x ^= 1 << rnd.randrange(64) | 1 << rnd.randrange(64)
            values.add(x)
        y = rnd.getrandbits(64)
        values |= {y ^ (1 << rnd.randrange(64)) for _ in range(30)}
    signed = [int(np.uint64(v).astype(np.int64)) for v in values]
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"))
    edges = [(r["a"], r["b"]) for r in found.collect()]
    mask = (1 << 64) - 1
    assert all(((a ^ b) & mask).bit_count() <= 3 for a, b in edges)

    def groups(pairs):
        of = {v: v for v in signed}

        def find(v):
            while of[v] != v:
                v = of[v]
            return v

        for a, b in pairs:
            of[find(a)] = find(b)
        out = defaultdict(set)
        for v in signed:
            out[find(v)].add(v)
        return {frozenset(g) for g in out.values()}

    every = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & mask).bit_count() <= 3]
    assert groups(edges) == groups(every)


def test_embedding_is_a_lower_bound(spark):
    rnd = random.Random(5)
    pairs = [(rnd.getrandbits(63), rnd.getrandbits(63)) for _ in range(200)]
    pairs += [(a, a ^ 1 << rnd.randrange(63)) for a, _ in pairs]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(pairs, "a long, b long")
    got = df.select("a", "b", F.bit_count(simhash.embedding(F.col("a")).bitwiseXOR(simhash.embedding(F.col("b")))).alias("l1")).collect()
    for r in got:
        want = sum(abs((r["a"] >> s & 3).bit_count() - (r["b"] >> s & 3).bit_count()) for s in range(0, 64, 2))
        assert r["l1"] == want <= ((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count()


def test_exact_classes_edge_cases(spark):
    groups = defaultdict(list)
    for r in rows():
        groups[r[1] or ""].append(r[0])
    want = Counter()
    for ids in groups.values():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, keep, len(ids), i == keep)] += 1
    got = exact.exact_classes(frame(spark)).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == want
    hashes = {hashlib.sha256((r[1] or "").encode()).hexdigest() for r in rows()}
    assert {r["content_hash"] for r in got if r["content_hash"]} <= hashes
    assert exact.exact_classes(empty(spark)).count() == 0


def test_exact_drop_leaves_one_row_of_each_text(spark):
    kept = exact.drop_exact_duplicates(frame(spark))
    assert kept.columns == frame(spark).columns
    texts = [r["text"] or "" for r in kept.collect()]
    assert sorted(texts) == sorted({r[1] or "" for r in rows()})
    assert exact.drop_exact_duplicates(empty(spark)).count() == 0


def test_exact_query_has_no_python(spark, small):
    plan = queries.op4_exact_dedup(spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
