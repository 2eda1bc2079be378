import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ontoloom.llm import ctw, langid, queries
from tests.llm.edge import empty, frame, rows


def plain_ppm(learned, text):
    """Bits by language, one byte at a time."""
    out = {}
    for lang, texts in learned.items():
        counts = [defaultdict(Counter) for _ in range(langid.ORDER + 1)]
        for t in texts:
            b = b"\0\0\0\0" + t.lower().encode()
            for i in range(4, len(b)):
                for k in range(langid.ORDER + 1):
                    counts[k][b[i - k : i]][b[i]] += 1
        bits, b = 0.0, b"\0\0\0\0" + text.lower().encode()
        for i in range(4, len(b)):
            for k in range(langid.ORDER, -2, -1):
                if k < 0:
                    bits += 8
                    break
                seen = counts[k].get(b[i - k : i])
                if not seen:
                    continue
                total = sum(seen.values()) + len(seen)
                if b[i] in seen:
                    bits -= math.log2(seen[b[i]] / total)
                    break
                bits -= math.log2(len(seen) / total)
        out[lang] = bits
    return out


def test_code_lengths_against_a_plain_coder(spark):
    learned = {"en": ["the cat sat on the mat", "then the rat ran"], "de": ["die katze saß auf der matte", "dann rannte die ratte"]}
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate((x, t) for x, ts in learned.items() for t in ts)], "doc_id long, text string, lang string")
    model = langid.fit(df)
    texts = ["the mat", "die matte", "quite unlike 日本", "", "ratte rat"]
    got = model.code_lengths([t.encode() for t in texts])
    for t, row in zip(texts, got, strict=True):
        want = plain_ppm(learned, t)
        assert row == pytest.approx([want[x] for x in model.langs], rel=1e-4)


def test_language_query(spark, small):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = queries.op7_ppm_language(spark, small).collect()
    assert len(got) == len(docs)
    right = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in got if r["held_out"] and docs[r["doc_id"]]["lang"]]
    assert sum(right) / len(right) > 0.9
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1


def test_language_edge_cases(spark):
    got = langid.learn_and_predict(frame(spark)).collect()
    assert len(got) == len(rows())
    by_id = defaultdict(list)
    for r in got:
        by_id[r["doc_id"]].append(r)
    for i in (4, 5, 6, 10, 12):  # empty, null, white space, digits
        assert [r["lang_pred"] for r in by_id[i]] == ["und"]
    assert langid.learn_and_predict(empty(spark)).count() == 0
    nothing = langid.learn_and_predict(frame(spark).where("lang is null"))
    assert {r["lang_pred"] for r in nothing.collect()} <= {"und"}
    assert langid.keep_known_language(frame(spark)).columns == frame(spark).columns


def plain_base(docs):
    learn = [i is not None and zlib.crc32(str(i).encode()) % 10 != 0 for i, _ in docs]
    words = [[w for w in (t or "").encode().lower().split()] for _, t in docs]
    c = Counter()
    for ok, w in zip(learn, words, strict=True):
        if ok:
            c.update([*w, None])
    total, distinct = sum(c.values()), len(c)
    out = Counter()
    for (i, _), ok, w in zip(docs, learn, words, strict=True):
        tokens = [*w, None]
        score = sum(math.log10((c[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in tokens)
        out[(i, not ok, len(tokens), sum(c[x] > 0 for x in tokens), total, round(score, 6))] += 1
    return out


def plain_ctw(train, text):
    """log10 P(text) with trees walked one bit at a time."""
    counts = defaultdict(lambda: [0, 0])
    contexts = set()
    for t in train:
        b = b"\0\0" + t.encode().lower()
        for i in range(2, len(b)):
            node = 1
            for bit in range(7, -1, -1):
                one = b[i] >> bit & 1
                for d in range(3):
                    counts[(b[i - d : i], node)][one] += 1
                node = 2 * node + one
            contexts.add(b[i - 2 : i])

    def kt(key):
        a, b = counts.get(key, (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    memo = {}

    def weighted(context, node):
        if len(context) == 2:
            return kt((context, node))
        if (context, node) not in memo:
            seen = {c[-len(context) - 1 :] for c in contexts if c.endswith(context)} if context else {c[-1:] for c in contexts}
            rest = (256 - len(seen)) * (math.log(0.5) + math.log(2) if not context else 0.0)
            own, kids = kt((context, node)), sum(weighted(s, node) for s in seen) + rest
            memo[(context, node)] = max(own, kids) + math.log1p(math.exp(-abs(own - kids))) - math.log(2)
        return memo[(context, node)]

    def p_one(history, node, d=0):
        key = (history[len(history) - d :], node)
        a, b = counts.get(key, (0, 0))
        own = (b + 0.5) / (a + b + 1)
        if d == 2:
            return own
        w = math.exp(math.log(0.5) + kt(key) - weighted(*key))
        return w * own + (1 - w) * p_one(history, node, d + 1)

    b, total = b"\0\0" + text.encode().lower(), 0.0
    for i in range(2, len(b)):
        node = 1
        for bit in range(7, -1, -1):
            one, p = b[i] >> bit & 1, p_one(b[i - 2 : i], node)
            total += math.log10(p if one else 1 - p)
            node = 2 * node + one
    return total


def test_scores_against_plain_models(spark):
    docs = [(i, t) for i, t in enumerate(["the cat sat", "the rat", "", None, "a mat the mat", "Der Bär", "the cat ran off", "zzz qqq", "the the the"] * 2)]
    docs += [(None, "the cat")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = ctw.score(df).collect()
    keys = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")
    assert Counter((*(r[k] for k in keys), round(r["base_score"], 6)) for r in got) == plain_base(docs)
    train = [t or "" for i, t in docs if i is not None and zlib.crc32(str(i).encode()) % 10]
    text = dict(docs)
    for r in got:
        assert r["score"] == pytest.approx(plain_ctw(train, text[r["doc_id"]] or ""), rel=1e-5, abs=1e-9)


def test_score_query(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = queries.op9_ctw(spark, small).collect()
    keys = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")
    assert Counter(tuple(r[k] for k in keys) for r in got) == Counter(k[:5] for k in plain_base(docs).elements())
    held = [r["bits_per_byte"] for r in got if r["held_out"]]
    assert sum(held) / len(held) < 4  # far below the 8 bits of a byte


def test_score_edge_cases(spark):
    got = ctw.score(frame(spark)).collect()
    keys = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")
    assert Counter((*(r[k] for k in keys), round(r["base_score"], 6)) for r in got) == plain_base([(r[0], r[1]) for r in rows()])
    assert ctw.score(empty(spark)).count() == 0
    assert np.isfinite([r["score"] for r in got]).all()


def plain_deep_ctw(train, text, depth):
    """log10 P(text) of trees of any depth, one decision at a time."""
    counts, below = defaultdict(lambda: [0, 0]), defaultdict(set)
    pad = b"\0" * depth
    for t in train:
        b = pad + t.encode().lower()
        for i in range(depth, len(b)):
            node = 1
            for bit in range(7, -1, -1):
                one = b[i] >> bit & 1
                for d in range(depth + 1):
                    counts[(b[i - d : i], node)][one] += 1
                    if d:
                        below[(b[i - d + 1 : i], node)].add(b[i - d : i])
                node = 2 * node + one

    def kt(key):
        a, b = counts.get(key, (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    memo = {}

    def weighted(context, node):
        if len(context) == depth:
            return kt((context, node))
        if (context, node) not in memo:
            own, kids = kt((context, node)), sum(weighted(s, node) for s in below.get((context, node), ()))
            memo[(context, node)] = max(own, kids) + math.log1p(math.exp(-abs(own - kids))) - math.log(2)
        return memo[(context, node)]

    def p_one(history, node, d=0):
        key = (history[len(history) - d :], node)
        a, b = counts.get(key, (0, 0))
        own = (b + 0.5) / (a + b + 1)
        if d == depth:
            return own
        w = math.exp(math.log(0.5) + kt(key) - weighted(*key))
        return w * own + (1 - w) * p_one(history, node, d + 1)

    b, total = pad + text.encode().lower(), 0.0
    for i in range(depth, len(b)):
        node = 1
        for bit in range(7, -1, -1):
            one, p = b[i] >> bit & 1, p_one(b[i - depth : i], node)
            total += math.log10(p if one else 1 - p)
            node = 2 * node + one
    return total


def test_deep_scores_against_plain_trees(spark):
    docs = [(i, t) for i, t in enumerate(["the cat sat on the mat", "that cat ran", "", None, "a mat, the mat", "Der Bär", "the cat ran off", "zzz qqq"] * 3)]
    train = [t or "" for i, t in docs if zlib.crc32(str(i).encode()) % 10]
    text = dict(docs)
    for depth in (2, ctw.DEPTH, 7):
        got = ctw.score(spark.createDataFrame(docs, "doc_id long, text string"), depth).collect()
        assert len(got) == len(docs)
        for r in got:
            assert r["score"] == pytest.approx(plain_deep_ctw(train, text[r["doc_id"]] or "", depth), rel=1e-5, abs=1e-9)
    assert ctw.DEPTH >= 5


def test_score_query_looks_past_two_bytes(spark, tmp_path):
    """'xab' is followed by c, 'yab' by d: two bytes of context cannot tell."""
    docs = [(i, "xabc yabd " * 20) for i in range(200)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert max(r["bits_per_byte"] for r in queries.op9_ctw(spark, str(tmp_path)).collect()) < 0.05


def test_every_language_is_learned_in_shards(spark, monkeypatch):
    """70 languages, each with its own words: none is left out, and shards of any size give the same."""
    docs = [(200 * k + i, f"{chr(0x4E00 + k)}{chr(0x5E00 + k)} " * 5, f"l{k:02}") for k in range(70) for i in range(4)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    found = {}
    for size in (200, 1 << 20):
        monkeypatch.setattr(langid, "SHARD_WINDOWS", size)
        models = list(langid.fit_shards(df))
        assert [x for m in models for x in m.langs] == sorted({x for *_, x in docs}) and (len(models) > 1) == (size == 200)
        found[size] = {r["doc_id"]: (r["lang_pred"], round(r["score"], 6), round(r["bits_per_byte"], 4)) for r in langid.predict(df, models, ("doc_id",)).collect()}
    assert found[200] == found[1 << 20] and {i: x for i, _, x in docs} == {i: v[0] for i, v in found[200].items()}
