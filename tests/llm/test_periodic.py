import hashlib
import random
import re
import zlib

import numpy as np

from ontoloom.llm import periodic, queries
from tests.llm.edge import empty, frame, rows


def plain_runs(words, least=12):
    """Every period in turn: maximal stretches of agreeing words, less those that a smaller period explains."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and words[e] == words[e + q]:
                e += 1
            length = e + q - s
            if length >= max(least, 2 * q) and not any(all(words[x] == words[x + r] for x in range(s, s + length - r)) for r in range(1, q)):
                out.append((s, length, q))
            s = e + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text, loop):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if loop and h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
        sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def plain_lyndon(w):
    return [next((j for j in range(i + 1, len(w)) if w[j:] < w[i:]), len(w)) - i for i in range(len(w))]


def some_words(rnd):
    n, kinds = rnd.randint(1, 40), rnd.randint(1, 4)
    w = [rnd.randrange(kinds) for _ in range(n)]
    if rnd.random() < 0.5:
        p, x = rnd.randint(1, 8), rnd.randrange(n)
        w = [w[min(x + (i - x) % p, n - 1)] if i >= x else w[i] for i in range(n)]
    used = sorted(set(w))
    return [used.index(c) for c in w]


def test_lyndon_lengths_and_runs_against_plain_versions():
    rnd = random.Random(5)
    for _ in range(1500):
        w = some_words(rnd)
        assert periodic.lyndon_lengths(w) == plain_lyndon(w)
        for least in (2, 5, 12):
            assert periodic.runs_within(np.array(w), least) == plain_runs(w, least)


def test_stretches_hold_every_run_of_several_texts():
    rnd = random.Random(6)
    for _ in range(300):
        texts = [some_words(rnd) for _ in range(rnd.randint(1, 5))]
        words, part = np.array(sum(texts, [])), np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        for least in (4, 7, 12):
            got = [(a + s, length, q) for a, b in periodic.repeating(words, part, least) for s, length, q in periodic.runs_within(words[a:b], least)]
            want, at = [], 0
            for t in texts:
                want += [(at + s, length, q) for s, length, q in plain_runs(t, least)]
                at += len(t)
            assert sorted(got) == sorted(want)


def test_known_words():
    fibonacci, last = [0, 1], [0]
    while len(fibonacci) < 400:
        last, fibonacci = fibonacci, fibonacci + last
    for w in (fibonacci, [0] * 500, list(range(40)) * 9 + [7], [0, 1, 2] * 30 + [0, 1] * 20, [bin(i).count("1") % 2 for i in range(300)]):
        assert periodic.runs_within(np.array(w)) == plain_runs(w)


def test_query_against_plain_version(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").where("length(text) < 6000").collect()]
    got = {r["doc_id"]: tuple(r) for r in queries.op11_periodic(spark, small).collect()}
    assert len(got) == spark.read.parquet(f"{small}/documents.parquet").count()
    for doc_id, text in docs:
        assert got[doc_id] == plain_row(doc_id, text, loop=True)


def test_query_columns(spark, small):
    kinds = dict(queries.op11_periodic(spark, small).dtypes)
    assert {k: kinds[k] for k in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")} == dict.fromkeys(("doc_id", "n_runs", "start", "length", "period", "exponent_milli"), "bigint")


def test_odd_rows_and_long_texts(spark, monkeypatch):
    got = periodic.find_runs(frame(spark)).collect()
    assert sorted((str(r["doc_id"]), len(r["runs"]), r["collapsed"]) for r in got) == sorted(
        (str(r[0]), len(plain_runs((r[1] or "").split())), " ".join(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in rows()
    )
    assert periodic.find_runs(empty(spark)).count() == 0
    phrase = " ".join(f"w{i}" for i in range(700))
    text = "start\x0bhere " + "\n".join([phrase] * 9) + "  end \x1c\x85  of it"
    monkeypatch.setattr(periodic, "_PART", 97)  # a text longer than a part is numbered as one
    table, words, counts = periodic.number_words([text.encode(), b"", b"w1 w2"])
    assert [table[i].decode() for i in words] == re.findall(r"[^\x20\x09-\x0D]+", text) + ["w1", "w2"] and counts.tolist()[1:] == [0, 2]
    (row,) = periodic.find_runs(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()
    assert [tuple(r) for r in row["runs"]] == [(2, 6300, 700)]
    assert row["collapsed"] == f"start here {phrase} end \x1c\x85  of it"


def test_map_columns_and_looped_nulls(spark):
    docs = spark.sql("select 5L as doc_id, 'a b a b a b a b a b a b' as text, map('k', 1) as runs, array(1) as words union all select null, null, map(), array()")
    got = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in periodic.find_runs(docs).collect()}
    assert got == {5: [(0, 12, 2)], None: []}
    assert {(r["doc_id"], r["text"]) for r in queries.looped(docs).collect()} >= {(None, None)}
