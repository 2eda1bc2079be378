import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

from ontoloom.llm import packing, queries, repair, tokens
from tests.llm.edge import empty, frame, rows


@lru_cache(1)
def library():
    t = Tokenizer.from_file(tokens.default_vocabulary())
    t.encode_special_tokens = True
    return t


def plain(text):
    return library().encode(text or "", add_special_tokens=False).ids + [2]


def test_encoder_equals_the_library():
    rnd = random.Random(2)
    alphabet = "aZé'sß ²½_09\t\n\r\x85\xa0\x1c\x1f.,!?-#@Ā日ſ​" + "'ll've  "
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(600)]
    path = tokens.default_vocabulary()
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    for text in [*texts, "a<|endoftext|>b", "  x", "it's I'll", "\n\n a"]:
        assert np.frombuffer(tokens.encode(text, path), dtype="<u4").tolist() == t.encode(text, add_special_tokens=False).ids + [2], repr(text)


def check_packing(got, docs, limit=1024):
    want = Counter()
    for doc_id, text in docs:
        ids = plain(text)
        cuts = packing.cut(len(ids), limit)
        assert sum(n for _, n in cuts) == len(ids) and all(n == limit for _, n in cuts[1:])
        for k, (s, n) in enumerate(cuts):
            want[(doc_id, k, s, n, zlib.crc32(np.array(ids[s : s + n], dtype="<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= limit
    return bins


def test_pack_query(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = queries.op2_best_fit(spark, small).collect()
    bins = check_packing(got, docs)
    assert len(bins) <= 1.01 * -(-sum(r["length"] for r in got) // 1024) + 1


def test_pack_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 2)
    check_packing(packing.pack_documents(frame(spark)).collect(), [(r[0], r[1]) for r in rows()])
    assert packing.pack_documents(empty(spark)).count() == 0


def test_plan_respects_every_capacity():
    rnd = random.Random(7)
    histogram = dict(Counter(rnd.choice([3, 5, 17, 100, 400, 700, 1024]) for _ in range(3000)))
    for rule in ("dot", "norm"):
        capacity = packing.Capacity(documents=6, attention=600_000 + 1024 * 500, rule=rule)
        used = defaultdict(list)
        for length, table in packing.plan(histogram, capacity).items():
            edges = [*table, (histogram[length], None, None)]
            for (rank, first, offset), (upto, _, _) in zip(edges, edges[1:], strict=False):
                for i in range(upto - rank):
                    used[first + i].append((offset, length))
        assert sum(map(len, used.values())) == sum(histogram.values())
        for own in used.values():
            at = 0
            for offset, n in sorted(own):
                assert offset == at
                at += n
            assert at <= 1024 and len(own) <= 6 and sum(n * n for _, n in own) <= capacity.attention


def test_repair_round_trip():
    rnd = np.random.default_rng(1)
    for n, words in ((1, 3), (50, 2), (4000, 30), (4000, 3000)):
        ids = rnd.integers(0, words, n).astype(np.uint32)
        ends = np.unique(np.append(rnd.integers(1, n + 1, 7), n))
        data, at, base, rules, sizes = repair.compress(ids, ends, least=2)
        assert (repair.expand(data, base, rules) == ids).all() and (repair.expand_all(data, base, rules, sizes) == ids).all()
        starts = np.concatenate([[0], at[:-1]])
        for a, b, x, y in zip(starts, at, np.concatenate([[0], ends[:-1]]), ends, strict=True):
            assert (repair.expand(data[a:b], base, rules) == ids[x:y]).all()
        for k in range(len(rules)):
            assert len(repair.expand(np.array([base + k]), base, rules)) == sizes[k]
    assert len(data) <= n


def plain_round(docs, least, number):
    """One round of replacement on lists of symbols: (docs, rules)."""
    counts, spots = Counter(), []
    for d, own in enumerate(docs):
        free = -1
        for i, pair in enumerate(zip(own, own[1:], strict=False)):
            if pair[0] != pair[1] or i > free:  # occurrences of one pair do not overlap
                counts[pair] += 1
                spots.append((d, i, pair))
                free = i + 1 if pair[0] == pair[1] else -1
            else:
                free = -1
    order = {p: k for k, (p, _) in enumerate(sorted(((p, c) for p, c in counts.items() if c >= least), key=lambda x: (-x[1], x[0])))}
    at = {(d, i): order[p] for d, i, p in spots if p in order}
    far = len(order)
    chosen = {s: r for s, r in at.items() if r < at.get((s[0], s[1] - 1), far) and r < at.get((s[0], s[1] + 1), far)}
    uses = Counter(chosen.values())
    fit = [p for p in order if uses[order[p]] >= least]
    name = {order[p]: number + k for k, p in enumerate(fit)}
    out = []
    for d, own in enumerate(docs):
        new, i = [], 0
        while i < len(own):
            rule = name.get(chosen.get((d, i)))
            new.append(own[i] if rule is None else rule)
            i += 1 if rule is None else 2
        out.append(new)
    return out, fit


def test_repair_rules_equal_a_plain_version():
    rnd = random.Random(5)
    for n, words, least in ((60, 2, 2), (400, 3, 2), (900, 9, 3), (2000, 25, 4)):
        docs = [[rnd.choice(range(words)) for _ in range(rnd.randint(1, n))] for _ in range(4)] + [[0] * n, [1]]
        base = max(map(max, docs)) + 1
        data, at, got_base, rules, _ = repair.compress(np.array(sum(docs, []), dtype=np.uint32), np.cumsum([len(d) for d in docs]), least)
        want, now = [], docs
        while True:
            now, fit = plain_round(now, least, base + len(want))
            if not fit:
                break
            want += fit
        assert got_base == base and [tuple(r) for r in rules.tolist()] == want
        assert [x.tolist() for x in np.split(data, at[:-1])] == now
        left = Counter(p for own in now for p in zip(own, own[1:], strict=False) if p[0] != p[1])
        assert max(left.values(), default=0) < least  # no frequent pair is left


def test_repair_is_about_as_short_as_one_pair_at_a_time():
    rnd = random.Random(6)
    vocabulary = [rnd.choices(range(60), k=rnd.randint(2, 6)) for _ in range(80)]
    ids = sum((rnd.choices(vocabulary, weights=[1 / (k + 1) for k in range(80)])[0] for _ in range(900)), [])
    data, _, _, rules, _ = repair.compress(np.array(ids, dtype=np.uint32), np.array([len(ids)]), 4)
    seq, made = list(ids), 0
    while True:
        counts = Counter(zip(seq, seq[1:], strict=False))
        pair, n = max(counts.items(), key=lambda x: (x[1], x[0]))
        if n < 4:
            break
        out, i = [], 0
        while i < len(seq):
            hit = tuple(seq[i : i + 2]) == pair
            out.append(10_000 + made if hit else seq[i])
            i += 1 + hit
        if len(out) == len(seq):
            break
        seq, made = out, made + 1
    assert len(data) + 2 * len(rules) <= 1.05 * (len(seq) + 2 * made)


def test_id_files(spark, small, tmp_path):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    got = {r["doc_id"]: r for r in queries.op8_repair(spark, small).collect()}
    start = 0
    for doc_id, text in docs:
        ids = plain(text)
        r = got[doc_id]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)


def test_id_files_edge_cases(spark, tmp_path):
    path = f"file://{tmp_path}/ids"
    repair.write_ids(frame(spark), path, shard_tokens=500)
    got = repair.read_ids(spark, path).collect()
    want = Counter((r[0], len(i := plain(r[1])), zlib.crc32(np.array(i, dtype="<u4").tobytes())) for r in rows())
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    by_start = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] is not None and r["doc_id"] for r in by_start] == sorted((r["doc_id"] is not None and r["doc_id"] for r in got), key=lambda x: (x is not False, x))
    at = 0
    for r in by_start:
        assert r["start"] == at
        at += r["n_tokens"]
    assert repair.document_ids(spark, path, 3) == [plain(rows()[3][1])]
    repair.write_ids(empty(spark), path + "0")
    assert repair.read_ids(spark, path + "0").count() == 0


def test_pool_keeps_only_what_the_table_points_at(monkeypatch):
    rnd = random.Random(31)
    path = tokens.default_vocabulary()
    own = tokens.Encoder(path)
    long_words = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(40)) for _ in range(400)).encode()
    first = [long_words(), b"short words stay here"]
    own(first)
    used, held = own.used, own.held
    for _ in range(5):
        own([long_words()])
    assert own.used - used < 200 and own.held - held < 100  # only spaces and single signs may be new
    assert np.array_equal(own(first)[0], tokens.Encoder(path)(first)[0])
    monkeypatch.setattr(tokens, "KEPT", own.held)  # full: nothing more is kept
    full = own.used
    texts = [" ".join(f"word{i}x{j}" for i in range(50)).encode() for j in range(5)]
    assert np.array_equal(own(texts)[0], tokens.Encoder(path)(texts)[0]) and own.used == full
