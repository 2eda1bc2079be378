"""Scores of texts under models learned from the corpus.

Base: words with add-0.1 smoothing over all training tokens. Model: context-tree weighting over bytes. A byte is eight binary
decisions; each of the 255 decision nodes has its own tree over the bytes before, of depth 0 to ``depth``. A tree node mixes its
Krichevsky-Trofimov estimate half and half with its children, so all depths are weighed by how well they coded the training
texts; scoring uses those frozen weights. What no training text holds has KT estimate and weighted probability one and adds
nothing, so only seen nodes are kept: the statistics grow with the corpus, and no table of all windows exists anywhere.

Words and byte windows of a block of documents (a bounded run of rows) are counted once for each block before any shuffle. Words
are shuffled as rows, windows as packed arrays, one for each block and pair of newest context bytes; a pair's windows of all blocks
meet in one task, which walks its trees from the deepest nodes to depth two. Depths one and zero (65,280 nodes at most) are an
aggregate over pairs. The windows of held-out texts travel along with a count of zero, so every window gets its price there.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ontoloom.llm.batches import crc_column, crc_of, emit, runs, texts_of
from ontoloom.plans.staging import staged

SMOOTH = 0.1
#: Bytes of context that op9_ctw looks at.
DEPTH = 5
#: Bytes of text of a block, about.
BLOCK_BYTES = 8 << 20
_END = b" "  # no word holds a space
_PIECE = [("pair", pa.int32()), ("keys", pa.binary()), ("n", pa.binary())]
_BLOCK_SQL = "block long, words array<binary>, trained array<int>, text binary, docs array<struct<doc_id:bigint,held_out:boolean,size:bigint>>, pieces array<struct<pair:int,keys:binary,n:binary>>"
_BLOCK = pa.schema(
    [
        ("block", pa.int64()),
        ("words", pa.list_(pa.binary())),
        ("trained", pa.list_(pa.int32())),
        ("text", pa.binary()),
        ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("size", pa.int64())]))),
        ("pieces", pa.list_(pa.struct(_PIECE))),
    ]
)


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the id mod 10 is 0. A null id is held out."""
    return F.coalesce(crc_column(doc_id) % 10 == 0, F.lit(True))


def words(text: bytes) -> list[bytes]:
    return text.lower().split()


def windows(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed windows of ``depth`` + 1 bytes, each text after ``depth`` zero bytes; and their number by text.

    From the top: the byte two back, the byte one back (these are the pair), older bytes from the oldest on, the byte itself.
    """
    counts = np.array([len(t) for t in texts], dtype=np.int64)
    flat = np.frombuffer(b"".join(b"\0" * depth + t for t in texts), dtype=np.uint8)
    inside = np.ones(len(flat), dtype=bool)
    heads = np.cumsum(counts + depth) - (counts + depth)
    inside[(heads[:, None] + np.arange(depth)).ravel()] = False
    keys = flat[depth:].astype(np.uint64)
    for back in range(1, depth + 1):
        place = depth - 1 if back == 1 else depth if back == 2 else back - 2
        keys |= flat[depth - back : len(flat) - back].astype(np.uint64) << np.uint64(8 * place)
    return keys[inside[depth:]], counts


def gram_counts(texts: list[bytes], depth: int, step: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows of texts and their counts, looking at about ``step`` bytes at a time."""
    parts, held, size = [], [], 0
    for text in [*texts, None]:
        if held and (text is None or size + len(text) > step):
            parts.append(np.unique(windows(held, depth)[0], return_counts=True))
            held, size = [], 0
        if text is not None:
            held.append(text)
            size += len(text)
    return _summed(parts)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all parts and the sums of their counts."""
    if not parts:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    if len(parts) == 1:
        return parts[0]
    keys, n = np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, dtype=np.int64)
    return keys[first], np.add.reduceat(n[order], first) if len(first) else n


def _pack(x: np.ndarray) -> bytes:
    return zlib.compress(x.tobytes(), 1)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as steps, bytes of one rank together."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return zlib.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack_keys(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), dtype="<i8")


def _pieces(texts: list[bytes], out: list[bool], depth: int) -> list[dict]:
    """Windows of a block by pair, with their training counts; those of held-out texts alone count zero."""
    learned = gram_counts([t for t, o in zip(texts, out, strict=True) if not o], depth)
    asked = gram_counts([t for t, o in zip(texts, out, strict=True) if o], depth)[0]
    keys, n = _summed([learned, (asked, np.zeros(len(asked), dtype=np.int64))])
    below = np.uint64(8 * (depth - 1))
    pairs = keys >> below
    at = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(keys) else np.empty(0, dtype=np.int64)
    rest = keys & np.uint64((1 << int(below)) - 1)
    return [{"pair": int(pairs[a]), "keys": _pack_keys(rest[a:b]), "n": _pack(n[a:b].astype("<i8"))} for a, b in zip(at, [*at[1:], len(keys)], strict=True)]


def _word_ids(texts: list[bytes]) -> tuple[dict[bytes, int], list[np.ndarray]]:
    """Numbers of distinct words in the order seen (the end is 0), and the words of each text as numbers."""
    index: dict[bytes, int] = defaultdict(count().__next__)
    index[_END]
    return index, [np.fromiter(map(index.__getitem__, t.split()), dtype=np.uint32) for t in texts]


def _blocks(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, rows in enumerate(runs(batches, BLOCK_BYTES)):
            texts = [t.lower() for t in texts_of(rows)]
            ids = rows.column("doc_id").to_pylist()
            out = [x is None or crc_of(x) % 10 == 0 for x in ids]
            index, tokens = _word_ids(texts)
            trained = np.zeros(len(index), dtype=np.int32)
            trained[0] = len(out) - sum(out)
            learned = [t for t, o in zip(tokens, out, strict=True) if not o]
            if learned:
                trained += np.bincount(np.concatenate(learned), minlength=len(index)).astype(np.int32)
            yield emit(
                _BLOCK,
                block=[(part << 32) + k],
                words=[list(index)],
                trained=[trained],
                text=[zlib.compress(b"".join(texts), 1)],
                docs=[[{"doc_id": i, "held_out": o, "size": len(t)} for i, o, t in zip(ids, out, texts, strict=True)]],
                pieces=[_pieces(texts, out, depth)],
            )

    return run


# --- context-tree weighting -----------------------------------------------------------------------------------------


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by eight; x > 0."""
    shift = np.ones_like(x)
    for i in range(8):
        shift *= x + i
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


_SMALL = np.arange(1 << 14, dtype=float)
_HALVES, _WHOLES = _lgamma(_SMALL + 0.5), _lgamma(_SMALL + 1)


def _looked_up(n: np.ndarray, table: np.ndarray, add: float) -> np.ndarray:
    out = table[np.minimum(n, len(table) - 1).astype(np.int64)]
    if (large := n >= len(table)).any():
        out[large] = _lgamma(n[large] + add)
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return _looked_up(zeros, _HALVES, 0.5) + _looked_up(ones, _HALVES, 0.5) - np.log(np.pi) - _looked_up(zeros + ones, _WHOLES, 1.0)


def _one(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (ones + 0.5) / (zeros + ones + 1)


def _log_weighted(own: np.ndarray, children: np.ndarray) -> np.ndarray:
    return np.logaddexp(own, children) - np.log(2)


def walk(keys: np.ndarray, n: np.ndarray, depth: int) -> Iterator[tuple]:
    """For each of the eight decisions of a byte, the trees of one pair from the deepest nodes to depth two.

    Gives the decision node and the bit of each window; the place of each window among distinct (context, node)s; the probability of
    a one mixed over the depths from two on, and the node, of each of those; and nodes, zeros, ones and log weighted
    probabilities at depth two.
    """
    byte, context = keys & np.uint64(255), keys >> np.uint64(8)
    for bit in range(8):
        node = (byte | np.uint64(256)) >> np.uint64(8 - bit)
        one = ((byte >> np.uint64(7 - bit)) & np.uint64(1)).astype(float)
        at, place = np.unique(context << np.uint64(8) | node, return_inverse=True)
        zeros, ones = np.bincount(place, n * (1 - one)), np.bincount(place, n * one)
        weighted, p, up, own = log_kt(zeros, ones), _one(zeros, ones), np.arange(len(at)), at
        for d in range(depth - 1, 1, -1):
            nearer = (at >> np.uint64(8)) & np.uint64((1 << 8 * (d - 2)) - 1)
            at, parent = np.unique(nearer << np.uint64(8) | (at & np.uint64(255)), return_inverse=True)
            zeros, ones, children = np.bincount(parent, zeros), np.bincount(parent, ones), np.bincount(parent, weighted)
            kt = log_kt(zeros, ones)
            weighted = _log_weighted(kt, children)
            weight, up = np.exp(np.log(0.5) + kt - weighted), parent[up]
            p = weight[up] * _one(zeros, ones)[up] + (1 - weight[up]) * p
        yield one, place, p, (own & np.uint64(255)).astype(np.int64), (at.astype(np.int64), zeros, ones, weighted)


def prices(pair: int, keys: np.ndarray, n: np.ndarray, depth: int, upper: tuple) -> np.ndarray:
    """log10 probability of each window of a pair; ``upper`` holds weights and estimates of depth one (256, 256) and zero (256)."""
    weight1, one1, weight0, one0 = upper
    last, out = pair & 255, np.zeros(len(keys))
    for one, place, p, node, _ in walk(keys, n, depth):
        p = weight1[last, node] * one1[last, node] + (1 - weight1[last, node]) * p
        p = (weight0[node] * one0[node] + (1 - weight0[node]) * p)[place]
        out += np.log10(np.where(one == 1, p, 1 - p))
    return out


_PAIR_SQL = "pair int, keys binary, n binary, nodes array<struct<node:int,zeros:double,ones:double,weighted:double>>"
_PAIR = pa.schema([*_PIECE, ("nodes", pa.list_(pa.struct([("node", pa.int32()), ("zeros", pa.float64()), ("ones", pa.float64()), ("weighted", pa.float64())])))])


def _gathered(depth: int):
    """Pieces in order of their pair to one row a pair: its windows, and its trees' nodes at depth two."""

    def row(pair: int, parts: list) -> pa.RecordBatch:
        keys, n = _summed(parts)
        nodes = [dict(zip(("node", "zeros", "ones", "weighted"), x, strict=True)) for *_, top in walk(keys, n.astype(float), depth) for x in zip(*(c.tolist() for c in top), strict=True)]
        return emit(_PAIR, pair=[pair], keys=[_pack_keys(keys)], n=[_pack(n.astype("<i8"))], nodes=[nodes])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, parts, fresh, held = None, [], 0, 0
        for batch in batches:
            for i, own in enumerate(batch.column("pair").to_pylist()):
                if own != pair:
                    if parts:
                        yield row(pair, parts)
                    pair, parts, fresh, held = own, [], 0, 0
                parts.append((_unpack_keys(batch.column("keys")[i].as_py()), _unpack(batch.column("n")[i].as_py())))
                fresh += len(parts[-1][0])
                if fresh > max(1 << 20, held):  # what is held stays near the number of distinct windows
                    parts, fresh = [_summed(parts)], 0
                    held = len(parts[0][0])
        if parts:
            yield row(pair, parts)

    return run


def upper_weights(pairs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weights and probabilities of a one at depth one, by last byte and node, and at depth zero, by node."""
    nodes = pairs.select(F.col("pair").bitwiseAND(255).alias("last"), F.explode("nodes").alias("x")).select("last", "x.*")
    rows = nodes.groupBy("last", "node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "weighted")]).toArrow()  # 65,280 at most
    zeros, ones, children = np.zeros((3, 256, 256))
    at = rows.column("last").to_numpy(), rows.column("node").to_numpy()
    for table, name in ((zeros, "zeros"), (ones, "ones"), (children, "weighted")):
        table[at] = rows.column(name).to_numpy()
    kt = log_kt(zeros, ones)
    weighted = _log_weighted(kt, children)
    all_zeros, all_ones = zeros.sum(axis=0), ones.sum(axis=0)
    kt0 = log_kt(all_zeros, all_ones)
    weight0 = np.exp(np.log(0.5) + kt0 - _log_weighted(kt0, weighted.sum(axis=0)))
    return np.exp(np.log(0.5) + kt - weighted), _one(zeros, ones), weight0, _one(all_zeros, all_ones)


def _priced(depth: int, shared):
    """After the row of a pair (block -1), the pieces of its blocks: prices in each piece's order."""
    schema = pa.schema([("block", pa.int64()), ("pair", pa.int32()), ("prices", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = price = None
        for batch in batches:
            blocks, pairs, packed = [], [], []
            for i, (block, pair) in enumerate(zip(batch.column("block").to_pylist(), batch.column("pair").to_pylist(), strict=True)):
                own = _unpack_keys(batch.column("keys")[i].as_py())
                if block < 0:
                    keys, price = own, prices(pair, own, _unpack(batch.column("n")[i].as_py()).astype(float), depth, shared.value).astype("<f4")
                else:
                    blocks.append(block)
                    pairs.append(pair)
                    packed.append(price[np.searchsorted(keys, own)].tobytes())
            yield emit(schema, block=blocks, pair=pairs, prices=packed)

    return run


def window_prices(blocks: DataFrame, depth: int) -> DataFrame:
    """(block, prices): log10 probabilities of a block's windows, as an array of (pair, packed prices)."""
    pieces = blocks.select("block", F.explode("pieces").alias("p")).select("block", "p.*")
    pairs = staged(pieces.select("pair", "keys", "n").repartition("pair").sortWithinPartitions("pair").mapInArrow(_gathered(depth), _PAIR_SQL), "pairs")
    shared = blocks.sparkSession.sparkContext.broadcast(upper_weights(pairs))
    both = pairs.select(F.lit(-1).cast("long").alias("block"), "pair", "keys", "n").union(pieces.select("block", "pair", "keys", F.lit(None).cast("binary").alias("n")))
    priced = both.repartition("pair").sortWithinPartitions("pair", "block").mapInArrow(_priced(depth, shared), "block long, pair int, prices binary")
    return priced.groupBy("block").agg(F.collect_list(F.struct("pair", "prices")).alias("prices"))


# --- scoring --------------------------------------------------------------------------------------------------------


def _runs(sizes: list[int], step: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts with about ``step`` bytes."""
    lo = held = 0
    for i, size in enumerate(sizes):
        if i > lo and held + size > step:
            yield lo, i
            lo, held = i, 0
        held += size
    if lo < len(sizes):
        yield lo, len(sizes)


def _scores(total: int, distinct: int, depth: int):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    below = np.log10(total + SMOOTH * (distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                docs = batch.column("docs")[i].as_py()
                whole, sizes = zlib.decompress(batch.column("text")[i].as_py()), [d["size"] for d in docs]
                ends = np.cumsum(sizes).tolist()
                texts = [whole[e - n : e] for e, n in zip(ends, sizes, strict=True)]
                tokens = _word_ids(texts)[1]
                lengths = np.array([len(t) for t in tokens], dtype=np.int64)
                pairs = batch.column("counts")[i].values
                c = np.zeros(len(pairs), dtype=np.int64)
                c[pairs.field("at").to_numpy()] = pairs.field("c").to_numpy()
                cost, known = np.log10(c + SMOOTH) - below, (c > 0).astype(np.int64)
                base, n = np.full(len(docs), cost[0]), np.full(len(docs), known[0])
                if len(filled := np.flatnonzero(lengths)):
                    starts, flat = (np.cumsum(lengths) - lengths)[filled], np.concatenate(tokens)
                    base[filled] += np.add.reduceat(cost[flat], starts)
                    n[filled] += np.add.reduceat(known[flat], starts)
                score = np.zeros(len(docs))
                if whole:
                    by_pair = sorted(batch.column("prices")[i].as_py(), key=lambda x: x["pair"])
                    price = np.concatenate([np.frombuffer(x["prices"], dtype="<f4") for x in by_pair])
                    keys = gram_counts(texts, depth)[0]  # by pair, then key: the order of the prices
                    for lo, hi in _runs(sizes):
                        own, counts = windows(texts[lo:hi], depth)
                        if len(filled := np.flatnonzero(counts)):
                            cost_of = price[np.searchsorted(keys, own)].astype(float)
                            score[lo + filled] = np.add.reduceat(cost_of, (np.cumsum(counts) - counts)[filled])
                cols = {k: [d[k] for d in docs] for k in ("doc_id", "held_out")}
                yield emit(schema, **cols, n_bytes=sizes, n_tokens=lengths + 1, n_known=n, base_score=base, score=score)

    return run


def score(docs: DataFrame, depth: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row.

    Both models learn from the rows that are not held out. A null text is empty: one end token, score 0, bits_per_byte null.
    Both scores take A-Z in lower case. Rows that repeat doc_id and text score alike; with no training rows every
    token has the smoothed probability of an unknown one and every bit costs one bit. Contexts have up to ``depth`` bytes, 2 to 7.
    """
    if not 2 <= depth <= 7:
        raise ValueError("windows are packed in 64 bits and divided by pairs of bytes")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text"))
    blocks = staged(rows.mapInArrow(_blocks(depth), _BLOCK_SQL), "blocks")
    each = blocks.select("block", F.posexplode(F.arrays_zip("words", "trained")).alias("at", "w"))
    each = each.select("block", "at", F.col("w.words").alias("word"), F.col("w.trained").cast("long").alias("n"))
    totals = blocks.select(F.aggregate("trained", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).agg(F.sum("n").alias("n")).first()["n"] or 0
    own = Window.partitionBy("word")
    counted = each.withColumn("c", F.sum("n").over(own)).withColumn("first", F.col("block") == F.min("block").over(own))
    counted = staged(counted.select("block", "at", "c", "first"), "words")
    distinct = counted.where("first and c > 0").count()
    back = counted.groupBy("block").agg(F.collect_list(F.struct("at", "c")).alias("counts"))
    whole = blocks.select("block", "docs", "text").join(back, "block").join(window_prices(blocks, depth), "block", "left").select("docs", "text", "counts", "prices")
    ddl = "doc_id long, held_out boolean, n_bytes long, n_tokens long, n_known long, base_score double, score double"
    return whole.mapInArrow(_scores(int(totals), distinct, depth), ddl).select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(int(totals)).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        (-F.col("score") / F.lit(float(np.log10(2))) / F.nullif(F.col("n_bytes"), F.lit(0))).alias("bits_per_byte"),
    )
