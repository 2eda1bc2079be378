"""Vector best-fit packing of token sequences.

A piece needs tokens, one document slot and attention cost (its length squared), so pieces of one length are alike. Spark
counts pieces by length; the bounded histogram (one row per length up to the capacity) is packed as best-fit decreasing on
whole classes of equal bins, and Spark then places each piece by its rank among those of its length. The plan is the exact
best-fit result for all pieces together, however many there are, and no piece passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ontoloom.llm import tokens
from ontoloom.llm.batches import documents, emit, slices, texts_of
from ontoloom.plans.staging import staged

#: Rows of one length that one rank window orders at most, about.
RANK_ROWS = 100_000
_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_PIECE_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = pa.schema([*_PIECE, ("sequence_id", pa.int64()), ("offset", pa.int64())])


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds. Defaults of documents and attention allow whatever the tokens allow."""

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    #: "dot": the largest weighted dot product of need and residual; "norm": the smallest weighted residual after placing.
    rule: str = "norm"
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)


def cut(length: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: whole if it fits, else full pieces after a first one that may be shorter."""
    if length <= limit:
        return [(0, length)]
    first = length % limit
    starts = ([0] if first else []) + list(range(first, length, limit))
    return [(s, (first if first and s == 0 else limit)) for s in starts]


def _pieces(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path)
        for part in slices(batches, 1 << 20):
            flat, counts = encode(texts_of(part))
            view, rows, at = memoryview(flat.astype("<u4").tobytes()), [], 0
            for doc_id, n in zip(part.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                for k, (start, length) in enumerate(cut(n, limit)):
                    rows.append((doc_id, k, start, length, tokens.crc(view[4 * (at + start) : 4 * (at + start + length)])))
                at += n
            yield emit(_PIECE, **dict(zip(_PIECE.names, map(list, zip(*rows, strict=True)), strict=True)))

    return run


def pieces(docs: DataFrame, limit: int = 1024, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of all documents; a null text is empty and so is its end id alone."""
    return documents(docs).mapInArrow(_pieces(vocabulary or tokens.default_vocabulary(), limit), _PIECE_SQL)


def plan(histogram: dict[int, int], capacity: Capacity) -> dict[int, list[tuple[int, int, int]]]:
    """length -> [(first rank, first sequence, offset)]: best-fit decreasing over a histogram of lengths.

    Bins of equal content are one class, a run of sequence numbers; the n pieces of a length fill the best class that has
    room for one, bin by bin, before the next best.
    """
    full = np.array([capacity.tokens, capacity.documents, capacity.attention], dtype=float)
    weights = np.array(capacity.weights)
    rest = np.empty((0, 3))  # residual capacity of each class
    runs: list[list[tuple[int, int]]] = []  # (first sequence, count) of each class
    at: dict[tuple, int] = {}  # class by residual
    made, out = 0, {}

    def put(residual: np.ndarray, run: list[tuple[int, int]]) -> None:
        nonlocal rest
        key = tuple(residual)
        if key in at:
            runs[at[key]].extend(run)
        else:
            at[key] = len(runs)
            runs.append(run)
            rest = np.vstack([rest, residual])

    for length in sorted(histogram, reverse=True):
        need, left, rank, rows = np.array([length, 1, length * length], dtype=float), histogram[length], 0, []
        if (need > full).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        while left:
            able = np.flatnonzero((rest >= need).all(axis=1))
            able = able[[bool(runs[i]) for i in able]] if len(able) else able
            if len(able):
                scaled = rest[able] / full
                score = -(scaled * need / full * weights).sum(axis=1) if capacity.rule == "dot" else (weights * (scaled - need / full) ** 2).sum(axis=1)
                best = able[np.argmin(score)]
            else:
                each = int(min(full // need))  # as many as one new sequence holds, first to last
                bins = -(-left // each)
                put(full.copy(), [(made, bins)])
                made += bins
                continue
            first, n = runs[best].pop()
            used = min(n, left)
            if used < n:
                runs[best].append((first + used, n - used))
            rows.append((rank, first, int(capacity.tokens - rest[best][0])))
            put(rest[best] - need, [(first, used)])
            rank, left = rank + used, left - used
        out[length] = rows
    return out


def _placed(lengths: np.ndarray, ranks: np.ndarray, table: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sequence, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    for length in np.unique(lengths):
        own = lengths == length
        rows = table[int(length)]
        k = np.searchsorted(rows[:, 0], ranks[own], side="right") - 1
        sequence[own], offset[own] = rows[k, 1] + ranks[own] - rows[k, 0], rows[k, 2]
    return sequence, offset


def ranked(rows: DataFrame, histogram: DataFrame) -> DataFrame:
    """``rows`` with a dense rank from 0 among those of the same length. Frequent lengths are dealt to several windows."""
    split = histogram.select(F.col("length").alias("l"), F.ceil(F.col("n") / RANK_ROWS).cast("int").alias("parts"))
    dealt = rows.join(split, rows["length"] == split["l"]).drop("l")
    dealt = staged(dealt.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit("rank")), F.col("parts")).cast("int")).drop("parts"), "dealt")
    sizes = dealt.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    base = sizes.select(F.col("length").alias("l"), F.col("part").alias("p"), before.alias("before"))
    own = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")
    local = dealt.withColumn("local", F.row_number().over(own) - 1)
    return local.join(base, (local["length"] == base["l"]) & (local["part"] == base["p"])).select(
        *rows.columns, (F.col("before") + F.col("local")).alias("rank")
    )


def pack(rows: DataFrame, capacity: Capacity = Capacity()) -> DataFrame:  # noqa: B008
    """Place pieces (column length, 1 to the token capacity) into as few sequences as best-fit decreasing needs.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset, one row for each piece. Ties and repeated rows
    are pieces like any other; an empty table gives an empty table.
    """
    rows = staged(rows.select(*_PIECE.names), "pieces")
    counts = staged(rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    table = {k: np.array(v, dtype=np.int64) for k, v in plan({int(r["length"]): int(r["n"]) for r in counts.collect()}, capacity).items()}
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = _placed(batch.column("length").to_numpy(), batch.column("rank").to_numpy(), shared.value)
            yield emit(_PLACED, **{n: batch.column(n) for n in _PIECE.names}, sequence_id=sequence, offset=offset)

    return ranked(rows, counts).mapInArrow(run, _PIECE_SQL + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: Capacity = Capacity(), vocabulary: str | None = None) -> DataFrame:  # noqa: B008
    """Tokenize whole documents, cut the longer ones and pack all pieces; see ``pieces`` and ``pack``."""
    return pack(pieces(docs, capacity.tokens, vocabulary), capacity)
