"""Hard negatives: for an anchor and one of its positives, the best rows of other labels whose score lies in a window below the positive's.

Scores are integer inner products of quantised vectors. Every row stores its angles to a few reference directions. For an anchor and a
row, the triangle rule on the sphere gives, from each reference, a least and a greatest angle between the two: |s - t| and
min(s + t, 2 pi - s - t). Cosines of these, times the norms, rounded outwards, bound the score; only rows whose bounds overlap a window
that is still open are scored, exactly.

Anchors are dealt into chunks by nearest reference, all rows into blocks by nearest reference, and blocks into groups, each of bounded
bytes. A chunk meets the groups one by one, a pair of them a task; pairs of a chunk and a block that can't reach a window are dropped
before any row moves. A task keeps only the best few for each window of its chunk, and these meet at the end. Anchors and rows are never
collected; references come from a sample of bounded size, and no result depends on them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ontoloom.plans.staging import staged
from ontoloom.session import ship_package

# Fixed values of the search: positives of an anchor, negatives of a window, the window's lower end in fifths of the positive's score, scale of components.
POSITIVES, NEGATIVES, LOWER_FIFTHS, SCALE = 5, 5, 4, 256.0
#: Reference directions; rows and bytes of the sample that they are fitted to (those of least hash).
REFERENCES, SAMPLE_ROWS, SAMPLE_BYTES = 16, 4096, 32 << 20
#: Rows of a block; rows and bytes of a chunk of anchors and of a group of blocks; groups at least, so that small tables spread too.
BLOCK_ROWS, CHUNK_ROWS, CHUNK_BYTES, GROUPS = 2048, 1 << 16, 24 << 20, 32
#: Bytes of vectors that a task holds back while it fills blocks; anchors that are bounded together; chunk summaries that are broadcast.
HELD_BYTES, TILE, MOST_SUMMARIES = 32 << 20, 128, 50_000
#: Stored angles are off by less than half of this (their cosines by 1e-13, single precision by 2e-7).
_SLACK = 1e-5
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max

_PACK = [
    ("rows", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary()), ("wide", pa.bool_()), ("norms", pa.binary()), ("angles", pa.binary()),
    ("low", pa.list_(pa.float32())), ("high", pa.list_(pa.float32())), ("norm", pa.float64()),
]
_PACK_SQL = "rows int, ids binary, labels binary, vectors binary, wide boolean, norms binary, angles binary, low array<float>, high array<float>, norm double"


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, quantised and filled up with zeros, and which of them have only finite components."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    lengths = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), dtype=np.float64)
    lengths = np.nan_to_num(lengths).astype(np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.zeros((len(lengths), dim))
    with np.errstate(over="ignore"):
        out[row, at] = np.clip(np.floor(SCALE * flat), float(_LEAST), float(_MOST))
    good = np.ones(len(lengths), dtype=bool)
    good[row[~np.isfinite(flat)]] = False
    out[~good] = 0
    return out, good


def _angles(vectors: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and angles to each direction; a zero vector is at right angles to all."""
    most = np.maximum(np.abs(vectors).max(axis=1, initial=0), 1)
    norms = np.sqrt(((vectors / most[:, None]) ** 2).sum(axis=1)) * most
    cosines = (vectors @ directions.T) / np.where(norms > 0, norms, 1)[:, None]
    return norms, np.arccos(np.clip(cosines, -1, 1)).astype(np.float32)


def fit_directions(sample: np.ndarray, k: int = REFERENCES, rounds: int = 6) -> np.ndarray:
    """Unit directions: far from each other at first, then means of the sample's rows nearest to them."""
    norms = np.linalg.norm(sample, axis=1)
    unit = sample[norms > 0] / norms[norms > 0][:, None]
    if not len(unit):
        return np.eye(1, sample.shape[1])
    chosen = [unit[0]]
    nearest = unit @ unit[0]
    while len(chosen) < min(k, len(unit)):
        chosen.append(unit[int(nearest.argmin())])
        nearest = np.maximum(nearest, unit @ chosen[-1])
    directions = np.array(chosen)
    for _ in range(rounds):
        own = (unit @ directions.T).argmax(axis=1)
        for c in range(len(directions)):
            mean = unit[own == c].sum(axis=0)
            if (size := np.linalg.norm(mean)) > 1e-9:
                directions[c] = mean / size
    return directions


def _packed(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, norms: np.ndarray, angles: np.ndarray) -> dict:
    wide = bool(np.abs(vectors).max(initial=0) >= 1 << 24)  # else single precision holds the integers
    return {
        "rows": len(ids), "ids": ids.astype("<i8").tobytes(), "labels": labels.astype("<i8").tobytes(), "vectors": vectors.astype("<f8" if wide else "<f4").tobytes(),
        "wide": wide, "norms": norms.astype("<f8").tobytes(), "angles": angles.astype("<f4").tobytes(), "low": angles.min(axis=0), "high": angles.max(axis=0), "norm": float(norms.max()),
    }


def _batch(rows: list[dict], fields: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], type=t) for n, t in fields], schema=pa.schema(fields))


class _Pack:
    """A packed row read back."""

    def __init__(self, row: dict):
        n = row["rows"]
        self.ids, self.labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
        self.vectors = np.frombuffer(row["vectors"], "<f8" if row["wide"] else "<f4").reshape(n, -1)
        self.norms, self.angles = np.frombuffer(row["norms"], "<f8"), np.frombuffer(row["angles"], "<f4").reshape(n, -1)


def _rows(batch: pa.RecordBatch, dim: int, directions: np.ndarray):
    vectors, good = _matrix(batch.column("vector"), dim)
    ids, labels = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False), dtype=np.int64)[good] for c in ("vec_id", "label"))
    norms, angles = _angles(vectors[good], directions)
    return ids, labels, vectors[good], norms, angles


_BLOCK = [("cell", pa.int32()), *_PACK]


def _blocks(dim: int, directions: np.ndarray):
    """Rows by nearest direction, in blocks; when too much is held back the largest part becomes a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        sizes: dict[int, int] = {}

        def out(cell: int) -> pa.RecordBatch:
            parts = [np.concatenate(x) for x in zip(*held.pop(cell), strict=True)]
            order = np.argsort(parts[4][:, cell], kind="stable")
            del sizes[cell]
            return _batch([{"cell": cell} | _packed(*[x[order] for x in parts])], _BLOCK)

        for batch in batches:
            step = max(1, (4 << 20) // (8 * max(dim, 1)))
            for at in range(0, batch.num_rows, step):
                rows = _rows(batch.slice(at, step), dim, directions)
                cells = rows[4].argmin(axis=1) if len(rows[0]) else np.zeros(0, dtype=int)
                for cell in np.unique(cells).tolist():
                    own = np.flatnonzero(cells == cell)
                    for a in range(0, len(own), BLOCK_ROWS):
                        part = own[a : a + BLOCK_ROWS]
                        held.setdefault(cell, []).append([x[part] for x in rows])
                        sizes[cell] = sizes.get(cell, 0) + len(part)
                        if sizes[cell] >= BLOCK_ROWS:
                            yield out(cell)
                while sizes and sum(sizes.values()) * 8 * dim > HELD_BYTES:
                    yield out(max(sizes, key=sizes.__getitem__))
        for cell in list(held):
            yield out(cell)

    return run


_ANCHOR = [("vec_id", pa.int64()), ("label", pa.int64()), ("cell", pa.int32()), ("vector", pa.list_(pa.float64()))]


def _anchor_rows(dim: int, directions: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, vectors, _, angles = _rows(batch, dim, directions)
            if len(ids):
                yield _batch([{"vec_id": i, "label": c, "cell": a, "vector": v} for i, c, a, v in zip(ids, labels, angles.argmin(axis=1), vectors, strict=True)], _ANCHOR)

    return run


def exact_scores(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Inner products of rows of integers, each below ``bound``: in the narrowest number that holds all sums; past long, held at its ends."""
    if bound < 1 << 24:
        return a.astype(np.float32, copy=False) @ b.astype(np.float32, copy=False).T
    if bound < 1 << 53:
        return a.astype(np.float64, copy=False) @ b.astype(np.float64, copy=False).T
    whole = np.vectorize(int, otypes=[object])
    exact = whole(a).dot(whole(b).T) if a.shape[1] else np.zeros((len(a), len(b)), dtype=object)
    return np.clip(exact, _LEAST + 1, _MOST).astype(np.int64)


def _below(values: np.ndarray, kind) -> np.ndarray:
    """Integers as numbers of ``kind`` that are not greater."""
    if np.issubdtype(kind, np.integer):
        return values
    out = values.astype(kind)
    return np.where(out.astype(np.float64) > values, np.nextafter(out, -np.inf, dtype=kind), out) if kind == np.float32 else np.nextafter(out, -np.inf)


def _above(values: np.ndarray, kind) -> np.ndarray:
    return values if np.issubdtype(kind, np.integer) else np.nextafter(values.astype(kind), np.inf)


class Best:
    """The best few (score, id) of each slot: higher scores first, then smaller ids."""

    def __init__(self, slots: int, keep: int):
        self.score, self.id = np.full((slots, keep), _LEAST), np.full((slots, keep), _MOST)

    def add(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        last, last_id = self.score[slots, -1], self.id[slots, -1]
        ahead = (scores > last) | ((scores == last) & (ids < last_id))
        slots, scores, ids = slots[ahead], scores[ahead], ids[ahead]
        if not len(slots):
            return
        keep, own = self.score.shape[1], np.unique(slots)
        slots = np.concatenate([np.repeat(own, keep), slots])
        scores, ids = np.concatenate([self.score[own].ravel(), scores]), np.concatenate([self.id[own].ravel(), ids])
        order = np.lexsort((ids, ~scores, slots))
        slots, scores, ids = slots[order], scores[order], ids[order]
        first = np.flatnonzero(np.append(True, slots[1:] != slots[:-1]))
        rank = np.arange(len(slots)) - np.repeat(first, np.diff(np.append(first, len(slots))))
        kept = rank < keep
        self.score[slots[kept], rank[kept]], self.id[slots[kept], rank[kept]] = scores[kept], ids[kept]


def reachable(anchors: _Pack, own: slice, rows: _Pack, low: float, high: float) -> np.ndarray:
    """Rows whose score with some of these anchors may lie between ``low`` and ``high``, by bounds from every reference."""
    lo, hi = anchors.angles[own].min(axis=0).astype(np.float64), anchors.angles[own].max(axis=0).astype(np.float64)
    most, least = anchors.norms[own].max(), anchors.norms[own].min()
    t = rows.angles.astype(np.float64)
    nearest = np.maximum(np.maximum(t - hi, lo - t).max(axis=1) - _SLACK, 0)
    farthest = np.minimum(np.minimum(t + hi, 2 * np.pi - t - lo).min(axis=1) + _SLACK, np.pi)
    upper = np.maximum(np.cos(np.minimum(nearest, np.pi)), 0) * most * rows.norms
    down = np.cos(farthest)
    lower = down * np.where(down > 0, least, most) * rows.norms
    spare = 1 + 1e-9 * most * rows.norms
    high = np.inf if high >= 2.0**62 else high  # scores past long are held there
    return np.flatnonzero((upper + spare >= low) & (lower - spare <= high))


def _tiles(n: int) -> Iterator[slice]:
    return (slice(a, min(a + TILE, n)) for a in range(0, n, TILE))


def positives_of(anchors: _Pack, blocks: list[_Pack], need: np.ndarray, keep: int) -> Best:
    """The best rows of each anchor's label but itself; ``need`` is a score that the last of them is known to reach."""
    best = Best(len(anchors.ids), keep)
    for rows in blocks:
        for own in _tiles(len(anchors.ids)):
            floor = np.maximum(need[own], best.score[own, -1])
            able = reachable(anchors, own, rows, float(floor.min()), np.inf)
            able = able[np.isin(rows.labels[able], anchors.labels[own])] if len(able) else able
            if not len(able):
                continue
            scores = exact_scores(anchors.vectors[own], rows.vectors[able], anchors.norms[own].max() * rows.norms[able].max() * (1 + 1e-9))
            a, x = np.nonzero((scores >= _below(floor, scores.dtype)[:, None]) & (anchors.labels[own][:, None] == rows.labels[able]))
            x_ids, value = rows.ids[able][x], scores[a, x].astype(np.int64)
            other = (x_ids != anchors.ids[own][a]) & (value >= floor[a])
            best.add(own.start + a[other], value[other], x_ids[other])
    return best


def window(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of a negative beside a positive of that score; empty where it is negative."""
    return LOWER_FIFTHS * (score // 5) - (-LOWER_FIFTHS * (score % 5)) // 5, score


def negatives_of(anchors: _Pack, blocks: list[_Pack], positive: np.ndarray, there: np.ndarray, keep: int) -> Best:
    """The best rows of other labels in each window; slot a * k + j is the window of anchor a's positive j, of that score and present or not."""
    low, high = window(positive)
    shut = ~there | (low > high)
    low, high = np.where(shut, _MOST, low), np.where(shut, _LEAST, high)
    k, best = positive.shape[1], Best(positive.size, keep)
    for rows in blocks:
        for own in _tiles(len(anchors.ids)):
            floor = np.maximum(low[own], best.score[:, -1].reshape(-1, k)[own])
            bottom, top = floor.min(axis=1), high[own].max(axis=1)
            if (bottom > top).all():
                continue
            able = reachable(anchors, own, rows, float(bottom.min()), float(top.max()))
            if not len(able):
                continue
            scores = exact_scores(anchors.vectors[own], rows.vectors[able], anchors.norms[own].max() * rows.norms[able].max() * (1 + 1e-9))
            near = (scores >= _below(bottom, scores.dtype)[:, None]) & (scores <= _above(top, scores.dtype)[:, None])
            a, x = np.nonzero(near & (anchors.labels[own][:, None] != rows.labels[able]))
            value, ids = scores[a, x].astype(np.int64), rows.ids[able][x]
            for j in range(k):
                fits = (value >= floor[a, j]) & (value <= high[own][a, j])
                best.add((own.start + a[fits]) * k + j, value[fits], ids[fits])
    return best


_CHUNK = [("chunk", pa.int32()), *_PACK, ("need", pa.binary()), ("least", pa.float64())]
_CHUNK_SQL = f"chunk int, {_PACK_SQL}, need binary, least double"


def _chunks(directions: np.ndarray, keep: int):
    """One packed row of a chunk's anchors; what they score among themselves already tells what the last positive reaches at least."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        vectors = np.asarray(table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(table.num_rows, -1)
        norms, angles = _angles(vectors, directions)
        cells = angles.argmin(axis=1)
        ids, labels = table.column("vec_id").to_numpy(), table.column("label").to_numpy()
        order = np.lexsort((ids, angles[np.arange(len(cells)), cells], cells))
        packed = _packed(*[x[order] for x in (ids, labels, vectors, norms, angles)])
        one = _Pack(packed)
        need = positives_of(one, [one], np.full(len(ids), _LEAST), keep).score[:, -1]
        row = {"chunk": key[0].as_py()} | packed | {"need": need.astype("<i8").tobytes(), "least": float(need.min())}
        return pa.Table.from_batches([_batch([row], _CHUNK)])

    return run


_FOUND = [("chunk", pa.int32()), ("slot", pa.int32()), ("anchor_id", pa.int64()), ("found_id", pa.int64()), ("score", pa.int64())]
_FOUND_SQL = "chunk int, slot int, anchor_id long, found_id long, score long"


def _positives(keep: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.schema(_FOUND).empty_table()
        row = left.to_pylist()[0]
        anchors = _Pack(row)
        best = positives_of(anchors, [_Pack(r) for r in _by_cell(right)], np.frombuffer(row["need"], "<i8"), keep)
        slot, rank = np.nonzero(best.score > _LEAST)
        columns = [np.full(len(slot), row["chunk"]), slot, anchors.ids[slot], best.id[slot, rank], best.score[slot, rank]]
        return pa.Table.from_arrays([pa.array(c, type=t) for c, (_, t) in zip(columns, _FOUND, strict=True)], schema=pa.schema(_FOUND))

    return run


def _by_cell(table: pa.Table) -> list[dict]:
    return sorted(table.to_pylist(), key=lambda r: (r["cell"], r["ids"]))


_WINDOWS_SQL = f"chunk int, {_PACK_SQL}, positive_ids binary, positive_scores binary, there binary, least double"
_WINDOWS = [("chunk", pa.int32()), *_PACK, ("positive_ids", pa.binary()), ("positive_scores", pa.binary()), ("there", pa.binary()), ("least", pa.float64())]


def _windows(keep: int):
    """A chunk with its anchors' positives, and the least score that any window asks for."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        at = right.column("slot").to_numpy(), right.column("rank").to_numpy() - 1
        shape = (row["rows"], keep)
        ids, scores, there = np.zeros(shape, dtype="<i8"), np.zeros(shape, dtype="<i8"), np.zeros(shape, dtype=bool)
        ids[at], scores[at], there[at] = right.column("found_id").to_numpy(), right.column("score").to_numpy(), True
        low, high = window(scores)
        open_ = there & (low <= high)
        row |= {"positive_ids": ids.tobytes(), "positive_scores": scores.tobytes(), "there": there.tobytes(), "least": float(low[open_].min()) if open_.any() else np.inf}
        return pa.Table.from_batches([_batch([row], _WINDOWS)])

    return run


_NEGATIVE = [
    ("chunk", pa.int32()), ("slot", pa.int32()), ("positive_rank", pa.int32()), ("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64()),
    ("negative_id", pa.int64()), ("negative_score", pa.int64()),
]
_NEGATIVE_SQL = "chunk int, slot int, positive_rank int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def _negatives(keep: int, keep_positives: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.schema(_NEGATIVE).empty_table()
        row = left.to_pylist()[0]
        anchors = _Pack(row)
        ids, scores = (np.frombuffer(row[c], "<i8").reshape(-1, keep_positives) for c in ("positive_ids", "positive_scores"))
        best = negatives_of(anchors, [_Pack(r) for r in _by_cell(right)], scores, np.frombuffer(row["there"], bool).reshape(ids.shape), keep)
        where, rank = np.nonzero(best.score > _LEAST)
        slot, j = where // keep_positives, where % keep_positives
        columns = [np.full(len(slot), row["chunk"]), slot, j + 1, anchors.ids[slot], ids[slot, j], scores[slot, j], best.id[where, rank], best.score[where, rank]]
        return pa.Table.from_arrays([pa.array(c, type=t) for c, (_, t) in zip(columns, _NEGATIVE, strict=True)], schema=pa.schema(_NEGATIVE))

    return run


def _pairs(chunks: DataFrame, blocks: DataFrame, n_chunks: int, groups: int):
    """Chunks and blocks by (chunk, group), without blocks that no anchor of the chunk can need."""
    summary = chunks.select("chunk", F.col("low").alias("c_low"), F.col("high").alias("c_high"), F.col("norm").alias("c_norm"), F.col("least").alias("c_least"))
    summary = F.broadcast(summary) if n_chunks <= MOST_SUMMARIES else summary
    dealt = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1)))).join(summary, "chunk")
    gap = F.transform(F.arrays_zip("low", "high", "c_low", "c_high"), lambda z: F.greatest(z["low"] - z["c_high"], z["c_low"] - z["high"]))
    nearest = F.greatest(F.array_max(gap).cast("double") - F.lit(_SLACK), F.lit(0.0))
    upper = F.greatest(F.cos(F.least(nearest, F.lit(np.pi))), F.lit(0.0)) * F.col("norm") * F.col("c_norm")
    dealt = dealt.where(upper + 1 + F.lit(1e-9) * F.col("norm") * F.col("c_norm") >= F.col("c_least")).drop("c_low", "c_high", "c_norm", "c_least")
    left = chunks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).groupBy("chunk", "group")
    return left.cogroup(dealt.groupBy("chunk", "group"))


def _first(rows: DataFrame, keys: list[str], order: list[Column], keep: int) -> DataFrame:
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("rank") <= keep)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank) for every window's negatives.

    Components x count as floor(256 x). Rows with a null id, label or vector, or a component that is null or not finite, take no part.
    Shorter vectors are filled up with zeros; scores past the range of long are held at its ends, and so are components. Scores tie by
    smaller id. A repeated row is a row and can be positive or negative more than once, but not of an anchor with its id; rows that are
    alike in id, label and vector are one anchor, others of one id are anchors of their own. Windows without a row give none; an anchor
    without rows of its label gives none; an empty table gives an empty table. Further columns, whatever their names, are not looked at.
    """
    spark = rows.sparkSession
    ship_package(spark)
    base = rows.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"), is_anchor.alias("anchor")
    ).where("vec_id is not null and label is not null and vector is not null")
    size = base.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("vector")).alias("dim")).first()
    dim = max(1, size["dim"] or 1)
    drawn = base.select("vector", F.xxhash64("vec_id", "label").alias("h"), "vec_id").orderBy("h", "vec_id").limit(max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim))))
    drawn = drawn.select("vector").toArrow().column("vector")
    directions = fit_directions(_matrix(drawn, dim)[0] if len(drawn) else np.zeros((0, dim)))
    blocks = staged(base.drop("anchor").mapInArrow(_blocks(dim, directions), f"cell int, {_PACK_SQL}"), "blocks")
    anchors = base.where("anchor").drop("anchor").mapInArrow(_anchor_rows(dim, directions), "vec_id long, label long, cell int, vector array<double>")
    anchors = staged(anchors.dropDuplicates(["vec_id", "label", "vector"]), "anchors")
    most = max(1, min(CHUNK_ROWS, CHUNK_BYTES // (8 * dim)))
    groups = max(GROUPS, -(-size["rows"] // most))
    blocks = blocks.withColumn("group", F.pmod(F.xxhash64("ids", "vectors"), F.lit(groups)).cast("int"))
    places, n_chunks, room = [], 0, 0
    for r in sorted(anchors.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()):  # one row a direction
        if r["n"] > room:
            parts = -(-r["n"] // most)
            n_chunks, room = n_chunks + parts, most - r["n"] if parts == 1 else 0
        else:
            parts, room = 1, room - r["n"]
        places.append((r["cell"], n_chunks - parts, parts))
    if not places:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long, positive_rank int")
    places = F.broadcast(spark.createDataFrame(places, "cell int, first int, parts int"))
    anchors = anchors.join(places, "cell").withColumn("chunk", (F.col("first") + F.pmod(F.xxhash64("vec_id", "vector"), F.col("parts"))).cast("int"))
    chunks = staged(anchors.select("chunk", "vec_id", "label", "vector").groupBy("chunk").applyInArrow(_chunks(directions, positives), _CHUNK_SQL), "chunks")
    found = _pairs(chunks, blocks, n_chunks, groups).applyInArrow(_positives(positives), _FOUND_SQL)
    found = staged(_first(found, ["chunk", "slot"], [F.col("score").desc(), F.col("found_id")], positives), "positives")
    with_windows = chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(_windows(positives), _WINDOWS_SQL)
    with_windows = staged(with_windows.where(F.col("least") < float("inf")), "windows")
    got = _pairs(with_windows, blocks, n_chunks, groups).applyInArrow(_negatives(negatives, positives), _NEGATIVE_SQL)
    got = _first(got, ["chunk", "slot", "positive_rank"], [F.col("negative_score").desc(), F.col("negative_id")], negatives)
    return got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank")
