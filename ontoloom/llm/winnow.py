"""Benchmark decontamination by winnowing.

Of every nine successive 5-word hashes of a text the least is kept, so two texts that share 13 words in a row keep a hash
inside the shared span in both. Kept hashes of documents and benchmark items are joined; each meeting carries the words
around it and is extended in both directions, and a run as long as the item's window (13 words, or the whole of a shorter
item) is a hit. Items of fewer than 13 words are kept whole: one hash of their own length, with every hash of that length of
a document, which is the same guarantee.

A bitmap of bounded size over the benchmark's hashes goes to all tasks; it only spares rows that the join would drop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.llm.batches import emit, slices, text_hash, texts_of, without
from ontoloom.plans.staging import staged

WINDOW, GRAM = 13, 5
KEEP_OF = WINDOW - GRAM + 1
#: Bits that name a slot of the bitmap, least and most (2 and 128 MB), and those of a slot within a chunk.
SLOT_BITS, MOST_BITS, CHUNK_BITS = 24, 30, 12
_TABLE = bytes((c | 32 if 0x41 <= c <= 0x5A else c) if 0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_P = 0x100000001B3
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes) -> list[bytes]:
    """Words of a text: runs of letters and digits of ASCII and of all bytes past it, A-Z in lower case."""
    return text.translate(_TABLE).split()


def word_hashes(spaced: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, first and end byte of each word of translated text."""
    raw = np.frombuffer(spaced, dtype=np.uint8)
    solid = np.zeros(len(raw) + 2, dtype=np.int8)
    solid[1:-1] = raw != 0x20
    edge = np.diff(solid)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    powers = np.empty(len(raw) + 1, dtype=np.uint64)
    powers[0] = 1
    powers[1:] = np.uint64(_P)
    np.multiply.accumulate(powers, out=powers)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])
    # a word's polynomial times a power of its place: brought to one common power by the inverse, which exists as P is odd
    inverse = np.full(len(raw) + 1, pow(_P, -1, 1 << 64), dtype=np.uint64)
    inverse[0] = 1
    np.multiply.accumulate(inverse, out=inverse)
    h = (sums[end] - sums[start]) * inverse[start]
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32)), start, end


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k successive words."""
    if len(h) < k:
        return np.empty(0, dtype=np.uint64)
    out = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        out = out * _MIX + h[i : len(h) - k + 1 + i]
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32)) ^ np.uint64(k)


def kept(g: np.ndarray, of: int = KEEP_OF) -> np.ndarray:
    """Whether each hash is the least of some window of ``of`` successive ones (of all, if there are fewer). Ties are all kept."""
    if not len(g):
        return np.zeros(0, dtype=bool)
    least = np.lib.stride_tricks.sliding_window_view(g, min(of, len(g))).min(axis=1)
    out = np.zeros(len(g), dtype=bool)
    n = len(g) - len(least)
    for i in range(n + 1):
        out[i : i + len(least)] |= g[i : i + len(least)] == least
    return out


def slot(g: np.ndarray, bits: int) -> np.ndarray:
    return (g >> np.uint64(64 - bits)).astype(np.int64)


_HIT = [("pos", pa.int32()), ("k", pa.int32()), ("hash", pa.int64()), ("mid", pa.string()), ("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))]
_HIT_SQL = "array<struct<pos:int,k:int,hash:bigint,mid:string,left:array<string>,right:array<string>>>"


def _around(own: list[bytes], pos: int, k: int, reach: int) -> dict:
    text = lambda x: x.decode("utf-8", "replace")
    return {
        "pos": pos,
        "k": k,
        "mid": text(b" ".join(own[pos : pos + k])),
        "left": [text(w) for w in own[max(0, pos - reach) : pos][::-1]],
        "right": [text(w) for w in own[pos + k : pos + k + reach]],
    }


def _item_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("item_id", pa.string()), ("need", pa.int32()), ("marks", pa.list_(pa.struct(_HIT)))])
    for part in slices(batches):
        for key, text in zip(part.column("item_id").to_pylist(), texts_of(part), strict=True):
            own = words(text)
            if not own:
                continue
            h = word_hashes(b" ".join(own))[0]
            if len(own) < WINDOW:
                k, at, reach = len(own), np.array([0]), 0
            else:
                k, reach = GRAM, WINDOW - GRAM
                at = np.flatnonzero(kept(grams(h, k)))
            g = grams(h, k)
            marks = [_around(own, int(p), k, reach) | {"hash": int(g[p].view(np.int64))} for p in at]
            yield emit(schema, item_id=[key], need=[min(len(own), WINDOW)], marks=[marks])


def benchmark_marks(benchmark: DataFrame) -> DataFrame:
    """(item_id, need, pos, k, hash, mid, left, right): the kept hashes of every item that has words."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text"))
    found = rows.mapInArrow(_item_marks, f"item_id string, need int, marks {_HIT_SQL}")
    return found.select("item_id", "need", F.explode("marks").alias("m")).select("item_id", "need", "m.*")


def bitmap(marks: DataFrame) -> tuple[int, bytes]:
    """Bits of a slot's name, and a map with a bit set for each hash's leading bits: about 16 slots a hash, 2^30 at most, gathered by chunks."""
    bits = min(MOST_BITS, max(SLOT_BITS, marks.count().bit_length() + 4))
    chunk = bits - CHUNK_BITS
    at = F.shiftrightunsigned("hash", 64 - bits)
    slots = marks.select(at.alias("slot")).distinct()
    rows = slots.groupBy(F.shiftright("slot", chunk).alias("chunk")).agg(F.collect_set(F.col("slot").bitwiseAND((1 << chunk) - 1).cast("int")).alias("in"))
    out = np.zeros(1 << bits - 3, dtype=np.uint8)
    for r in rows.toLocalIterator():
        place = (int(r["chunk"]) << chunk) + np.array(r["in"], dtype=np.int64)
        np.bitwise_or.at(out, place >> 3, (0x80 >> (place & 7)).astype(np.uint8))
    return bits, out.tobytes()


def _document_marks(shared, short: list[int], long_items: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n_words", pa.int64()), ("marks", pa.list_(pa.struct(_HIT)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, packed = shared.value
        packed = np.frombuffer(packed, dtype=np.uint8)
        for part in slices(batches, 1 << 20):
            texts = [t.translate(_TABLE) for t in texts_of(part)]
            flat = b" ".join(texts)
            h, start, _ = word_hashes(flat) if flat else (np.empty(0, np.uint64), np.empty(0, np.int64), None)
            ends = np.cumsum([len(t) + 1 for t in texts])
            bound = np.concatenate([[0], np.searchsorted(start, ends)])
            doc_of = np.repeat(np.arange(len(texts)), np.diff(bound))
            marks: list[list] = [[] for _ in texts]
            own: dict[int, list[bytes]] = {}
            for k in sorted({*short, *[GRAM] * long_items}):
                g = grams(h, k)
                reach = WINDOW - GRAM if k == GRAM and long_items else 0
                place = slot(g, bits)
                for p in np.flatnonzero(packed[place >> 3] & (0x80 >> (place & 7)).astype(np.uint8)):
                    d = int(doc_of[p])
                    lo, hi = int(bound[d]), int(bound[d + 1])
                    if p + k > hi:
                        continue
                    a, b = max(lo, p - KEEP_OF + 1), min(hi - k + 1, p + KEEP_OF)
                    if k not in short and not kept(g[a:b])[p - a]:
                        continue
                    if d not in own:
                        own[d] = texts[d].split()
                    marks[d].append(_around(own[d], int(p - lo), k, reach) | {"hash": int(g[p].view(np.int64))})
            yield emit(schema, doc_id=part.column("doc_id"), h=part.column("h"), n_words=np.diff(bound), marks=marks)

    return run


def _run(x, y):
    """Length of the common beginning of two word arrays."""
    same = F.array_position(F.zip_with(x, y, lambda a, b: F.coalesce(a == b, F.lit(False))), False)
    return F.when(same == 0, F.greatest(F.size(x), F.size(y))).otherwise(same - 1).cast("int")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, contaminated) for every row of ``docs``.

    A word is hit inside any occurrence of a window of 13 item words (of the whole of a shorter item); items lists, sorted as
    strings, the item_ids with such a window. A document is contaminated when a twentieth of its words or more are hit. Null
    and empty texts have no words; items without words match nothing; items with a null id are reported as an empty id.
    """
    return _contamination(docs, benchmark).drop("h")


def _contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``contamination`` with h, the hash of the text."""
    items = staged(benchmark_marks(benchmark).withColumn("item_id", F.coalesce("item_id", F.lit(""))), "item-marks")
    needs = [r[0] for r in items.select("need").distinct().orderBy("need").collect()]  # 13 values at most
    short, long_items = [n for n in needs if n < WINDOW], WINDOW in needs
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(items))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), text_hash().alias("h"))
    marked = rows.mapInArrow(_document_marks(shared, short, long_items), f"doc_id long, h long, n_words long, marks {_HIT_SQL}")
    base = staged(marked.withColumn("row", F.monotonically_increasing_id()), "document-marks")
    found = base.where(F.size("marks") > 0).select("row", F.explode("marks").alias("d")).select("row", "d.*")
    item = items.select("item_id", "need", "k", "hash", *[F.col(c).alias(f"i_{c}") for c in ("mid", "left", "right")])
    met = found.join(item, ["k", "hash"]).where("mid = i_mid")
    back, ahead = _run(F.col("left"), F.col("i_left")), _run(F.col("right"), F.col("i_right"))
    whole = F.col("need") == F.col("k")
    met = met.withColumn("back", F.when(whole, 0).otherwise(back)).withColumn("ahead", F.when(whole, 0).otherwise(ahead))
    met = met.where(F.col("back") + F.col("k") + F.col("ahead") >= F.col("need"))
    span = F.struct((F.col("pos") - F.col("back")).alias("a"), (F.col("pos") + F.col("k") + F.col("ahead")).alias("b"))
    spans = met.select("row", "item_id", span.alias("s"))
    hit = spans.select("row", "s").distinct().select("row", F.explode(F.sequence("s.a", F.col("s.b") - 1)).alias("at"))
    hit = hit.distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    which = spans.select("row", "item_id").distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_items"), F.sort_array(F.collect_list("item_id")).alias("items"))
    out = base.select("row", "doc_id", "h", "n_words").join(hit.join(which, "row"), "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id",
        "h",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents less the contaminated ones, told apart by doc_id and text."""
    return without(docs, _contamination(docs, benchmark).where("contaminated").select("doc_id", "h"))
