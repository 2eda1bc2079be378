"""Near-duplicate documents by SimHash.

A fingerprint of 64 bits is embedded as the bit counts of 32 two-bit segments, so the Manhattan distance between two
embeddings never exceeds the fingerprints' Hamming distance. Counts are held in unary code (a segment's bits, ones
first), which makes that distance one XOR and a popcount. The segments form six groups of axes; two points within
distance three differ on at most three groups, so they share a cell of one of the 20 grids over three groups. Cells are
joined, pairs beyond the lower bound go, and what is left is verified on the fingerprints.

Work in a crowded cell: its members are dealt to blocks of bounded size, each two blocks of a cell make one row, and that
row gives a spanning forest of its links, never all pairs. Equal fingerprints meet as one row before any join.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoloom.llm.batches import documents, emit, slices, text_hash, texts_of, without
from ontoloom.operators.components import connected_components
from ontoloom.plans.spread import spread_join
from ontoloom.plans.staging import staged

SHINGLE_WORDS, HASH_SEED, MAX_BITS = 3, 42, 3
#: Members of a crowded cell that one row of work holds at most, about.
BLOCK = 2048
_ODD = 0x5555555555555555
_GROUP_SEGMENTS = (6, 5, 5, 6, 5, 5)
_FP = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("h", pa.int64())])
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingles(text: bytes, width: int = SHINGLE_WORDS) -> list[bytes]:
    """Word shingles of a text with A-Z in lower case; a text of fewer words is one shingle, one without words none."""
    words = text.lower().split()
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))


def fingerprint_batch(texts: list[bytes], width: int = SHINGLE_WORDS) -> np.ndarray:
    """Signed 64-bit fingerprints; zero for a text without words."""
    digest = partial(xxhash.xxh64_intdigest, seed=HASH_SEED)
    out, hashes, counts = np.zeros(len(texts), dtype=np.uint64), [], []
    for text in texts:
        found = shingles(text, width)
        counts.append(len(found))
        hashes.extend(map(digest, found))
    counts = np.array(counts)
    filled = np.flatnonzero(counts)
    if not len(filled):
        return out.view(np.int64)
    starts = np.concatenate([[0], np.cumsum(counts[filled])[:-1]])
    h = np.array(hashes, dtype=np.uint64)
    for bit in range(64):
        ones = np.add.reduceat(((h >> np.uint64(bit)) & np.uint64(1)).astype(np.int32), starts)
        out[filled] |= (2 * ones > counts[filled]).astype(np.uint64) << np.uint64(bit)
    return out.view(np.int64)


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1 << 20):
            yield emit(_FP, doc_id=part.column("doc_id"), fp=fingerprint_batch(texts_of(part), width), h=part.column("h"))

    return run


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp, h) of every document, of whole texts; h is ``text_hash``."""
    rows = documents(docs.select("doc_id", "text")).withColumn("h", text_hash())
    return rows.mapInArrow(_fingerprints(width), "doc_id long, fp long, h long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def embedding(fp: Column) -> Column:
    """Bit counts of the two-bit segments in unary code: ``bit_count(x ^ y)`` is the Manhattan distance."""
    half = F.shiftrightunsigned(fp, 1)
    either, both = fp.bitwiseOR(half).bitwiseAND(F.lit(_ODD)), fp.bitwiseAND(half).bitwiseAND(F.lit(_ODD))
    return either.bitwiseOR(F.shiftleft(both, 1))


def grid_masks() -> list[int]:
    """For each grid, the bits of the segments on its axes."""
    groups, at = [], 0
    for n in _GROUP_SEGMENTS:
        groups.append(((1 << 2 * n) - 1) << at)
        at += 2 * n
    return [_signed(a | b | c) for a, b, c in combinations(groups, 3)]


def _embed(fps: np.ndarray) -> np.ndarray:
    x, odd = fps.view(np.uint64), np.uint64(_ODD)
    half = x >> np.uint64(1)
    return ((x | half) & odd) | (((x & half) & odd) << np.uint64(1))


def forest(fps: np.ndarray, bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph that links values at ``bits`` or fewer differing bits.

    Breadth first: what a value reaches leaves the rest, so a dense group costs few passes.
    """
    fps = np.unique(fps)
    near, raw, rest, edges = _embed(fps), fps.view(np.uint64), np.arange(len(fps)), []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            close = np.bitwise_count(near[rest] ^ near[at]) <= bits
            close[close] = np.bitwise_count(raw[rest[close]] ^ raw[at]) <= bits
            if close.any():
                reached, rest = rest[close], rest[~close]
                edges += [(int(fps[at]), int(fps[x])) for x in reached]
                queue += reached.tolist()
    return edges


def _forests(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("x"), batch.column("y"), strict=True):
                members = np.concatenate([np.asarray(v.values.to_numpy(zero_copy_only=False)) for v in (a, b)])
                if edges := forest(members, bits):
                    yield emit(_LINK, a=[e[0] for e in edges], b=[e[1] for e in edges])

    return run


def links(distinct: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """(a, b): links that connect all fingerprints of ``distinct`` (column fp) that lie within ``bits`` of each other."""
    if not 0 <= bits <= MAX_BITS:
        raise ValueError("the grids are built for three differing bits at most")
    cell = F.array(*[embedding(F.col("fp")).bitwiseAND(F.lit(m)) for m in grid_masks()])
    cells = distinct.select("fp", F.posexplode(cell).alias("grid", "cell"))
    held = staged(
        cells.groupBy("grid", "cell")
        .agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
        .where("n > 1"),
        "cells",
    )
    apart = lambda x, y: F.bit_count(x.bitwiseXOR(y))
    twos = held.where("n = 2").where(apart(embedding(F.col("a")), embedding(F.col("b"))) <= bits).where(apart(F.col("a"), F.col("b")) <= bits)
    crowded = held.where("n > 2").select("grid", "cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    members = cells.join(crowded, ["grid", "cell"])
    blocks = staged(
        members.withColumn("block", F.pmod(F.xxhash64("fp", F.lit("block")), F.col("blocks")).cast("int"))
        .groupBy("grid", "cell", "blocks", "block")
        .agg(F.collect_list("fp").alias("fps")),
        "blocks",
    )
    one = blocks.where("blocks = 1").select(F.col("fps").alias("x"), F.array().cast("array<bigint>").alias("y"))
    # each block goes to every pair of blocks that it is part of, so a crowded cell's pairs are spread over all tasks
    many = blocks.where("blocks > 1").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pair = [F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")]
    met = many.groupBy("grid", "cell", *pair).agg(F.min_by("fps", "block").alias("x"), F.max_by("fps", "block").alias("y"))
    found = one.union(met.select("x", "y")).mapInArrow(_forests(bits), "a long, b long")
    return twos.select("a", "b").union(found).distinct()


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS, bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the least doc_id reachable over links.

    Null and empty texts, and texts of white space alone, have fingerprint zero and are linked like others. A null doc_id
    is never a component_id unless its component has no other. Rows that repeat a doc_id each get a row. An empty table
    gives an empty table. Columns besides doc_id and text are not looked at.
    """
    return _grouped(docs, width, bits).select("doc_id", "fp", "component_id")


def _grouped(docs: DataFrame, width: int = SHINGLE_WORDS, bits: int = MAX_BITS) -> DataFrame:
    """``near_duplicates`` with h, the hash of the text, and group, which no two components share."""
    rows = staged(fingerprints(docs, width), "fingerprints")
    distinct = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "distinct")
    member = connected_components(links(distinct, bits))
    joined = distinct.join(member.withColumnRenamed("member", "fp"), "fp")
    least = joined.groupBy("component").agg(F.min("first_id").alias("least_id"))
    of_fp = staged(joined.join(least, "component").select("fp", "component", "least_id"), "reached")
    named = distinct.join(of_fp, "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id"), F.coalesce("component", "fp").alias("group"), "n")
    return spread_join(rows, staged(named, "named"), ["fp"], ["doc_id", "h"]).select("doc_id", "fp", "component_id", "h", "group")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each component: the least doc_id (null last), of several such rows the least text hash.

    Rows that repeat both doc_id and text are one document; where it stays, one of them does.
    """
    rows = staged(_grouped(docs), "grouped")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    crowded = staged(rows.groupBy("group").agg(F.min(first).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1"), "groups")
    found = staged(spread_join(rows, crowded, ["group"], ["doc_id", "h"]).withColumn("stays", F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("h") == F.col("best.h"))), "crowded")
    left = without(docs, found.where("not stays").select("doc_id", "h"))
    twice = staged(found.where("stays").groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "twice")
    cols = docs.columns
    again = twice.select(F.col("doc_id").alias("__id"), F.col("h").alias("__hash"))
    keyed = left.join(again, left["doc_id"].cast("long").eqNullSafe(again["__id"]) & (text_hash(left["text"]) == again["__hash"]), "left_semi")
    one = keyed.groupBy(F.col("doc_id").alias("__k"), text_hash().alias("__h")).agg(F.any_value(F.struct(*[F.col(f"`{c}`") for c in cols])).alias("__row"))
    return without(left, twice).union(one.select(*[F.col(f"__row.`{c}`").alias(c) for c in cols]))
