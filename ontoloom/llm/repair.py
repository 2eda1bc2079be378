"""Token ids as Re-Pair grammars.

Documents in ascending doc_id order are dealt to shards; each shard is one row of a Parquet dataset and holds a grammar:
pairs of ids that are frequent in the shard are replaced, again and again, by nonterminals. A row keeps the rules, the length
each nonterminal expands to, and where each document's symbols begin, so any document is decoded without its neighbours.

Fields of a row (all integers little-endian): shard (long), doc_ids, symbols and lengths (arrays: id, symbols after
replacement, and tokens of each document in order), base (int: the first nonterminal), rules (unsigned 32-bit pairs),
expansion (unsigned 32-bit length of each rule), data (unsigned 32-bit symbols of the whole shard).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ontoloom.llm import tokens
from ontoloom.llm.batches import documents, emit, slices, texts_of
from ontoloom.session import shared_dir

#: Tokens of a shard, about; the least count of a pair that a rule is worth.
SHARD_TOKENS, LEAST_COUNT = 1 << 20, 8
#: Slots (a power of two) of the table that counts pairs, at most.
SLOT_BITS = 20
_SHARD = pa.schema(
    [("shard", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("symbols", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32()))]
    + [("base", pa.int32())]
    + [(n, pa.binary()) for n in ("rules", "expansion", "data")]
)
_SHARD_SQL = "shard long, doc_ids array<long>, symbols array<int>, lengths array<int>, base int, rules binary, expansion binary, data binary"


def _counted(keys: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, pair, counts): places of the keys that occur ``least`` times or more, the number of each one's pair, and counts by pair."""
    bits = min(SLOT_BITS, len(keys).bit_length() + 1)
    slot = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
    # a key is as frequent as its slot of a hash table at most; full slots are counted exactly, those of one key without a sort
    at = np.flatnonzero((np.bincount(slot, minlength=1 << bits) >= least)[slot])
    slot, own = slot[at], keys[at]
    first = np.empty(1 << bits, dtype=np.uint64)
    first[slot] = own
    others = np.flatnonzero(first[slot] != own)
    if len(others):
        slot[others] = (1 << bits) + np.unique(own[others], return_inverse=True)[1]
    counts = np.bincount(slot, minlength=1)
    often = counts[slot] >= least
    number = np.cumsum(counts >= least) - 1
    return at[often], number[slot[often]], counts[counts >= least]


def _best(near: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Whether each occurrence ranks before those that overlap it (``near``: it and the next one do); equal ones never overlap here."""
    wins = np.ones(len(rank), dtype=bool)
    wins[1:] &= ~near | (rank[1:] < rank[:-1])
    wins[:-1] &= ~near | (rank[:-1] < rank[1:])
    return wins


def compress(ids: np.ndarray, ends: np.ndarray, least: int = LEAST_COUNT):
    """(symbols, ends, base, rules, expansion) of ids whose documents end before ``ends``. No rule spans two documents.

    Rounds until no pair occurs ``least`` times. In a round every such pair is ranked by its count (occurrences that do not overlap,
    from the left; ties by the pair), and an occurrence is replaced where it ranks before both pairs that overlap it; a pair that would
    be replaced less than ``least`` times waits. The first pair in rank is always replaced everywhere, as one pair at a time would be.
    A pair can only become frequent where a symbol is new, so later rounds look there and at frequent pairs that are left.
    """
    size, base = len(ids), int(ids.max()) + 1 if len(ids) else 0
    seq, last, gone, mark = ids.astype(np.uint64), *(np.zeros(size + 1, dtype=bool) for _ in range(3))
    last[ends - 1] = True
    after, before = np.arange(1, size + 1), np.arange(-1, size)
    rules, expansion = np.empty((0, 2), dtype=np.uint32), np.empty(0, dtype=np.uint32)
    look = np.flatnonzero(~last[:size])
    while len(look):
        follows = after[look]
        keys = (seq[look] << np.uint64(32)) | seq[follows]
        # of a pair that overlaps itself (a run of one symbol) every second occurrence counts
        same = np.flatnonzero((follows[:-1] == look[1:]) & (keys[1:] == keys[:-1])) + 1
        begins = np.concatenate([[True], np.diff(same) > 1])[: len(same)]
        nth = np.arange(len(same)) - np.maximum.accumulate(np.where(begins, np.arange(len(same)), 0))
        counted = np.ones(len(look), dtype=bool)
        counted[odd := same[nth % 2 == 0]] = False
        own = np.flatnonzero(counted)
        at, pair, counts = _counted(keys[own], least)
        if not len(counts):
            break
        at = own[at]
        value = np.empty(len(counts), dtype=np.uint64)
        value[pair] = keys[at]
        order = np.lexsort((value, -counts))
        ranks = np.empty(len(counts), dtype=np.int64)
        ranks[order] = np.arange(len(counts))
        rank = ranks[pair]
        chosen = _best(follows[at[:-1]] == look[at[1:]], rank)
        fit = np.bincount(rank[chosen], minlength=len(counts)) >= least
        chosen &= fit[rank]
        made = value[order][fit]
        left, right = (made >> np.uint64(32)).astype(np.uint32), (made & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        spans = lambda s: np.where(s < base, 1, expansion[np.maximum(s.astype(np.int64) - base, 0)] if len(expansion) else 1)
        number = base + len(rules) + np.cumsum(fit) - 1
        rules, expansion = np.vstack([rules, np.stack([left, right], axis=1)]), np.concatenate([expansion, (spans(left) + spans(right)).astype(np.uint32)])
        frequent = np.zeros(len(look), dtype=bool)
        frequent[at] = True
        frequent[odd] = frequent[odd - 1]
        where = look[at[chosen]]
        eaten = after[where]
        seq[where], last[where], gone[eaten] = number[rank[chosen]].astype(np.uint64), last[eaten], True
        after[where] = after[eaten]
        before[after[where]] = where
        mark[look[frequent]] = mark[where] = True
        mark[before[where]] = True  # the place before the first is the spare last one
        mark &= ~(gone | last)
        mark[size] = False
        look = np.flatnonzero(mark)
        mark[look] = False
    keep = ~gone[:size]
    return seq[keep].astype(np.uint32), np.flatnonzero(last[:size][keep]) + 1, base, rules.astype(np.uint32), expansion


def _ragged(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Runs of ``flat``, one after another."""
    upto = np.cumsum(size)
    return flat[np.repeat(start - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)]


def expand(symbols: np.ndarray, base: int, rules: np.ndarray) -> np.ndarray:
    """Token ids of any run of symbols, each rule replaced by its pair until none is left."""
    seq = symbols.astype(np.uint32)
    while len(seq) and (deep := seq >= base).any():
        width = np.where(deep, 2, 1)
        out = np.repeat(seq, width)
        at = np.cumsum(width) - width
        pair = rules[seq[deep].astype(np.int64) - base]
        out[at[deep]], out[at[deep] + 1] = pair[:, 0], pair[:, 1]
        seq = out
    return seq


def expand_all(data: np.ndarray, base: int, rules: np.ndarray, expansion: np.ndarray) -> np.ndarray:
    """Token ids of a whole shard: each rule is expanded once, and the symbols are looked up."""
    size = expansion.astype(np.int64)
    flat = np.concatenate([np.arange(base, dtype=np.uint32), expand(base + np.arange(len(rules), dtype=np.uint32), base, rules)])
    at = np.concatenate([np.arange(base), base + np.cumsum(size) - size])
    n = np.concatenate([np.ones(base, dtype=np.int64), size])
    return _ragged(flat, at[data], n[data])


def _shards(path: str, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, held, ids_of, size, encode = TaskContext.get().partitionId(), 0, [], [], 0, tokens.encoder(path)

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(x) for x in held], dtype=np.int32)
            data, ends, base, rules, expansion = compress(np.concatenate(held), np.cumsum(lengths))
            symbols = np.diff(ends, prepend=0).astype(np.int32)
            row = {"shard": (part << 32) + k, "doc_ids": ids_of, "symbols": symbols, "lengths": lengths, "base": base}
            row |= {"rules": rules.astype("<u4").tobytes(), "expansion": expansion.astype("<u4").tobytes(), "data": data.astype("<u4").tobytes()}
            return emit(_SHARD, **{n: [v] for n, v in row.items()})

        for rows in slices(batches, 1 << 20):
            flat, counts = encode(texts_of(rows))
            for doc_id, n, end in zip(rows.column("doc_id").to_pylist(), counts.tolist(), np.cumsum(counts).tolist(), strict=True):
                if held and size + n > shard_tokens:
                    yield flush()
                    k, held, ids_of, size = k + 1, [], [], 0
                held.append(flat[end - n : end])
                ids_of.append(doc_id)
                size += n
        if held:
            yield flush()

    return run


def write_ids(docs: DataFrame, path: str, vocabulary: str | None = None, shard_tokens: int = SHARD_TOKENS) -> None:
    """Write the ids of whole documents, in ascending doc_id order, as a dataset of grammar shards.

    Null texts are empty (an end id alone), null doc_ids come first, rows that repeat a doc_id follow each other. A shard ends
    before the document that would take it past ``shard_tokens``; a longer document is a shard of its own.
    """
    rows = documents(docs)
    # the hash of the text splits a doc_id that very many rows share (null, say)
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id")
    ordered.mapInArrow(_shards(vocabulary or tokens.default_vocabulary(), shard_tokens), _SHARD_SQL).write.parquet(path)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            rules = np.frombuffer(row["rules"], dtype="<u4").reshape(-1, 2)
            ids = expand_all(np.frombuffer(row["data"], dtype="<u4"), row["base"], rules, np.frombuffer(row["expansion"], dtype="<u4"))
            ends = np.cumsum(row["lengths"], dtype=np.int64)
            starts = ends - np.array(row["lengths"], dtype=np.int64)
            raw = memoryview(ids.astype("<u4").tobytes())
            crcs = [tokens.crc(raw[4 * a : 4 * b]) for a, b in zip(starts, ends, strict=True)]
            n = len(starts)
            yield emit(_DECODED, shard=[row["shard"]] * n, doc_id=row["doc_ids"], local=starts, n_tokens=np.diff(ends, prepend=0), ids_crc32=crcs)


_DECODED = pa.schema([(n, pa.int64()) for n in ("shard", "doc_id", "local", "n_tokens", "ids_crc32")])


def read_ids(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files: every document decoded, start counted over all before it."""
    files = spark.read.parquet(path)
    sizes = files.select("shard", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    # one row for each shard of a million tokens, summed by ranges of shards first
    part = F.shiftright("shard", 32)
    by_part = sizes.groupBy(part.alias("part")).agg(F.sum("n").alias("n"))
    base = by_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    inner = F.sum("n").over(Window.partitionBy(part).orderBy("shard")) - F.col("n")
    begin = sizes.select("shard", part.alias("part"), inner.alias("inner")).join(base, "part")
    begin = begin.select("shard", (F.col("part_start") + F.col("inner")).alias("shard_start"))
    docs = files.mapInArrow(_decoded, "shard long, doc_id long, local long, n_tokens long, ids_crc32 long")
    return docs.join(begin, "shard").select("doc_id", (F.col("shard_start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def scratch_path(spark) -> str:
    import uuid

    return f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"


def document_ids(spark, path: str, doc_id: int) -> list[list[int]]:
    """Random access: the ids of one document, decoding its own symbols only."""
    rows = spark.read.parquet(path).where(F.array_contains("doc_ids", F.lit(doc_id).cast("long"))).collect()
    found = []
    for row in rows:
        rules, data = np.frombuffer(row["rules"], dtype="<u4").reshape(-1, 2), np.frombuffer(row["data"], dtype="<u4")
        ends = np.cumsum(row["symbols"])
        for k in [i for i, x in enumerate(row["doc_ids"]) if x == doc_id]:
            found.append(expand(data[ends[k] - row["symbols"][k] : ends[k]], row["base"], rules).tolist())
    return found
