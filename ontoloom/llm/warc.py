"""Fixity of replicated WARC records by Merkle trees.

Pages become WARC records, and the records of 4096 successive keys are a shard, in order of their keys. A leaf holds all records of
a key: their number, their bytes and the sums of their hashes. A node hashes its 16 children in order, each with the range of bytes
it covers, counted from the node's own beginning; a shard has one root. As ranges begin anew in every node, a record that is lost or
shortened changes the nodes above it and no other. An audit compares the roots of two replicas and descends, level by level, only
below nodes that differ, to the records that are damaged, missing or extra.

Hashing and comparing are SQL functions. A node gathers 16 children at most; leaves are sums, which combine before the shuffle, so a
key that very many records share is no burden.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ontoloom.plans.staging import staged

FANOUT, LEVELS = 16, 3
#: Slots of a shard.
SHARD = FANOUT**LEVELS
PRIMARY, REPLICA = 1, -1


def record(url: Column, payload: Column) -> Column:
    """A WARC response record as text. Null urls and payloads are empty."""
    body = F.coalesce(payload.cast("string"), F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "),
        F.coalesce(url.cast("string"), F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """(shard, slot, page_id, length, content): the hash of every record, at its key's slot. Rows with a null id are keyed by url."""
    key = F.coalesce(F.col(id_col).cast("long"), F.pmod(F.xxhash64(F.col(url_col)), F.lit(1 << 40)))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), key.alias("key"), record(F.col(url_col), F.col(body_col)).alias("r"))
    shard, slot = F.floor(F.col("key") / SHARD).cast("long"), F.pmod("key", F.lit(SHARD)).cast("int")
    return rows.select(shard.alias("shard"), slot.alias("slot"), "page_id", F.octet_length("r").cast("long").alias("length"), F.sha2("r", 256).alias("content"))


def _leaves(rows: DataFrame) -> DataFrame:
    """(side, shard, level, node, size, digest) of each slot: sums of the 32-bit parts of its records' hashes, so their order is free and repeats count."""
    parts = [F.sum(F.conv(F.substring("content", 8 * i + 1, 8), 16, 10).cast("long")).alias(f"s{i}") for i in range(8)]
    sums = rows.groupBy("side", "shard", F.col("slot").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("size"), *parts)
    line = F.concat_ws(":", *[F.col(c).cast("string") for c in ("n", "size", *[f"s{i}" for i in range(8)])])
    return sums.select("side", "shard", F.lit(0).alias("level"), "node", "size", F.sha2(line, 256).alias("digest"))


def _up(children: DataFrame, level: int) -> DataFrame:
    kids = F.sort_array(F.collect_list(F.struct("node", "size", "digest")))
    up = children.groupBy("side", "shard", F.floor(F.col("node") / FANOUT).cast("int").alias("parent")).agg(kids.alias("k"), F.sum("size").alias("size"))
    none = F.struct(F.lit(0).cast("long").alias("end"), F.lit("").alias("text"))

    def next_(done: Column, c: Column) -> Column:
        part = F.concat_ws(":", c["node"].cast("string"), done["end"].cast("string"), c["size"].cast("string"), c["digest"])
        return F.struct((done["end"] + c["size"]).alias("end"), F.concat(done["text"], part, F.lit(",")).alias("text"))

    line = F.aggregate("k", none, next_, lambda done: done["text"])
    return up.select("side", "shard", F.lit(level).alias("level"), F.col("parent").alias("node"), "size", F.sha2(line, 256).alias("digest"))


def merkle(rows: DataFrame) -> list[DataFrame]:
    """Nodes (side, shard, level, node, size, digest) of the trees over each side's ``records``: a table for each level, from the slots to the roots.

    Each level is built from the one written before, and a descent reads a level's nodes once and no other's.
    """
    levels = [staged(_leaves(rows), "leaves")]
    for k in range(1, LEVELS + 1):
        levels.append(staged(_up(levels[-1], k), "nodes"))
    return levels


def _starts(slots: DataFrame, shards: DataFrame) -> DataFrame:
    """(shard, slot, p_start, r_start): where a slot's records begin in their shard on each side. A window sees the slots of one shard, 4096 at most."""
    slots = slots.join(shards, "shard", "left_semi")
    before = Window.partitionBy("side", "shard").orderBy("node")
    slots = slots.select("side", "shard", F.col("node").alias("slot"), (F.sum("size").over(before) - F.col("size")).alias("start"))
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("start")))
    return slots.groupBy("shard", "slot").agg(of(PRIMARY).alias("p_start"), of(REPLICA).alias("r_start"))


def audit(primary: DataFrame, replica: DataFrame, **names) -> tuple[DataFrame, DataFrame]:
    """(damage, visited) of two replicas of a page table.

    damage has a row for each record that differs: shard, slot, page_id, start, length, expected, found, copies, state. start is the
    offset in its shard of the slot's first byte (in the replica for extra records), expected and found are hashes, copies counts
    records of equal bytes. A record is damaged where one of its key differs on either side; where several do, nothing tells which became
    which, and they are missing and extra. visited counts the nodes compared by level. Empty replicas differ in every shard of the other.
    """
    both = records(primary, **names).withColumn("side", F.lit(PRIMARY)).union(records(replica, **names).withColumn("side", F.lit(REPLICA)))
    both = staged(both, "records")
    levels = merkle(both)
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("digest")))
    suspects, visited, shards = None, None, None
    for level in range(LEVELS, -1, -1):
        here = levels[level]
        if suspects is not None:
            under = suspects.select("shard", F.col("node").alias("up"))
            here = here.withColumn("up", F.floor(F.col("node") / FANOUT).cast("int")).join(under, ["shard", "up"], "left_semi")
        met = staged(here.groupBy("shard", "node").agg(of(PRIMARY).alias("x"), of(REPLICA).alias("y")), "met")
        seen = met.agg(F.lit(level).alias("level"), F.count(F.lit(1)).alias("compared"), F.count_if(~F.col("x").eqNullSafe(F.col("y"))).alias("differing"))
        visited = seen if visited is None else visited.union(seen)
        suspects = met.where(~F.col("x").eqNullSafe(F.col("y"))).select("shard", "node")
        shards = suspects.select("shard") if shards is None else shards
    bad = suspects.select("shard", F.col("node").alias("slot"))
    held = both.join(bad, ["shard", "slot"], "left_semi")
    # equal records of the two sides cancel: what is left over on one side is gone from, or new to, the other
    over = held.groupBy("shard", "slot", "content").agg(F.sum("side").alias("over"), F.min("page_id").alias("page_id"), F.min("length").alias("length"))
    over = staged(over.where("over <> 0"), "over")
    gone, new = F.col("over") > 0, F.col("over") < 0
    keys = over.groupBy("shard", "slot").agg(
        (F.count_if(gone) == 1).alias("one_gone"),
        (F.count_if(new) == 1).alias("one_new"),
        F.sum("over").alias("balance"),
        F.max("over").alias("copies"),
        F.max(F.when(gone, F.struct("page_id", "length", "content"))).alias("p"),
        F.max(F.when(new, F.struct("page_id", "length", "content"))).alias("r"),
    )
    keys = keys.withColumn("pair", F.col("one_gone") & F.col("one_new") & (F.col("balance") == 0))
    paired = keys.where("pair").select("shard", "slot", F.coalesce("p.page_id", "r.page_id").alias("page_id"), "p.length", F.col("p.content").alias("expected"), F.col("r.content").alias("found"), "copies", F.lit("damaged").alias("state"))
    rest = over.join(keys.where("not pair"), ["shard", "slot"], "left_semi")
    rest = rest.select("shard", "slot", "page_id", "length", F.when(gone, F.col("content")).alias("expected"), F.when(new, F.col("content")).alias("found"), F.abs("over").alias("copies"), F.when(gone, "missing").otherwise("extra").alias("state"))
    out = paired.union(rest).join(_starts(levels[0], shards), ["shard", "slot"], "left")
    start = F.when(F.col("state") == "extra", F.col("r_start")).otherwise(F.col("p_start"))
    return out.select("shard", "slot", "page_id", start.alias("start"), "length", "expected", "found", "copies", "state"), visited
