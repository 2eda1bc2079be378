"""Exact duplicates by progressive refinement: length, then a hash of a prefix, then a hash of the whole text.

Each step looks only at groups that the step before left with two rows or more; whole texts are hashed for the rows of
such groups alone. Groups are counted by aggregates that combine before the shuffle, never gathered, and rows meet their
group's row by ``spread_join``, which deals a text, prefix or length that very many rows share over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.plans.spread import spread_join
from ontoloom.plans.staging import staged

PREFIX_CHARS = 64


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, content_hash) for every row; texts are equal when their bytes are.

    Null counts as the empty text. The row with the largest doc_id of a class stays; a null doc_id stays only where a class
    has no other. Rows that repeat doc_id and text are one document written twice: each has a row, with the same decision.
    content_hash (sha256) is null where length or prefix already told a text from all others. Empty tables give empty
    tables; other columns are not looked at, whatever their names.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    brief = staged(
        base.select("doc_id", F.octet_length("text").alias("len"), F.xxhash64(F.substring("text", 1, PREFIX_CHARS)).alias("pre")), "brief"
    )
    # rows of one length are first counted by prefix, so a length that very many rows share is a few rows here
    small = staged(brief.groupBy("len", "pre").agg(F.count(F.lit(1)).alias("n")), "prefixes")
    lengths = staged(small.groupBy("len").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("n")).where("rows > 1").drop("rows"), "lengths")
    open_groups = staged(spread_join(small, lengths, ["len"], ["pre"], "left_semi").where("n > 1"), "open-groups")
    whole = base.withColumn("len", F.octet_length("text")).withColumn("pre", F.xxhash64(F.substring("text", 1, PREFIX_CHARS)))
    whole = spread_join(whole, open_groups, ["len", "pre"], ["doc_id"], "left_semi").select("doc_id", "len", "pre", F.sha2("text", 256).alias("content_hash"))
    whole = staged(whole, "whole-hash")
    sizes = whole.groupBy("content_hash").agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"))
    classes = staged(sizes.withColumn("n", F.col("group_size")), "classes")
    grouped = spread_join(whole, classes, ["content_hash"], ["doc_id"]).select("doc_id", "keep_id", "group_size", "content_hash")
    alone = spread_join(brief, open_groups, ["len", "pre"], ["doc_id"], "left_anti").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(None).cast("string").alias("content_hash")
    )
    return grouped.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The documents less the rows that ``exact_classes`` does not keep; whole repeated rows leave one."""
    rows = staged(exact_classes(docs), "classified")
    cols = docs.columns
    gone = rows.where(~F.col("kept")).select(F.col("doc_id").alias("__gone_id"), F.col("content_hash").alias("__gone_hash")).distinct()
    gone = gone.hint("merge")  # these may be a part of all rows
    # a document written twice keeps its doc_id in both rows: those few are narrowed to one by an aggregate
    twice = rows.where("kept and content_hash is not null").groupBy("doc_id", "content_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    twice = staged(twice.select(F.col("doc_id").alias("__twice_id"), F.col("content_hash").alias("__twice_hash")), "twice")
    hashed = F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")), 256)
    this_id = docs["doc_id"].cast("long")
    left = docs.join(gone, this_id.eqNullSafe(gone["__gone_id"]) & (hashed == gone["__gone_hash"]), "left_anti")
    again = this_id.eqNullSafe(twice["__twice_id"]) & (hashed == twice["__twice_hash"])
    one = docs.join(twice, again, "left_semi")
    key = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    one = one.groupBy(F.col("doc_id").alias("__k"), key.alias("__h")).agg(F.any_value(F.struct(*[F.col(f"`{c}`") for c in cols])).alias("__row"))
    return left.join(twice, again, "left_anti").union(one.select(*[F.col(f"__row.`{c}`").alias(c) for c in cols]))
