"""Joins whose keys may hold a large share of all rows, and joins to a table that is small beside them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoloom.plans.staging import staged

#: A table of this many rows at most is broadcast whole. Beyond it, a key with more than one in PARTS of all rows is hot, so there are
#: fewer hot keys than PARTS.
SMALL_ROWS, PARTS = 100_000, 1000
#: Bytes of a table that is sent to all tasks where many rows meet it; a row counts as its texts and so many bytes besides.
SMALL_BYTES, ROW_BYTES = 64 << 20, 64


def small(table: DataFrame, made_of: DataFrame | None = None) -> DataFrame:
    """``table``, to be broadcast if the rows it is made of (its own) have at most ``SMALL_BYTES``: what it is joined to then stays where it is. Else as it is."""
    rows = table if made_of is None else made_of
    texts = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in rows.columns]
    size = rows.agg(F.sum(reduce(Column.__add__, texts, F.lit(ROW_BYTES)).cast("long")).alias("n")).first()["n"]
    return F.broadcast(table) if (size or 0) <= SMALL_BYTES else table


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], mix: list[str], how: str = "inner", n: str = "n") -> DataFrame:
    """``rows`` joined to ``table``, which has a row for each key and says in ``n`` how many of ``rows`` have that key.

    A small table is broadcast: then no row moves. Else a hot key's rows are dealt over as many tasks as it is hot times over, by a hash of their columns ``mix``, and its row of the
    table goes to each of these; the table of hot keys is below ``PARTS`` rows and is broadcast. Keys are not null. ``n`` is dropped.
    """
    size = table.agg(F.count(F.lit(1)).alias("keys"), F.sum(n).alias("rows")).first()
    if size["keys"] <= SMALL_ROWS:
        return rows.join(F.broadcast(table.drop(n)), keys, how)
    total = size["rows"]
    hot = staged(table.where(F.col(n) * PARTS > F.lit(total)).select(*keys, F.ceil(F.col(n) * PARTS / F.lit(total)).cast("int").alias("__parts")), "hot-keys")
    if hot.isEmpty():
        return rows.join(table.drop(n), keys, how)
    salt = F.coalesce(F.pmod(F.xxhash64(*mix), F.col("__parts")).cast("int"), F.lit(0))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("__salt", salt).drop("__parts")
    held = table.drop(n).join(F.broadcast(hot), keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__parts") - 1, F.lit(0))))).drop("__parts")
    return dealt.join(held, [*keys, "__salt"], how).drop("__salt")
