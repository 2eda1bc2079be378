"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.plans.staging import staged


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step. Edges hold child > parent, and so does the result."""
    both = edges.select(F.col("child").alias("u"), F.col("parent").alias("v")).union(
        edges.select(F.col("parent").alias("u"), F.col("child").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = (
        both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("child"), F.col("m").alias("parent")).distinct()
    )
    large = staged(large, "large-star")
    root = large.groupBy("child").agg(F.min("parent").alias("m"))
    joined = large.join(root, "child")
    small = joined.select(F.col("child"), F.col("m").alias("parent")).union(
        joined.where(F.col("parent") > F.col("m")).select(F.col("parent").alias("child"), F.col("m").alias("parent"))
    )
    return staged(small.distinct(), "small-star")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """(member, component) for every node of an edge; component is the least member. Needs orderable node keys.

    Self edges, edges in both directions and repeats are harmless; rows with a null end are no edges. An empty table
    gives an empty table. Each round halves the depth of every tree at least, so paths of n nodes take O(log n) rounds.
    """
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("child"), F.least(a, b).alias("parent"))
    now = staged(now.distinct(), "edges")
    mark = F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("child", "parent")).alias("x"))
    was = None
    for _ in range(max_rounds):
        state = now.agg(mark.alias("s")).first()["s"]
        if state["n"] == 0 or state == was:
            break
        was, now = state, _stars(now)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("parent").alias("member")).distinct()
    return now.select(F.col("child").alias("member"), F.col("parent").alias("component")).union(
        roots.select("member", F.col("member").alias("component"))
    )
