"""Trees by page: how many paths lead to a node, and any run of them, without building the others.

A node has as many root paths as its parents have together, so counts go down the hierarchy once. The k-th path of a node is found by going
up: its parents, in order, hold consecutive runs of numbers as long as their own counts, so one of them has the k-th, at a place within its run.
A page costs its paths times their length, whatever the number of paths (which may be exponential in the number of nodes).

Cycles: an edge between nodes that reach each other is followed only where it leads away from the roots, by least number of edges; so
every node under a root is shown, and every path ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ontoloom.functions.text import path_id
from ontoloom.operators.reach import strong_components
from ontoloom.plans.staging import staged

#: Counts are whole numbers of up to 38 digits.
_WIDE = "decimal(38,0)"


def acyclic(edges: DataFrame) -> DataFrame:
    """``edges`` (src below dst) less those that lead back in a cycle under a root; a graph without cycles stays as it is, and so do cycles under no root."""
    edges = staged(edges.where("src is not null and dst is not null and src <> dst").select("src", "dst").distinct(), "edges")
    cycles = strong_components(edges)
    if cycles.isEmpty():
        return edges
    cycles = staged(cycles, "components")
    a, b = cycles.select(F.col("id").alias("src"), F.col("comp").alias("a")), cycles.select(F.col("id").alias("dst"), F.col("comp").alias("b"))
    marked = staged(edges.join(a, "src", "left").join(b, "dst", "left").select("src", "dst", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("inner")), "marked")
    tops = edges.select(F.col("dst").alias("id")).distinct().join(edges.select(F.col("src").alias("id")), "id", "left_anti")
    near = ahead = staged(tops.withColumn("depth", F.lit(0)), "depths")
    while not ahead.isEmpty():
        step = edges.join(ahead.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg((F.min("depth") + 1).alias("depth"))
        ahead = staged(step.join(near, "id", "left_anti"), "depths")
        near = staged(near.union(ahead), "depths")
    inner = marked.where("inner").join(near.select(F.col("id").alias("src"), F.col("depth").alias("s")), "src", "left").join(near.select(F.col("id").alias("dst"), F.col("depth").alias("d")), "dst", "left")
    return staged(marked.where("not inner").select("src", "dst").union(inner.where("s is null or s > d").select("src", "dst")), "acyclic")


def path_counts(nodes: DataFrame, dag: DataFrame) -> DataFrame:
    """(id, n): the root paths of each node (id) under a ``dag`` that ``acyclic`` gave. Roots have one; what no root is above has no row."""
    roots = nodes.select("id").distinct().join(dag.select(F.col("src").alias("id")), "id", "left_anti")
    found = done = staged(roots.withColumn("n", F.lit(1).cast(_WIDE)), "counts")
    need = staged(dag.groupBy("src").agg(F.count(F.lit(1)).alias("parents")), "parents")
    while not done.isEmpty():
        # what has all its parents counted, one of them in the last round
        near = dag.join(done.select(F.col("id").alias("dst")), "dst", "left_semi").select("src").distinct()
        told = dag.join(near, "src", "left_semi").join(found.withColumnRenamed("id", "dst"), "dst").groupBy("src").agg(F.sum("n").cast(_WIDE).alias("n"), F.count(F.lit(1)).alias("known"))
        done = staged(told.join(need, "src").where("known = parents").select(F.col("src").alias("id"), "n"), "counts")
        found = staged(found.union(done), "counts")
    return found


def runs(dag: DataFrame, counts: DataFrame) -> DataFrame:
    """(src, dst, low, high): the numbers of a node's paths that go over each of its parents, in the order of the parents' ids."""
    held = dag.join(counts.withColumnRenamed("id", "dst"), "dst")
    high = F.sum("n").over(Window.partitionBy("src").orderBy("dst")).cast(_WIDE)
    return held.select("src", "dst", high.alias("high"), "n").select("src", "dst", (F.col("high") - F.col("n")).cast(_WIDE).alias("low"), "high")


def paths(focus: DataFrame, dag: DataFrame, counts: DataFrame, start: int = 0, size: int = 20) -> DataFrame:
    """(focus, k, path): for each node of ``focus`` (id) its paths number ``start`` to ``start + size - 1`` as far as there are, from the root down.

    Paths are ordered by parent, then that one's parent, and so on. A node under no root has none.
    """
    own = focus.select("id").distinct().join(counts, "id")
    last = F.least(F.lit(start + size).cast(_WIDE), F.col("n"))
    asked = own.where(F.col("n") > start).select(F.col("id").alias("focus"), F.explode(F.sequence(F.lit(start).cast("long"), (last - 1).cast("long"))).alias("k"))
    state = staged(asked.select("focus", "k", F.col("focus").alias("at"), F.col("k").cast(_WIDE).alias("left"), F.array("focus").alias("path")), "paths")
    over = staged(runs(dag, counts), "runs").withColumnRenamed("src", "at")
    whole = None
    while not state.isEmpty():
        step = state.join(over, "at", "left").where("dst is null or (left >= low and left < high)")
        step = staged(step.select("focus", "k", F.col("dst").alias("at"), (F.col("left") - F.coalesce("low", F.lit(0).cast(_WIDE))).cast(_WIDE).alias("left"), F.when(F.col("dst").isNull(), F.col("path")).otherwise(F.concat(F.array("dst"), "path")).alias("path")), "paths")
        ended = step.where("at is null").select("focus", "k", "path")
        whole = ended if whole is None else whole.union(ended)
        state = step.where("at is not null")
    return whole if whole is not None else asked.select("focus", "k", F.array("focus").alias("path"))


def tree_rows(found: DataFrame) -> DataFrame:
    """(id, node_id, parent_id, depth) of the tree that paths form: each node once for each way to it; the root's parent is ``#``."""
    each = found.select("path", F.explode(F.sequence(F.lit(1), F.size("path"))).alias("depth")).select(F.slice("path", F.lit(1), F.col("depth")).alias("p"), "depth").distinct()
    above = F.when(F.col("depth") > 1, path_id(F.slice("p", F.lit(1), F.col("depth") - 1))).otherwise(F.lit("#"))
    return each.select(F.element_at("p", -1).alias("id"), path_id(F.col("p")).alias("node_id"), above.alias("parent_id"), F.col("depth").cast("long").alias("depth"))
