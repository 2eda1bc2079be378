"""Hierarchies: transitive closure, ancestors, descendants, flags, roots, paths, and the order of linked lists.

Edge frames hold (src, dst) with src below dst. Nothing is gathered by node: closure pairs are rows throughout.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.plans.staging import staged


def closure(edges: DataFrame, max_rounds: int | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, src, dst, depth): every pair one or more edges apart, once, with the least number of edges.

    Semi-naive: each round puts an edge before the pairs that the round before found. A node with one edge reaches all else over it, so its
    pairs come up once each and are only written; those of nodes with several edges are held against what such nodes reached before. A node
    reaches itself only over a cycle, and cycles end the loop like anything else, so there is no limit on rounds unless one is asked for. ``keys`` (an ontology id, say) keep edge sets apart. Null ends are no edges.
    """
    base = edges.where("src is not null and dst is not null").select(*keys, "src", "dst").distinct()
    branches = base.groupBy(*keys, "src").agg((F.count(F.lit(1)) == 1).alias("lone"))
    base = staged(base.join(branches, [*keys, "src"]).select(*keys, "src", "dst", "lone"), "edges")
    step = base.withColumnRenamed("dst", "mid")
    found = [base.withColumn("depth", F.lit(1))]
    for depth in count(2) if max_rounds is None else range(2, max_rounds + 2):
        # what goes on from a node to itself is an edge, and known
        ahead = found[-1].where("src <> dst").select(*keys, F.col("src").alias("mid"), "dst").join(step, [*keys, "mid"]).select(*keys, "src", "dst", "lone")
        known = reduce(DataFrame.union, found).where("not lone").select(*keys, "src", "dst")
        several = ahead.where("not lone").distinct().join(known, [*keys, "src", "dst"], "left_anti")
        new = staged(ahead.where("lone").union(several.select(ahead.columns)).withColumn("depth", F.lit(depth)), "closure")
        if new.isEmpty():
            return reduce(DataFrame.union, found).drop("lone")
        found.append(new)
    raise RuntimeError(f"the closure has pairs more than {max_rounds} edges apart")


def descendant_counts(nodes: DataFrame, pairs: DataFrame, name: str = "num_descendants") -> DataFrame:
    """(id, name): how many nodes lie below each node, 0 where none do."""
    counts = pairs.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias(name))
    return nodes.select("id").join(counts, "id", "left").select("id", F.coalesce(name, F.lit(0).cast("long")).alias(name))


def hierarchy_flags(nodes: DataFrame, edges: DataFrame, top: tuple[str, ...] = (), keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, id, has_parents, has_children) by semi-join tests; nodes in ``top`` do not count as parents. ``keys`` keep edge sets apart."""
    up = edges.where(~F.col("dst").isin(*top)) if top else edges
    parents = up.select(*keys, F.col("src").alias("id")).distinct().withColumn("p", F.lit(True))
    children = edges.select(*keys, F.col("dst").alias("id")).distinct().withColumn("c", F.lit(True))
    out = nodes.select(*keys, "id").join(parents, [*keys, "id"], "left").join(children, [*keys, "id"], "left")
    no = F.lit(False)
    return out.select(*keys, "id", F.coalesce("p", no).alias("has_parents"), F.coalesce("c", no).alias("has_children"))


def marked(nodes: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """``nodes`` with a flag ``name``: whether ``ids`` (id) has them.

    An outer join: a semi- or anti-join would be put under a union of node tables, and ``ids`` sorted once for each of them.
    """
    return nodes.join(ids.select("id").distinct().withColumn(name, F.lit(True)), "id", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def roots(nodes: DataFrame, edges: DataFrame, obsolete: str | None = None) -> DataFrame:
    """Nodes without a parent, less obsolete ones where a flag column is named."""
    top = marked(nodes, edges.select(F.col("src").alias("id")), "__up").where("not __up").drop("__up")
    return top.where(~F.col(obsolete)) if obsolete else top


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with neither parent nor child."""
    return marked(roots(nodes, edges), edges.select(F.col("dst").alias("id")), "__down").where("not __down").drop("__down")


def root_paths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, path): every path from a root down to a node, as an array of ids.

    Multiple parents give multiple paths; an edge back to a node of its own path is not followed.
    """
    level = roots(nodes, edges).select("id", F.array("id").alias("path"))
    down = staged(edges.select(F.col("dst").alias("id"), F.col("src").alias("child")).distinct(), "down")
    found = [staged(level, "paths")]
    while True:  # no path repeats a node, so paths end
        grown = found[-1].join(down, "id").where(~F.array_contains("path", F.col("child")))
        grown = staged(grown.select(F.col("child").alias("id"), F.concat("path", F.array("child")).alias("path")), "paths")
        if grown.isEmpty():
            break
        found.append(grown)
    return reduce(DataFrame.union, found)


def list_positions(cells: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(id, head, pos) of linked-list cells (id, rest), by pointer doubling: a list of n cells takes log2 n rounds.

    The head is the cell that no other names as its rest; cells of a circular list have no head and are left out.
    """
    prev = cells.where("rest is not null").select(F.col("rest").alias("id"), F.col("id").alias("at"))
    state = cells.select("id").join(prev, "id", "left")
    state = staged(state.select("id", F.coalesce("at", "id").alias("at"), F.when(F.col("at").isNull(), 0).otherwise(1).cast("long").alias("pos")), "list")
    size = state.count()
    for _ in range(max_rounds):
        ahead = state.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("pos").alias("more"))
        state = staged(state.join(ahead, "at").select("id", F.col("next").alias("at"), (F.col("pos") + F.col("more")).alias("pos")), "list")
        open_ = state.join(prev.select(F.col("id").alias("at")), "at", "left_semi")
        # past 2^round cells no list is that long, so what is still open runs in a circle
        left = open_.agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("least")).first()
        if not left["n"] or (left["least"] or 0) > size:
            break
    return state.join(prev.select(F.col("id").alias("at")), "at", "left_anti").select("id", F.col("at").alias("head"), "pos")
