"""Reads of a property graph: nodes (id, ...) and edges (src, edge_type, dst, props)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.functions.text import path_id
from ontoloom.operators.closure import closure, root_paths
from ontoloom.plans.staging import staged


def nodes_where(nodes: DataFrame, **equal) -> DataFrame:
    for name, value in equal.items():
        nodes = nodes.where(F.col(name) == value)
    return nodes


def one(df: DataFrame):
    """The only row; an error if there is none or another."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise LookupError("not exactly one row")
    return rows[0]


def step(edges: DataFrame, types: list[str], incoming: bool = False, props: dict[str, str] | None = None) -> DataFrame:
    """(id, other) one edge away, each pair once. ``props`` asks for a value in an edge's property array."""
    kept = edges.where(F.col("edge_type").isin(types))
    for name, value in (props or {}).items():
        kept = kept.where(F.array_contains(F.col("props")[name], value))
    a, b = ("dst", "src") if incoming else ("src", "dst")
    return kept.select(F.col(a).alias("id"), F.col(b).alias("other")).distinct()


def reach(edges: DataFrame, types: list[str], incoming: bool = False) -> DataFrame:
    """(id, other) one or more edges away over any mix of the types."""
    pairs = closure(edges.where(F.col("edge_type").isin(types)).select("src", "dst"))
    a, b = ("dst", "src") if incoming else ("src", "dst")
    return pairs.select(F.col(a).alias("id"), F.col(b).alias("other"))


def neighbourhood(edges: DataFrame, focus: DataFrame, out_types: list[str], in_types: list[str]) -> DataFrame:
    """(focus, src, dst, edge_type): edges out of and into each focus node (column id), each once."""
    out = edges.where(F.col("edge_type").isin(out_types)).join(focus.select(F.col("id").alias("src")), "src", "left_semi")
    into = edges.where(F.col("edge_type").isin(in_types)).join(focus.select(F.col("id").alias("dst")), "dst", "left_semi")
    a = out.select(F.col("src").alias("focus"), "src", "dst", "edge_type")
    return a.union(into.select(F.col("dst").alias("focus"), "src", "dst", "edge_type")).distinct()


def js_tree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, node_id, parent_id, depth) of each path from a root: node_id is base64 of the path, a root's parent is ``#``."""
    paths = root_paths(nodes, edges)
    size = F.size("path")
    parent = F.when(size == 1, F.lit("#")).otherwise(path_id(F.slice("path", F.lit(1), size - 1)))
    return paths.select("id", path_id(F.col("path")).alias("node_id"), parent.alias("parent_id"), size.cast("long").alias("depth"))


def by_cascade(df: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of the first column, in the order given, that equals each wanted key."""
    found = None
    for rank, name in enumerate(columns):
        hit = wanted.join(df.withColumn("__k", F.col(name)), F.col("wanted") == F.col("__k")).drop("__k").withColumn("rank", F.lit(rank))
        found = hit if found is None else found.union(hit)
    best = found.groupBy("wanted").agg(F.min("rank").alias("best"))
    return found.join(best, "wanted").where("rank = best").drop("best")


def reach_from(edges: DataFrame, focus: DataFrame, types: list[str], incoming: bool = False, max_rounds: int = 100) -> DataFrame:
    """(focus, id): the nodes one or more edges from each focus node (column id).

    Only what the focus nodes reach is walked, a round for each step, so a lookup never closes the whole graph. A focus node is in its own
    result only over a cycle. Edges join on their near end; a round's new rows are all that the next one joins.
    """
    a, b = ("dst", "src") if incoming else ("src", "dst")
    near = edges.where(F.col("edge_type").isin(types)).select(F.col(a).alias("at"), F.col(b).alias("next")).where("at is not null and next is not null").distinct()
    start = focus.select(F.col("id").alias("focus"), F.col("id").alias("at")).distinct()
    found: DataFrame | None = None
    ahead = start
    for _ in range(max_rounds):
        step_ = ahead.join(near, "at").select("focus", F.col("next").alias("at")).distinct()
        ahead = staged(step_.join(found, ["focus", "at"], "left_anti") if found is not None else step_, "reach")
        if found is not None and ahead.isEmpty():
            return found.select("focus", F.col("at").alias("id"))
        found = ahead if found is None else found.union(ahead)
    raise RuntimeError(f"nodes more than {max_rounds} edges away")
