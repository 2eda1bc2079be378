"""Reachability by intervals: a hierarchy's closure without its pairs.

Cycles are contracted to one node each. Every node then gets one of its parents as its tree parent; a walk of that forest numbers each
node with an interval [enter, leave] that holds the numbers of all below it in the tree. What a node's further parents add are exceptions:
each ancestor that is not above it in the tree is a row of its own, only for nodes that have several parents somewhere above. "Below x" is a range of
numbers, or a range for each of few exceptions, and a count of descendants is a difference of numbers plus exceptions.

Numbers come from aggregates by depth: subtree sizes from the deepest level up, places from the roots down. Levels are as many as the longest chain.
Nothing is gathered by node.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ontoloom.plans.staging import staged


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, comp) of the nodes on cycles of an edge table (src, dst); comp is the least id of those that reach each other. Other nodes have no row.

    Nodes without a way in or out are taken away until none is left; then each node is coloured by the greatest id that reaches it, and what
    reaches back within a colour is the component of its greatest id. It is put aside, and the rest goes on.
    """
    left = edges.where("src <> dst").select("src", "dst").distinct()
    found = None
    while True:
        held = None
        while True:  # trim ends: those without a way in first, which are most in a tree; the rest is small
            ins = left.select(F.col("dst").alias("src")).distinct()
            left = staged(left.join(ins, "src", "left_semi").select("src", "dst"), "core")
            outs = left.select(F.col("src").alias("dst")).distinct()
            left = staged(left.join(outs, "dst", "left_semi").select("src", "dst"), "core")
            before, held = held, left.count()
            if held in (0, before):
                break
        if left.isEmpty():
            break
        colour = staged(left.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("colour", F.col("id")), "colours")
        while True:
            told = left.join(colour.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("colour").alias("more"))
            new = staged(colour.join(told, "id", "left").select("id", F.greatest("colour", F.coalesce("more", "colour")).alias("colour")), "colours")
            changed = not new.join(colour.withColumnRenamed("colour", "was"), "id").where("colour <> was").isEmpty()
            colour = new
            if not changed:
                break
        # back from each colour's own node, within the colour
        own = left.join(colour.select(F.col("id").alias("src"), F.col("colour").alias("a")), "src").join(colour.select(F.col("id").alias("dst"), F.col("colour").alias("b")), "dst").where("a = b").select("src", "dst", F.col("a").alias("colour"))
        own = staged(own, "within")
        reached = staged(colour.where("id = colour"), "back")
        ahead = reached
        while True:
            step = own.join(ahead.select(F.col("id").alias("dst"), "colour"), ["dst", "colour"]).select(F.col("src").alias("id"), "colour").distinct()
            ahead = staged(step.join(reached, ["id", "colour"], "left_anti"), "back")
            if ahead.isEmpty():
                break
            reached = staged(reached.union(ahead), "back")
        found = reached if found is None else staged(found.union(reached), "components")
        gone = reached.select("id")
        left = staged(left.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"), "rest")
    if found is None:
        return edges.select(F.col("src").alias("id"), F.col("src").alias("comp")).where("false")
    several = found.groupBy("colour").agg(F.min("id").alias("comp"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return found.join(several, "colour").select("id", "comp")


@dataclass(frozen=True)
class Reach:
    """``nodes``: (id, comp, enter, leave), an interval for each contracted node; ``extra``: (comp, above) of ancestors that no interval shows;
    ``loops``: nodes that are below themselves."""

    nodes: DataFrame
    extra: DataFrame
    loops: DataFrame

    def below(self, tops: DataFrame) -> DataFrame:
        """(top, id): the nodes one or more edges below each of ``tops`` (column id), once; a top itself only over a cycle.

        A top is its own interval and one for each contracted node that it is an exception of, where those have no exceptions in common.
        """
        top = self.nodes.join(tops.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("top"), F.col("comp").alias("top_comp"), "enter", "leave")
        tree = self._within(top.select("top", "enter", "leave"))
        more = self.extra.join(top.select("top", F.col("top_comp").alias("above")), "above").select("top", "comp")
        other = self.nodes.join(more, "comp").select("top", "id")
        loops = self.loops.select(F.col("id").alias("top"), F.lit(True).alias("loop"))
        out = tree.union(other).join(loops, "top", "left")
        return out.where("top <> id or loop").select("top", "id")

    def _within(self, ranges: DataFrame) -> DataFrame:
        """(top, id) of nodes whose number lies in a range: rows meet in blocks of numbers, so that no pair is tried in vain but at a range's ends."""
        total = self.nodes.agg(F.max("enter").alias("m")).first()["m"] or 0
        size = max(1024, int((total + 1) ** 0.5))
        blocks = ranges.withColumn("block", F.explode(F.sequence(F.floor(F.col("enter") / size), F.floor(F.col("leave") / size))))
        held = self.nodes.select("id", F.col("enter").alias("at"), F.floor(F.col("enter") / size).alias("block"))
        return held.join(blocks, "block").where("at between enter and leave").select("top", "id")

    def below_one(self, id_: str) -> DataFrame:
        """(id): as ``below`` for a single top: a predicate of ranges on ``nodes``, and its exceptions."""
        own = self.nodes.where(F.col("id") == id_).first()
        if own is None:
            return self.nodes.select("id").where("false")
        tree = self.nodes.where(F.col("enter").between(own["enter"], own["leave"])).select("id")
        other = self.nodes.join(self.extra.where(F.col("above") == own["comp"]).select("comp"), "comp", "left_semi").select("id")
        looped = not self.loops.where(F.col("id") == id_).isEmpty()
        return tree.union(other).where(F.lit(looped) | (F.col("id") != id_))

    def descendant_counts(self) -> DataFrame:
        """(id, n): how many nodes lie below each: what its interval holds, and its exceptions; itself only over a cycle."""
        members = self.nodes.groupBy("comp", "enter").agg(F.count(F.lit(1)).alias("size"))
        # nodes up to a number, by a running sum over blocks of numbers: a sum of block sums, and one within each block
        size = 4096
        block = members.withColumn("block", F.floor(F.col("enter") / size))
        sums = block.groupBy("block").agg(F.sum("size").alias("s"))
        before = sums.select("block", (F.sum("s").over(Window.orderBy("block")) - F.col("s")).alias("before"))
        upto = block.join(before, "block").withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("block").orderBy("enter"))).select("comp", "enter", "size", "upto")
        ends = self.nodes.select("comp", "leave").distinct()
        last = upto.select(F.col("enter").alias("leave"), F.col("upto").alias("last"))
        tree = upto.join(ends, "comp").join(last, "leave").select("comp", (F.col("last") - F.col("upto") + F.col("size")).alias("tree"))
        more = self.extra.join(members, "comp").groupBy(F.col("above").alias("comp")).agg(F.sum("size").alias("more"))
        loops = self.loops.withColumn("loop", F.lit(1))
        out = self.nodes.join(tree, "comp").join(more, "comp", "left").join(loops, "id", "left")
        return out.select("id", (F.col("tree") - 1 + F.coalesce("more", F.lit(0)) + F.coalesce("loop", F.lit(0))).cast("long").alias("n"))


def _levels(up: DataFrame, ids: DataFrame) -> DataFrame:
    """(comp, level) of a forest (comp, parent): edges above each node, by pointer doubling."""
    state = ids.join(up, "comp", "left").select("comp", F.col("parent").alias("at"), F.when(F.col("parent").isNotNull(), 1).otherwise(0).cast("long").alias("level"))
    state = staged(state, "levels")
    while not state.where("at is not null").isEmpty():
        ahead = state.select(F.col("comp").alias("at"), F.col("at").alias("next"), F.col("level").alias("more"))
        state = staged(state.join(ahead, "at", "left").select("comp", F.col("next").alias("at"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")), "levels")
    return state.select("comp", "level")


def build(nodes: DataFrame, edges: DataFrame) -> Reach:
    """Index ``nodes`` (id) under ``edges`` (src below dst). Ends that are no nodes count as nodes; null ends are no edges; repeats are one edge."""
    edges = staged(edges.where("src is not null and dst is not null").select("src", "dst").distinct(), "edges")
    ids = nodes.select("id").where("id is not null").union(edges.select(F.explode(F.array("src", "dst")))).distinct()
    cycles = strong_components(edges)
    loops = staged(cycles.select("id").union(edges.where("src = dst").select("src")).distinct(), "loops")
    if cycles.isEmpty():
        comps = staged(ids.select("id", F.col("id").alias("comp")), "contracted")
        dag = edges.where("src <> dst").select(F.col("src").alias("comp"), F.col("dst").alias("parent"))
    else:
        comps = staged(ids.join(cycles, "id", "left").select("id", F.coalesce("comp", "id").alias("comp")), "contracted")
        a, b = comps.select(F.col("id").alias("src"), F.col("comp").alias("comp")), comps.select(F.col("id").alias("dst"), F.col("comp").alias("parent"))
        dag = staged(edges.join(a, "src").join(b, "dst").where("comp <> parent").select("comp", "parent").distinct(), "acyclic")
    up = staged(dag.groupBy("comp").agg(F.min("parent").alias("parent"), F.count(F.lit(1)).alias("n")), "tree")
    # most nodes have nothing below them: only the others, and what lies on their paths, go through the rounds
    inner = staged(up.select(F.col("parent").alias("comp")).distinct(), "inner")
    above = up.join(inner, "comp", "left_semi").select("comp", "parent")
    level = staged(_levels(above, inner).join(above, "comp", "left").select("comp", "level", "parent"), "forest")
    deepest = level.agg(F.max("level").alias("m")).first()["m"] or 0
    tips = up.join(inner, "comp", "left_anti").select("comp", "parent")
    alone = comps.select("comp").distinct().join(up.select("comp").union(inner), "comp", "left_anti")
    leaves = staged(tips.union(alone.withColumn("parent", F.lit(None).cast(dict(comps.dtypes)["comp"]))), "leaves")
    # sizes of subtrees, from the deepest level up
    tipped = leaves.where("parent is not null").groupBy(F.col("parent").alias("comp")).agg((F.count(F.lit(1)) + 1).alias("own"))
    level = staged(level.join(tipped, "comp", "left").select("comp", "parent", "level", F.coalesce("own", F.lit(1).cast("long")).alias("size")), "forest")
    sizes, lower = leaves.select("comp", "parent", F.lit(None).cast("long").alias("level"), F.lit(1).cast("long").alias("size")), None
    for k in range(deepest, -1, -1):
        here = level.where(F.col("level") == k)
        if lower is not None:
            sums = lower.where("parent is not null").groupBy(F.col("parent").alias("comp")).agg(F.sum("size").alias("below"))
            here = here.join(sums, "comp", "left").select("comp", "parent", "level", (F.coalesce("below", F.lit(0)) + F.col("size")).alias("size"))
        lower = staged(here, "sizes")
        sizes = sizes.union(lower)
    # places among siblings: sizes of those before, by running sums over blocks of siblings
    placed = staged(_offsets(sizes), "offsets")
    numbered = upper = None
    for k in range(deepest + 1):
        here = placed.where(F.col("level") == k)
        upper = staged(here.select("comp", F.col("offset").alias("enter"), "size") if upper is None else _under(here, upper), "numbers")
        numbered = upper if numbered is None else numbered.union(upper)
    rest = placed.where("level is null")
    lone = rest.where("parent is null").select("comp", F.col("offset").alias("enter"), "size")
    numbered = numbered.union(_under(rest.where("parent is not null"), numbered)).union(lone)
    numbered = staged(numbered.select("comp", "enter", (F.col("enter") + F.col("size") - 1).alias("leave")), "intervals")
    nodes = numbered.select(F.col("comp").alias("id"), "comp", "enter", "leave") if cycles.isEmpty() else staged(comps.join(numbered, "comp").select("id", "comp", "enter", "leave"), "reach")
    return Reach(nodes, _exceptions(dag, up, numbered), loops)


def _under(rows: DataFrame, parents: DataFrame) -> DataFrame:
    """(comp, enter, size) of ``rows`` with places under numbered ``parents``."""
    met = rows.join(parents.select(F.col("comp").alias("parent"), F.col("enter").alias("from")), "parent")
    return met.select("comp", (F.col("from") + 1 + F.col("offset")).alias("enter"), "size")


def _offsets(sizes: DataFrame, blocks: int = 256) -> DataFrame:
    """``sizes`` with ``offset``: the sizes of siblings before a node. Siblings are dealt to blocks by hash, so a parent of very many is no one task's."""
    rows = sizes.withColumn("block", F.pmod(F.xxhash64("comp"), F.lit(blocks)))
    sums = rows.groupBy("parent", "block").agg(F.sum("size").alias("s"))
    over = Window.partitionBy("parent").orderBy("block")
    before = sums.select(F.col("parent").alias("p"), F.col("block").alias("b"), (F.sum("s").over(over) - F.col("s")).alias("before"))
    met = rows.join(before, rows["parent"].eqNullSafe(before["p"]) & (rows["block"] == before["b"]))
    within = F.sum("size").over(Window.partitionBy("parent", "block").orderBy("comp")) - F.col("size")
    return met.withColumn("offset", F.col("before") + within).select("comp", "parent", "level", "size", "offset")


def _exceptions(dag: DataFrame, up: DataFrame, numbered: DataFrame) -> DataFrame:
    """(comp, above): ancestors outside a node's tree path. Only nodes with several parents start any; they go down the tree, and up every edge."""
    several = dag.join(up.where("n > 1").select("comp"), "comp", "left_semi")
    inside = numbered.select("comp", F.col("enter").alias("at"))
    above = numbered.select(F.col("comp").alias("above"), "enter", "leave")

    def outside(pairs: DataFrame) -> DataFrame:
        """Pairs that the tree doesn't show."""
        return pairs.join(inside, "comp").join(above, "above").where("not (at between enter and leave)").select("comp", "above")

    found = staged(outside(several.select("comp", F.col("parent").alias("above"))).distinct(), "extra")
    ahead = found
    while not ahead.isEmpty():
        # an exception of a node is one of its children (over any edge), and its ancestors' parents are exceptions too
        down = dag.join(ahead.select(F.col("comp").alias("parent"), "above"), "parent").select("comp", "above")
        higher = ahead.join(dag.select(F.col("comp").alias("above"), "parent"), "above").select("comp", F.col("parent").alias("above"))
        ahead = staged(outside(down.union(higher).distinct()).join(found, ["comp", "above"], "left_anti"), "extra")
        found = staged(found.union(ahead), "extra")
    return found
