"""Mixing sources to target weights by systematic sampling.

Each source has a target of words; its documents' expected copies are target over size, all alike. Documents of a source stand in order
of size and id; their expected copies are summed from the first on, one random offset is added, and a document is emitted once for each
whole number that the sum crosses there. A source's taken words then differ from its target by about one document's size at most.

Places in that order come from one range-partitioned sort of (source, size, id): the place within a partition, plus the rows of all
partitions before. No source, size or id is gathered in one task, and only one row a source and one number a partition are ever summed up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ontoloom.plans.spread import spread_join
from ontoloom.plans.staging import staged

# Fixed values of the mix: weights by a source's place in order, repeating; words wanted over words there; most words wanted over a source's own.
WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2.0
_LOW_BITS = 33  # of monotonically_increasing_id: the place within a partition


def word_count(text: Column) -> Column:
    """Words between space and the signs 9 to 13; null has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows``, a table that is read and not computed, with their places from 0 in ``order`` as column ``name``."""
    place = F.monotonically_increasing_id()
    sorted_ = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", place), "sorted")
    part, within = F.shiftrightunsigned("__at", _LOW_BITS), F.col("__at").bitwiseAND(F.lit((1 << _LOW_BITS) - 1))
    sizes = sorted_.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__rows"))
    before = sizes.select("__part", (F.sum("__rows").over(Window.orderBy("__part")) - F.col("__rows")).alias("__before"))
    # one row a partition of the sort
    placed = sorted_.withColumn("__part", part).join(F.broadcast(before), "__part")
    return placed.withColumn(name, F.col("__before") + within).drop("__at", "__part", "__before")


def water_level(sources: DataFrame, share: float, cap: float) -> float:
    """The words that a weight of one gets when all sources above ``cap`` times their size give their excess back, by weight, until none is above.

    One small aggregate a round; each settles at least one more source, and the level only rises.
    """
    level = 0.0
    while True:
        full = F.col("weight") * F.lit(level) > F.lit(cap) * F.col("source_size")
        got = sources.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("source_size"))).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("open")
        ).first()
        if not got["all"] or not got["open"]:
            return level
        rise = (share * got["all"] - cap * (got["held"] or 0)) / got["open"]
        if rise <= level:
            return level
        level = rise


def mix(
    docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 7,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: str | None = None,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row: how often the mix takes it, and its words in all.

    Sources stand by code point, null last, a source of its own like the empty name; their weights are ``weights`` in turn. Targets share
    ``share`` times all words and stop at ``cap`` times their source's words. A null or empty text has no words, and its copies count for
    nothing. Rows with one id are documents of their own; rows alike in id, source and size may take each other's place. Null ids come
    last. A source without words has target 0 and no copies; an empty table gives an empty table. Further columns, whatever their names,
    are not looked at; ``keep`` names one to carry along. The same rows and seed give the same result.
    """
    if not 0 <= share <= cap:
        raise ValueError("a source can't give more than its cap")
    kept = [F.col(keep)] if keep else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), *kept)
    rows = staged(rows.withColumn("__row", F.monotonically_increasing_id()), "sizes")  # tells rows apart that nothing else does
    order = [F.col("source").asc_nulls_last(), F.col("size").asc(), F.col("doc_id").asc_nulls_last(), F.col("__row").asc()]
    rows = numbered(rows, order, "place").withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    sources = staged(rows.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.min("place").alias("first"), F.count(F.lit(1)).alias("n")), "sources")
    turn = F.col("turn") % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int"))
    sources = staged(numbered(sources, [F.col("source").asc_nulls_last()], "turn").withColumn("weight", weight), "weights")
    level = water_level(sources, share, cap)
    target = F.least(F.lit(level) * F.col("weight"), F.lit(cap) * F.col("source_size"))
    # one offset a source, from its name and the seed
    name = F.md5(F.concat(F.lit(f"{seed}"), F.coalesce(F.concat(F.lit(":"), "source"), F.lit(""))).cast("binary"))
    offset = F.conv(F.substring(name, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    expected = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0))
    sources = sources.select("key", "source_size", "first", "n", target.alias("target"), expected.alias("expected"), offset.alias("offset"))
    rows = spread_join(rows, staged(sources, "targets"), ["key"], ["place"])
    # whole copies apart from the rest, so that no rounding of a long sum adds to them
    rank, part = F.col("place") - F.col("first"), F.col("expected") - F.floor("expected")
    crossed = F.floor(F.col("offset") + part * (rank + 1)) - F.floor(F.col("offset") + part * rank)
    copies = F.floor("expected") + crossed
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *kept)


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mixed table: each row of ``docs``, all its columns, as often as ``mix`` takes it. Options are those of ``mix``."""
    held = staged(docs.withColumn("__id", F.monotonically_increasing_id()), "documents")
    copies = mix(held, keep="__id", **options).where("copies > 0").select("__id", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__copy"))
    return held.join(copies, "__id").select(*[F.col(f"`{c}`") for c in docs.columns])
