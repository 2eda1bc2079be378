"""Search values of nested entity documents: JSON objects whose members are texts, lists, and objects that wrap a value.

Documents are VARIANT columns, so no schema is fixed and no text is parsed twice. A member's value is unwrapped by kind, step by step:

* an object without a list of types (a class expression, or anything of a configuration) holds nothing to search;
* a literal, a reification or a relation stands for its value, which may be wrapped again;
* a datatype holds nothing; an object of other types is an error.

A list gives its items' values. What is no text is shown as JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Types of wrappers whose value counts, and of those that hold nothing.
WRAPPERS, EMPTY = ("literal", "reification", "related"), ("datatype",)
#: Wrappers within wrappers that are unwrapped; deeper ones are an error, not a loss.
DEPTH = 6


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def _inner(value: Column) -> Column:
    """One wrapper less; what isn't wrapped stays."""
    listed = _is(F.try_variant_get(value, "$.type", "variant"), "ARRAY")
    types = F.when(listed, F.try_variant_get(value, "$.type", "array<string>"))
    has = lambda names: F.arrays_overlap(types, F.array(*map(F.lit, names)))
    none = F.lit(None).cast("variant")
    unknown = F.raise_error(F.concat(F.lit("an object of unknown types: "), F.to_json(value))).cast("variant")
    inside = F.when(~listed, none).when(has(WRAPPERS), F.try_variant_get(value, "$.value", "variant")).when(has(EMPTY), none).otherwise(unknown)
    return F.when(_is(value, "OBJECT"), inside).otherwise(value)


def unwrapped(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the VARIANT column ``name`` unwrapped; null where nothing is left."""
    # a generated column is computed once; a plain one would be written out again for each of its uses in the next step
    step = lambda value: rows.select(*[c for c in rows.columns if c != name], F.explode(F.array(value)).alias(name)).select(rows.columns)
    for _ in range(DEPTH):
        rows = step(_inner(F.col(name)))
    deeper = F.raise_error(F.lit(f"wrapped more than {DEPTH} times")).cast("variant")
    value = F.when(_is(F.col(name), "OBJECT"), deeper).otherwise(F.col(name))
    return step(F.when(~F.coalesce(F.is_variant_null(name), F.lit(False)), value))


def shown(value: Column) -> Column:
    """A value as text: texts as they are, anything else as JSON."""
    return F.when(_is(value, "STRING"), F.try_variant_get(value, "$", "string")).otherwise(F.to_json(value))


def members(docs: DataFrame, key: str, name: str) -> DataFrame:
    """(key, field, value) of each member of the objects in the VARIANT column ``name``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("__key"), F.col(name).alias("__doc")).where(_is(F.col("__doc"), "OBJECT"))
    return rows.lateralJoin(spark.tvf.variant_explode(F.col("__doc").outer())).select(F.col("__key").alias(key), F.col("key").alias("field"), "value")


def search_values(docs: DataFrame, key: str = "id", name: str = "doc") -> DataFrame:
    """(key, field, pos, value): the texts of every member of the objects in ``name`` (VARIANT, or JSON text), colons of names doubled to underscores.

    A null or non-object document has none; JSON that can't be read raises. pos tells a list's items apart, and is 0 for a single value.
    """
    spark = docs.sparkSession
    if dict(docs.dtypes)[name] == "string":
        docs = docs.select(key, F.parse_json(name).alias(name))
    each = unwrapped(members(docs, key, name), "value").where("value is not null").withColumn("__list", _is(F.col("value"), "ARRAY"))
    single = each.where("not __list").select(key, "field", F.lit(0).alias("pos"), "value")
    items = each.where("__list").select(F.col(key).alias("__key"), "field", F.col("value").alias("__items"))
    items = items.lateralJoin(spark.tvf.variant_explode(F.col("__items").outer())).select(F.col("__key").alias(key), "field", "pos", "value")
    flat = single.union(unwrapped(items, "value").where("value is not null"))
    return flat.select(key, F.replace("field", F.lit(":"), F.lit("__")).alias("field"), "pos", shown(F.col("value")).alias("value"))
