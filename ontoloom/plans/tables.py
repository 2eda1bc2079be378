"""The given tables seen as a labelled graph: entities, and edges between them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Tables of one folder, each read once; ``sf.orders`` is the orders table."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        frame = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        self.__dict__[name] = frame
        return frame


def key(kind: str, column: Column | str) -> Column:
    return F.concat(F.lit(kind + ":"), (F.col(column) if isinstance(column, str) else column).cast("string"))


def entities(t: Tables) -> DataFrame:
    """(id, kind, type, label, onto)."""

    def rows(frame: DataFrame, kind: str, k: str, label: Column, onto: str, type_: str = "class") -> DataFrame:
        return frame.select(key(kind, k).alias("id"), F.lit(kind).alias("kind"), F.lit(type_).alias("type"), label.alias("label"), F.lit(onto).alias("onto"))

    parts = [
        rows(t.region, "region", "r_regionkey", F.col("r_name"), "geo"),
        rows(t.nation, "nation", "n_nationkey", F.col("n_name"), "geo"),
        rows(t.customer, "customer", "c_custkey", F.col("c_name"), "sales"),
        rows(t.supplier, "supplier", "s_suppkey", F.col("s_name"), "catalog"),
        rows(t.part, "part", "p_partkey", F.col("p_name"), "catalog"),
        rows(t.part.select("p_type").distinct(), "type", "p_type", F.col("p_type"), "catalog"),
        rows(t.part.select("p_brand").distinct(), "brand", "p_brand", F.col("p_brand"), "catalog"),
        rows(t.orders, "order", "o_orderkey", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), "sales", "individual"),
    ]
    return reduce(DataFrame.union, parts)


def edges(t: Tables, *kinds: str) -> DataFrame:
    """(src, edge_type, dst) of the kinds asked for: directParent, part_of, contains, supplied_by."""

    def rows(frame: DataFrame, src: Column, kind: str, dst: Column) -> DataFrame:
        return frame.select(src.alias("src"), F.lit(kind).alias("edge_type"), dst.alias("dst"))

    found = []
    if "directParent" in kinds:
        found += [
            rows(t.nation, key("nation", "n_nationkey"), "directParent", key("region", "n_regionkey")),
            rows(t.customer, key("customer", "c_custkey"), "directParent", key("nation", "c_nationkey")),
            rows(t.supplier, key("supplier", "s_suppkey"), "directParent", key("nation", "s_nationkey")),
            rows(t.orders, key("order", "o_orderkey"), "directParent", key("customer", "o_custkey")),
            rows(t.part, key("part", "p_partkey"), "directParent", key("type", "p_type")),
        ]
    if "part_of" in kinds:
        found.append(rows(t.part, key("part", "p_partkey"), "part_of", key("brand", "p_brand")))
    if "contains" in kinds:
        found.append(rows(t.lineitem, key("order", "l_orderkey"), "contains", key("part", "l_partkey")).distinct())
    if "supplied_by" in kinds:
        found.append(rows(t.lineitem, key("part", "l_partkey"), "supplied_by", key("supplier", "l_suppkey")).distinct())
    return reduce(DataFrame.union, found)


#: The same in SQL, as common table expressions.
ENTITIES_SQL = """ent as (
select 'region:' || r_regionkey as id, 'region' as kind, 'class' as type, r_name as label, 'geo' as onto from region
union all select 'nation:' || n_nationkey, 'nation', 'class', n_name, 'geo' from nation
union all select 'customer:' || c_custkey, 'customer', 'class', c_name, 'sales' from customer
union all select 'supplier:' || s_suppkey, 'supplier', 'class', s_name, 'catalog' from supplier
union all select 'part:' || p_partkey, 'part', 'class', p_name, 'catalog' from part
union all select distinct 'type:' || p_type, 'type', 'class', p_type, 'catalog' from part
union all select distinct 'brand:' || p_brand, 'brand', 'class', p_brand, 'catalog' from part
union all select 'order:' || o_orderkey, 'order', 'individual', 'order ' || o_orderkey, 'sales' from orders)"""
PARENTS_SQL = """par as (
select 'nation:' || n_nationkey as src, 'region:' || n_regionkey as dst from nation
union all select 'customer:' || c_custkey, 'nation:' || c_nationkey from customer
union all select 'supplier:' || s_suppkey, 'nation:' || s_nationkey from supplier
union all select 'order:' || o_orderkey, 'customer:' || o_custkey from orders
union all select 'part:' || p_partkey, 'type:' || p_type from part)"""
CLOSURE_SQL = "clo as (select src, dst from {edges} union select c.src, e.dst from clo c join {edges} e on c.dst = e.src)"
