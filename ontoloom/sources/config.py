"""Ontology configurations: merging of several files, and where an ontology's file is."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def merged_configs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(ontology_id, config map<string,string of JSON>): files in order, later keys win; ids in lower case.

    A configuration names ontologies, not their contents, so the driver reads it through Spark's text reader.
    """
    merged: dict[str, dict] = {}
    for path in paths:
        text = spark.read.text(path, wholetext=True).first()
        for item in json.loads(text["value"])["ontologies"]:
            merged.setdefault(item["id"].lower(), {}).update(item)
    rows = [(k, {n: json.dumps(v) for n, v in c.items()}) for k, c in merged.items()]
    return spark.createDataFrame(rows, "ontology_id string, config map<string,string>")


def with_sources(configs: DataFrame) -> DataFrame:
    """With ``path``: ontology_purl, else the first product's that ends in .owl; null where there is none."""
    own = text_of("ontology_purl")
    products = F.from_json(F.col("config")["products"], "array<struct<ontology_purl:string>>")
    owl = F.filter(F.transform(products, lambda p: p["ontology_purl"]), lambda u: u.endswith(".owl"))
    return configs.withColumn("path", F.coalesce(own, F.try_element_at(owl, F.lit(1))))


def list_of(name: str):
    """A configured list of strings; one string alone is a list of one."""
    return F.coalesce(F.from_json(F.col("config")[name], "array<string>"), F.array_compact(F.array(text_of(name))))


def text_of(name: str):
    """A configured string; null where there is none."""
    return F.get_json_object(F.concat(F.lit('{"x":'), F.col("config")[name], F.lit("}")), "$.x")
