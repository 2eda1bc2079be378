"""The corpus pipeline: documents to packed training sequences, in stages that each call one operator of ``ontoloom.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; each result is written and read again as the next stage's docs. All stages
but the last return the columns of documents, of any type and name, and an empty table for an empty one. Rows are told apart by doc_id and
text, so null or repeated ids cost no other row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ontoloom.llm import exact, langid, packing, simhash, winnow
from ontoloom.session import shared_dir, ship_package


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the learned languages go, and so do null texts and texts without a letter. Repeated rows share their fate; a null doc_id changes nothing."""
    ship_package(spark)
    return langid.keep_known_language(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays, a null one only where there is no other. Null counts as the empty text; of rows alike in both, any one stays."""
    return exact.drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the least doc_id stays, null last; ties go to the least text hash. Texts without words are one group; rows alike in id and text leave one."""
    ship_package(spark)
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go. A null text or item has no words and contaminates nothing; repeated rows go or stay together."""
    ship_package(spark)
    return winnow.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in a sequence. A null text is empty, its end id one piece; repeated rows are packed each."""
    ship_package(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

#: No stage but exact dedup can be said in SQL; tests/llm hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{top}/{k}-{name}")
        docs = spark.read.parquet(f"{top}/{k}-{name}")
    raise ValueError("STAGES is empty")
