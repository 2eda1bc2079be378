"""Incremental loads: a stream of search documents merged into a table by ontology, one micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def merge_stream(stream: DataFrame, table: str, checkpoint: str, key: str = "ontology_id") -> StreamingQuery:
    """Each batch replaces the partitions of the ontologies it holds and leaves the others; a repeated batch changes nothing.

    An ontology's documents are to come in one batch, as a file or as files that arrive together: a later batch stands in for an earlier one.
    """

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(table)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def document_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(folder)
