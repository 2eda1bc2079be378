"""Cut a plan at a written table, so that a lost executor costs a re-read and no second computation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ontoloom.session import shared_dir


def staged(df: DataFrame, tag: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    Every later use reads the same rows, also when the source would order or split them differently a second time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
