"""Sessions and the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def local_session(app: str = "ontoloom", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("ONTOLOOM_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only where none is set (tests, local runs) a temporary one is made."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


#: Bytes that one Arrow batch to or from a Python task holds, about: by default only its rows are limited, and texts may be long.
BATCH_BYTES = 4 << 20
_BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once for each context (nothing happens where they have it already), and bound Arrow batches where the session doesn't."""
    if spark.conf.get(_BATCH_LIMIT, None) is None:
        spark.conf.set(_BATCH_LIMIT, str(BATCH_BYTES))
    context = spark.sparkContext
    if getattr(context, "_ontoloom_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    if os.path.dirname(top) not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "ontoloom.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for folder, _, names in os.walk(top):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        out.write(full, os.path.relpath(full, os.path.dirname(top)))
        context.addPyFile(archive)
    context._ontoloom_shipped = True
