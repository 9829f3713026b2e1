"""Tables written to the folder all executors share, to cut lineage and read often."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir

BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = "4m"


def shared_table(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet into `spark.checkpoint.dir` and read it back.

    Later steps read only the columns they need, a lost executor costs a
    re-read, and the file system drops the folder when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def per_process(key: tuple, make: Callable):
    """An object kept for the life of a worker process.

    The library's functions travel to the workers by value, so their module's
    globals do not outlive a task; a module of this name does.
    """
    kept = sys.modules.setdefault("lumenact_worker", types.ModuleType("lumenact_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def small_batches(spark: SparkSession) -> SparkSession:
    """Let Arrow batches hold few bytes, unless the session says otherwise.

    The operators' Python code works on small slices anyway; large batches
    would only be held twice, by the executor and by its worker.
    """
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    return spark
