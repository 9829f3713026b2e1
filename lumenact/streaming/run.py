"""Running totals over records, and running streams to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import shared_dir


def running_totals(records: DataFrame) -> DataFrame:
    """Records and clean records by status and subtopic so far."""
    return records.groupBy("_status", "subtopic").agg(F.count(F.lit(1)).alias("n"))


def totals_summary(totals: DataFrame) -> DataFrame:
    """Totals by status and ok records by subtopic: (section, key, n)."""
    status = totals.groupBy(F.lit("status").alias("section"), F.col("_status").alias("key")).agg(F.sum("n").alias("n"))
    ok = totals.where(F.col("_status") == "ok").groupBy(
        F.lit("ok_by_subtopic").alias("section"), F.col("subtopic").alias("key")).agg(F.sum("n").alias("n"))
    return status.unionByName(ok)


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def drain_append(stream: DataFrame) -> DataFrame:
    """Process all input there is, append the output to a table, and read it."""
    spark = stream.sparkSession
    folder = new_folder(spark)
    (stream.writeStream.format("parquet").outputMode("append")
     .option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def drain_complete(stream: DataFrame) -> DataFrame:
    """Process all input there is, each time replacing the result table.

    An epoch that runs again after a failure writes its own folder again. The
    result is the newest epoch that the stream's checkpoint has committed; a
    stream without input gives no rows.
    """
    spark = stream.sparkSession
    folder = new_folder(spark)

    def replace(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")

    (stream.writeStream.outputMode("complete").foreachBatch(replace)
     .option("checkpointLocation", f"{folder}/state")
     .trigger(availableNow=True).start().awaitTermination())
    return newest_epoch(spark, folder, stream.schema)


def newest_epoch(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The table that the last committed epoch of a stream has left in `folder`."""
    jvm = spark.sparkContext._jvm
    commits = jvm.org.apache.hadoop.fs.Path(f"{folder}/state/commits")
    files = commits.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(commits)] if files.exists(commits) else []
    epochs = [int(name) for name in names if name.isdigit()]
    if not epochs:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/out/epoch={max(epochs)}")
