"""Session settings and the shared folder used to cut long lineages."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Cut "first n per group" inside the map tasks for caps of this size too.
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
    # JSON replies may repeat a key; the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Stateful streaming operators need the RocksDB store.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on, where the caller has set nothing else."""
    chosen = spark.conf.getAll
    for key, value in SETTINGS.items():
        if key not in chosen:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A small session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lumenact")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by `spark.checkpoint.dir`.

    A folder of this machine is used only in local mode, where the executors
    live on this machine too.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = context.getCheckpointDir() or tempfile.mkdtemp(prefix="lumenact-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def stage(df: DataFrame) -> DataFrame:
    """Compute `df` once and read it back from the shared folder.

    For tables that several later steps read: the expensive scan and encoding
    behind them then runs once, and a lost executor costs a re-read, not a
    recomputation.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
