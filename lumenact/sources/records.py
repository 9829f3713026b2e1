"""Prompt records, feature tables, encoder weights and run folders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.discover import feature_columns
from ..schemas import PROMPT

STAMP = r"_(\d{8}_\d{6})_meta\.json"


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """Prompt records from JSON lines; a malformed line fails the job."""
    return spark.read.schema(PROMPT).option("mode", "FAILFAST").json(path)


def write_prompts(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Prompt records as JSON lines, with null fields written out."""
    records.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_features(spark: SparkSession, path: str, n_features: int | None = None) -> tuple[DataFrame, list[str], int]:
    """A feature table cut to its first n features: (table, columns, classes)."""
    df = spark.read.parquet(path)
    return select_features(df, n_features)


def select_features(df: DataFrame, n_features: int | None = None) -> tuple[DataFrame, list[str], int]:
    names = feature_columns(df, n_features)
    n_classes = int(df.agg(F.max("label")).first()[0]) + 1
    keep = [c for c in ("sample_id",) if c in df.columns]
    return df.select(*keep, *names, "label"), names, n_classes


def read_prompt_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("prompt", "label")


def read_sae_weights(
    spark: SparkSession, path: str, layers: Sequence[int] | None = None,
    stride: int = 1, expected_d_model: int | None = None,
) -> DataFrame:
    """Encoder weights of the listed layers, or of every `stride`-th layer."""
    weights = spark.read.parquet(path)
    if layers is not None:
        weights = weights.where(F.col("layer").isin(list(layers)))
    elif stride > 1:
        weights = weights.where(F.col("layer") % stride == 0)
    widths = weights.groupBy("layer").agg(F.min(F.size("w")).alias("low"), F.max(F.size("w")).alias("high"))
    sizes = widths.orderBy("layer").collect()
    missing = set(layers or ()) - {r["layer"] for r in sizes}
    if missing or not sizes:
        raise ValueError(f"no weights for layers {sorted(missing) or 'given'}")
    for row in sizes:
        wanted = expected_d_model if expected_d_model is not None else row["low"]
        if row["low"] != wanted or row["high"] != wanted:
            raise ValueError(f"layer {row['layer']} has d_model={row['low']}..{row['high']}, expected {wanted}")
    return weights


def write_split_tables(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A table with a `split` column, one folder per split."""
    df.write.mode(mode).partitionBy("split").parquet(path)


def write_variances(variance: DataFrame, path: str, keys: Sequence[str] = ("layer",), mode: str = "errorifexists") -> None:
    """The variance of every feature, per layer or snapshot."""
    variance.select(*keys, "feature_id", "variance").write.mode(mode).partitionBy(*keys).parquet(path)


def write_manifest(spark: SparkSession, prefix: str, parts: Mapping[str, DataFrame | object]) -> None:
    """One JSON document: small tables become arrays of structs, the rest fields.

    Every table here is a summary (scores per layer, metrics per topic).
    """
    row = spark.range(1).select(F.lit(1).alias("_one"))
    for name, part in parts.items():
        if isinstance(part, DataFrame):
            items = part.agg(F.array_sort(F.collect_list(F.struct(*part.columns))).alias(name)).withColumn("_one", F.lit(1))
            row = row.join(items, "_one")
        else:
            row = row.withColumn(name, F.lit(part))
    row.drop("_one").coalesce(1).write.option("ignoreNullFields", "false").json(f"{prefix}_meta.json")


def latest_run(spark: SparkSession, folder: str) -> str:
    """Prefix of the run with the newest time stamp, whatever its model."""
    try:
        # Only paths are read: no byte of a manifest leaves the file.
        files = spark.read.format("binaryFile").load(f"{folder}/*_meta.json")
    except AnalysisException as error:
        raise FileNotFoundError(f"no runs found in {folder}") from error
    path = F.col("path")
    runs = files.select(path.alias("path"), F.regexp_extract(path, STAMP, 1).alias("stamp")).where("stamp != ''")
    newest = runs.agg(F.max_by("path", "stamp")).first()[0]
    if newest is None:
        raise FileNotFoundError(f"no runs found in {folder}")
    return newest[: newest.rindex("_meta.json")]


def load_run(spark: SparkSession, prefix: str) -> dict[str, DataFrame]:
    """Manifest, test metadata and model weights of a run; all must be there."""
    members = {}
    readers = {
        "meta": lambda: spark.read.json(f"{prefix}_meta.json", multiLine=True),
        "test": lambda: spark.read.parquet(f"{prefix}_test.parquet"),
        "weights": lambda: spark.read.parquet(f"{prefix}_weights.parquet"),
    }
    for name, read in readers.items():
        try:
            members[name] = read()
        except AnalysisException as error:
            raise FileNotFoundError(f"run {prefix} lacks its {name}") from error
    return members
