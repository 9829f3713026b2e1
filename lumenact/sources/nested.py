"""Reading text out of nested datasets by a column specification."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import row_text, seeded_sample


def read_topic_rows(spark: SparkSession, specs: Sequence[Mapping]) -> DataFrame:
    """(topic, id, text) of several datasets, one topic each.

    A spec names topic, path, columns and id, and optionally format ("parquet"),
    options and a schema. Rows without any text are left out.
    """
    out = None
    for spec in specs:
        reader = spark.read.format(spec.get("format", "parquet")).options(**spec.get("options", {}))
        if spec.get("schema") is not None:
            reader = reader.schema(spec["schema"])
        rows = reader.load(spec["path"])
        part = rows.select(
            F.lit(spec["topic"]).alias("topic"), F.col(spec["id"]).cast("long").alias("id"),
            row_text(rows, spec["columns"]).alias("text")).where(F.col("text") != "")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no datasets given")
    return out


def topic_texts(spark: SparkSession, specs: Sequence[Mapping], needed: int, seed: int) -> DataFrame:
    """At most `needed` usable rows per topic, in seeded order."""
    return seeded_sample(read_topic_rows(spark, specs), "id", needed, seed, ["topic"])[0]
