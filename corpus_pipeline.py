"""From raw documents to token ids: toxicity, line dedup, near-dedup, mixing, encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenact.llm import byte_bpe, line_dedup, mixing, toxicity
from lumenact.llm.near_dedup import first_of_each
from lumenact.llm.queries import BPE_RANKS, table
from lumenact.llm.tables import shared_table, small_batches

#: Classifiers, shingle sets and merges cannot be stated in SQL.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model rejects go."""
    labels = table(small_batches(spark), sf_dir, "labels")
    return toxicity.without_toxic(docs, toxicity.fit(docs, labels))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go, rare long ones too; n_chars follows the text."""
    cleaned = line_dedup.without_boilerplate(docs, "source", rare=line_dedup.RARE).drop("_removed")
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    small_batches(spark)
    return first_of_each(docs, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources repeat up to one and a half times; no document is left out."""
    return mixing.mixed_documents(docs, mixing.Target(max_repeats=1.5))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of what they decode to."""
    small_batches(spark)
    return byte_bpe.round_trip_digests(docs, public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic), ("line dedup", drop_lines), ("MinHash near-dedup", near_dedup),
    ("temperature mixing", mix_sources), ("byte-level BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each one's result is written and read back for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
