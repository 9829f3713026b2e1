"""Exact nearest neighbours on binary feature vectors.

Vectors are packed into 63-bit words. Short 0/1 vectors repeat a lot, so equal
ones are compared once: of the training rows with the same bits only the k of
the lowest ids can be neighbours, and test rows with the same bits share theirs.
Training vectors that fit one block are compared in numpy with each block of
queries, and a task keeps only the k nearest per query, so no table of pairs
ever exists. More vectors than that are met through an index (`neighbor_index`).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .neighbor_index import WORD, nearest_by_index

BLOCK_ROWS = 32_768
CHUNK = 256


def packed_vectors(first: DataFrame, samples: DataFrame, ids: Sequence[int]) -> DataFrame:
    """(sample_id, label, bits): bit i of the words tells whether ids[i] fired."""
    words = []
    for start in range(0, len(ids), WORD):
        bits = [F.max(F.when(F.col("feature_id") == int(f), F.lit(1 << j)).otherwise(0))
                for j, f in enumerate(ids[start:start + WORD])]
        total = bits[0]
        for bit in bits[1:]:
            total = total + bit
        words.append(total.cast("long").alias(f"_w{len(words)}"))
    packed = first.groupBy("sample_id").agg(*words)
    return samples.select("sample_id", "label").join(packed, "sample_id", "left").select(
        "sample_id", "label",
        F.array(*[F.coalesce(f"_w{i}", F.lit(0).cast("long")) for i in range(len(words))]).alias("bits"))


def _nearest_in_block(k: int):
    def nearest(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        names = ["sample_id", "distance", "neighbor_id", "neighbor_label"]
        if queries.empty or rows.empty:
            return pd.DataFrame(columns=names)
        rows = rows.sort_values("neighbor_id")
        ids, labels = rows["neighbor_id"].to_numpy(), rows["neighbor_label"].to_numpy()
        train = np.stack(rows["neighbor_bits"].to_numpy())
        parts = []
        keep = min(k, len(rows))
        for start in range(0, len(queries), CHUNK):
            part = queries.iloc[start:start + CHUNK]
            bits = np.stack(part["query_bits"].to_numpy())
            distance = np.zeros((len(part), len(rows)), dtype=np.int64)
            for word in range(train.shape[1]):
                distance += np.bitwise_count(bits[:, word, None] ^ train[None, :, word])
            # Rows are in id order, so this key breaks ties by the lower id.
            order = distance * len(rows) + np.arange(len(rows))
            best = np.argpartition(order, keep - 1, axis=1)[:, :keep]
            where = np.arange(len(part))[:, None]
            parts.append(pd.DataFrame({
                "sample_id": np.repeat(part["query_id"].to_numpy(), keep),
                "distance": distance[where, best].ravel().astype(np.int32),
                "neighbor_id": ids[best].ravel(),
                "neighbor_label": labels[best].ravel(),
            }))
        return pd.concat(parts)

    return nearest


def _one_block(vectors: DataFrame, asked: DataFrame, k: int, block_rows: int) -> DataFrame:
    """Blocks of queries, each compared with all of a few vectors."""
    n_left = max(-(-asked.count() // block_rows), 1)
    left = asked.select(
        "query_id", F.col("bits").alias("query_bits"), F.pmod(F.xxhash64("bits"), F.lit(n_left)).alias("_left"))
    right = vectors.select(
        "neighbor_id", F.lit(0).alias("neighbor_label"), F.col("bits").alias("neighbor_bits"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_left - 1).cast("long"))).alias("_left"))
    schema = "sample_id long, distance int, neighbor_id long, neighbor_label int"
    return left.groupBy("_left").cogroup(right.groupBy("_left")).applyInPandas(
        _nearest_in_block(k), schema).select(F.col("sample_id").alias("query_id"), "distance", "neighbor_id")


def nearest_neighbors(
    train: DataFrame, test: DataFrame, k: int, block_rows: int = BLOCK_ROWS, n_bits: int | None = None
) -> DataFrame:
    """The k nearest training rows of each test row, ranked from 1.

    Distance is the number of differing bits, of which a vector has `n_bits`
    (all bits of its words by default); ties go to the lower id.
    """
    vectors, asked = _distinct(train, test, k)
    if vectors.count() <= block_rows:
        near = _one_block(vectors, asked, k, block_rows)
    else:
        n_bits = n_bits or vectors.select(F.size("bits")).first()[0] * WORD
        near, _ = nearest_by_index(vectors, asked, k, n_bits, block_rows)
    return _rows(near, vectors, asked, test, k)


def indexed_neighbors(
    train: DataFrame, test: DataFrame, k: int, n_bits: int, block_rows: int = BLOCK_ROWS
) -> tuple[DataFrame, DataFrame]:
    """The same rows through the index, and its report with one row per distinct test vector."""
    vectors, asked = _distinct(train, test, k)
    near, report = nearest_by_index(vectors, asked, k, n_bits, block_rows)
    return _rows(near, vectors, asked, test, k), report


def _distinct(train: DataFrame, test: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Each vector of either side once; of the training rows that share one, the k of the lowest ids."""
    lowest = Window.partitionBy("bits").orderBy("sample_id")
    vectors = train.withColumn("_rn", F.row_number().over(lowest)).where(F.col("_rn") <= k).groupBy("bits").agg(
        F.min("sample_id").alias("neighbor_id"), F.collect_list(F.struct("sample_id", "label")).alias("members"))
    asked = test.groupBy("bits").agg(F.min("sample_id").alias("query_id"))
    return stage(vectors), stage(asked)


def _rows(near: DataFrame, vectors: DataFrame, asked: DataFrame, test: DataFrame, k: int) -> DataFrame:
    """Back to rows: the members of each near vector, then every test row with the query's bits."""
    rows = near.join(vectors.select("neighbor_id", F.explode("members").alias("_m")), "neighbor_id").select(
        "query_id", "distance", F.col("_m.sample_id").alias("neighbor_id"), F.col("_m.label").alias("neighbor_label"))
    rank = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    best = rows.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    owners = test.select("sample_id", "bits").join(asked, "bits").select("query_id", "sample_id")
    return owners.join(best, "query_id").select("sample_id", "distance", "neighbor_id", "neighbor_label", "rank")


def vote(neighbors: DataFrame, test: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Majority class among the k nearest, for each k; the lowest class on a tie."""
    sizes = F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: F.col("rank") <= k)
    votes = (
        neighbors.select("sample_id", "neighbor_label", F.explode(sizes).alias("k"))
        .groupBy("sample_id", "k", "neighbor_label").agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("sample_id", "k")
        .agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col("neighbor_label").alias("pred"))).alias("_v"))
    )
    return test.select("sample_id", "label").join(votes, "sample_id").select(
        "sample_id", "label", "k", F.col("_v.pred").alias("pred"))
