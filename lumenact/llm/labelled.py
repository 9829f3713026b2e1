"""Bounded samples of labelled documents, and sparse features looked up by hash."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import shared_table

SAMPLE_ROWS = 20_000
_FILTER_BITS = 22


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, limit: int = SAMPLE_ROWS,
    only: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, text, label) of at most `limit` labelled documents, those whose ids hash lowest.

    Null ids and labels are left out, a repeated id has its greatest label and
    its greatest text and is one row, null texts are empty. The sampled ids are
    at most `limit` and so are broadcast; only their texts are shuffled, the
    copies of each combined before. The sample does not depend on the layout of
    the files. `only` filters the labels.
    """
    rows = labels if only is None else labels.where(only)
    rows = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(
        F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = rows.orderBy(F.xxhash64("id", F.lit(17)), "id").limit(limit)
    texts = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    one = texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.max("text").alias("text"))
    return shared_table(one.select("id", "text", "label"), "sample")


class Lookup:
    """Positions of 64-bit keys in a sorted table of at most a bounded number of features."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys  # sorted
        self.maybe = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.maybe[keys >> np.uint64(64 - _FILTER_BITS)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are features, and which feature each is."""
        rows = np.flatnonzero(self.maybe[hashes >> np.uint64(64 - _FILTER_BITS)])
        if not len(rows) or not len(self.keys):
            none = np.zeros(0, dtype=np.int64)
            return none, none
        wanted = hashes[rows]
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        hit = self.keys[at] == wanted
        return rows[hit], at[hit]


def row_sums(docs: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(docs, weights=values, minlength=n).astype(np.float64)  # whole numbers if empty


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))
