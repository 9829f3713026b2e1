"""Nearest bit vectors through an index over parts of the bits.

The bits of a vector are cut into m parts. If two vectors differ in fewer than
m * (s + 1) bits, some part differs in at most s. So round s looks every part of
a query up with s bits turned, and a query is finished once its k-th distance is
below m * (s + 1): nothing that was not met can be nearer. Vectors are met in
tasks that hold a run of part values; a value that many vectors share is cut into
blocks by a hash, and a task keeps k rows per query, so no pairs leave it. Within
a value, vectors are ordered by their number of set bits and only those whose
number lies within the query's k-th distance so far are compared.

When turning more bits would meet more vectors than there are, the queries still
open are compared with all vectors, block by block.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations
from math import ceil, comb, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

WORD = 63
PAIRS = 1 << 18  # comparisons made at once; one query adds at most a block of rows
FAR = 1 << 20  # more bits than any vector has
NONE = -1
FOUND = "query_id long, distance int, neighbor_id long, compared long"


def part_places(n_bits: int, n_vectors: int) -> list[tuple[int, int]]:
    """(first bit, width) of each part; a part has about log2(vectors) bits, and there are two at least."""
    wanted = min(max(ceil(log2(max(n_vectors, 2))), 4), 24, max(n_bits // 2, 1))
    pieces = -(-n_bits // wanted)
    cuts = [n_bits * i // pieces for i in range(pieces + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def turned(width: int, s: int) -> list[int]:
    """All masks of `width` bits with s of them set."""
    return [sum(1 << i for i in chosen) for chosen in combinations(range(width), s)]


def _part_values(bits: Column, places, masks: Callable[[int], list[int]]) -> Column:
    """Array of (part, value): every part of the vector under each of the masks of its width."""
    def turned_values(part: int, value: Column, some: Column) -> Column:
        return F.transform(some, lambda m: F.struct(F.lit(part).alias("part"), value.bitwiseXOR(m).alias("value")))

    values = []
    for part, (start, width) in enumerate(places):
        word, shift = divmod(start, WORD)
        value = F.shiftright(F.get(bits, F.lit(word)), shift)
        if shift + width > WORD:
            value = value.bitwiseOR(F.shiftleft(F.get(bits, F.lit(word + 1)), WORD - shift))
        value = value.bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        some = F.array(*[F.lit(m).cast("long") for m in masks(width)])
        values.append(turned_values(part, value, some))
    return F.flatten(F.array(*values))


def _meet(k: int):
    """The k nearest vectors of each query among those with its part value."""

    def meet(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or rows.empty:
            return pd.DataFrame(columns=["query_id", "distance", "neighbor_id", "compared"])
        # A place of a row: its value, then its number of ones.
        values = pd.MultiIndex.from_frame(rows[["part", "value"]].drop_duplicates())
        place = values.get_indexer(pd.MultiIndex.from_frame(rows[["part", "value"]])) * FAR + rows["ones"].to_numpy()
        order = np.argsort(place, kind="stable")
        place, ids = place[order], rows["neighbor_id"].to_numpy()[order]
        bits = np.stack(rows["bits"].to_numpy())[order]
        at = values.get_indexer(pd.MultiIndex.from_frame(queries[["part", "value"]]))
        asked, query_bits = queries["query_id"].to_numpy(), np.stack(queries["bits"].to_numpy())
        ones, worst = queries["ones"].to_numpy().astype(np.int64), queries["worst"].to_numpy().astype(np.int64)
        low = np.searchsorted(place, at * FAR + np.maximum(ones - worst, 0))
        high = np.searchsorted(place, at * FAR + np.minimum(ones + worst, FAR - 1), side="right")
        size = np.where(at >= 0, high - low, 0)
        # Queries in runs with about PAIRS comparisons.
        runs = np.flatnonzero(np.diff(np.cumsum(size) // PAIRS, prepend=-1))
        parts = []
        for first, last in zip(runs, [*runs[1:], len(size)], strict=True):
            run = size[first:last]
            query = first + np.repeat(np.arange(len(run)), run)
            row = np.arange(len(query)) + np.repeat(low[first:last] - np.cumsum(run) + run, run)
            distance = np.bitwise_count(query_bits[query] ^ bits[row]).sum(axis=1, dtype=np.int64)
            near = np.flatnonzero(distance <= worst[query])
            near = near[np.lexsort((ids[row[near]], distance[near], asked[query[near]]))]
            # A vector met through several values counts once.
            again = (np.diff(asked[query[near]]) == 0) & (np.diff(ids[row[near]]) == 0)
            near = near[np.append(True, ~again)[:len(near)]]
            owner = asked[query[near]]
            new = np.flatnonzero(np.diff(owner, prepend=owner[:1] - 1))
            rank = np.arange(len(owner)) - np.repeat(new, np.diff(np.append(new, len(owner))))
            near = near[rank < k]
            parts.append(pd.DataFrame({
                "query_id": asked[query[near]], "distance": distance[near], "neighbor_id": ids[row[near]], "compared": 0}))
        # A row without a distance carries the number of comparisons.
        parts.append(pd.DataFrame({"query_id": asked, "distance": NONE, "neighbor_id": 0, "compared": size})[size > 0])
        return pd.concat(parts).astype("int64")

    return meet


def _blocks(rows: DataFrame, key: list[str], block_rows: int) -> DataFrame:
    """Values that more than one block of rows share, and their number of blocks."""
    return rows.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_n")).where("_n > 1")


def _met(asked: DataFrame, index: DataFrame, k: int, block_rows: int, n_rows: int) -> DataFrame:
    """Queries and vectors brought together by (part, value)."""
    key = ["part", "value"]
    many_rows = _blocks(index, key, block_rows).withColumnRenamed("_n", "_rows")
    many_asked = _blocks(asked, key, block_rows).withColumnRenamed("_n", "_asked")
    buckets = max(-(-n_rows // block_rows), 1)

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        one = F.lit(1)
        cut = df.join(many_rows, key, "left").join(many_asked, key, "left").withColumn(
            f"{own}_block", F.pmod(F.xxhash64("bits"), F.coalesce(own, one)).cast("int")).withColumn(
            f"{other}_block", F.explode(F.sequence(F.lit(0), F.coalesce(other, one) - 1)))
        return cut.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets))).drop("_rows", "_asked")

    meeting = ["bucket", "_rows_block", "_asked_block"]
    return dealt(asked, "_asked", "_rows").groupBy(*meeting).cogroup(
        dealt(index, "_rows", "_asked").groupBy(*meeting)).applyInPandas(_meet(k), FOUND)


def nearest_by_index(
    vectors: DataFrame, asked: DataFrame, k: int, n_bits: int, block_rows: int = 32_768,
) -> tuple[DataFrame, DataFrame]:
    """The k nearest of `vectors` (neighbor_id, bits) for each of `asked` (query_id, bits), ties to the lower id.

    `bits` are words of 63 bits, equal in number in both tables; vectors are
    distinct. Returns (query_id, distance, neighbor_id), k rows or all vectors
    per query, and a report (query_id, rounds, compared): how often the query
    was looked up and with how many vectors it was compared.
    """
    def ones(words: Column) -> Column:
        return F.aggregate(words, F.lit(0), lambda a, w: a + F.bit_count(w))

    vectors = vectors.select("neighbor_id", "bits", ones(F.col("bits")).alias("ones"))
    n = vectors.count()
    places = part_places(n_bits, n)
    m = len(places)
    index = stage(vectors.withColumn("_v", F.explode(_part_values(F.col("bits"), places, lambda w: [0]))).select(
        "neighbor_id", "bits", "ones", "_v.part", "_v.value"))
    # Both sides may come from one table: a new name keeps their columns apart.
    asked = asked.select("query_id", F.col("bits").alias("bits"))
    open_queries = stage(asked.select("query_id", "bits", ones(F.col("bits")).alias("ones"), F.lit(FAR).alias("worst")))
    empty = open_queries.sparkSession.createDataFrame([], FOUND)
    best, met, s = empty, [], 0
    nearest = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    while True:
        meetings = sum(comb(width, s) * max(n / 2 ** width, 1) for _, width in places)
        whole = meetings > n / 2 or s > min(width for _, width in places)
        if whole:
            probes = open_queries.withColumn("part", F.lit(0)).withColumn("value", F.lit(0).cast("long"))
            rows = vectors.withColumn("part", F.lit(0)).withColumn("value", F.lit(0).cast("long"))
            found = _met(probes, rows, k, block_rows, n)
        else:
            probes = open_queries.withColumn("_v", F.explode(_part_values(
                F.col("bits"), places, lambda w, s=s: turned(w, s)))).select(
                "query_id", "bits", "ones", "worst", "_v.part", "_v.value")
            found = _met(probes, index, k, block_rows, n * m)
        found = stage(found)
        met.append(found.groupBy("query_id").agg(F.sum("compared").alias("compared")).withColumn("round", F.lit(s)))
        # A vector met again, through another part or round, is one row.
        best = stage(best.unionByName(found.where(F.col("distance") != NONE)).groupBy("query_id", "neighbor_id").agg(
            F.min("distance").alias("distance")).withColumn(
            "_r", F.row_number().over(nearest)).where(F.col("_r") <= k).drop("_r").withColumn(
            "compared", F.lit(0).cast("long")))
        if whole:
            break
        kth = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"), F.max("distance").alias("_d"))
        open_queries = stage(open_queries.join(kth, "query_id", "left").withColumn(
            "worst", F.when(F.col("_n") >= k, F.col("_d")).otherwise(F.lit(FAR))).where(
            F.col("worst") >= m * (s + 1)).drop("_n", "_d"))
        if open_queries.isEmpty():
            break
        s += 1
    report = met[0]
    for more in met[1:]:
        report = report.unionByName(more)
    report = asked.select("query_id").join(report, "query_id", "left").groupBy("query_id").agg(
        F.coalesce(F.max("round") + 1, F.lit(1)).alias("rounds"), F.coalesce(F.sum("compared"), F.lit(0)).alias("compared"))
    return best.select("query_id", "distance", "neighbor_id"), report
