"""Connected components of a large graph by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import shared_table


def components(links: DataFrame) -> DataFrame:
    """Smallest reachable id for every id that occurs in `links`.

    `links` has two columns of ids; their order and repeats do not matter, and
    links with a null end are ignored. Each round points every larger neighbour
    of a node, then every smaller one, at the smallest id of its neighbourhood;
    the number of rounds grows with the logarithm of the graph. A hub is only
    ever aggregated or joined, its neighbours are never gathered in a list.
    Returns (id, component), ids without a link left out.
    """
    one, other = links.columns
    edges = links.select(
        F.greatest(one, other).alias("u"), F.least(one, other).alias("v")
    ).where(F.col(one).isNotNull() & F.col(other).isNotNull() & (F.col("u") > F.col("v"))).distinct()
    edges = shared_table(edges, "links")
    seen = _digest(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = large.union(lowest.where("low < u").select("u", F.col("low").alias("v"))).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(lowest, "u").select(
            F.when(F.col("v") == F.col("low"), F.col("u")).otherwise(F.col("v")).alias("u"),
            F.col("low").alias("v"))
        edges = shared_table(small.where("u > v").distinct(), "links")
        now = _digest(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
        F.sum(F.col("v").cast("decimal(38,0)"))).first())
