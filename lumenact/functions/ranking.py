"""Seeded orders, exact ranks and rank cut-offs without a one-task sort.

A seeded order sorts by md5(seed:id). Because md5 spreads ids evenly, its
leading hex digits cut any group, however large, into even buckets: bucket
counts give the offset of each bucket, and a row's exact rank is that offset
plus its rank inside the bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import match

HEX_DIGITS = 3


def seeded_key(seed: int | str | Column, *parts: Column) -> Column:
    """Hex key that orders rows at random but repeatably."""
    first = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", first, *[p.cast("string") for p in parts]))


def key_number(key: Column) -> Column:
    """The first 32 bits of a hex key."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long")


def draw_index(key: Column, n: int) -> Column:
    """Uniform 0-based choice among n."""
    return key_number(key) % F.lit(n)


def draw_unit(key: Column) -> Column:
    """Uniform double in [0, 1)."""
    return key_number(key).cast("double") / F.lit(4294967296.0)


def key_bucket(key: Column, digits: int = HEX_DIGITS) -> Column:
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("int")


def bucketed_rank(
    df: DataFrame,
    order: Sequence[str],
    bucket: Column,
    groups: Sequence[str] = (),
    name: str = "rank",
) -> DataFrame:
    """Exact 0-based rank by `order` within `groups`.

    `bucket` must rise with `order` and keep its buckets small; only one
    bucket of one group is ever sorted in a task.
    """
    groups = list(groups)
    with_bucket = df.withColumn("_bucket", bucket)
    counts = with_bucket.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    offsets = counts.select(
        *groups, "_bucket", (F.sum("_n").over(before) - F.col("_n")).alias("_offset"))
    inside = Window.partitionBy(*groups, "_bucket").orderBy(*order)
    return (
        match(with_bucket, offsets, [*groups, "_bucket"])
        .withColumn(name, F.col("_offset") + F.row_number().over(inside) - 1)
        .drop("_bucket", "_offset")
    )


def hash_rank(
    df: DataFrame,
    id_col: str,
    seed: int | str,
    groups: Sequence[str] = (),
    name: str = "rank",
    digits: int = HEX_DIGITS,
) -> DataFrame:
    """Exact 0-based rank of each row in the seeded order of its ids."""
    keyed = df.withColumn("_key", seeded_key(seed, F.col(id_col)))
    ranked = bucketed_rank(
        keyed, ["_key", id_col], key_bucket(F.col("_key"), digits), groups, name)
    return ranked.drop("_key")


def hash_cutoffs(
    df: DataFrame,
    groups: Sequence[str],
    id_col: str,
    seed: int | str | Column,
    take: Callable[[Column], Column],
    digits: int = HEX_DIGITS,
    totals: bool = False,
) -> DataFrame:
    """Last key of the first `take(count)` rows of each group, in seeded order.

    Reads only the group and id columns. Rows are counted per bucket, and only
    the one bucket of each group that holds the cut is sorted. The result has
    one row per group of which something is taken: (groups, cut_key, cut_id);
    with `totals`, one row per group with total and taken as well.
    """
    groups = list(groups)
    key = seeded_key(seed, F.col(id_col))
    narrow = df.select(*groups, F.col(id_col).alias("_id"), key.alias("_key"))
    narrow = narrow.withColumn("_bucket", key_bucket(F.col("_key"), digits))
    counts = narrow.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    counts = (
        counts.withColumn("_through", F.sum("_n").over(running))
        .withColumn("total", F.sum("_n").over(Window.partitionBy(*groups)))
        .withColumn("taken", F.least(take(F.col("total")), F.col("total")).cast("long"))
    )
    edges = counts.where(
        (F.col("_through") >= F.col("taken")) & (F.col("_through") - F.col("_n") < F.col("taken"))
    ).select(*groups, "_bucket", (F.col("taken") - F.col("_through") + F.col("_n")).alias("_nth"))
    inside = Window.partitionBy(*groups, "_bucket").orderBy("_key", "_id")
    cuts = (
        match(narrow, edges, [*groups, "_bucket"])
        .withColumn("_rn", F.row_number().over(inside))
        .where(F.col("_rn") == F.col("_nth"))
        .select(*groups, F.col("_key").alias("cut_key"), F.col("_id").alias("cut_id"))
    )
    if not totals:
        return cuts
    sizes = counts.groupBy(*groups).agg(F.max("total").alias("total"), F.max("taken").alias("taken"))
    if not groups:
        return sizes.withColumn("_one", F.lit(1)).join(
            cuts.withColumn("_one", F.lit(1)), "_one", "left").drop("_one")
    return match(sizes, cuts, groups, "left")


def before_cut(id_col: str, seed: int | str | Column) -> Column:
    """True for rows up to and including the cut of their group."""
    key = seeded_key(seed, F.col(id_col))
    return F.coalesce(
        (key < F.col("cut_key")) | ((key == F.col("cut_key")) & (F.col(id_col) <= F.col("cut_id"))),
        F.lit(False),
    )
