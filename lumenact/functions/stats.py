"""Statistics that count absent rows as zeros, exact quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import match


def variance_with_zeros(value: str, domain: Column) -> Column:
    """Population variance over `domain` values of which absent rows are 0.

    The n values present have a mean m and n*var_pop as squared deviations;
    merging them with (domain - n) zeros adds m^2 * n * (domain - n) / domain.
    """
    n = F.count(value).cast("double")
    d = domain.cast("double")
    spread = F.var_pop(value) * n + F.avg(value) * F.avg(value) * n * (d - n) / d
    return spread / d


def std_with_zeros(value: str, domain: Column) -> Column:
    return F.sqrt(variance_with_zeros(value, domain))


def grouped_quantile(
    df: DataFrame, keys: Sequence[str], value: str, p: float, name: str, accuracy: int = 10_000
) -> DataFrame:
    """Exact interpolated quantile of a continuous column per group.

    A sketch brackets the quantile; values below the bracket are only counted,
    values above it dropped, and equal values inside it collapsed before one
    group's bracket is sorted. Small groups use their whole range.
    """
    keys = list(keys)
    margin = 2.0 / accuracy
    sketch = df.groupBy(*keys).agg(
        F.count(value).alias("_n"),
        F.min(value).alias("_min"),
        F.max(value).alias("_max"),
        F.percentile_approx(
            value, [max(p - margin, 0.0), min(p + margin, 1.0)], accuracy).alias("_b"),
    )
    small = F.col("_n") < 4 * accuracy
    brackets = sketch.select(
        *keys, "_n",
        F.when(small, F.col("_min")).otherwise(F.col("_b")[0]).alias("_lo"),
        F.when(small, F.col("_max")).otherwise(F.col("_b")[1]).alias("_hi"),
    )
    inside = (
        match(df.select(*keys, F.col(value).alias("_v")), brackets, keys)
        .where(F.col("_v") <= F.col("_hi"))
        .withColumn("_v", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")))
        .groupBy(*keys, "_n", "_v").agg(F.count(F.lit(1)).alias("_c"))
    )
    running = Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    place = F.lit(p) * (F.col("_n") - 1)
    through = inside.withColumn("_through", F.sum("_c").over(running)).withColumn("_place", place)
    return (
        through.groupBy(*keys)
        .agg(
            F.min(F.when(F.col("_through") > F.floor("_place"), F.col("_v"))).alias("_low"),
            F.min(F.when(F.col("_through") > F.ceil("_place"), F.col("_v"))).alias("_high"),
            F.max(F.col("_place") - F.floor("_place")).alias("_frac"),
        )
        .select(*keys, (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_frac")).alias(name))
    )

