"""Step coverage, single-step variance and lock-in of the right class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import variance_with_zeros

LOCKIN = 0.9
MIN_COVERAGE = 0.5


def _steps_of(n_steps: str = "n_steps") -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(n_steps) - 1))


def step_coverage(samples: DataFrame, minimum: float = MIN_COVERAGE) -> DataFrame:
    """Share of samples still active at each step, while at least `minimum`.

    Coverage only falls, so the filter keeps a prefix. Samples are counted per
    length before lengths are spread over steps.
    """
    lengths = samples.groupBy("n_steps").agg(F.count(F.lit(1)).alias("_n"))
    total = lengths.agg(F.sum("_n").alias("_all")).withColumn("_one", F.lit(1))
    active = (
        lengths.where(F.col("n_steps") > 0).select(_steps_of().alias("step"), "_n")
        .groupBy("step").agg(F.sum("_n").alias("n_active"))
    )
    return (
        active.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one")
        .select("step", "n_active", (F.col("n_active") / F.col("_all")).alias("coverage"))
        .where(F.col("coverage") >= minimum)
    )


def single_step_variance(
    fired: DataFrame, samples: DataFrame, coverage: DataFrame, d_sae: int, n_topics: int
) -> DataFrame:
    """Cross-topic variance of what fires at one step, averaged over all features.

    Rates count the samples active at the step; a step at which some topic has
    none is 0. `fired` holds one layer.
    """
    active = (
        samples.where(F.col("n_steps") > 0)
        .groupBy("label", "n_steps").agg(F.count(F.lit(1)).alias("_n"))
        .select("label", _steps_of().alias("step"), "_n")
        .groupBy("step", "label").agg(F.sum("_n").alias("n_label"))
    )
    present = active.groupBy("step").agg(F.count(F.lit(1)).alias("n_present"))
    counts = (
        fired.select("label", "step", F.explode("fired").alias("feature_id"))
        .groupBy("step", "label", "feature_id").agg(F.count(F.lit(1)).alias("n_fired"))
    )
    per_feature = (
        counts.join(active, ["step", "label"])
        .withColumn("rate", F.col("n_fired") / F.col("n_label"))
        .groupBy("step", "feature_id")
        .agg(variance_with_zeros("rate", F.lit(n_topics)).alias("variance"))
    )
    sums = per_feature.groupBy("step").agg((F.sum("variance") / F.lit(float(d_sae))).alias("_v"))
    return (
        coverage.join(present, "step").join(sums, "step", "left")
        .select("step", "coverage",
                F.when(F.col("n_present") < n_topics, 0.0).otherwise(F.coalesce("_v", F.lit(0.0))).alias("variance"))
    )


def analysed(curve: DataFrame, coverage: DataFrame) -> DataFrame:
    """The curve at the steps that enough samples reach."""
    return curve.join(coverage.select(F.col("step").alias("t")), "t", "left_semi")


def topic_confidence(curve: DataFrame) -> DataFrame:
    """Mean probability of the right class per topic and step."""
    return curve.groupBy("label", "t").agg(F.avg("p_true").alias("mean_p_true"))


def lockin_steps(curve: DataFrame, threshold: float = LOCKIN) -> DataFrame:
    """First step at which the right class reaches the threshold, or -1."""
    return curve.groupBy("sample_id", "label").agg(
        F.coalesce(F.min(F.when(F.col("p_true") >= threshold, F.col("t"))), F.lit(-1)).alias("lockin"))


def lockin_summary(lockin: DataFrame) -> DataFrame:
    """Median, spread and share of samples that lock in, per topic."""
    reached = F.when(F.col("lockin") >= 0, F.col("lockin"))
    return lockin.groupBy("label").agg(
        F.percentile(reached, 0.5).alias("median"),
        F.stddev_pop(reached).alias("std"),
        F.count(reached).alias("n_reached"),
        F.count(F.lit(1)).alias("n_samples"),
        (F.lit(100.0) * F.count(reached) / F.count(F.lit(1))).alias("pct_reached"))


def median_spread(summary: DataFrame, limit: float = 10.0) -> DataFrame:
    """Range of the topic medians; null with fewer than two of them."""
    spread = F.when(F.count("median") > 1, F.max("median") - F.min("median"))
    return summary.agg(spread.alias("spread")).withColumn("consistent", F.col("spread") < limit)


def peak_step(variance: DataFrame) -> DataFrame:
    """The step of highest single-step variance, the first of equals."""
    return variance.orderBy(F.round("variance", 12).desc(), "step").limit(1).select("step", "variance")


def lockin_boxes(lockin: DataFrame) -> DataFrame:
    """Quartiles and whiskers (within 1.5 interquartile ranges) per topic."""
    counted = lockin.where(F.col("lockin") >= 0).groupBy("label", "lockin").agg(F.count(F.lit(1)).alias("n"))
    quartiles = counted.groupBy("label").agg(
        F.percentile("lockin", [0.25, 0.5, 0.75], F.col("n")).alias("_q"))
    q1, q3 = F.col("_q")[0], F.col("_q")[2]
    reach = F.lit(1.5) * (q3 - q1)
    near = F.col("lockin").between(q1 - reach, q3 + reach)
    inside = F.when(near, F.col("lockin"))
    return counted.join(quartiles, "label").groupBy("label").agg(
        F.max(q1).alias("q1"), F.max(F.col("_q")[1]).alias("q2"), F.max(q3).alias("q3"),
        F.min(inside).alias("whisker_low"), F.max(inside).alias("whisker_high"),
        F.sum(F.when(near, 0).otherwise(F.col("n"))).alias("n_outliers"))
