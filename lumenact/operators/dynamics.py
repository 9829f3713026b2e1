"""Feature variance and refitted classifiers at snapshots of the generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import variance_with_zeros
from .discover import label_counts
from .evaluate import hit
from .linear import BIAS, as_arrays, bernoulli_weights, complete_counts, decide
from .temporal import _literal, entry_point


def cumulative_counts(first: DataFrame, grid: Sequence[int]) -> DataFrame:
    """Samples in which a feature fired before t: (t, label, feature_id, n_fired).

    First firings are counted per grid point, and the counts, not the rows,
    are spread over the later points.
    """
    entered = (
        first.select("label", "feature_id", entry_point(grid).alias("_t"))
        .where(F.col("_t").isNotNull())
        .groupBy("label", "feature_id", "_t").agg(F.count(F.lit(1)).alias("_n"))
    )
    later = F.filter(_literal(grid), lambda t: t >= F.col("_t"))
    return (
        entered.select("label", "feature_id", "_n", F.explode(later).alias("t"))
        .groupBy("t", "label", "feature_id").agg(F.sum("_n").alias("n_fired"))
    )


def snapshot_variance(first: DataFrame, samples: DataFrame, grid: Sequence[int]) -> DataFrame:
    """Cross-topic variance of the cumulative firing rate per (t, feature)."""
    counts = cumulative_counts(first, grid).join(label_counts(samples), "label")
    rates = counts.withColumn("rate", F.col("n_fired") / F.col("n_label"))
    return rates.groupBy("t", "feature_id").agg(
        variance_with_zeros("rate", F.max("n_topics")).alias("variance"))


def snapshot_weights(
    first: DataFrame, samples: DataFrame, ids: Sequence[int], grid: Sequence[int], alpha: float = 1.0
) -> DataFrame:
    """One Bernoulli model per snapshot, all fitted in one job."""
    labels = samples.groupBy("label").agg(F.count(F.lit(1)).alias("n_label"))
    total = samples.agg(F.count(F.lit(1)).alias("n")).withColumn("_one", F.lit(1))
    labels = labels.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").drop("_one")
    labels = labels.withColumn("t", F.explode(_literal(grid)))
    counts = complete_counts(labels, cumulative_counts(first, grid), ids, ["t"])
    return as_arrays(bernoulli_weights(counts, ["t"], alpha), ["t"])


def snapshot_predictions(
    first: DataFrame, samples: DataFrame, weights: DataFrame, classes: Sequence[int], grid: Sequence[int]
) -> DataFrame:
    """Predictions of each snapshot's own model on the features seen by then.

    A sample's firings, at most one for each chosen feature, are gathered once;
    the snapshots are then scored row by row, with one row of weights for each
    snapshot broadcast, so no firing is copied before a shuffle.
    """
    fires = first.groupBy("sample_id").agg(F.collect_list(F.struct("feature_id", "first_step")).alias("_fires"))
    models = weights.groupBy("t").agg(F.map_from_entries(F.collect_list(F.struct("feature_id", "w"))).alias("_model"))
    points = (
        samples.select("sample_id", "label").join(fires, "sample_id", "left")
        .withColumn("t", F.explode(_literal(grid))).join(F.broadcast(models), "t")
    )
    seen = F.filter("_fires", lambda x: x["first_step"] < F.col("t"))
    names = [f"_c{i}" for i in range(len(classes))]

    def total(i: int):
        own = F.col("_model")[F.lit(BIAS)][i]
        return F.coalesce(F.aggregate("_seen", own, lambda acc, x: acc + F.col("_model")[x["feature_id"]][i]), own)

    scored = points.withColumn("_seen", seen).select(
        "sample_id", "label", "t", *[total(i).alias(n) for i, n in enumerate(names)])
    return decide(scored, names, classes, ["sample_id", "label", "t"])


def snapshot_summary(predictions: DataFrame) -> DataFrame:
    """Accuracy and mean confidence per t, overall (label null) and per topic."""
    # Predictions are summed per topic first, so that only sums are taken twice.
    sums = predictions.groupBy("t", "label").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(hit()).alias("_hits"), F.sum("confidence").alias("_sure"))
    n = F.sum("_n")
    return (
        sums.groupingSets([["t"], ["t", "label"]], "t", "label")
        .agg((F.sum("_hits") / n).alias("accuracy"), (F.sum("_sure") / n).alias("mean_confidence"))
        .select("t", "label", "accuracy", "mean_confidence")
    )


def topic_crossing(summary: DataFrame, targets: Sequence[float], max_steps: int) -> DataFrame:
    """First t at which a topic's mean confidence reaches each target."""
    topics = summary.where(F.col("label").isNotNull())
    goals = F.explode(F.array(*[F.lit(float(c)) for c in targets])).alias("target")
    return (
        topics.select("label", "t", "mean_confidence", goals)
        .groupBy("label", "target")
        .agg(F.coalesce(F.min(F.when(F.round("mean_confidence", 7) >= F.col("target"), F.col("t"))),
                        F.lit(max_steps)).alias("step"))
    )
