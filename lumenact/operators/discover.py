"""Firing statistics and feature discovery on sparse, long tables.

`first_fire` holds one row per (sample, layer, feature) that fired at all,
with the first step it fired at. Absent rows are zeros everywhere below.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import std_with_zeros, variance_with_zeros

RANK_DIGITS = 12


def first_fire(fired: DataFrame, carry: Sequence[str] = ("sample_id", "label", "layer")) -> DataFrame:
    """First step at which each feature fires, per sample and layer."""
    return (
        fired.select(*carry, "step", F.explode("fired").alias("feature_id"))
        .groupBy(*carry, "feature_id").agg(F.min("step").alias("first_step"))
    )


def label_counts(samples: DataFrame) -> DataFrame:
    """Samples per label, with the number of labels on every row."""
    counts = samples.groupBy("label").agg(F.count(F.lit(1)).alias("n_label"))
    return counts.withColumn("n_topics", F.count(F.lit(1)).over(Window.partitionBy()))


def firing_rate(first: DataFrame, samples: DataFrame) -> DataFrame:
    """Share of all samples in which each feature of each layer fires."""
    total = samples.agg(F.count(F.lit(1)).alias("n_samples")).withColumn("_one", F.lit(1))
    fired = first.groupBy("layer", "feature_id").agg(F.count(F.lit(1)).alias("n_fired"))
    return (
        fired.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one")
        .select("layer", "feature_id", "n_fired", (F.col("n_fired") / F.col("n_samples")).alias("rate"))
    )


def topic_firing_rate(first: DataFrame, samples: DataFrame) -> DataFrame:
    """Share of each label's samples in which a feature fires."""
    fired = first.groupBy("layer", "label", "feature_id").agg(F.count(F.lit(1)).alias("n_fired"))
    return fired.join(label_counts(samples), "label").select(
        "layer", "label", "feature_id", (F.col("n_fired") / F.col("n_label")).alias("rate"), "n_topics")


def cross_topic_variance(rates: DataFrame, keys: Sequence[str] = ("layer", "feature_id")) -> DataFrame:
    """Population variance of the rate across topics, zeros included."""
    return rates.groupBy(*keys).agg(
        variance_with_zeros("rate", F.max("n_topics")).alias("variance"))


def feature_domain(layers: DataFrame, d_sae: int) -> DataFrame:
    """Every (layer, feature) pair, from a one-column frame of layers."""
    return layers.select("layer", F.explode(F.sequence(F.lit(0), F.lit(d_sae - 1))).alias("feature_id"))


def dense_variance(variance: DataFrame, layers: DataFrame, d_sae: int) -> DataFrame:
    """Variance of every feature, 0 for those that never fired."""
    return (
        feature_domain(layers, d_sae).join(variance, ["layer", "feature_id"], "left")
        .select("layer", "feature_id", F.coalesce("variance", F.lit(0.0)).alias("variance"))
    )


def top_features(variance: DataFrame, k: int, keys: Sequence[str] = ("layer",)) -> DataFrame:
    """The k features of highest variance per key, rank 1 first."""
    order = Window.partitionBy(*keys).orderBy(
        F.round("variance", RANK_DIGITS).desc(), F.col("feature_id"))
    return variance.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def layer_scores(variance: DataFrame, k: int, d_sae: int) -> DataFrame:
    """Mean of the k largest variances per layer."""
    return top_features(variance, k).groupBy("layer").agg(
        (F.sum("variance") / F.lit(float(min(k, d_sae)))).alias("score"))


def best_layer(scores: DataFrame) -> DataFrame:
    """The layer of highest score, the lowest layer on a tie."""
    return scores.orderBy(F.round("score", RANK_DIGITS).desc(), "layer").limit(1)


def discover(
    first: DataFrame,
    samples: DataFrame,
    k: int,
    d_sae: int,
    layer: int | None = None,
    layers: DataFrame | None = None,
) -> DataFrame:
    """The best layer's k features: (layer, feature_id, variance, rank).

    A given `layer` skips the search. `layers` pads the ranking with features
    of variance 0 when fewer than k ever fired.
    """
    if layer is not None:
        first = first.where(F.col("layer") == layer)
    variance = cross_topic_variance(topic_firing_rate(first, samples))
    if layers is not None:
        if layer is not None:
            layers = layers.where(F.col("layer") == layer)
        variance = dense_variance(variance, layers, d_sae)
    chosen = top_features(variance, k)
    if layer is not None:
        return chosen
    # k rows per layer are left: rank the layers by the mean over those.
    score = F.sum("variance").over(Window.partitionBy("layer")) / F.lit(float(min(k, d_sae)))
    order = Window.partitionBy().orderBy(F.round("_score", RANK_DIGITS).desc(), "layer")
    return (
        chosen.withColumn("_score", score).withColumn("_place", F.rank().over(order))
        .where(F.col("_place") == 1).drop("_score", "_place")
    )


def variance_summary(
    variance: DataFrame, d_sae: int, percents: Sequence[int], keys: Sequence[str] = ("layer",)
) -> DataFrame:
    """Moments and percentiles over all d_sae features, from the sparse rows.

    The features without a row enter the percentiles as one zero with their
    number as its frequency.
    """
    keys = list(keys)
    domain = F.lit(float(d_sae))
    present = variance.groupBy(*keys).agg(
        (F.sum("variance") / domain).alias("mean"),
        std_with_zeros("variance", domain).alias("std"),
        F.max("variance").alias("max"),
        F.count_if(F.col("variance") > 0).alias("n_nonzero"),
        F.count(F.lit(1)).alias("_n"),
    )
    zeros = present.where(F.col("_n") < d_sae).select(
        *keys, F.lit(0.0).alias("variance"), (F.lit(d_sae) - F.col("_n")).alias("_freq"))
    weighted = variance.select(*keys, "variance", F.lit(1).cast("long").alias("_freq")).unionByName(zeros)
    cuts = weighted.groupBy(*keys).agg(
        F.percentile("variance", [p / 100.0 for p in percents], F.col("_freq")).alias("_p"))
    return present.join(cuts, keys).select(
        *keys, "mean", "std",
        *[F.col("_p")[i].alias(f"p{p}") for i, p in enumerate(percents)],
        "max", "n_nonzero")


def ranked_variances(chosen: DataFrame, keys: Sequence[str] = ("layer",)) -> DataFrame:
    """The chosen features and their variances as arrays in rank order."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "feature_id", "variance")))
    return chosen.groupBy(*keys).agg(rows.alias("_r")).select(
        *keys,
        F.transform("_r", lambda r: r["feature_id"]).alias("feature_ids"),
        F.transform("_r", lambda r: r["variance"]).alias("feature_variances"))


def feature_ids_in_order(chosen: DataFrame) -> list[int]:
    """The chosen ids by rank: one layer's k, which the caller has set."""
    rows = chosen.select("rank", "feature_id").collect()
    return [r["feature_id"] for r in sorted(rows, key=lambda r: r["rank"])]


def keep_chosen(first: DataFrame, chosen: DataFrame) -> DataFrame:
    """Firings of the chosen features only."""
    return first.join(F.broadcast(chosen.select("layer", "feature_id")), ["layer", "feature_id"], "left_semi")


def feature_table(
    first: DataFrame, samples: DataFrame, chosen: DataFrame, ids: Sequence[int]
) -> DataFrame:
    """One 0/1 column per chosen feature, `feat_<id>` in rank order, and the label.

    Samples in which no chosen feature fired are kept as zeros.
    """
    flags = [
        F.max(F.when(F.col("feature_id") == i, 1.0).otherwise(0.0)).cast("float").alias(f"feat_{i}")
        for i in ids
    ]
    fired = keep_chosen(first, chosen).groupBy("sample_id").agg(*flags)
    return (
        samples.select("sample_id", "label").join(fired, "sample_id", "left")
        .select("sample_id", *[F.coalesce(f"feat_{i}", F.lit(0.0)).cast("float").alias(f"feat_{i}") for i in ids],
                "label")
    )


def feature_prefix(chosen: DataFrame, n: int) -> DataFrame:
    """The n best of the chosen features."""
    return chosen.where(F.col("rank") <= n)


def feature_columns(df: DataFrame, n: int | None = None, label: str = "label") -> list[str]:
    """Feature columns of a wide table in file order, the first n of them."""
    names = [c for c in df.columns if c.startswith("feat_") and c != label]
    return names if n is None else names[:n]
