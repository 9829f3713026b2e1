"""Accuracy, per-topic metrics, and the bookkeeping of sweeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hit(pred: str = "pred", label: str = "label") -> Column:
    return (F.col(pred) == F.col(label)).cast("double")


def accuracy(predictions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return predictions.groupBy(*keys).agg(
        F.avg(hit()).alias("accuracy"), F.count(F.lit(1)).alias("n_samples"))


def topic_metrics(predictions: DataFrame, topics: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of every topic; 0 where undefined.

    Confusion counts are taken first, so each topic is joined to at most one
    row per predicted class.
    """
    pairs = predictions.groupBy("label", "pred").agg(F.count(F.lit(1)).alias("n"))
    truth = pairs.groupBy("label").agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("pred"), F.col("n"))).alias("tp"))
    guessed = pairs.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("n_pred"))
    joined = topics.join(truth, "label", "left").join(guessed, "label", "left").fillna(0, ["support", "tp", "n_pred"])
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide("tp", "n_pred"), zero)
    recall = F.coalesce(F.try_divide("tp", "support"), zero)
    f1 = F.coalesce(F.try_divide(F.lit(2.0) * F.col("tp"), F.col("n_pred") + F.col("support")), zero)
    return joined.select(
        *topics.columns, precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
        F.col("support").alias("n_test"))


def over_seeds(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and spread of the accuracy over the seeds of each configuration."""
    by_seed = F.array_sort(F.collect_list(F.struct("seed", "accuracy")))
    return results.groupBy(*keys).agg(
        F.avg("accuracy").alias("mean_acc"), F.stddev_pop("accuracy").alias("std_acc"),
        F.transform(by_seed, lambda r: r["accuracy"]).alias("seed_accs"))


def best_per(results: DataFrame, keys: Sequence[str], order: str, score: str = "mean_acc") -> DataFrame:
    """The best configuration per key; the first of equals by `order`."""
    rank = Window.partitionBy(*keys).orderBy(F.round(score, 9).desc(), order)
    return results.withColumn("_rn", F.row_number().over(rank)).where(F.col("_rn") == 1).drop("_rn")


def layout_label(hidden: Column) -> Column:
    """Hidden widths as "a→b", or "linear" without hidden layers."""
    return F.when(F.size(hidden) == 0, "linear").otherwise(F.array_join(hidden.cast("array<string>"), "→"))


def parameter_count(n_in: Column, n_classes: Column, hidden: Column) -> Column:
    """Weights and biases of a dense network."""
    sizes = F.concat(F.array(n_in), hidden, F.array(n_classes))
    pairs = F.zip_with(sizes, F.slice(sizes, F.lit(2), F.size(sizes)), lambda a, b: F.coalesce(a * b + b, F.lit(0)))
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda acc, x: acc + x)


def union_sections(sections: Sequence[DataFrame]) -> DataFrame:
    """Result tables with different columns as one."""
    out = sections[0]
    for section in sections[1:]:
        out = out.unionByName(section, allowMissingColumns=True)
    return out
