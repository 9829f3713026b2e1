"""How the prediction of one fixed classifier settles as steps arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import grouped_quantile
from .evaluate import hit
from .linear import BIAS, class_weights, decide


def evaluation_grid(max_steps: int) -> list[int]:
    """Every step to 50, every 5th to 200, then every 20th."""
    steps = {*range(1, 51), *range(55, 201, 5), *range(220, max_steps + 1, 20)}
    return sorted(t for t in steps if t <= max_steps)


def evaluation_grid_frame(max_steps: DataFrame) -> DataFrame:
    """The same grid as rows, from a frame with the column `max_steps`."""
    last = F.col("max_steps")
    pieces = [
        F.sequence(F.lit(1), F.lit(50)),
        F.sequence(F.lit(55), F.lit(200), F.lit(5)),
        F.when(last >= 220, F.sequence(F.lit(220), F.greatest(last, F.lit(220)), F.lit(20))),
    ]
    parts = [max_steps.select("max_steps", F.explode(p).alias("t")) for p in pieces]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return union.where(F.col("t") <= F.col("max_steps")).select("t").distinct()


def snapshot_grid(interval: int, max_steps: int) -> list[int]:
    return list(range(interval, max_steps + 1, interval))


def _literal(grid: Sequence[int]) -> Column:
    return F.array(*[F.lit(int(t)) for t in grid])


def entry_point(grid: Sequence[int], inclusive: bool = False) -> Column:
    """First grid point that sees a feature first fired at `first_step`.

    Exclusive: point t sees steps 0 .. t-1. Inclusive: steps 0 .. t.
    """
    step = F.col("first_step")
    seen = F.filter(_literal(grid), lambda t: t >= step if inclusive else t > step)
    return F.get(seen, 0)


def fired_by(first: DataFrame, grid: Sequence[int], keep: Sequence[str] = ("sample_id", "feature_id")) -> DataFrame:
    """Features fired so far at every grid point, as rows."""
    seen = F.filter(_literal(grid), lambda t: t > F.col("first_step"))
    return first.select(*keep, F.explode(seen).alias("t"))


def confidence_curve(
    first: DataFrame, samples: DataFrame, weights: DataFrame, classes: Sequence[int],
    grid: Sequence[int], inclusive: bool = False,
) -> DataFrame:
    """(sample_id, label, t, pred, confidence, p_true) at every grid point.

    Each firing adds its weights at the grid point that first sees it; the
    scores are running sums over one sample's points, so nothing is multiplied
    out and the only shuffle is by sample.
    """
    n = len(classes)
    names = [f"_c{i}" for i in range(n)]
    fires = first.select("sample_id", "label", "feature_id", entry_point(grid, inclusive).alias("t"))
    bias = samples.select(
        "sample_id", "label", F.lit(BIAS).alias("feature_id"), F.lit(int(grid[0])).alias("t"))
    added = (
        fires.where(F.col("t").isNotNull()).unionByName(bias)
        .join(F.broadcast(weights), "feature_id")
        .select("sample_id", "label", "t", F.lit(False).alias("_point"), *class_weights(n))
    )
    points = samples.select(
        "sample_id", "label", F.explode(_literal(grid)).alias("t"), F.lit(True).alias("_point"),
        *[F.lit(None).cast("double").alias(c) for c in names])
    # A point comes after the firings it sees.
    so_far = Window.partitionBy("sample_id").orderBy("t", "_point").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    sums = added.unionByName(points).select(
        "sample_id", "label", "t", "_point", *[F.sum(c).over(so_far).alias(c) for c in names])
    return decide(sums.where("_point"), names, classes, ["sample_id", "label", "t"])


def confidence_changes(
    first: DataFrame, samples: DataFrame, weights: DataFrame, classes: Sequence[int],
    grid: Sequence[int], min_steps: int, inclusive: bool = False,
) -> DataFrame:
    """The rows of `confidence_curve` where a decision can change, for `early_stop`.

    Scores only move at grid points that see a new firing, so those, the first
    point and the first one from `min_steps` on are scored; the grid is never
    multiplied out. Every other point repeats the row before it.
    """
    n = len(classes)
    names = [f"_c{i}" for i in range(n)]
    marks = sorted({grid[0], *[t for t in grid if t >= min_steps][:1]})
    fires = first.select("sample_id", "label", "feature_id", entry_point(grid, inclusive).alias("t"))
    bias = samples.select("sample_id", "label", F.lit(BIAS).alias("feature_id"), F.lit(int(grid[0])).alias("t"))
    added = (
        fires.where(F.col("t").isNotNull()).unionByName(bias).join(F.broadcast(weights), "feature_id")
        .select("sample_id", "label", "t", *class_weights(n)))
    still = samples.select(
        "sample_id", "label", F.explode(_literal(marks)).alias("t"), *[F.lit(0.0).alias(c) for c in names])
    so_far = Window.partitionBy("sample_id").orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = added.unionByName(still).select("sample_id", "label", "t", *[F.sum(c).over(so_far).alias(c) for c in names])
    points = sums.groupBy("sample_id", "label", "t").agg(*[F.max(c).alias(c) for c in names])
    return decide(points, names, classes, ["sample_id", "label", "t"])


def reported(curve: DataFrame) -> DataFrame:
    """The steps that summaries report."""
    return curve.where((F.col("t") <= 200) | (F.col("t") % 40 == 0))


def curve_summary(curve: DataFrame) -> DataFrame:
    """Accuracy, mean and median confidence per reported step; the curve is read three times."""
    shown = reported(curve)
    means = shown.groupBy("t").agg(
        F.avg(hit()).alias("accuracy"), F.avg("confidence").alias("mean_confidence"))
    return means.join(grouped_quantile(shown, ["t"], "confidence", 0.5, "median_confidence"), "t")


def early_stop(
    curve: DataFrame, targets: Sequence[float], min_steps: int, max_steps: int
) -> DataFrame:
    """Per sample and target: steps used and the prediction made.

    Stops at the first point from `min_steps` on whose confidence reaches the
    target; otherwise `max_steps` are used and the last prediction stands.
    """
    point = F.struct("t", "pred")
    ready = F.col("t") >= min_steps
    stops = [F.min(F.when(ready & (F.col("confidence") >= F.lit(float(c))), point)).alias(f"_s{i}")
             for i, c in enumerate(targets)]
    found = curve.groupBy("sample_id", "label").agg(F.max(point).alias("_last"), *stops)
    outcomes = F.array(*[
        F.struct(
            F.lit(float(c)).alias("target"),
            F.coalesce(F.col(f"_s{i}")["t"], F.lit(max_steps)).alias("tokens"),
            F.coalesce(F.col(f"_s{i}")["pred"], F.col("_last")["pred"]).alias("pred"))
        for i, c in enumerate(targets)])
    return found.select("sample_id", "label", F.explode(outcomes).alias("_o")).select(
        "sample_id", "label", "_o.*")


def median_stop(stops: DataFrame) -> DataFrame:
    """Median steps per topic and overall (label null), truncated.

    Equal steps are counted first, so the medians work on a few rows.
    """
    counted = stops.groupBy("target", "label", "tokens").agg(F.count(F.lit(1)).alias("n"))
    return (
        counted.groupingSets([["target", "label"], ["target"]], "target", "label")
        .agg(F.percentile("tokens", 0.5, F.col("n")).cast("int").alias("median_stop"))
        .select("target", "label", "median_stop")
    )


def early_stop_summary(stops: DataFrame, max_steps: int, keys: Sequence[str] = ("target",)) -> DataFrame:
    """Accuracy, mean and median steps and the share stopped early."""
    counted = stops.groupBy(*keys, "tokens").agg(
        F.count(F.lit(1)).alias("n"), F.sum(hit()).alias("hits"))
    n = F.sum("n")
    return counted.groupBy(*keys).agg(
        (F.sum("hits") / n).alias("accuracy"),
        (F.sum(F.col("tokens") * F.col("n")) / n).alias("mean_tokens"),
        F.percentile("tokens", 0.5, F.col("n")).alias("median_tokens"),
        (F.sum(F.when(F.col("tokens") < max_steps, F.col("n")).otherwise(0)) / n).alias("pct_early"))


def first_samples(samples: DataFrame) -> DataFrame:
    """The lowest sample id of each topic."""
    return samples.groupBy("label").agg(F.min("sample_id").alias("sample_id")).select("sample_id")


def example_traces(curve: DataFrame, steps: Sequence[int]) -> DataFrame:
    """The curve of the samples to show (see `first_samples`) at the listed steps."""
    return (
        curve.where(F.col("t").isin(list(steps)))
        .select("label", "sample_id", "t", "confidence", "pred", (F.col("pred") == F.col("label")).alias("correct"))
    )
