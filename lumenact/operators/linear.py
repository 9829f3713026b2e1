"""Linear classifiers as weight tables over fired features.

A model is a table (keys, feature_id, w), w holding one weight per class in
the order of the class list. The bias is the weight of feature BIAS, which
every sample fires. Scoring is then one join on feature_id and one sum; keys
carry a parameter grid or a time step, so a whole sweep is one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BIAS = -1
DIGITS = 9
TIE = 1e-9
MAX_CLASSES = 1000


def class_list(samples: DataFrame, label: str = "label") -> list[int]:
    """The sorted class ids, of which there are few."""
    rows = samples.select(label).distinct().limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    return sorted(r[0] for r in rows)


def restrict(first: DataFrame, layer: int, ids: Sequence[int]) -> DataFrame:
    """Firings of the given features of one layer."""
    return first.where((F.col("layer") == layer) & F.col("feature_id").isin(list(ids)))


def bernoulli_counts(
    first: DataFrame, samples: DataFrame, ids: Sequence[int], keys: Sequence[str] = ()
) -> DataFrame:
    """Counts behind a Bernoulli model, for every (label, feature) pair.

    (keys, label, feature_id, n_fired, n_label, n): pairs that never fired
    together are kept with 0.
    """
    keys = list(keys)
    labels = samples.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n_label"))
    labels = labels.withColumn("n", F.sum("n_label").over(Window.partitionBy(*keys)))
    fired = first.groupBy(*keys, "label", "feature_id").agg(F.count(F.lit(1)).alias("n_fired"))
    return complete_counts(labels, fired, ids, keys)


def complete_counts(
    labels: DataFrame, fired: DataFrame, ids: Sequence[int], keys: Sequence[str]
) -> DataFrame:
    domain = labels.withColumn("feature_id", F.explode(F.array(*[F.lit(int(i)) for i in ids])))
    return domain.join(fired, [*keys, "label", "feature_id"], "left").select(
        *keys, "label", "feature_id",
        F.coalesce("n_fired", F.lit(0).cast("long")).alias("n_fired"), "n_label", "n")


def bernoulli_weights(
    counts: DataFrame, keys: Sequence[str] = (), alpha: Column | float = 1.0
) -> DataFrame:
    """Bernoulli naive Bayes as a weight table, smoothed by `alpha`.

    With p the smoothed firing share of a feature in a class, the weight is
    log p - log(1 - p); the bias adds the log prior and all log(1 - p).
    """
    keys = list(keys)
    smooth = F.lit(alpha) if isinstance(alpha, (int, float)) else alpha
    p = (F.col("n_fired") + smooth) / (F.col("n_label") + 2 * smooth)
    rows = counts.select(
        *keys, "label", "feature_id",
        (F.log(p) - F.log(1 - p)).alias("weight"), F.log(1 - p).alias("_miss"),
        F.log(F.col("n_label") / F.col("n")).alias("_prior"))
    bias = rows.groupBy(*keys, "label").agg(
        F.lit(BIAS).alias("feature_id"), (F.max("_prior") + F.sum("_miss")).alias("weight"))
    return rows.select(*keys, "label", "feature_id", "weight").unionByName(bias)


def as_arrays(weights: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per feature with its weights in class order."""
    entries = F.array_sort(F.collect_list(F.struct("label", "weight")))
    return weights.groupBy(*keys, "feature_id").agg(
        F.transform(entries, lambda e: e["weight"]).alias("w"))


def from_matrix(
    spark: SparkSession, ids: Sequence[int], coefficients, intercept
) -> DataFrame:
    """Weight table of a fitted linear model: rows of `coefficients` are classes."""
    rows = [(int(f), [float(c[j]) for c in coefficients]) for j, f in enumerate(ids)]
    rows.append((BIAS, [float(b) for b in intercept]))
    schema = T.StructType([
        T.StructField("feature_id", T.IntegerType()), T.StructField("w", T.ArrayType(T.DoubleType()))])
    return spark.createDataFrame(rows, schema)


def decide(df: DataFrame, scores: Sequence[str], classes: Sequence[int], keep: Sequence[str]) -> DataFrame:
    """Class, its probability and that of the true class, from score columns.

    Scores are sums whose order may vary, so scores within TIE of the best
    count as equal to it (the lowest class wins), and probabilities are
    rounded to DIGITS digits. Plain columns, one per class, keep all of this
    inside generated code.
    """
    top = F.greatest(*scores) if len(scores) > 1 else F.col(scores[0])
    scored = df.select(*keep, *scores, top.alias("_top"))
    powers = [f"_e{i}" for i in range(len(scores))]
    pred, true = F.when(F.lit(False), F.lit(None).cast("int")), F.when(F.lit(False), F.lit(None).cast("double"))
    for c, s, e in zip(classes, scores, powers):
        pred = pred.when(F.col(s) >= F.col("_top") - F.lit(TIE), F.lit(int(c)))
        true = true.when(F.col("label") == int(c), F.col(e))
    scored = scored.select(
        *keep, pred.alias("pred"), *[F.exp(F.col(s) - F.col("_top")).alias(e) for s, e in zip(scores, powers)])
    total = F.col(powers[0])
    for e in powers[1:]:
        total = total + F.col(e)
    scored = scored.select(*keep, "pred", true.alias("_true"), F.greatest(*powers, F.lit(0.0)).alias("_best"), total.alias("_all"))
    return scored.select(
        *keep, "pred",
        F.round(F.col("_best") / F.col("_all"), DIGITS).alias("confidence"),
        F.round(F.col("_true") / F.col("_all"), DIGITS).alias("p_true"))


def class_weights(n: int) -> list[Column]:
    """The weight of each class as a column of its own."""
    return [F.get("w", F.lit(i)).alias(f"_c{i}") for i in range(n)]


def with_bias(first: DataFrame, samples: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Firings of each sample, and its firing of the bias."""
    cols = [*keys, "sample_id", "label", "feature_id"]
    return first.select(*cols).unionByName(
        samples.withColumn("feature_id", F.lit(BIAS)).select(*cols))


def score(
    fires: DataFrame, weights: DataFrame, classes: Sequence[int],
    on: Sequence[str] = (), keys: Sequence[str] = (),
) -> DataFrame:
    """Predictions (sample_id, label, keys, pred, confidence, p_true).

    `fires` comes from `with_bias`. Columns `on` must match between firings
    and weights; `keys` are all columns that tell models apart. The weights
    are broadcast: a row per chosen feature and model, and the chosen features
    are a checked list (`feature_ids_in_order`).
    """
    group = ["sample_id", "label", *dict.fromkeys([*on, *keys])]
    names = [f"_c{i}" for i in range(len(classes))]
    added = fires.join(F.broadcast(weights), [*on, "feature_id"]).select(*group, *class_weights(len(classes)))
    totals = added.groupBy(*group).agg(*[F.sum(c).alias(c) for c in names])
    return decide(totals, names, classes, group)
