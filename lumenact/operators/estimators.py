"""Spark ML classifiers on feature vectors, comparisons and sweeps.

The cost parameter C of the usual libraries sums the loss over n rows; Spark
averages it, so regParam = 1 / (C * n).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator
from pyspark.ml.classification import (
    GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluate import hit

# The parameter grids of the comparison and the sweeps.
LOGISTIC_C = (0.01, 0.1, 1.0, 10.0)
LINEAR_SVM_C = (0.1, 1.0, 10.0)
RBF_SVM_C = (1.0, 10.0, 100.0)
FOREST_TREES = (100, 500)
BOOSTING_ROUNDS = 200
# A support vector machine ends by its tolerance; this many iterations only stop one that never would.
SVM_STEPS = 1000
KERNEL_FEATURES = 1024  # an entry of the kernel is off by at most 1 / sqrt(1024) (one standard deviation)
MAX_TREE_DEPTH = 30  # Spark's limit; the reference has none
NEIGHBOR_COUNTS = (1, 3, 5, 11)
FEATURE_COUNTS = (5, 10, 20, 30, 50, 75, 100)
SWEEP_HIDDEN = (512, 256)
SWEEP_STEPS = 50
LAYOUT_SEEDS = (0, 1, 2, 3, 4)
WEIGHT_DECAYS = (0.0, 1e-4, 1e-3, 1e-2, 1e-1, 0.5)
LAYOUTS = (
    (), (16,), (32,), (64,), (128,), (256,), (512,), (64, 32), (128, 64), (256, 128), (512, 256),
    (64, 64, 32), (128, 64, 32), (256, 128, 64),
)


def vector_table(first: DataFrame, samples: DataFrame, ids: Sequence[int]) -> DataFrame:
    """(sample_id, label, features): 0/1 vectors in the order of `ids`."""
    flags = F.array(*[F.max(F.when(F.col("feature_id") == int(i), 1.0).otherwise(0.0)) for i in ids])
    fired = first.groupBy("sample_id").agg(flags.alias("_f"))
    zeros = F.array(*[F.lit(0.0)] * len(ids))
    return samples.select("sample_id", "label").join(fired, "sample_id", "left").select(
        "sample_id", "label", array_to_vector(F.coalesce("_f", zeros)).alias("features"))


def logistic(c: float, n: int, max_iter: int = 1000) -> LogisticRegression:
    return LogisticRegression(
        family="multinomial", regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=max_iter)


def linear_svm(c: float, n: int, max_iter: int = SVM_STEPS) -> OneVsRest:
    # Classes are fitted one after the other: threads inside OneVsRest would share one set of
    # job properties, and a fit that clears it breaks the others. run_sweep runs whole fits
    # side by side, each thread with properties of its own.
    return OneVsRest(
        classifier=LinearSVC(regParam=1.0 / (c * n), standardization=False, maxIter=max_iter), parallelism=1)


def random_forest(trees: int, seed: int = 42) -> RandomForestClassifier:
    return RandomForestClassifier(numTrees=trees, seed=seed, maxDepth=MAX_TREE_DEPTH)


def gradient_boosting(rounds: int = BOOSTING_ROUNDS, seed: int = 42) -> OneVsRest:
    return OneVsRest(classifier=GBTClassifier(maxIter=rounds, maxDepth=3, stepSize=0.1, seed=seed), parallelism=1)


def bernoulli_bayes() -> NaiveBayes:
    return NaiveBayes(modelType="bernoulli", smoothing=1.0)


def perceptron(
    n_in: int, n_classes: int, hidden: Sequence[int], seed: int = 42, max_iter: int = 100
) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(layers=[n_in, *hidden, n_classes], seed=seed, maxIter=max_iter)


def train_perceptron(train: DataFrame, n_in: int, n_classes: int, hidden: int = 64, **params):
    """The fitted network and its loss per iteration as rows."""
    model = perceptron(n_in, n_classes, (hidden,), **params).fit(train)
    history = [(i, float(loss)) for i, loss in enumerate(model.summary().objectiveHistory)]
    return model, train.sparkSession.createDataFrame(history, "iteration int, loss double")


def scale_gamma(train: DataFrame, n_in: int) -> float:
    """1 / (features * variance of all entries), the usual kernel width."""
    entries = vector_to_array("features")
    sums = train.select(
        F.aggregate(entries, F.lit(0.0), lambda a, x: a + x).alias("s"),
        F.aggregate(entries, F.lit(0.0), lambda a, x: a + x * x).alias("q"),
    ).agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.count(F.lit(1)).alias("n")).first()
    n = sums["n"] * n_in
    variance = sums["q"] / n - (sums["s"] / n) ** 2
    return 1.0 / (n_in * variance) if variance > 0 else 1.0


def fourier_features(df: DataFrame, n_in: int, n_out: int, gamma: float, seed: int = 42) -> DataFrame:
    """Random cosine features whose dot products approximate the RBF kernel."""

    @F.pandas_udf("array<double>")
    def project(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rng = np.random.default_rng(seed)
        w = rng.normal(scale=np.sqrt(2 * gamma), size=(n_in, n_out))
        b = rng.uniform(0, 2 * np.pi, size=n_out)
        for batch in batches:
            if batch.empty:
                yield pd.Series([], dtype=object)
                continue
            x = np.stack(batch.to_numpy())
            yield pd.Series(list(np.sqrt(2.0 / n_out) * np.cos(x @ w + b)))

    return df.withColumn("features", array_to_vector(project(vector_to_array("features"))))


@dataclass
class Config:
    """One cell of a sweep: what to fit, on what view of the vectors."""

    name: str
    estimator: Estimator
    params: dict = field(default_factory=dict)
    n_features: int | None = None


def _one(config: Config, train: DataFrame, test: DataFrame) -> tuple:
    if config.n_features is not None:
        cut = VectorSlicer(inputCol="_all", outputCol="features", indices=list(range(config.n_features)))
        train = cut.transform(train.withColumnRenamed("features", "_all"))
        test = cut.transform(test.withColumnRenamed("features", "_all"))
    model = config.estimator.fit(train)
    scored = model.transform(test).agg(F.avg(hit("prediction")).alias("a"), F.count(F.lit(1)).alias("n")).first()
    return config.name, {k: str(v) for k, v in config.params.items()}, float(scored["a"]), int(scored["n"])


def run_sweep(
    train: DataFrame, test: DataFrame, configs: Sequence[Config], threads: int = 4, dataset: str = "main"
) -> DataFrame:
    """Fit and score every configuration: one result row each.

    The fits share the two vector tables, and a few of them run at a time so
    that small fits do not leave the cluster idle. In every iteration each
    partition sends its sum of gradients, as large as the model, so there are no
    more partitions than cores, however many rows.
    """
    cores = train.sparkSession.sparkContext.defaultParallelism
    train, test = train.coalesce(cores), test.coalesce(cores)
    with ThreadPoolExecutor(threads) as pool:
        # Every fit gets a thread target of its own, which copies the caller's job properties.
        fits = [pool.submit(inheritable_thread_target(train.sparkSession)(lambda c=c: (dataset, *_one(c, train, test))))
                for c in configs]
        rows = [fit.result() for fit in fits]
    return train.sparkSession.createDataFrame(
        rows, "dataset string, config string, params map<string,string>, accuracy double, n_test long")


def comparison(n: int, svm_steps: int = SVM_STEPS, rounds: int = BOOSTING_ROUNDS) -> list[Config]:
    """The classifiers on plain vectors that are compared."""
    out = [Config(f"LogReg C={c:g}", logistic(c, n), {"C": c}) for c in LOGISTIC_C]
    out += [Config(f"SVM linear C={c:g}", linear_svm(c, n, svm_steps), {"C": c}) for c in LINEAR_SVM_C]
    out += [Config(f"RandomForest {t}", random_forest(t), {"trees": t}) for t in FOREST_TREES]
    out.append(Config("GradientBoosting", gradient_boosting(rounds)))
    out.append(Config("BernoulliNB", bernoulli_bayes()))
    return out


def kernel_comparison(n: int, svm_steps: int = SVM_STEPS) -> list[Config]:
    """The kernel machines, for vectors of random cosine features."""
    return [Config(f"SVM RBF C={c:g}", linear_svm(c, n, svm_steps), {"C": c}) for c in RBF_SVM_C]


def layout_name(hidden: Sequence[int]) -> str:
    return "→".join(map(str, hidden)) or "linear"


def parameter_count(n_in: int, n_classes: int, hidden: Sequence[int]) -> int:
    """Weights and biases of a perceptron."""
    sizes = [n_in, *hidden, n_classes]
    return sum((a + 1) * b for a, b in zip(sizes[:-1], sizes[1:], strict=True))
