"""Every classifier learns what can be learnt."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from lumenact.operators import estimators as est


@pytest.fixture(scope="module")
def tables(spark):
    """Three classes told apart by which of six features fire, with some noise."""
    random = np.random.default_rng(0)
    rows = []
    for i in range(240):
        label = i % 3
        fires = np.array([0.95 if k // 2 == label else 0.05 for k in range(6)])
        rows.append((i, label, (random.random(6) < fires).astype(float).tolist()))
    df = spark.createDataFrame(rows, "sample_id long, label int, f array<double>").select(
        "sample_id", "label", array_to_vector("f").alias("features")).coalesce(2).cache()
    return df.where("sample_id < 180"), df.where("sample_id >= 180")


def accuracy(tables, estimator):
    return est.run_sweep(*tables, [est.Config("one", estimator)]).first()["accuracy"]


@pytest.mark.parametrize("name, make", [
    ("logistic", lambda n: est.logistic(1.0, n, 100)), ("linear_svm", lambda n: est.linear_svm(1.0, n, 30)),
    ("random_forest", lambda n: est.random_forest(20)), ("gradient_boosting", lambda n: est.gradient_boosting(5)),
    ("bernoulli_bayes", lambda n: est.bernoulli_bayes()), ("perceptron", lambda n: est.perceptron(6, 3, (8,), 1, 60))])
def test_accuracy_floor(tables, name, make):
    assert accuracy(tables, make(tables[0].count())) > 0.85


def test_logistic_is_at_its_optimum(tables):
    """The gradient of the penalised loss vanishes at the solution."""
    train = tables[0]
    n = train.count()
    model = est.logistic(1.0, n).setTol(1e-10).fit(train)
    x = np.array([r["features"].toArray() for r in train.collect()])
    y = np.array([r["label"] for r in train.collect()])
    w, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    scores = x @ w.T + b
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    gradient = (p - np.eye(3)[y]).T @ x / n + w / (1.0 * n)
    assert np.abs(gradient).max() < 1e-4


def test_rbf_svm_bends(spark):
    """A ring inside a ring: no line separates them, the kernel does."""
    random = np.random.default_rng(1)
    rows = []
    for i in range(200):
        radius, angle = (1.0 if i % 2 else 3.0), random.random() * 2 * np.pi
        rows.append((i, i % 2, [float(radius * np.cos(angle)), float(radius * np.sin(angle))]))
    df = spark.createDataFrame(rows, "sample_id long, label int, f array<double>").select(
        "sample_id", "label", array_to_vector("f").alias("features")).coalesce(2)
    mapped = est.fourier_features(df, 2, 100, 0.5).cache()
    straight = est.run_sweep(df, df, [est.Config("line", est.linear_svm(10.0, 200, 20))]).first()["accuracy"]
    bent = est.run_sweep(mapped, mapped, [est.Config("ring", est.linear_svm(10.0, 200, 20))]).first()["accuracy"]
    assert straight < 0.8 and bent > 0.95


def test_kernel_is_approximated(spark):
    random = np.random.default_rng(2)
    x = random.normal(size=(20, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "sample_id long, f array<double>").select(
        "sample_id", array_to_vector("f").alias("features"))
    z = np.array([r["features"].toArray() for r in est.fourier_features(df, 4, 5000, 0.3).orderBy("sample_id").collect()])
    exact = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - exact).max() < 0.1


def test_perceptron_loss_falls(tables):
    _, history = est.train_perceptron(tables[0], 6, 3, hidden=8, max_iter=20)
    losses = [r["loss"] for r in history.orderBy("iteration").collect()]
    assert losses[-1] < losses[0]


def test_svm_fits_side_by_side_do_not_disturb_each_other(tables):
    """Repeated, as a race shows only now and then."""
    for _ in range(3):
        configs = [est.Config(f"C={c}", est.linear_svm(c, 180, 3)) for c in (0.1, 1.0, 10.0, 100.0)]
        assert est.run_sweep(*tables, configs).count() == 4
