"""The model queries fit what the reference fits, and end."""

import pytest
from pyspark.ml.classification import RandomForestClassifier

import __spark_entry__ as entry
from lumenact.operators import estimators as est
from lumenact.operators import patterns as pat
from tests.conftest import SF


@pytest.mark.parametrize("name, configs", [
    ("c04_linear_svm", {f"SVM linear C={c:g}" for c in (0.1, 1, 10)}),
    ("c05_rbf_svm", {f"SVM RBF C={c:g}" for c in (1, 10, 100)}), ("c08_gradient_boosting", {"GradientBoosting"})])
def test_ends_in_full(spark, name, configs):
    rows = entry.queries()[name](spark, SF).collect()
    assert {r["config"] for r in rows} == configs
    assert all(0 <= r["accuracy"] <= 1 and r["n_test"] == rows[0]["n_test"] for r in rows)


def test_eighteen_classifiers(spark):
    rows = entry.queries()["c10_classifier_comparison"](spark, SF).collect()
    assert len({r["config"] for r in rows}) == len(rows) == 18
    assert {r["params"].get("rounds") for r in rows} == {None, "200"}
    assert {r["params"].get("trees") for r in rows} == {None, "100", "500"}


def seen(spark, monkeypatch, target, attribute, name):
    """What a query would fit, looked at before anything is fitted."""
    found = []

    def record(train, test, fits, *rest, **more):
        found.extend(fits)
        raise InterruptedError

    monkeypatch.setattr(target, attribute, record)
    with pytest.raises(InterruptedError):
        entry.queries()[name](spark, SF).collect()
    return found


def test_whole_settings(spark, monkeypatch):
    fits = seen(spark, monkeypatch, pat, "run_fits", "c10_classifier_comparison")
    assert [f.params["rounds"] for f in fits if "rounds" in f.params] == [200]
    trees = [f.params["trees"] for f in fits if f.config == "RandomForest 500"]
    assert sum(b - a for a, b in trees) == 500 and sorted(trees)[0][0] == 0
    networks = seen(spark, monkeypatch, pat, "run_fits", "c12_layout_sweep")
    assert len(networks) == 70 and {f.params["epochs"] for f in networks} == {50}


def test_spark_forests(spark, monkeypatch):
    configs = seen(spark, monkeypatch, est, "run_sweep", "c07_random_forest")
    assert all(isinstance(c.estimator, RandomForestClassifier) and c.estimator.getMaxDepth() == 30 for c in configs)


def test_feature_counts(spark, monkeypatch):
    configs = seen(spark, monkeypatch, est, "run_sweep", "c11_feature_count_logistic")
    counts = [c.n_features for c in configs]
    assert counts == [1, 2, 4, 5, 8, 10, 20, 30] * 2
