"""Fits on distinct vectors against plain versions on single rows."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from lumenact.operators import boosting as boost
from lumenact.operators import patterns as pat
from lumenact.operators import solvers as sol


def rows_and_patterns(seed, classes=3, features=6, rows=240):
    """0/1 rows with labels, and the same as distinct vectors with counts."""
    random = np.random.default_rng(seed)
    label = random.integers(0, classes, rows)
    share = random.uniform(0.1, 0.9, (classes, features))
    x = (random.random((rows, features)) < share[label]).astype(float)
    distinct, at = np.unique(x, axis=0, return_inverse=True)
    n = np.zeros((len(distinct), classes))
    np.add.at(n, (at, label), 1)
    return x, label, distinct, n


def frame(spark, x, label):
    rows = [(i, int(c), v.tolist()) for i, (v, c) in enumerate(zip(x, label, strict=True))]
    return spark.createDataFrame(rows, "sample_id long, label int, f array<double>").select(
        "sample_id", "label", array_to_vector("f").alias("features"))


def plain_boosting(x, y, rounds, depth=3, rate=0.1):
    """Row by row and node by node."""
    classes = int(y.max()) + 1
    start = np.log(np.bincount(y) / len(y))
    if classes == 2:
        scores, trees = np.full((len(x), 1), start[1] - start[0]), 1
    else:
        scores, trees = np.tile(start, (len(x), 1)), classes

    def grow(rows, residual, curve, level):
        best, gain = None, -1.0
        for f in range(x.shape[1]) if level < depth else []:
            right = x[rows, f] > 0.5
            if right.any() and not right.all():
                a, b = residual[rows][right], residual[rows][~right]
                value = len(a) * len(b) / len(rows) * (a.mean() - b.mean()) ** 2
                if value > gain * (1 + 1e-9) + 1e-12:
                    best, gain = f, value
        if best is None:
            factor = 1.0 if classes == 2 else (classes - 1) / classes
            total = curve[rows].sum()
            scores_of[rows] = factor * residual[rows].sum() / total if abs(total) > 1e-150 else 0.0
            return
        right = x[rows, best] > 0.5
        grow(rows[~right], residual, curve, level + 1)
        grow(rows[right], residual, curve, level + 1)

    for _ in range(rounds):
        p = boost.probabilities(scores)
        added = np.zeros_like(scores)
        for k in range(trees):
            hit = (y == (k if trees > 1 else 1)).astype(float)
            residual = hit - p[:, k]
            scores_of = np.zeros(len(x))
            grow(np.arange(len(x)), residual, np.abs(residual) * (1 - np.abs(residual)), 0)
            added[:, k] = scores_of
        scores = scores + rate * added
    return scores


@pytest.mark.parametrize("classes", [2, 3, 5])
def test_boosting_equals_rows(classes):
    x, y, distinct, n = rows_and_patterns(classes, classes)
    trees = boost.fit_local(distinct, n, rounds=25)
    assert np.allclose(trees.start + trees.scores(x), plain_boosting(x, y, 25), atol=1e-8)


def test_boosting_spread_over_partitions_equals_one_task(spark):
    x, y, distinct, n = rows_and_patterns(7)
    table = pat.patterns(frame(spark, x, y), [0, 1, 2]).repartition(3)
    spread, local = boost.fit_spread(table, rounds=4), boost.fit_local(distinct, n, rounds=4)
    for a, b in zip(spread.features, local.features, strict=True):
        assert (a == b).all()
    assert np.allclose(spread.scores(distinct), local.scores(distinct))


@pytest.mark.parametrize("gamma", [None, 0.3])
@pytest.mark.parametrize("c", [0.1, 1.0, 10.0])
def test_svm_is_at_its_optimum(c, gamma, monkeypatch):
    x, y, distinct, n = rows_and_patterns(11, classes=2, rows=150)
    weights, bias, facts = sol.two_class_svm(distinct, n, c, gamma)
    assert facts["gap"] < 1e-3 and facts["n_rows"] == 150
    # The same rows, each for itself, and kernel rows computed one at a time.
    monkeypatch.setattr(sol, "MAX_KERNEL", 0)
    single = np.eye(2)[y]
    own, own_bias, own_facts = sol.two_class_svm(x, single, c, gamma)
    assert own_facts["gap"] < 1e-3
    kernel = sol.Kernel(distinct, gamma)
    a = kernel.between(x, distinct) @ weights + bias
    b = kernel.between(x, x) @ own + own_bias
    assert np.abs(a - b).max() < 0.02


def test_svm_by_hand():
    """Two points two apart: the margin is the distance, the middle is the boundary."""
    x, n = np.array([[0.0, 0.0], [2.0, 0.0]]), np.array([[0.0, 3.0], [5.0, 0.0]])
    weights, bias, _ = sol.two_class_svm(x, n, 10.0, None)
    assert np.allclose(weights @ x, [1.0, 0.0], atol=1e-3) and abs(bias + 1.0) < 1e-3
    votes, _ = sol.pair_svm(x, n, np.array([[1.5, 0.0], [0.5, 0.0]]), (0, 1), 10.0)
    assert votes.tolist() == [[1.0, 0.0], [0.0, 1.0]]


def test_exact_kernel_depends_on_the_hamming_distance():
    x = rows_and_patterns(3)[2]
    kernel = sol.Kernel(x, 0.4).between(x, x)
    assert np.abs(kernel - np.exp(-0.4 * (x[:, None] != x[None]).sum(axis=2))).max() < 1e-12


@pytest.mark.parametrize("c", [0.01, 1.0, 100.0])
def test_logistic_gradient_vanishes(c):
    x, y, distinct, n = rows_and_patterns(5, classes=4)
    w, facts = sol.newton_logistic(distinct, n, c)
    p = sol.softmax(np.column_stack([x, np.ones(len(x))]) @ w.T)
    gradient = (p - np.eye(4)[y]).T @ np.column_stack([x, np.ones(len(x))]) / len(x)
    gradient[:, :-1] += w[:, :-1] / (c * len(x))
    assert np.abs(gradient).max() < 2 * sol.GRADIENT and facts["gradient"] < sol.GRADIENT


def test_forest_does_not_depend_on_its_parts():
    x, y, distinct, n = rows_and_patterns(9)
    whole, _ = sol.forest(distinct, n, x, (0, 20))
    parts = sum(sol.forest(distinct, n, x, (i, i + 5))[0] for i in range(0, 20, 5))
    assert np.allclose(whole, parts) and np.allclose(whole.sum(axis=1), 20)
    assert (whole.argmax(axis=1) == y).mean() > 0.7


def test_network_learns_and_repeats():
    x, y, distinct, n = rows_and_patterns(13)
    first, losses = sol.train_network(distinct, n, (16, 8), 1, 60, 32, 1e-2, 0.01)
    again, _ = sol.train_network(distinct, n, (16, 8), 1, 60, 32, 1e-2, 0.01)
    assert losses[-1] < 0.8 * losses[0]
    assert all((a == b).all() for one, two in zip(first, again, strict=True) for a, b in zip(one, two, strict=True))
    assert (sol.forward(first, x)[-1].argmax(axis=1) == y).mean() > 0.7


def test_network_gradient():
    """One step without moments' history moves against the sign of the numeric gradient."""
    x, _, distinct, n = rows_and_patterns(17, rows=40)
    layers, _ = sol.train_network(distinct, n, (5,), 3, 0, 1000, 1e-3, 0.0)
    moved, _ = sol.train_network(distinct, n, (5,), 3, 1, 1000, 1e-3, 0.0)

    def loss(ls):
        logs = np.log(sol.softmax(sol.forward(ls, distinct)[-1]))
        return -(n * logs).sum() / n.sum()

    for i, (w, b) in enumerate(layers):
        for at in np.ndindex(*w.shape):
            near = w.copy()
            near[at] += 1e-6
            slope = (loss(layers[:i] + [(near, b)] + layers[i + 1:]) - loss(layers)) / 1e-6
            if abs(slope) > 1e-4:
                assert np.isclose(moved[i][0][at] - w[at], -1e-3 * np.sign(slope), rtol=1e-2)


def test_fits_run_as_tasks(spark):
    x, y, distinct, n = rows_and_patterns(19)
    df = frame(spark, x, y)
    odd = df.unionByName(spark.createDataFrame([(999, 77), (1000, None)], "sample_id long, label int").withColumn(
        "features", F.lit(None).cast(df.schema["features"].dataType)))
    train, test = pat.patterns(odd.repartition(5), [0, 1, 2]), pat.patterns(df, [0, 1, 2])
    fits = [pat.Fit("bayes", sol.bernoulli_bayes), pat.Fit("logistic", sol.logistic, {"c": 1.0}),
            *[pat.Fit("svm", sol.pair_svm, {"pair": p, "c": 1.0, "rbf": True}, i) for i, p in enumerate([(0, 1), (0, 2), (1, 2)])],
            *[pat.Fit("forest", sol.forest, {"trees": (i, i + 4)}, i) for i in (0, 4)],
            pat.Fit("boosting", boost.boosted, {"rounds": 10}), pat.Fit("network", sol.network, {"epochs": 5})]
    results = pat.run_fits(train, test, fits).cache()
    scores = {r["config"]: r for r in pat.accuracies(results).collect()}
    assert set(scores) == {f.config for f in fits}
    assert all(r["n_test"] == 240 for r in scores.values())
    assert all(scores[k]["accuracy"] > 0.7 for k in ("bayes", "logistic", "svm", "forest", "boosting"))
    assert pat.facts(results).count() == len(fits)
    # The rows of the votes, added up by hand.
    votes = sum(sol.pair_svm(distinct, n, distinct, p, 1.0, True)[0] for p in [(0, 1), (0, 2), (1, 2)])
    assert np.isclose(scores["svm"]["accuracy"], n[np.arange(len(n)), votes.argmax(axis=1)].sum() / 240)


def test_datasets_side_by_side_and_empty_ones(spark):
    x, y, _, _ = rows_and_patterns(23)
    df = frame(spark, x, y).withColumn("t", F.explode(F.array(F.lit(1), F.lit(2))))
    train = pat.patterns(df.where("t = 1 or sample_id % 2 = 0"), [0, 1, 2], ["t"])
    test = pat.patterns(df, [0, 1, 2], ["t"])
    results = pat.run_fits(train, test, [pat.Fit("bayes", sol.bernoulli_bayes)], ["t"])
    assert {(r["t"], r["n_test"]) for r in pat.accuracies(results, ["t"]).collect()} == {(1, 240), (2, 240)}
    empty = pat.run_fits(train.limit(0), test.limit(0), [pat.Fit("bayes", sol.bernoulli_bayes)], ["t"])
    assert empty.count() == 0


def test_large_tables_are_refused(spark, monkeypatch):
    x, y, _, _ = rows_and_patterns(29)
    monkeypatch.setattr(pat, "MAX_CELLS", 10)
    with pytest.raises(ValueError, match="more than a task may hold"):
        pat.run_fits(pat.patterns(frame(spark, x, y), [0, 1, 2]), pat.patterns(frame(spark, x, y), [0, 1, 2]), [])
