"""Fits are dealt one a task, and training costs the same late as early."""

import numpy as np
from pyspark.sql import functions as F

from lumenact.operators import patterns as pat
from lumenact.operators import solvers as sol
from lumenact.plans import q_models


def test_each_fit_is_a_task_of_its_own(spark):
    table = spark.createDataFrame(
        [([float(i & 1), float(i >> 1)], [i + 1, 4 - i]) for i in range(4)], "x array<double>, n array<bigint>")
    fits = [pat.Fit(f"fit {i}", sol.bernoulli_bayes) for i in range(30)]
    facts = pat.run_fits(table, table, fits).withColumn("task", F.spark_partition_id()).where("x is null")
    assert facts.select("task").distinct().count() == facts.count() == 30


def plain(x, y, n_classes, hidden, seed, epochs, batch, rate, decay):
    """The same training row by row: no counting, no shared arrays."""
    random = np.random.default_rng(seed)
    sizes = [x.shape[1], *hidden, n_classes]
    layers = [[random.uniform(-1, 1, (a, b)) / np.sqrt(a), random.uniform(-1, 1, b) / np.sqrt(a)]
              for a, b in zip(sizes[:-1], sizes[1:], strict=True)]
    m, s = ([[np.zeros_like(p) for p in layer] for layer in layers] for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = random.permutation(len(x))
        for start in range(0, len(x), batch):
            rows, step = order[start:start + batch], step + 1
            seen = sol.forward(layers, x[rows])
            back = sol.softmax(seen[-1])
            back[np.arange(len(rows)), y[rows]] -= 1
            back /= len(rows)
            for i in reversed(range(len(layers))):
                grads = seen[i].T @ back, back.sum(axis=0)
                back = (back @ layers[i][0].T) * (seen[i] > 0) if i else None
                for k, g in enumerate(grads):
                    m[i][k] = 0.9 * m[i][k] + 0.1 * g
                    s[i][k] = 0.999 * s[i][k] + 0.001 * g * g
                    move = m[i][k] / (1 - 0.9 ** step) / (np.sqrt(s[i][k] / (1 - 0.999 ** step)) + 1e-8)
                    layers[i][k] = layers[i][k] * (1 - rate * decay) - rate * move
    return layers


def test_training_equals_the_plain_formula(monkeypatch):
    monkeypatch.setattr(sol, "_UPDATED_AT_ONCE", 7)
    monkeypatch.setattr(sol, "_STEPS_A_SWEEP", 3)
    random = np.random.default_rng(5)
    vectors = np.array([[i >> k & 1 for k in range(3)] for i in range(8)], dtype=np.float64)
    n = random.integers(0, 9, (8, 3))
    vector, label = np.nonzero(n)
    rows = np.repeat(np.arange(len(vector)), n[vector, label])
    got, _ = sol.train_network(vectors, n, (6, 4), 2, 5, 16, 1e-2, 0.1)
    want = plain(vectors[vector[rows]], label[rows], 3, (6, 4), 2, 5, 16, 1e-2, 0.1)
    assert all(np.allclose(a, b, atol=1e-10) for one, two in zip(got, want, strict=True) for a, b in zip(one, two, strict=True))


def test_moments_of_silent_units_end_at_zero():
    values, grads, moments, squares = np.array([[1.0, 1.0], [0.0, 1e-3], [1e-3, 1e-3], [1e-6, 1e-6]])
    for step in range(1, 9000):
        sol._update(values, grads, moments, squares, step, 1e-3, 0.0, np.empty(2))
    assert moments[0] == 0 and moments[1] > 0 and squares[0] > 1e-12


def test_the_longest_networks_start_first():
    widths = [f.params["hidden"] for f in q_models._layout_fits()]
    assert len(widths) == 70 and widths[:5] == [(512, 256)] * 5 and widths[-5:] == [()] * 5
