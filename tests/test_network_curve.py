import numpy as np
import pytest

from lumenact.operators import network_curve as net
from lumenact.operators.solvers import forward, softmax


@pytest.mark.parametrize("hidden", [(), (5,), (6, 4)])
@pytest.mark.parametrize("inclusive", [False, True])
def test_equals_the_whole_network_at_every_step(spark, hidden, inclusive):
    random = np.random.default_rng(len(hidden))
    ids, classes, grid = [9, 4, 7, 30], [2, 5, 6], [1, 3, 4, 9]
    sizes = [len(ids), *hidden, len(classes)]
    layers = [(random.normal(size=(a, b)), random.normal(size=b)) for a, b in zip(sizes[:-1], sizes[1:], strict=True)]
    fires = [(s, f, int(random.integers(0, 10))) for s in range(30) for f in [*ids, 99] if random.random() < 0.5]
    samples = [(s, classes[s % 3] if s < 28 else 77) for s in range(33)]  # 30-32 never fire
    df = spark.createDataFrame(samples, "sample_id long, label int").repartition(3)
    first = spark.createDataFrame(fires, "sample_id long, feature_id int, first_step int")
    got = {(r["sample_id"], r["t"]): r for r in net.network_curve(first, df, layers, ids, classes, grid, inclusive).collect()}
    assert len(got) == len(samples) * len(grid)
    for s, label in samples:
        for t in grid:
            x = [float(any(a == s and f == i and (step <= t if inclusive else step < t) for a, f, step in fires)) for i in ids]
            p = softmax(forward(layers, np.array([x]))[-1])[0]
            row = got[s, t]
            assert row["pred"] == classes[int(p.argmax())]
            assert np.isclose(row["confidence"], p.max(), atol=1e-8)
            assert row["p_true"] is None if label == 77 else np.isclose(row["p_true"], p[classes.index(label)], atol=1e-8)


def test_no_samples(spark):
    empty = spark.createDataFrame([], "sample_id long, label int")
    first = spark.createDataFrame([], "sample_id long, feature_id int, first_step int")
    layers = [(np.ones((1, 2)), np.zeros(2))]
    assert net.network_predictions(first, empty, layers, [3], [0, 1]).count() == 0
