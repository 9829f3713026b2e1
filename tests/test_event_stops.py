import numpy as np
import pytest

from lumenact.operators import temporal as tmp
from lumenact.operators.linear import BIAS


@pytest.mark.parametrize("grid, min_steps", [(list(range(1, 13)), 3), ([1, 2, 4, 8, 16, 40], 5), ([1, 5, 9], 50)])
def test_stops_from_changes_equal_those_of_the_whole_curve(spark, grid, min_steps):
    random = np.random.default_rng(min_steps)
    fires = [(s, s % 3, f, int(random.integers(0, 20))) for s in range(40) for f in range(6) if random.random() < 0.6]
    first = spark.createDataFrame(fires, "sample_id long, label int, feature_id int, first_step int")
    samples = spark.createDataFrame([(s, s % 3) for s in range(43)], "sample_id long, label int")
    rows = [(f, [float(x) for x in random.integers(-8, 9, 3) / 8]) for f in [*range(6), BIAS]]
    weights = spark.createDataFrame(rows, "feature_id int, w array<double>")
    curve = tmp.confidence_curve(first, samples, weights, [0, 1, 2], grid)
    changes = tmp.confidence_changes(first, samples, weights, [0, 1, 2], grid, min_steps)
    assert changes.count() <= curve.count() + 43
    whole, short = (sorted(tmp.early_stop(c, (0.4, 0.5, 0.7, 0.99), min_steps, 99).collect()) for c in (curve, changes))
    assert whole == short
    every = {(r["sample_id"], r["t"]): r for r in curve.collect()}
    assert all(every[r["sample_id"], r["t"]] == r for r in changes.select(curve.columns).collect())
