"""Confidence over steps under a network, with its first layer kept as running sums.

Features only ever enter, so the first layer's input sums of a sample grow by
one row of weights with each of them. The rest of the network is computed anew
only at grid points where a feature entered; between them the scores stand.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import DIGITS, TIE
from .solvers import forward, softmax

ROWS_AT_ONCE = 2048
_CURVE = "sample_id long, label int, t int, pred int, confidence double, p_true double"


def _points(layers, ids, classes, grid, inclusive):
    """Rows of (sample_id, label, fires) to one row for each grid point."""
    grid, classes = np.asarray(grid), np.asarray(classes)
    column = {int(f): i for i, f in enumerate(ids)}
    (first, bias), rest = layers[0], layers[1:]

    def scored(sums: np.ndarray) -> np.ndarray:
        return forward(rest, np.maximum(sums, 0.0))[-1] if rest else sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                # In the order of the features, so that equal sets have equal sums.
                events = sorted((i, column[f["feature_id"]], f["first_step"]) for i, row in enumerate(
                    batch.column("fires").to_pylist()) for f in row or ())
                row, feature, step = np.array(events, dtype=np.int64).reshape(-1, 3).T
                entry = np.searchsorted(grid, step, side="left" if inclusive else "right")
                sums = np.tile(bias, (batch.num_rows, 1))
                scores = scored(sums)
                label = batch.column("label").to_numpy(zero_copy_only=False)
                for g, t in enumerate(grid):
                    new = entry == g
                    if new.any():
                        np.add.at(sums, row[new], first[feature[new]])
                        moved = np.unique(row[new])
                        scores[moved] = scored(sums[moved])
                    yield _decided(batch, scores, classes, label, int(t))

    return run


def _decided(batch: pa.RecordBatch, scores: np.ndarray, classes: np.ndarray, label: np.ndarray, t: int) -> pa.RecordBatch:
    p = softmax(scores)
    best = np.argmax(scores >= scores.max(axis=1, keepdims=True) - TIE, axis=1)
    true = (classes[None, :] == label[:, None])
    share = np.where(true.any(axis=1), (p * true).sum(axis=1), np.nan)
    n = batch.num_rows
    return pa.record_batch(
        [batch.column("sample_id"), batch.column("label"), pa.array(np.full(n, t), pa.int32()),
         pa.array(classes[best], pa.int32()), pa.array(p.max(axis=1)), pa.array(share, mask=np.isnan(share))],
        [c.split()[0] for c in _CURVE.split(", ")])


def network_curve(
    first: DataFrame, samples: DataFrame, layers: Sequence[tuple[np.ndarray, np.ndarray]], ids: Sequence[int],
    classes: Sequence[int], grid: Sequence[int], inclusive: bool = False,
) -> DataFrame:
    """(sample_id, label, t, pred, confidence, p_true) at every grid point, as of `confidence_curve`.

    `layers` are (weights, biases) from input to output, rectified in between;
    the inputs are the features of `ids` in that order. `first` has at most one
    row of a sample for each of them. A sample without firings has the scores of
    the empty input, a label that is no class has no p_true.
    """
    if not len(grid):
        raise ValueError("the grid has no points")
    own = first.where(F.col("feature_id").isin([int(i) for i in ids]))
    fires = own.groupBy("sample_id").agg(F.collect_list(F.struct("feature_id", "first_step")).alias("fires"))
    rows = samples.select(F.col("sample_id").cast("long").alias("sample_id"), F.col("label").cast("int").alias("label")).join(
        fires, "sample_id", "left")
    curve = rows.mapInArrow(_points(list(layers), ids, classes, sorted(grid), inclusive), _CURVE)
    return curve.withColumns({c: F.round(c, DIGITS) for c in ("confidence", "p_true")})


def network_predictions(first: DataFrame, samples: DataFrame, layers, ids, classes) -> DataFrame:
    """(sample_id, label, pred, confidence, p_true) on all features that ever fired."""
    last = np.iinfo(np.int32).max
    return network_curve(first, samples, layers, ids, classes, [last], True).drop("t")
