"""Gradient boosting of small trees on distinct 0/1 vectors, one tree per class and round.

A round needs sums over the vectors only: for every class, node and feature the
rows and residuals that fire, then for every leaf the residuals and curvatures.
Where these sums come from is left open. `fit_local` takes them from a pattern
table in one task, which keeps the scores between rounds; `fit_spread` has Spark
add up what each partition of a table of any size sums up, four small jobs a
round. Both grow the same trees.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .patterns import _matrix
from .solvers import softmax

ROUNDS = 200
DEPTH = 3
RATE = 0.1
_TIE = 1e-9


@dataclass
class Trees:
    """`features` has a row per tree: the splits by level, -1 where a node is left whole; `values` its leaves."""

    start: np.ndarray
    rate: float = RATE
    depth: int = DEPTH
    features: list[np.ndarray] = field(default_factory=list)
    values: list[np.ndarray] = field(default_factory=list)

    @property
    def width(self) -> int:
        return len(self.start)

    def scores(self, x: np.ndarray, since: int = 0) -> np.ndarray:
        """What the rounds from `since` on add to the scores."""
        out = np.zeros((len(x), self.width))
        for features, values in zip(self.features[since:], self.values[since:], strict=True):
            at = nodes(x, features, self.depth)
            out += self.rate * np.take_along_axis(values, at.T, axis=1).T
        return out


def nodes(x: np.ndarray, features: np.ndarray, levels: int) -> np.ndarray:
    """The node of each vector at a level, in each tree of a round; an unsplit node passes all to its left."""
    at = np.zeros((len(x), len(features)), dtype=np.int64)
    first = 0
    for level in range(levels):
        split = np.take_along_axis(features, first + at.T, axis=1).T
        fires = np.take_along_axis(x, np.maximum(split, 0), axis=1) > 0.5
        at = 2 * at + (fires & (split >= 0))
        first += 1 << level
    return at


def probabilities(scores: np.ndarray) -> np.ndarray:
    """Of each tree's class; with one tree for two classes, of the second."""
    if scores.shape[1] > 1:
        return softmax(scores)
    return 1.0 / (1.0 + np.exp(-np.clip(scores, -500, 500)))


def sums(x: np.ndarray, n: np.ndarray, scores: np.ndarray, features: np.ndarray, level: int, depth: int) -> np.ndarray:
    """Rows and residuals by (tree, node, feature) with their totals last; at the leaves residuals and curvatures."""
    rows, p = n.sum(axis=1), probabilities(scores)
    hits = n if scores.shape[1] > 1 else n[:, 1:]
    residual = hits - rows[:, None] * p
    at = nodes(x, features, level)
    trees, size = scores.shape[1], 1 << level
    where = at + np.arange(trees) * size
    ones = np.repeat(np.arange(len(x)), trees)

    def spread(values: np.ndarray) -> np.ndarray:
        grid = np.zeros((len(x), trees * size))
        grid[ones, where.ravel()] = values.ravel()
        return grid

    if level == depth:
        parts = [spread(residual).sum(axis=0), spread(rows[:, None] * p * (1 - p)).sum(axis=0)]
        return np.stack(parts).reshape(2, trees, size, 1)
    wide = np.column_stack([x, np.ones(len(x))])
    every = np.broadcast_to(rows[:, None], p.shape)
    return np.stack([spread(v).T @ wide for v in (every, residual)]).reshape(2, trees, size, -1)


def _splits(found: np.ndarray) -> np.ndarray:
    """The feature of each node with the largest gain, the lowest of equals; -1 if none parts the rows."""
    rows, residual = found
    right, total = rows[..., :-1], rows[..., -1:]
    left = total - right
    with np.errstate(divide="ignore", invalid="ignore"):
        mean_right = residual[..., :-1] / right
        mean_left = (residual[..., -1:] - residual[..., :-1]) / left
        gain = right * left / total * (mean_left - mean_right) ** 2
    gain = np.where((right > 0.5) & (left > 0.5), gain, -1.0)
    best = gain.max(axis=-1, keepdims=True)
    # Sums differ in their last digits with the order of adding.
    chosen = np.argmax(gain >= best * (1 - _TIE) - 1e-12, axis=-1)
    return np.where(best[..., 0] >= 0, chosen, -1)


def fit(
    totals: np.ndarray, take: Callable[[Trees, np.ndarray, int], np.ndarray],
    rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE,
) -> Trees:
    """`totals` are the rows of each class; `take(trees, features, level)` returns the sums of a level."""
    share = np.maximum(totals, 1e-300) / max(totals.sum(), 1.0)
    start = np.log(share) if len(share) != 2 else np.log(share[1:] / share[:1])
    trees = Trees(start, rate, depth)
    for _ in range(rounds):
        features = np.full((trees.width, (1 << depth) - 1), -1, dtype=np.int64)
        for level in range(depth):
            first = (1 << level) - 1
            features[:, first:2 * first + 1] = _splits(take(trees, features, level))
        residual, curve = take(trees, features, depth)[..., 0]
        factor = 1.0 if trees.width == 1 else (trees.width - 1) / trees.width
        safe = np.abs(curve) > 1e-150
        trees.values.append(np.where(safe, factor * residual / np.where(safe, curve, 1.0), 0.0))
        trees.features.append(features)
    return trees


def fit_local(x: np.ndarray, n: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """On one pattern table; the scores are carried from round to round."""
    held: dict = {"round": 0}

    def take(trees: Trees, features: np.ndarray, level: int) -> np.ndarray:
        if "scores" not in held:
            held["scores"] = np.tile(trees.start, (len(x), 1))
        if held["round"] < len(trees.features):
            held["scores"] = held["scores"] + trees.scores(x, held["round"])
            held["round"] = len(trees.features)
        return sums(x, n, held["scores"], features, level, trees.depth)

    return fit(n.sum(axis=0), take, rounds, depth, rate)


def class_scores(trees: Trees, x: np.ndarray) -> np.ndarray:
    scores = trees.start + trees.scores(x)
    return scores if trees.width > 1 else np.column_stack([-scores, scores])


def boosted(x: np.ndarray, n: np.ndarray, test: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE):
    """The body of a fit that runs as one task."""
    trees = fit_local(x, n, rounds, depth, rate)
    p = softmax(class_scores(trees, x) * (1.0 if trees.width > 1 else 0.5))
    loss = float(-(n * np.log(np.maximum(p, 1e-300))).sum() / n.sum())
    return class_scores(trees, test), {"rounds": rounds, "loss": loss, "n_patterns": len(x), "n_rows": n.sum()}


def fit_spread(table: DataFrame, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """The same trees for a pattern table (x, n) of any size: partitions send sums, never rows.

    Scores are computed anew from the trees so far, so a lost executor costs
    its partitions' sums only. What a partition sends does not grow with its rows.
    """
    table = stage(table.select("x", "n"))
    counts = table.select(F.posexplode("n").alias("i", "c")).groupBy("i").agg(F.sum("c").alias("c")).collect()
    totals = np.array([r["c"] for r in sorted(counts)], dtype=np.float64)

    def take(trees: Trees, features: np.ndarray, level: int) -> np.ndarray:
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                part = pa.Table.from_batches([batch])
                if not len(part):
                    continue
                x, n = _matrix(part, "x"), _matrix(part, "n")
                found = sums(x, n, trees.start + trees.scores(x), features, level, trees.depth)
                total = found if total is None else total + found
            if total is not None:
                yield pa.record_batch([pa.array([list(total.shape)]), pa.array([total.ravel().tolist()])], ["shape", "v"])

        parts = table.mapInArrow(partial, "shape array<long>, v array<double>").select("shape", F.posexplode("v")).groupBy(
            "shape", "pos").agg(F.sum("col").alias("v")).collect()
        out = np.zeros(len(parts))
        for r in parts:
            out[r["pos"]] = r["v"]
        return out.reshape(parts[0]["shape"])

    return fit(totals, take, rounds, depth, rate)
