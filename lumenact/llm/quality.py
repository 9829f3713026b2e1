"""Quality as naive Bayes support vectors.

Indicators of n-grams (words, word pairs, and runs of one to three word shapes)
are scaled by the log-count ratio of the two classes. A linear model is then
fitted to the hinge loss by dual coordinate descent, and its margin is turned
into a probability by a logistic curve fitted on documents left out of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text_hash
from .labelled import SAMPLE_ROWS, Lookup, labelled_sample, row_sums, sigmoid

MAX_FEATURES = 1 << 16
MIN_DOCS = 3
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 12
CALIBRATION_PART = 5  # every fifth sampled document fits the curve, not the margin

_U = np.uint64
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[0x41:0x5B] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[0x30:0x3A] = True


def _inside(flags: np.ndarray, found: text_hash.Words) -> np.ndarray:
    """How many bytes of each word have the flag."""
    sums = np.concatenate([[0], np.cumsum(flags[found.data])])
    return sums[found.ends] - sums[found.starts]


def shapes(found: text_hash.Words) -> np.ndarray:
    """A small number for each word: letters, case, digits, signs, its last byte, repetition."""
    length = found.ends - found.starts
    letters, upper, digits = (_inside(f, found) for f in (_LETTER, _UPPER, _DIGIT))
    signs = length - letters - digits
    shape = np.minimum(upper, 3) + 4 * np.minimum(digits, 2) + 12 * np.minimum(signs, 4)
    shape += 60 * np.minimum(np.log2(length).astype(np.int64), 5)
    last = found.data[found.ends - 1].astype(np.int64)
    shape += 360 * np.where(_LETTER[last] | _DIGIT[last], 0, last)
    again = np.zeros(len(length), dtype=bool)
    again[1:] = (found.hashes[1:] == found.hashes[:-1]) & (found.docs[1:] == found.docs[:-1])
    return shape + 360 * 256 * again


def ngrams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, hash) of every n-gram of whole texts, one kind after the other."""
    found = text_hash.words(texts)
    shaped = text_hash.Words(
        found.data, text_hash.mix(shapes(found).astype(np.uint64) + _U(1 << 40)), found.starts, found.ends,
        found.docs, found.first, found.sums)
    for salt, (source, n) in enumerate(((found, 1), (found, 2), (shaped, 1), (shaped, 2), (shaped, 3))):
        grams, docs = text_hash.ngram_hashes(source, n)
        yield docs, text_hash.mix(grams + _U(salt))


def indicators(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, n-gram hash) of whole texts."""
    kinds = list(ngrams(texts))
    docs = np.concatenate([d for d, _ in kinds])
    hashes = np.concatenate([h for _, h in kinds])
    order = np.lexsort((hashes, docs))
    docs, hashes = docs[order], hashes[order]
    new = np.ones(len(docs), dtype=bool)
    new[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
    return docs[new], hashes[new]


def features_of(texts: pa.Array, lookup: Lookup) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, feature) of whole texts, in order."""
    width = max(len(lookup.keys), 1)
    found = []
    for docs, hashes in ngrams(texts):
        rows, features = lookup.find(hashes)
        found.append(np.unique(docs[rows] * width + features))
    cells = np.unique(np.concatenate(found))
    return cells // width, cells % width


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int, pa.Array]]:
    for batch in batches:
        texts = text_hash.filled(batch.column("text"))
        for start, end in text_hash.slices(texts):
            yield batch, start, end - start, texts.slice(start, end - start)


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, start, n, texts in _slices(batches):
        docs, hashes = indicators(texts)
        good = batch.column("label").slice(start, n).to_numpy() > 0
        grams, at = np.unique(hashes, return_inverse=True)  # counted here before the shuffle
        positive = np.bincount(at, weights=good[docs], minlength=len(grams)).astype(np.int64)
        both = np.bincount(at, minlength=len(grams))
        yield pa.RecordBatch.from_arrays(
            [pa.array(grams.view(np.int64)), pa.array(positive), pa.array(both - positive)],
            names=["gram", "good", "bad"])


def _feature_rows(batches: Iterator[pa.RecordBatch], keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    lookup = Lookup(keys)
    for batch, start, n, texts in _slices(batches):
        docs, features = features_of(texts, lookup)
        offsets = pa.array(np.searchsorted(docs, np.arange(n + 1)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([
            batch.column("id").slice(start, n), batch.column("label").slice(start, n),
            pa.ListArray.from_arrays(offsets, pa.array(features.astype(np.int32)))],
            names=["id", "label", "features"])


@dataclass
class QualityModel:
    """Sorted n-gram hashes, weights times ratios, bias, and the curve of probabilities."""

    keys: np.ndarray
    weights: np.ndarray
    squares: np.ndarray  # squared ratios, for the length of a row
    bias: float
    slope: float
    shift: float

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * margins + self.shift)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", limit: int = SAMPLE_ROWS,
        only: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Fit on at most `limit` labelled documents, those of `only`.

    Without documents of both classes every score is the share of label 1
    (1.0 without any label).
    """
    sample = labelled_sample(docs, labels, label_col, limit, only, id_col, text_col)
    n, pos = sample.agg(F.count(F.lit(1)), F.coalesce(F.count_if(F.col("label") > 0), F.lit(0))).first()
    if not 0 < pos < n:
        return QualityModel(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), 0.0, 0.0, 500.0 if pos == n else -500.0)
    grams = sample.mapInArrow(_gram_rows, "gram long, good long, bad long").groupBy("gram").agg(
        F.sum("good").alias("good"), F.sum("bad").alias("bad")).where(f"good + bad >= {MIN_DOCS}")
    # The n-grams that tell most: ratio of the classes' shares, weighted by how often they occur.
    ratio = F.log(((F.col("good") + SMOOTHING) / float(pos + 2 * SMOOTHING))
                  / ((F.col("bad") + SMOOTHING) / float(n - pos + 2 * SMOOTHING)))
    table = grams.withColumn("ratio", ratio).orderBy(
        F.desc(F.abs("ratio") * F.sqrt(F.col("good") + F.col("bad"))), "gram").limit(MAX_FEATURES)
    table = table.select("gram", "ratio").toArrow()
    keys = table.column("gram").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    keys, ratios = keys[order], table.column("ratio").to_numpy()[order]
    rows = sample.mapInArrow(
        lambda b: _feature_rows(b, keys), "id long, label int, features array<int>").orderBy("id").toArrow()
    lists = rows.column("features").combine_chunks()
    sizes = lists.value_lengths().to_numpy().astype(np.int64)
    target = np.where(rows.column("label").to_numpy() > 0, 1.0, -1.0)
    return _fit_rows(keys, ratios, lists.flatten().to_numpy(), sizes, target)


def _fit_rows(
    keys: np.ndarray, ratios: np.ndarray, features: np.ndarray, sizes: np.ndarray, target: np.ndarray
) -> QualityModel:
    ends = np.cumsum(sizes)
    starts = ends - sizes
    # Rows of unit length, so that long documents weigh no more than short ones.
    squares = row_sums(np.repeat(np.arange(len(sizes)), sizes), ratios[features] ** 2, len(sizes))
    norms = np.sqrt(np.maximum(squares, 1e-12))
    held = np.arange(len(sizes)) % CALIBRATION_PART == CALIBRATION_PART - 1
    if len(set(target[held])) < 2 or len(set(target[~held])) < 2:
        held[:] = False
    weights, bias = np.zeros(len(keys)), 0.0
    alpha = np.zeros(len(sizes))
    order = np.flatnonzero(~held)
    random = np.random.default_rng(29)
    for _ in range(EPOCHS):
        for i in random.permutation(order):
            own = features[starts[i]:ends[i]]
            x = ratios[own] / norms[i]
            margin = weights[own] @ x + bias
            step = (1.0 - target[i] * margin) / 2.0  # squared length of the row with its bias entry
            new = min(max(alpha[i] + step, 0.0), COST)
            if new != alpha[i]:
                change = (new - alpha[i]) * target[i]
                weights[own] += change * x
                bias += change
                alpha[i] = new
    owner = np.repeat(np.arange(len(sizes)), sizes)
    margins = row_sums(owner, (weights * ratios)[features], len(sizes)) / norms + bias
    slope, shift = _curve(margins[held] if held.any() else margins, target[held] if held.any() else target)
    return QualityModel(keys, weights * ratios, ratios**2, bias, slope, shift)


def _curve(margins: np.ndarray, target: np.ndarray) -> tuple[float, float]:
    """Logistic curve by Newton steps, with softened targets."""
    good = (target > 0).sum()
    bad = len(target) - good
    goal = np.where(target > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = sigmoid(a * margins + b)
        g = np.array([((p - goal) * margins).sum(), (p - goal).sum()])
        w = p * (1 - p)
        h = np.array([[(w * margins**2).sum() + 1e-6, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-6]])
        change = np.linalg.solve(h, g)
        size = np.abs(change).max()
        a, b = a - change[0] * min(1.0, 2 / size), b - change[1] * min(1.0, 2 / size)
        if size < 1e-8:
            break
    return float(a), float(b)


def _score(batches: Iterator[pa.RecordBatch], model: QualityModel) -> Iterator[pa.RecordBatch]:
    lookup = Lookup(model.keys)
    for batch, start, n, texts in _slices(batches):
        docs, features = features_of(texts, lookup)
        norms = np.sqrt(np.maximum(row_sums(docs, model.squares[features], n), 1e-12))
        margins = row_sums(docs, model.weights[features], n) / norms + model.bias
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").slice(start, n), pa.array(model.probability(margins))], names=["id", "score"])


def quality_scores(
    docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, score (probability of label 1), from the whole text.

    Null and empty texts have no n-grams; their score is that of the bias.
    Null ids and repeated rows keep their rows; other columns are ignored; an
    empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda b: _score(b, model), "id long, score double").withColumnRenamed("id", "doc_id")
