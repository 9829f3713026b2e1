"""Toxicity as a severity grade, by cumulative-link ordinal regression.

P(grade <= k) = sigmoid(threshold_k - w . x): one weight per word, shared by all
ordered thresholds. x holds log(1 + count) of the words and word beginnings that
separate the grades in a bounded sample of labelled documents. A document's score is its
expected severity, the sum over k of P(grade > k).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text_hash
from .labelled import SAMPLE_ROWS, Lookup, labelled_sample, row_sums, sigmoid

MAX_FEATURES = 1 << 16
MIN_DOCS = 3
MIN_CHI_SQUARE = 10.83  # one degree of freedom, p = 0.001
PREFIXES = (4, 5, 6, 7, 8)  # bytes
PENALTY = 0.02
STEPS = 400


@dataclass
class OrdinalModel:
    """Sorted term hashes, their weights, and the ordered thresholds."""

    keys: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each row and threshold k."""
        return 1.0 - sigmoid(self.thresholds[None, :] - scores[:, None])


def terms(found: text_hash.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, hash) of all words, then of the beginnings of longer words."""
    yield found.docs, found.hashes
    for size in PREFIXES:
        yield found.prefixes(size)


def term_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, term hash, count), and the number of words of each document."""
    found = text_hash.words(texts, between=text_hash.PUNCTUATED)
    every = list(terms(found))
    docs, hashes = np.concatenate([d for d, _ in every]), np.concatenate([h for _, h in every])
    order = np.lexsort((hashes, docs))
    docs, hashes = docs[order], hashes[order]
    new = np.ones(len(docs), dtype=bool)
    new[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, len(docs)))
    return docs[starts], hashes[starts], counts, np.diff(found.first)


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = text_hash.filled(batch.column("text"))
        for start, end in text_hash.slices(texts, text_hash.SMALL_SLICE_BYTES):
            docs, hashes, _, _ = term_counts(texts.slice(start, end - start))
            toxic = batch.column("label").slice(start, end - start).to_numpy() > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes.view(np.int64)), pa.array(toxic[docs])], names=["term", "toxic"])


def _feature_rows(batches: Iterator[pa.RecordBatch], keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    lookup = Lookup(keys)
    for batch in batches:
        texts = text_hash.filled(batch.column("text"))
        for start, end in text_hash.slices(texts, text_hash.SMALL_SLICE_BYTES):
            docs, hashes, counts, lengths = term_counts(texts.slice(start, end - start))
            rows, features = lookup.find(hashes)
            first = np.searchsorted(docs[rows], np.arange(end - start + 1)).astype(np.int32)
            offsets = pa.array(first)
            yield pa.RecordBatch.from_arrays([
                batch.column("id").slice(start, end - start), batch.column("label").slice(start, end - start),
                pa.array(lengths),
                pa.ListArray.from_arrays(offsets, pa.array(features.astype(np.int32))),
                pa.ListArray.from_arrays(offsets, pa.array(counts[rows].astype(np.int32))),
            ], names=["id", "label", "words", "features", "counts"])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", limit: int = SAMPLE_ROWS,
        id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Fit on at most `limit` labelled documents.

    A label of 0 is grade 0. Where the labels know only 0 and 1, the marked
    documents are graded 1 or 2 by their share of words that speak for the
    mark, split at its median; labels with more grades are taken as they are.
    Without documents of two grades the model finds nothing toxic.
    """
    sample = labelled_sample(docs, labels, label_col, limit, None, id_col, text_col)
    totals = sample.agg(F.count(F.lit(1)), F.coalesce(F.count_if(F.col("label") > 0), F.lit(0))).first()
    none = OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.array([np.inf]))
    if not 0 < totals[1] < totals[0]:
        return none
    n, pos = float(totals[0]), float(totals[1])
    table = sample.mapInArrow(_term_rows, "term long, toxic boolean").groupBy("term").agg(
        F.count(F.lit(1)).cast("double").alias("df"), F.count_if("toxic").cast("double").alias("tox"))
    # Chi-square of the two-by-two table of term and mark.
    a, b = F.col("tox"), F.col("df") - F.col("tox")
    skew = a * (n - pos - b) - b * (pos - a)
    chi = F.lit(n) * skew * skew / (F.lit(pos * (n - pos)) * F.col("df") * (F.lit(n) - F.col("df")))
    chosen = table.where((F.col("df") >= MIN_DOCS) & (F.col("df") < n)).withColumn("chi", chi).where(
        F.col("chi") >= MIN_CHI_SQUARE).orderBy(F.desc("chi"), "term").limit(MAX_FEATURES)
    table = chosen.select("term", (skew > 0).alias("speaks")).toArrow()
    if not table.num_rows:
        return none
    keys = table.column("term").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    keys = keys[order]
    speaks = table.column("speaks").to_numpy()[order]
    rows = sample.mapInArrow(
        lambda b: _feature_rows(b, keys),
        "id long, label int, words long, features array<int>, counts array<int>").orderBy("id").toArrow().combine_chunks()
    grades = rows.column("label").to_numpy().astype(np.int64)
    sizes = rows.column("features").combine_chunks().value_lengths().to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(grades)), sizes)
    features = rows.column("features").combine_chunks().flatten().to_numpy()
    counts = rows.column("counts").combine_chunks().flatten().to_numpy()
    if grades.max() == 1:
        marked = row_sums(owner, counts * speaks[features], len(grades))
        share = marked / np.maximum(rows.column("words").to_numpy(), 1)
        grades = np.where(grades > 0, 1 + (share > np.median(share[grades > 0])), 0)
    grades = np.unique(grades, return_inverse=True)[1]
    return _fit_rows(keys, owner, features, np.log1p(counts), grades)


def _fit_rows(
    keys: np.ndarray, owner: np.ndarray, features: np.ndarray, values: np.ndarray, grades: np.ndarray
) -> OrdinalModel:
    """Penalised maximum likelihood by full-gradient steps with momentum and scaling."""
    n, top = len(grades), int(grades.max())
    weights = np.zeros(len(keys))
    # Thresholds as a start and logarithms of gaps, so that they stay ordered.
    shares = np.clip(np.cumsum(np.bincount(grades, minlength=top + 1))[:-1] / n, 1e-3, 1 - 1e-3)
    logits = np.log(shares / (1 - shares))
    start = np.concatenate([logits[:1], np.log(np.maximum(np.diff(logits), 1e-2))])
    params = np.concatenate([weights, start])
    mean, scale = np.zeros_like(params), np.zeros_like(params)
    f = len(keys)
    for step in range(1, STEPS + 1):
        gaps = np.exp(params[f + 1:])
        cuts = params[f] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = row_sums(owner, params[:f][features] * values, n)
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        high, low = sigmoid(edges[grades + 1] - score), sigmoid(edges[grades] - score)
        chance = np.maximum(high - low, 1e-12)
        d_high, d_low = high * (1 - high) / chance, low * (1 - low) / chance
        gradient = np.zeros_like(params)
        gradient[:f] = np.bincount(features, weights=(d_high - d_low)[owner] * values, minlength=f)
        gradient[:f] += PENALTY * params[:f]
        by_cut = np.zeros(top)
        np.add.at(by_cut, grades[grades < top], -d_high[grades < top])
        np.add.at(by_cut, grades[grades > 0] - 1, d_low[grades > 0])
        tails = np.cumsum(by_cut[::-1])[::-1]
        gradient[f] = tails[0]
        gradient[f + 1:] = tails[1:] * gaps
        mean = 0.9 * mean + 0.1 * gradient
        scale = 0.99 * scale + 0.01 * gradient * gradient
        rate = 0.1 * (1 - step / (STEPS + 1))
        params -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(scale / (1 - 0.99**step)) + 1e-9)
    gaps = np.exp(params[f + 1:])
    return OrdinalModel(keys, params[:f], params[f] + np.concatenate([[0.0], np.cumsum(gaps)]))


def _score(batches: Iterator[pa.RecordBatch], model: OrdinalModel) -> Iterator[pa.RecordBatch]:
    lookup = Lookup(model.keys)
    for batch in batches:
        texts = text_hash.filled(batch.column("text"))
        for start, end in text_hash.slices(texts, text_hash.SMALL_SLICE_BYTES):
            n = end - start
            found = text_hash.words(texts.slice(start, n), between=text_hash.PUNCTUATED)
            width = max(len(model.keys), 1)
            hits = []
            for docs, hashes in terms(found):
                rows, features = lookup.find(hashes)
                hits.append(docs[rows] * width + features)
            cells, counts = np.unique(np.concatenate(hits), return_counts=True)
            score = row_sums(cells // width, model.weights[cells % width] * np.log1p(counts), n) if len(
                cells) else np.zeros(n)
            above = model.above(score)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(start, n), pa.array(above.sum(axis=1)), pa.array(above[:, 0])],
                names=["id", "severity", "chance"])


def severity(
    docs: DataFrame, model: OrdinalModel, cut: float = 0.5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, severity (expected grade), toxic_probability, rejected.

    A document is rejected when the probability of any grade above 0 reaches
    `cut`. The whole text counts. Null and empty texts have no words and are
    scored by the thresholds alone; null ids and repeated rows keep their rows;
    other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda b: _score(b, model), "id long, severity double, chance double").select(
        F.col("id").alias("doc_id"), "severity", F.col("chance").alias("toxic_probability"),
        (F.col("chance") >= cut).alias("rejected"))


def without_toxic(docs: DataFrame, model: OrdinalModel, cut: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents that are not rejected, with all their columns (one pass, no join)."""
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = pa.array(np.arange(batch.num_rows))
            numbered = pa.RecordBatch.from_arrays([places, batch.column("text")], names=["id", "text"])
            for part in _score(iter([numbered]), model):
                stay = part.filter(pa.array(part.column("chance").to_numpy() < cut)).column("id")
                yield pa.RecordBatch.from_arrays([batch.column("row").take(stay)], names=["row"])

    return rows.mapInArrow(run, rows.select("row").schema).select("row.*")
