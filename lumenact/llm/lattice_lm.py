"""Marginal likelihood of texts under a unigram model over subwords.

An existing vocabulary gives the pieces. A word, written with a leading space,
is the sum over all ways to cut it into pieces, computed by a log-space forward
recursion; no piece spans two words, so a text is the product of its words and
an end token. The vocabulary's scores are the starting weights; expected counts
over all cuts of all training words (forward-backward) then turn them into
probabilities. A word's likelihood depends on the word alone, so each distinct
word of the corpus is scored once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text_hash
from .labelled import row_sums
from .tables import per_process, shared_table

HEAD_WORDS = 1 << 19
ROUNDS = 4
PRIOR_WEIGHT = 1.0
BASE_ADD = 0.1
WORDS_AT_ONCE = 4096
BYTES_AT_ONCE = 1 << 18
COMBINE_ROWS = 400_000
SLICE_BYTES = 2 << 20
_SPACE = b" "


class Pieces:
    """The vocabulary as a trie over bytes; every single byte is a piece."""

    def __init__(self, scores: dict[bytes, float]):
        self.names = sorted(scores)
        self.prior = np.array([scores[p] for p in self.names])
        nodes: dict[tuple[int, int], int] = {}
        piece_at = {}
        for number, name in enumerate(self.names):
            node = 0
            for byte in name:
                node = nodes.setdefault((node, byte), len(nodes) + 1)
            piece_at[node] = number
        self.step = np.full((len({n for n, _ in nodes}) + 1, 256), -1, dtype=np.int32)
        # Only nodes with children have a row in the table.
        row = {n: k for k, n in enumerate(sorted({n for n, _ in nodes}))}
        self.row = np.full(len(nodes) + 1, -1, dtype=np.int32)
        for n, k in row.items():
            self.row[n] = k
        for (n, byte), child in nodes.items():
            self.step[row[n], byte] = child
        self.piece = np.full(len(nodes) + 1, -1, dtype=np.int32)
        for node, number in piece_at.items():
            self.piece[node] = number

    def arcs(self, words: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, pieces) of all pieces in padded words, by rising start."""
        found = []
        width = words.shape[1]
        for start in range(width):
            rows = np.flatnonzero(lengths > start)
            place = np.zeros(len(rows), dtype=np.int32)
            end = start
            while len(rows) and end < width:
                node = self.step[place, words[rows, end]]
                end += 1
                alive = (node >= 0) & (lengths[rows] >= end)
                rows, node = rows[alive], node[alive]
                piece = self.piece[node]
                whole = piece >= 0
                if whole.any():
                    found.append((start, end, rows[whole], piece[whole]))
                place = self.row[node]
                deeper = place >= 0
                rows, place = rows[deeper], place[deeper]
        return found

    def forward(self, arcs, logs: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
        alpha = np.full((width + 1, len(lengths)), -np.inf)
        alpha[0] = 0.0
        for start, end, rows, pieces in arcs:
            alpha[end, rows] = np.logaddexp(alpha[end, rows], alpha[start, rows] + logs[pieces])
        return alpha

    def backward(self, arcs, logs: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
        beta = np.full((width + 1, len(lengths)), -np.inf)
        beta[lengths, np.arange(len(lengths))] = 0.0
        for start, end, rows, pieces in reversed(arcs):
            beta[start, rows] = np.logaddexp(beta[start, rows], beta[end, rows] + logs[pieces])
        return beta


def load_pieces(path: str) -> Pieces:
    """Pieces of a SentencePiece file that can occur inside one word, with starting log weights."""
    return per_process(("pieces", path), lambda: _read_pieces(path))


def _read_pieces(path: str) -> Pieces:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scores: dict[bytes, float] = {}
    lowest = 0.0
    for number in range(model.get_piece_size()):
        if model.is_unknown(number) or model.is_control(number) or model.is_byte(number):
            continue
        name = model.id_to_piece(number).replace("▁", " ").encode("utf-8")
        if _SPACE in name[1:]:
            continue
        # Scores of a merge vocabulary are negative ranks: weight by one over the rank.
        score = model.get_score(number)
        scores[name] = -float(np.log(2.0 - min(score, 0.0)))
        lowest = min(lowest, scores[name])
    for byte in range(256):
        scores.setdefault(bytes([byte]), lowest)
    total = np.logaddexp.reduce(list(scores.values()))
    return Pieces({name: score - total for name, score in scores.items()})


def _padded(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions, byte matrix, lengths) of words with their leading space, alike in length."""
    sizes = np.array([len(w) + 1 for w in words], dtype=np.int64)
    order = np.argsort(sizes, kind="stable")
    start = 0
    while start < len(order):
        end = min(start + WORDS_AT_ONCE, len(order))
        while end > start + 1 and (end - start) * sizes[order[end - 1]] > BYTES_AT_ONCE:
            end = start + (end - start) // 2
        rows = order[start:end]
        width = int(sizes[rows[-1]])
        joined = b"".join((_SPACE + words[r]).ljust(width, b"\0") for r in rows.tolist())
        yield rows, np.frombuffer(joined, dtype=np.uint8).reshape(len(rows), width), sizes[rows]
        start = end


def word_logs(words: list[bytes], pieces: Pieces, logs: np.ndarray) -> np.ndarray:
    """Natural log of each word's probability, summed over all segmentations."""
    out = np.zeros(len(words))
    for rows, matrix, lengths in _padded(words):
        alpha = pieces.forward(pieces.arcs(matrix, lengths), logs, lengths, matrix.shape[1])
        out[rows] = alpha[lengths, np.arange(len(rows))]
    return out


def _expected(batches: Iterator[pa.RecordBatch], path: str, logs: np.ndarray) -> Iterator[pa.RecordBatch]:
    pieces = load_pieces(path)
    totals = np.zeros(len(pieces.names))
    for batch in batches:
        words, counts = batch.column("word").to_pylist(), batch.column("c").to_numpy().astype(float)
        for rows, matrix, lengths in _padded(words):
            width = matrix.shape[1]
            arcs = pieces.arcs(matrix, lengths)
            alpha = pieces.forward(arcs, logs, lengths, width)
            beta = pieces.backward(arcs, logs, lengths, width)
            whole, weight = alpha[lengths, np.arange(len(rows))], counts[rows]
            for start, end, own, used in arcs:
                share = np.exp(alpha[start, own] + logs[used] + beta[end, own] - whole[own]) * weight[own]
                totals += np.bincount(used, weights=share, minlength=len(totals))
    used = np.flatnonzero(totals)
    yield pa.RecordBatch.from_arrays(
        [pa.array(used.astype(np.int32)), pa.array(totals[used])], names=["piece", "n"])


def _gather(found: text_hash.Words, rows: np.ndarray) -> pa.Array:
    """The lower-cased bytes of the given words."""
    starts, sizes = found.starts[rows], found.ends[rows] - found.starts[rows]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - starts, sizes)
    data = text_hash.fold(found.data[at])
    return pa.Array.from_buffers(
        pa.binary(), len(rows), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data.tobytes())])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words with their counts, combined before they leave the task."""
    waiting: list[pa.Table] = []
    rows = 0
    for batch in batches:
        texts = text_hash.filled(batch.column("text"))
        for start, end in text_hash.slices(texts, SLICE_BYTES):
            found = text_hash.words(texts.slice(start, end - start))
            train = batch.column("train").slice(start, end - start).to_numpy(zero_copy_only=False)
            hashes, first, at = np.unique(found.hashes, return_index=True, return_inverse=True)
            n = np.bincount(at, minlength=len(hashes))
            c = np.bincount(at, weights=train[found.docs], minlength=len(hashes))
            waiting.append(pa.table({
                "hash": hashes.view(np.int64), "word": _gather(found, first), "n": n, "c": c.astype(np.int64)}))
            rows += len(hashes)
        if rows > COMBINE_ROWS:
            done = _combine(waiting)
            if done.num_rows > COMBINE_ROWS // 2:
                yield from done.to_batches(10_000)
                waiting, rows = [], 0
            else:
                waiting, rows = [done], done.num_rows
    if waiting:
        yield from _combine(waiting).to_batches(10_000)


def _combine(tables: list[pa.Table]) -> pa.Table:
    whole = pa.concat_tables(tables).group_by(["hash", "word"]).aggregate([("n", "sum"), ("c", "sum")])
    return whole.rename_columns(["hash", "word", "n", "c"]).combine_chunks()


def _marginals(batches: Iterator[pa.RecordBatch], path: str, logs: np.ndarray) -> Iterator[pa.RecordBatch]:
    pieces = load_pieces(path)
    for batch in batches:
        scores = word_logs(batch.column("word").to_pylist(), pieces, logs) / np.log(10.0)
        yield pa.RecordBatch.from_arrays(
            [batch.column("hash"), batch.column("n"), batch.column("c"), pa.array(scores)],
            names=["hash", "n", "c", "marginal"])


class Model:
    """Distinct words with count, training count and marginal; the head also in memory."""

    def __init__(self, words: DataFrame, tokens: int, kinds: int, texts: int, end_log10: float, head_bin: int):
        self.words, self.tokens, self.kinds, self.texts = words, tokens, kinds, texts
        self.end_log10, self.head_bin = end_log10, head_bin

    def base(self, count: Column) -> Column:
        return F.log10((count + BASE_ADD) / F.lit(self.tokens + BASE_ADD * (self.kinds + 1)))


def _bin(n: Column) -> Column:
    """A rising, bounded number for any count."""
    return F.floor(F.log2(n.cast("double")) * 8).cast("int")


def fit(docs: DataFrame, train: Column, path: str, text_col: str = "text") -> Model:
    """Learn from all texts for which `train` is true; other texts only add words to score."""
    rows = docs.select(F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    counted = rows.mapInArrow(_word_counts, "hash long, word binary, n long, c long")
    vocabulary = shared_table(counted.groupBy("hash", "word").agg(
        F.sum("n").alias("n"), F.sum("c").alias("c")), "vocabulary")
    texts = rows.where("train").count()
    bins = vocabulary.groupBy(_bin(F.col("n")).alias("bin")).agg(
        F.count(F.lit(1)).alias("words"), F.sum("c").alias("c"), F.count_if(F.col("c") > 0).alias("kinds")).collect()
    tokens = sum(b["c"] for b in bins) + texts
    kinds = sum(b["kinds"] for b in bins) + (texts > 0)
    head_bin, room = 1 << 20, HEAD_WORDS
    for b in sorted(bins, key=lambda b: -b["bin"]):
        room -= b["words"]
        if room < 0:
            break
        head_bin = b["bin"]

    pieces = load_pieces(path)
    # Room for the end token: as likely, before any count, as one piece among all.
    logs, end = pieces.prior.copy(), -np.log(len(pieces.names))
    prior = np.exp(pieces.prior)
    train_words = vocabulary.where("c > 0").select("word", "c")
    for _ in range(ROUNDS):
        now = logs
        table = train_words.mapInArrow(lambda b: _expected(b, path, now), "piece int, n double").groupBy(
            "piece").agg(F.sum("n").alias("n")).toArrow()
        totals = np.zeros(len(prior))
        totals[table.column("piece").to_numpy()] = table.column("n").to_numpy()
        whole = totals.sum() + PRIOR_WEIGHT + texts + 1
        logs = np.log(totals + PRIOR_WEIGHT * prior) - np.log(whole)
        end = np.log(texts + 1) - np.log(whole)
    final = logs
    words = shared_table(vocabulary.mapInArrow(
        lambda b: _marginals(b, path, final), "hash long, n long, c long, marginal double"), "marginals")
    return Model(words, int(tokens), int(kinds), texts, float(end / np.log(10.0)), head_bin)


def _sum_rows(batches: Iterator[pa.RecordBatch], head) -> Iterator[pa.RecordBatch]:
    """For each text one row of sums over head words, and a row for each other distinct word."""
    keys, base, marginal, known = head.value
    start_row = TaskContext.get().partitionId() << 36
    for batch in batches:
        texts = text_hash.filled(batch.column("text"))
        for start, end in text_hash.slices(texts):
            n = end - start
            found = text_hash.words(texts.slice(start, n))
            hashes, at = np.unique(found.hashes, return_inverse=True)
            place = np.minimum(np.searchsorted(keys, hashes), max(len(keys) - 1, 0))
            hit = keys[place] == hashes if len(keys) else np.zeros(len(hashes), dtype=bool)
            values = [np.where(hit, v[place], 0.0)[at] if len(keys) else np.zeros(len(at))
                      for v in (base, marginal, known)]
            sums = [row_sums(found.docs, v, n) for v in values]
            row = start_row + np.arange(n)
            start_row += n
            ids = batch.column("id").slice(start, n)
            total = np.diff(found.first).astype(np.int64)
            # A text's own row has a key of its own, so that such rows spread over the join.
            yield pa.RecordBatch.from_arrays([
                pa.array(row), ids, pa.array(text_hash.mix(row.astype(np.uint64)).view(np.int64)),
                pa.array(np.zeros(n, dtype=np.int64)), pa.array(total), pa.array(sums[0]), pa.array(sums[1]),
                pa.array(sums[2].astype(np.int64))], names=_SUMS)
            rest = np.flatnonzero(~hit[at])
            cells, times = np.unique(found.docs[rest] * max(len(hashes), 1) + at[rest], return_counts=True)
            doc, word = cells // max(len(hashes), 1), cells % max(len(hashes), 1)
            for k in range(0, len(cells), 50_000):
                d, w = doc[k:k + 50_000], word[k:k + 50_000]
                zero = pa.array(np.zeros(len(d)))
                none = pa.array(np.zeros(len(d), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([
                    pa.array(row[d]), ids.take(pa.array(d)), pa.array(hashes[w].view(np.int64)),
                    pa.array(times[k:k + 50_000].astype(np.int64)), none, zero, zero, none], names=_SUMS)


_SUMS = ["row", "id", "hash", "times", "words", "base", "marginal", "known"]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: id, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words and one end; a null or empty text has only the end.
    Null ids and repeated rows keep their rows; other columns are ignored; an
    empty table gives no rows. Common words (at most HEAD_WORDS) are looked up
    in memory, all others by a join.
    """
    spark = docs.sparkSession
    head = model.words.where(_bin(F.col("n")) >= model.head_bin).select(
        "hash", model.base(F.col("c")).alias("base"), "marginal", (F.col("c") > 0).cast("double").alias("known"))
    table = head.toArrow()
    keys = table.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast(
        (keys[order], *[table.column(c).to_numpy()[order] for c in ("base", "marginal", "known")]))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sums = rows.mapInArrow(
        lambda b: _sum_rows(b, shared),
        "row long, id long, hash long, times long, words long, base double, marginal double, known long")
    tail = model.words.where(_bin(F.col("n")) < model.head_bin).select(
        "hash", model.base(F.col("c")).alias("word_base"), F.col("marginal").alias("word_marginal"),
        (F.col("c") > 0).cast("long").alias("word_known"))
    joined = sums.join(tail, "hash", "left")

    def part(own: str, word: str) -> Column:
        return F.sum(F.col(own) + F.when(F.col("times") > 0, F.col("times") * F.col(word)).otherwise(F.lit(0)))

    end_base = float(np.log10((model.texts + BASE_ADD) / (model.tokens + BASE_ADD * (model.kinds + 1))))
    return joined.groupBy("row", "id").agg(
        F.sum("words").alias("words"), part("known", "word_known").alias("known"),
        part("base", "word_base").alias("base"), part("marginal", "word_marginal").alias("marginal")
    ).select(
        F.col("id").alias("doc_id"), (F.col("words") + 1).alias("n_tokens"),
        (F.col("known") + (1 if model.texts else 0)).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.lit(end_base)).alias("base_score"),
        (F.col("marginal") + F.lit(model.end_log10)).alias("score"))
