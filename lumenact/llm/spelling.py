"""Spelling variants: words one edit apart, found with FM indexes of both directions.

A word and its variant share one half exactly: the one inserted, deleted or
replaced code point lies in the other half. So two searches suffice: match the
right half and go on leftwards with one error allowed, or match the left half
and go on rightwards. The second is the first on reversed words, which is all
that the reverse direction of the index is needed for.

Words are dealt by (direction, length searched for, exact half): only words
that share the half can be near, and each task indexes its share of the
vocabulary, joined by delimiters, as a sorted list of (symbol, row) of the
Burrows-Wheeler transform. One binary search in it is one step of a suffix-rank
interval. As the words are sorted and the delimiter is the smallest symbol, an
interval that ends in a delimiter is the rank of a word.

Rows are read from columns `doc_id` and `text` by name; other columns play no
part. Null texts have no words, a null id counts as the empty text. Repeated
rows count each time. Without words the result is empty.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import shared_table

#: Letters of a word after A-Z are lowered.
LETTERS = "a-zÀ-ÿ"
SHARD_SYMBOLS = 400_000
_HELD_WORDS = 200_000
_QUERY_BLOCK = 8_192
_WIDE = 64


def _misspelt(run: str, id_sum: int, one_in: int) -> str:
    """The run, or for one of `one_in` occurrences of an id and a run, the run less one code point."""
    drawn = zlib.crc32(run.encode(), id_sum)
    if drawn % one_in:
        return run
    at = drawn % len(run)
    return run[:at] + run[at + 1:]


def word_counts(
    docs: DataFrame, min_length: int = 5, min_count: int = 3, misspell: int | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(word, n): runs of letters of at least `min_length` code points that occur `min_count` times and more.

    With `misspell`, one code point is deleted where that number divides the
    checksum of `<id>:<run>`: variants whose origin is known.
    """
    find = re.compile(f"[{LETTERS}]{{{min_length},}}").findall  # runs too short before the deletion stay too short

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            texts = pc.ascii_lower(batch.column("text"))
            for name, text in zip(batch.column("id"), texts, strict=True):
                if not text.is_valid:
                    continue
                runs = Counter(find(text.as_py()))
                if misspell is None:
                    held.update(runs)
                else:
                    id_sum = zlib.crc32(f"{name.as_py()}:".encode())
                    for run, n in runs.items():
                        held[_misspelt(run, id_sum, misspell)] += n
                if len(held) > _HELD_WORDS:
                    yield _counted(held)
                    held.clear()
        yield _counted(held)

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    return (
        rows.mapInArrow(count, "word string, n long").where(F.length("word") >= min_length)
        .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count))


def _counted(held: Counter[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Start of each suffix in sorted order, by doubling the length that ranks cover."""
    n = len(text)
    rank = text.astype(np.int64)
    width = 1
    while True:
        after = np.zeros(n, dtype=np.int64)  # past the end: smaller than any rank
        after[:n - width] = rank[width:] + 1
        key = rank * (int(after.max()) + 1) + after
        order = np.argsort(key, kind="stable")
        steps = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = steps
        if steps[-1] == n - 1:
            return order
        width = min(2 * width, n - 1)


class FMIndex:
    """Words joined by delimiters, searched from their last symbol to their first."""

    def __init__(self, words: list[str]):
        self.words = sorted(words)
        points = np.frombuffer("\n".join(["", *self.words, ""]).encode("utf-32-le"), dtype=np.uint32)
        text = np.where(points == 10, 0, points)  # the delimiter comes before every letter
        self.alphabet, symbols = np.unique(text, return_inverse=True)
        self.size = len(symbols)
        self.transform = symbols[suffix_order(symbols) - 1]
        #: (symbol, row) of the transform, sorted: the place of (c, i) is C[c] + occurrences of c before row i.
        self.steps = np.sort(self.transform * self.size + np.arange(self.size))

    def encode(self, word: str) -> np.ndarray:
        """Symbols of a word; -1 for code points that occur in no indexed word."""
        points = np.frombuffer(word.encode("utf-32-le"), dtype=np.uint32)
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at, -1)

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the symbol put before what each interval stands for; empty for symbol -1."""
        base = symbols * self.size
        low, high = np.searchsorted(self.steps, base + low), np.searchsorted(self.steps, base + high)
        return low, np.where(symbols < 0, low, high)

    def others(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interval, symbol) for the letters that may precede each interval."""
        wide = np.flatnonzero(high - low > _WIDE)
        slim = np.flatnonzero(high - low <= _WIDE)
        sizes = (high - low)[slim]
        which = np.repeat(slim, sizes)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[which]
        letters = len(self.alphabet)
        pairs = np.unique(which * letters + self.transform[rows])
        pairs = np.concatenate([pairs, (wide[:, None] * letters + np.arange(letters)).ravel()])
        which, symbol = np.divmod(pairs, letters)
        return which[symbol > 0], symbol[symbol > 0]

    def one_error(self, words: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, rank of an indexed word) where the last `exact[word]` symbols are equal and,
        before them, one symbol is replaced or the indexed word has one more."""
        lengths = np.array([len(word) for word in words], dtype=np.int64)
        flat = np.concatenate([self.encode(word) for word in words])
        starts = np.cumsum(lengths) - lengths

        # Open searches: the word, how many of its symbols are left, its interval, whether the error is made.
        word = np.arange(len(words))
        left, low, high = lengths.copy(), np.zeros(len(words), np.int64), np.full(len(words), self.size, np.int64)
        low, high = self.extend(np.zeros(len(words), np.int64), low, high)
        erred = np.zeros(len(words), dtype=bool)
        found = []
        while len(word):
            following = np.where(left > 0, flat[starts[word] + np.maximum(left, 1) - 1], 0)
            new = self._errors(word, left, low, high, following, ~erred & (lengths[word] - left >= exact[word]))
            ended = left == 0
            low, high = self.extend(following, low, high)
            hit = ended & erred & (low < high)
            found.append((word[hit], low[hit] - 1))
            go = ~ended & (low < high)
            word, left, low, high, erred = (
                np.concatenate([old[go], made]) for old, made in zip(
                    (word, left - 1, low, high, erred), (*new, np.ones(len(new[0]), dtype=bool)), strict=True))
        return tuple(np.concatenate(part) for part in zip(*found, strict=True))

    def _errors(self, word, left, low, high, following, may) -> list[np.ndarray]:
        """The searches that make their error here: another letter in place of the following one, or before it.

        One more of the same letter is left to the place behind the run of that letter.
        """
        rows = np.flatnonzero(may)
        which, symbol = self.others(low[rows], high[rows])
        which = rows[which]
        other = symbol != following[which]
        which, symbol = which[other], symbol[other]
        at_low, at_high = self.extend(symbol, low[which], high[which])
        replaced = left[which] > 0
        return [np.concatenate([values[replaced], values]) for values in (word[which],)] + [
            np.concatenate([left[which][replaced] - 1, left[which]]),
            np.concatenate([at_low[replaced], at_low]), np.concatenate([at_high[replaced], at_high])]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition sorted by shard, the words to index first: pairs of near words."""
    shard, held, index, n_of = None, {}, None, None
    for batch in batches:
        shards = batch.column("shard").to_numpy()
        roles = batch.column("exact").to_numpy()
        cuts = np.flatnonzero(np.diff(shards)) + 1
        for start, end in zip([0, *cuts], [*cuts, len(shards)], strict=True):
            if shards[start] != shard:
                shard, held, index = shards[start], {}, None
            middle = start + int(np.count_nonzero(roles[start:end] < 0))
            if middle > start:
                part = batch.slice(start, middle - start)
                held.update(zip(part.column("word").to_pylist(), part.column("n").to_pylist(), strict=True))
            for at in range(middle, end if held else middle, _QUERY_BLOCK):
                if index is None:
                    index = FMIndex(list(held))
                    n_of = np.array([held[word] for word in index.words], dtype=np.int64)
                part = batch.slice(at, min(_QUERY_BLOCK, end - at))
                words = part.column("word").to_pylist()
                one, other = index.one_error(words, part.column("exact").to_numpy())
                yield pa.record_batch([
                    pa.array([words[i] for i in one], pa.string()), part.column("n").take(pa.array(one)),
                    pa.array([index.words[i] for i in other], pa.string()), pa.array(n_of[other]),
                    part.column("reversed").take(pa.array(one))], ["word", "n", "near", "near_n", "reversed"])


def _half(length: Column) -> Column:
    return F.floor(length / 2).cast("int")


def _dealt(words: DataFrame, longer: list[int], role: str) -> DataFrame:
    """One row for each direction and each length searched for: the reversed words' exact half is the left one.

    `longer` is by how many code points the word may be longer than the one searched for.
    """
    ways = F.array(*[
        F.struct(F.lit(back).alias("reversed"), F.lit(d).alias("d")) for back in (False, True) for d in longer])
    rows = words.withColumn("_way", F.explode(ways)).withColumn("_l", F.length("word") - F.col("_way.d"))
    exact = F.when(F.col("_way.reversed"), _half(F.col("_l"))).otherwise(F.col("_l") - _half(F.col("_l")))
    turned = F.when(F.col("_way.reversed"), F.reverse("word")).otherwise(F.col("word"))
    rows = rows.select(
        turned.alias("word"), "n", F.col("_way.reversed").alias("reversed"), "_l", exact.alias("exact"))
    key = F.xxhash64("reversed", "_l", F.expr("right(word, exact)"))
    return rows.select("word", "n", "reversed", key.alias("key"), (
        F.lit(-1) if role == "index" else F.col("exact")).cast("int").alias("exact"))


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): every word with every other one that is one code point away, both ways round.

    `words` has distinct `word`s and their counts `n`. A half that many words
    share is cut into blocks: each block of its words is indexed once for each
    block of the words that are searched. At most two in a shard's size of
    symbols are such halves, so their list is broadcast.
    """
    spark = words.sparkSession
    symbols = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    shards = int(2 * symbols // SHARD_SYMBOLS) + 1  # of each direction; a word is indexed for two lengths
    index, search = _dealt(words, [0, 1], "index"), _dealt(words, [0], "search")
    large = index.groupBy("key").agg(F.sum(F.length("word") + 1).alias("s")).where(F.col("s") > SHARD_SYMBOLS // 2)
    large = shared_table(
        large.select("key", F.ceil(F.col("s") / (SHARD_SYMBOLS // 2)).cast("int").alias("blocks")), "halves")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)

    def blocked(rows: DataFrame, own: str, other: str) -> DataFrame:
        rows = rows.join(F.broadcast(large), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        rows = rows.withColumn(own, F.pmod(F.xxhash64("word", F.lit(5)), F.col("blocks")).cast("int"))
        return rows.withColumn(other, F.explode(every)).select(
            (2 * F.pmod(F.xxhash64("key", "_i", "_s"), F.lit(shards)) + F.col("reversed").cast("int")).cast("int")
            .alias("shard"), "exact", "word", "n", "reversed")

    rows = blocked(index, "_i", "_s").unionByName(blocked(search, "_s", "_i"))
    found = rows.repartition(2 * shards, "shard").sortWithinPartitions("shard", F.col("exact") >= 0).mapInArrow(
        _search, "word string, n long, near string, near_n long, reversed boolean")
    turn = [F.when(F.col("reversed"), F.reverse(c)).otherwise(F.col(c)).alias(c) for c in ("word", "near")]
    found = found.select(*turn, "n", "near_n").where(
        (F.length("word") < F.length("near")) | (F.col("word") < F.col("near"))).distinct()
    return found.select(F.inline(F.array(
        F.struct("word", "near", "near_n"),
        F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))))


def variant_groups(words: DataFrame, dominance: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of `words` (word, n).

    A word's form is its commonest near word (the smallest of equals) if that
    is at least `dominance` (2 or more) times as common; following forms to
    the last gives the root. Counts grow along the way, so no path is a circle
    and its length is at most the logarithm of the largest count.
    """
    if dominance < 2:
        raise ValueError("dominance must be 2 or more")
    words = shared_table(words.select("word", "n"), "words")
    best = near_words(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    common = -F.col("best.less") >= dominance * F.col("n")
    rows = shared_table(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(common, F.col("best.near")).alias("form"), F.when(common, -F.col("best.less")).alias("form_n")),
        "forms")
    roots = rows.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    moved = 1
    while moved:
        roots = shared_table(roots, "roots")
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        ahead = roots.join(onward, "root", "left")
        moved = ahead.where(F.col("_next").isNotNull()).limit(1).count()
        if moved:
            roots = ahead.select("word", F.coalesce("_next", "root").alias("root"))
    return rows.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
