"""Words and shingles of whole Arrow batches as 64-bit hashes, without a Python loop over words.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D, with A-Z lowered;
no byte of a longer UTF-8 character falls into those ranges. A word's hash is a
polynomial over its bytes, taken from prefix sums modulo 2^64, so the cost is
a few vector operations a byte whatever the words look like.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
#: For workers that stay small: hashing takes some 50 bytes of working memory a byte of text.
SMALL_SLICE_BYTES = 1 << 18
_U = np.uint64
_GOLDEN = 0x9E3779B97F4A7C15
_BASE = 0x5851F42D4C957F2D
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + _U(seed * 0x1000003 & _MASK)) * _U(_GOLDEN))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20


def fold(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lowered."""
    return _FOLD[data]


_VALUE = stream(11, 256)
_VALUE_FOLDED = _VALUE[_FOLD]
_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) <= n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n + 1, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


@dataclass
class Words:
    """Words of several documents: hash, byte span, and the document of each."""

    data: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    docs: np.ndarray
    first: np.ndarray  # first word of each document, one more entry than documents
    sums: np.ndarray  # prefix sums of the bytes' terms

    def prefixes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, hash) of the first `size` bytes of each longer word."""
        rows = np.flatnonzero(self.ends - self.starts > size)
        starts = self.starts[rows]
        down = _power_tables(len(self.data))[1]
        return self.docs[rows], mix((self.sums[starts + size] - self.sums[starts]) * down[starts] + _U(size))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; one text is never cut."""
    offsets = _offsets(texts)
    start = 0
    while start < len(texts):
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), len(texts))
        yield start, end
        start = end


def _offsets(texts: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    return np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)


def filled(texts: pa.Array) -> pa.Array:
    """Null texts as empty ones."""
    if texts.null_count:
        texts = texts.fill_null("")
    return texts


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of consecutive texts, and where each begins (and the end)."""
    offsets = _offsets(texts)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


#: Everything but letters, digits and bytes of longer characters.
PUNCTUATED = np.ones(256, dtype=bool)
PUNCTUATED[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def words(texts: pa.Array, fold: bool = True, between: np.ndarray = _SPACE) -> Words:
    """All words of a slice of texts (no nulls); `between` marks the bytes outside words."""
    data, offsets = text_bytes(texts)
    n = len(data)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return Words(data, none.astype(np.uint64), none, none, none, np.zeros(len(texts) + 1, dtype=np.int64),
                     np.zeros(1, dtype=np.uint64))
    inside = ~between[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:n]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    up, down = _power_tables(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((_VALUE_FOLDED if fold else _VALUE)[data] * up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    first = np.searchsorted(starts, offsets)
    docs = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(data, hashes, starts, ends, docs, first, sums)


_PLACES = stream(23, 64) | _U(1)


def ngram_hashes(found: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word sequences and, for each, its document."""
    count = len(found.hashes) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    total = found.hashes[:count] * _PLACES[0]
    for k in range(1, n):
        total += found.hashes[k:k + count] * _PLACES[k]
    whole = found.docs[:count] == found.docs[n - 1:]
    return mix(total[whole] + _U(n)), found.docs[:count][whole]


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct `size`-word shingles of each text.

    A text with fewer words has its whole word sequence as one shingle; a text
    without words has none.
    """
    found = words(texts)
    hashes, docs = ngram_hashes(found, size)
    bounds = np.searchsorted(docs, np.arange(len(texts) + 1))
    sets = []
    for d in range(len(texts)):
        if bounds[d + 1] > bounds[d]:
            sets.append(np.unique(hashes[bounds[d]:bounds[d + 1]]))
            continue
        own = found.hashes[found.first[d]:found.first[d + 1]]
        if len(own):
            own = mix((own * _PLACES[:len(own)]).sum(dtype=np.uint64, keepdims=True) + _U(len(own)))
        sets.append(own)
    return sets
