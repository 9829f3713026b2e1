"""Byte-level BPE by a rank queue over a hierarchical bitmap.

All new pre-tokens of a batch form one linked list of byte tokens. Every pair
of neighbours whose join is in the vocabulary waits in the bucket of its merge
rank. A two-level bitmap of non-empty buckets gives the next rank by
find-first-set; entries that earlier merges made stale are skipped. Each merge
costs a constant number of steps, whatever the length of the pre-token, and
pre-tokens never touch, so their order in the queue does not matter. Within
one pre-token the lowest rank goes first and the leftmost of equal ranks.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import per_process

CACHE_ENTRIES = 250_000
_WORD_BITS = 8
_NONE = -1


class RankQueue:
    """Buckets of positions by rank, and the bitmap of those that hold any."""

    def __init__(self, ranks: int):
        self.words = [0] * ((ranks >> _WORD_BITS) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def add(self, rank: int, positions: list[int]) -> None:
        self.buckets[rank] = positions
        word = rank >> _WORD_BITS
        self.words[word] |= 1 << (rank & 255)
        self.top |= 1 << word

    def pop_lowest(self) -> tuple[int, list[int]]:
        word = (self.top & -self.top).bit_length() - 1
        bits = self.words[word]
        low = bits & -bits
        self.words[word] = bits ^ low
        if bits == low:
            self.top ^= 1 << word
        rank = word << _WORD_BITS | low.bit_length() - 1
        return rank, self.buckets.pop(rank)


class Encoder:
    """A vocabulary of byte strings by rank, and the pattern that splits texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern)
        self.size = max(ranks.values()) + 1
        self.pairs = {
            ranks[piece[:k]] * self.size + ranks[piece[k:]]: rank
            for piece, rank in ranks.items() for k in range(1, len(piece))
            if piece[:k] in ranks and piece[k:] in ranks}
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)])
        self.byte_pairs = np.array([
            [self.pairs.get(int(a) * self.size + int(b), _NONE) for b in self.bytes] for a in self.bytes])
        self.known: dict[str, bytes] = {}

    def learn(self, tokens: Iterable[str]) -> None:
        """Encode pre-tokens that are not yet known; the memory is bounded."""
        fresh, unknown = [], []
        for token in tokens:
            raw = token.encode("utf-8", "surrogatepass")
            rank = self.ranks.get(raw)
            if rank is not None:
                self.known[token] = rank.to_bytes(4, "little")
            else:
                fresh.append(raw)
                unknown.append(token)
        for token, ids in zip(unknown, self._merge_all(fresh), strict=True):
            self.known[token] = ids

    def _merge_all(self, raws: list[bytes]) -> list[bytes]:
        """Ids (little-endian 32-bit) of every pre-token."""
        if not raws:
            return []
        data = np.frombuffer(b"".join(raws), dtype=np.uint8)
        ends = np.cumsum([len(r) for r in raws])
        starts = np.concatenate([[0], ends[:-1]])
        n = len(data)
        tokens = self.bytes[data].tolist()
        after = np.arange(1, n + 1)
        after[ends - 1] = _NONE
        before = np.arange(-1, n - 1)
        before[starts] = _NONE
        first = np.full(n, _NONE)
        first[:-1] = self.byte_pairs[data[:-1], data[1:]]
        first[ends - 1] = _NONE
        queue = RankQueue(self.size)
        order = np.argsort(first, kind="stable")
        order = order[np.searchsorted(first[order], 0):]
        cuts = np.flatnonzero(np.diff(first[order])) + 1
        if len(order):
            for positions in np.split(order, cuts):
                queue.add(int(first[positions[0]]), positions.tolist())
        self._drain(queue, tokens, after.tolist(), before.tolist(), first.tolist())
        left = np.array(tokens, dtype=np.int64)
        kept = left >= 0
        ids = left[kept].astype("<u4").tobytes()
        counts = np.concatenate([[0], np.cumsum(kept)])
        return [ids[4 * a:4 * b] for a, b in zip(counts[starts].tolist(), counts[ends].tolist(), strict=True)]

    def _drain(self, queue: RankQueue, tokens: list[int], after: list[int], before: list[int], pair: list[int]) -> None:
        """Merge until no pair is left; a swallowed position's token becomes -1."""
        pairs, size, buckets = self.pairs.get, self.size, queue.buckets
        while queue.top:
            rank, waiting = queue.pop_lowest()
            waiting.sort()
            for at, i in enumerate(waiting):
                if pair[i] != rank:
                    continue  # stale
                j = after[i]
                k = after[j]
                tokens[i] = rank
                tokens[j] = pair[j] = pair[i] = _NONE
                after[i] = k
                lower = False
                if k >= 0:
                    before[k] = i
                    found = pairs(rank * size + tokens[k])
                    if found is not None:
                        pair[i] = found
                        if found in buckets:
                            buckets[found].append(i)
                        else:
                            queue.add(found, [i])
                        lower = found < rank
                h = before[i]
                if h >= 0:
                    found = pairs(tokens[h] * size + rank)
                    if found is None:
                        pair[h] = _NONE
                    else:
                        pair[h] = found
                        if found in buckets:
                            buckets[found].append(h)
                        else:
                            queue.add(found, [h])
                        lower = lower or found < rank
                if lower and at + 1 < len(waiting):
                    # A better pair appeared: the rest of this bucket waits its turn.
                    queue.add(rank, waiting[at + 1:])
                    break

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        split = [self.split.findall(text) for text in texts]
        new = set().union(*split).difference(self.known)
        if len(self.known) + len(new) > CACHE_ENTRIES:
            self.known.clear()
            new = set().union(*split)
        self.learn(new)
        known = self.known
        return [b"".join([known[token] for token in tokens]) for tokens in split]


class Decoder:
    """The vocabulary's byte strings by id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece

    def decode(self, ids: bytes) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


def parse_ranks(content: bytes) -> dict[bytes, int]:
    """The vocabulary of a rank file: a base64 string and its rank in each line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file that is part of the installation of every node."""
    with open(path, "rb") as file:
        return parse_ranks(file.read())


def load(path: str, pattern: str) -> Encoder:
    """One encoder per worker process."""
    return per_process(("bpe", path, pattern), lambda: Encoder(read_ranks(path), pattern))


def load_decoder(path: str) -> Decoder:
    return per_process(("bpe decoder", path), lambda: Decoder(read_ranks(path)))


CHARS_AT_ONCE = 1 << 20


def _encode(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    encoder = load(path, pattern)
    for batch in batches:
        texts, names = batch.column("text"), batch.column("id")
        start, size = 0, 0
        part: list[str] = []
        for k, value in enumerate(texts):
            part.append(value.as_py() or "")
            size += len(part[-1])
            if size >= CHARS_AT_ONCE or k + 1 == len(texts):
                ids = encoder.encode_all(part)
                yield pa.RecordBatch.from_arrays(
                    [names.slice(start, len(part)), pa.array(ids, pa.binary())], names=["id", "ids"])
                start, size, part = k + 1, 0, []


def _digest(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    decoder = load_decoder(path)
    for batch in batches:
        ids = batch.column("ids").to_pylist()
        yield pa.RecordBatch.from_arrays([
            batch.column("id"), pa.array([len(x) // 4 for x in ids], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
            pa.array([hashlib.sha256(decoder.decode(x)).hexdigest() for x in ids], pa.string()),
        ], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, ids): each text's token ids as little-endian unsigned 32-bit integers.

    `path` names a rank file installed on every node. A null text counts as
    empty and gives no ids; a null id is kept; repeated rows are encoded each.
    Other columns are ignored. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda b: _encode(b, path, pattern), "id long, ids binary")


def round_trip_digests(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode, decode the ids again, and digest both, in one worker; same cases as `encode`."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(
        lambda b: _digest(_encode(b, path, pattern), path),
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
