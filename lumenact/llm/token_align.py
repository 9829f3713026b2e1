"""Alignment of two tokenizers' tokens by the bytes they cover.

Both encode the same bytes, so a place where a token of each ends cuts the text
into groups, and the two tokens that end there are linked. All of it is Arrow
work on flat token lists: list_flatten and parent indices, cumulative sums that
start anew with each text, a hash join of (text, end) keys, and Table.group_by
for the counts of linked id pairs, which Spark adds up over the corpus.

Texts are encoded once. A chunk is some megabytes of texts (a longer text is a
chunk of its own): its rows with their links, and the counts of its distinct
id pairs, go to a table in the shared folder. The pairs' corpus-wide counts
come back to the chunk by joins, so neither texts nor ids are shuffled one by
one; a frequent pair is one row a chunk.

Null and empty texts, and those whose joined tokens do not give the text back,
have zeros and empty groups. Each row counts, repeated ones too; a null id is
an id. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .tables import per_process, shared_table
from .text_hash import filled, slices, text_bytes

CHUNK_BYTES = 8 << 20
ENCODE_BYTES = 1 << 20
ALIGN_BYTES = 1 << 19
CACHE_UNITS = 300_000
CACHE_BYTES = 2 << 20
_LONGEST_CACHED = 64
_SPACE = "▁"
#: A place no token covers, in a vocabulary without such a piece: a space after a visible character.
#: One that ends the text stays with its word, as nothing is not encoded as a space.
_CUT = re.compile("(?<=[!-~À-ÿ])(?= .)", re.DOTALL)
_COVERED = re.compile("[!-~À-ÿ] ")
_JOINABLE = re.compile("(?! ).*[!-~À-ÿ]", re.DOTALL)
_JOINED_UNITS = 256
#: Texts with other spaces than between visible characters and what follows are cut by the pattern above.
_ODD_SPACE = "^ |[^!-~À-ÿ] | $"


def byte_letters() -> dict[str, int]:
    """The letters byte-level vocabularies write bytes with: printable ones stand for themselves,
    the others, in order, for the letters from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """A byte-level vocabulary of the `tokenizers` library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            names = json.load(file)["model"]["vocab"]
        letters = byte_letters()
        pieces = [b""] * (max(names.values()) + 1)
        for name, number in names.items():
            pieces[number] = bytes(map(letters.get, name)) if all(c in letters for c in name) else name.encode()
        self.pieces = pa.array(pieces, pa.large_binary())
        self.lengths = np.array([len(piece) for piece in pieces])

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of a space and each text."""
        return [e.ids for e in self.model.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]


class Pieces:
    """A vocabulary of the `sentencepiece` library, which puts the space before the text itself."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = []
        for number in range(self.model.get_piece_size()):
            name = self.model.id_to_piece(number)
            pieces.append(bytes([int(name[3:5], 16)]) if self.model.is_byte(number)
                          else name.replace(_SPACE, " ").encode())
        self.pieces = pa.array(pieces, pa.large_binary())
        self.lengths = np.array([len(piece) for piece in pieces])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@dataclass
class Tokens:
    """Flat tokens of several texts: id, text, and end in bytes counted from the text's start."""

    ids: pa.Array
    text: pa.Array
    end: pa.Array
    offsets: np.ndarray  # first token of each text, and the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


def _lists(lists: list[list[int]]) -> pa.ListArray:
    flat = np.fromiter(chain.from_iterable(lists), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), pa.array(flat))


def unit_ids(side: ByteLevel | Pieces, units: list[str]) -> pa.ListArray:
    """Ids of a space and each unit; many units are encoded as one text and cut apart again."""
    lengths = np.array([len(unit.encode()) + 1 for unit in units], dtype=np.int64)
    joinable = np.array([_JOINABLE.fullmatch(unit) is not None for unit in units], dtype=bool)
    one = np.flatnonzero(joinable)
    groups = [one[at:at + _JOINED_UNITS] for at in range(0, len(one), _JOINED_UNITS)]
    sizes, flat, order = [], [], []
    alone = [np.flatnonzero(~joinable)]
    for group, ids in zip(groups, side.encode([" ".join([units[i] for i in g]) for g in groups]), strict=True):
        ids = np.array(ids, dtype=np.int32)
        ends = np.cumsum(side.lengths[ids])
        wanted = np.cumsum(lengths[group])
        at = np.searchsorted(ends, wanted)
        if len(ids) and at[-1] == len(ids) - 1 and (ends[at] == wanted).all():
            order.append(group)
            sizes.append(np.diff(at, prepend=-1))
            flat.append(ids)
        else:
            alone.append(group)  # its tokens do not give the text back
    rest = np.concatenate(alone)
    lists = side.encode([units[i] for i in rest])
    order = np.concatenate([*order, rest])
    sizes = np.concatenate([*sizes, np.array([len(x) for x in lists], dtype=np.int64)])
    flat = np.concatenate([*flat, np.fromiter(chain.from_iterable(lists), dtype=np.int32)])
    found = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, pa.int32()))
    return found.take(pa.array(np.argsort(order)))


def tokens_of(nested: pa.ListArray, pieces: pa.Array, texts: list[bytes]) -> tuple[Tokens, np.ndarray]:
    """The flat tokens of a list of ids for each text, and which texts their joined bytes give back."""
    ids, text = pc.list_flatten(nested), pc.list_parent_indices(nested)
    joined = pieces.take(ids)
    ends = pc.cumulative_sum(pc.cast(pc.binary_length(joined), pa.int64()))
    offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(nested).to_numpy())])
    bounds = np.concatenate([[0], ends.to_numpy()])[offsets]
    data = joined.buffers()[2]
    data = memoryview(data).cast("B") if data is not None else memoryview(b"")
    same = np.array([data[a:b] == whole for a, b, whole in zip(bounds[:-1], bounds[1:], texts, strict=True)], dtype=bool)
    own = pc.subtract(ends, pa.array(bounds[:-1]).take(text))
    return Tokens(ids, text, own, offsets), same


def _links(a: Tokens, b: Tokens) -> pa.Table:
    """(text, end, a_at, b_at, a, b): tokens of both that end together, in order."""
    sides = [pa.table({"text": t.text, "end": t.end, f"{name}_at": pa.array(np.arange(len(t.ids))), name: t.ids})
             for name, t in (("a", a), ("b", b))]
    joined = sides[0].join(sides[1], keys=["text", "end"], join_type="inner", use_threads=False)
    return joined.sort_by([("a_at", "ascending"), ("b_at", "ascending")]).combine_chunks()


def _group_digests(a: Tokens, b: Tokens, links: pa.Table, names: tuple[pa.Array, pa.Array], n: int):
    """Number of groups of each text, and the digest of its groups as `a1,a2|b1;a3|b2,b3`."""
    ends = links.group_by(["text", "end"], use_threads=False).aggregate([("a_at", "max"), ("b_at", "max")]).sort_by(
        "a_at_max")
    sides = []
    for tokens, name, column in ((a, names[0], "a_at_max"), (b, names[1], "b_at_max")):
        cuts = np.concatenate([[0], ends[column].to_numpy() + 1])
        lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), name.take(tokens.ids))
        sides.append(pc.binary_join(lists, ","))
    groups = pc.binary_join_element_wise(*sides, "|")
    counts = np.bincount(ends["text"].to_numpy(), minlength=n)
    cuts = np.concatenate([[0], np.cumsum(counts)])
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), groups), ";")
    return counts, [hashlib.sha256(w.as_buffer()).hexdigest() if k else "" for w, k in zip(whole, counts, strict=True)]


class Aligner:
    """Both tokenizers, and the work on the texts of one task.

    Texts are cut into units before every space that follows a visible
    character, where no piece of either vocabulary goes on, and the ids of
    units met before are kept, at most CACHE_UNITS: words repeat.
    """

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.names = tuple(pa.array(map(str, range(len(t.pieces))), pa.string()) for t in (self.a, self.b))
        self.width = len(self.b.pieces)
        names = (p.as_py().decode("utf-8", "replace") for side in (self.a, self.b) for p in side.pieces)
        self.cuts = not any(_COVERED.search(name) for name in names)
        self.known = pa.array([], pa.large_string())
        self.ids = [_lists([]), _lists([])]

    def units(self, texts: list[str]) -> pa.ListArray:
        """The units of each text, without the space each begins with."""
        if not self.cuts:
            return pa.array([[text] for text in texts], pa.list_(pa.large_string()))
        whole = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(whole, _ODD_SPACE)
        plain = pc.split_pattern(whole.filter(pc.invert(odd)), " ").cast(pa.list_(pa.large_string()))
        rest = [[unit[1:] for unit in _CUT.split(f" {text}")] for text in whole.filter(odd).to_pylist()]
        both = pa.concat_arrays([plain, pa.array(rest, pa.list_(pa.large_string()))])
        odd = odd.to_numpy(zero_copy_only=False)
        return both.take(pa.array(np.where(odd, len(plain) + np.cumsum(odd) - 1, np.cumsum(~odd) - 1)))

    def encode(self, texts: list[str]) -> list[pa.ListArray]:
        """Ids of a space and each text, of both tokenizers."""
        units = self.units(texts)
        coded = units.flatten().dictionary_encode()
        place = pc.index_in(coded.dictionary, value_set=self.known)
        new = coded.dictionary.filter(pc.is_null(place))
        place = place.to_numpy(zero_copy_only=False)
        missing = np.isnan(place) if place.dtype.kind == "f" else np.zeros(len(place), dtype=bool)
        place = np.where(missing, len(self.known) + np.cumsum(missing) - 1, place).astype(np.int64)
        which = pa.array(place[coded.indices.to_numpy()])
        cuts = pa.array(np.concatenate([[0], np.cumsum(units.value_lengths().to_numpy())]))
        bare, out = new.to_pylist(), []
        for k, side in enumerate((self.a, self.b)):
            self.ids[k] = pa.concat_arrays([self.ids[k], unit_ids(side, bare)])
            lists = self.ids[k].take(which)
            out.append(pa.ListArray.from_arrays(lists.offsets.take(cuts), lists.values))
        self.known = pa.concat_arrays([self.known, new])
        if len(self.known) > CACHE_UNITS or new.nbytes > CACHE_BYTES:
            # The newer half stays, without long units.
            half = np.arange(len(self.known))[-CACHE_UNITS // 2:]
            half = pa.array(half[pc.utf8_length(self.known.take(pa.array(half))).to_numpy() <= _LONGEST_CACHED])
            self.known, self.ids = self.known.take(half), [ids.take(half) for ids in self.ids]
        return out

    def rows(self, texts: list[str]) -> tuple[list[tuple], pa.Table]:
        """(n_a, n_b, n_groups, n_links, groups_sha256, links) of each text, and (pair, n) of all.

        A pair is one number, `a * width + b`; a text's links are its pairs in order.
        """
        out = [(0, 0, 0, 0, "", b"")] * len(texts)
        rows = [i for i, t in enumerate(texts) if t]
        raws = [f" {texts[i]}".encode() for i in rows]
        lists = self.encode([texts[i] for i in rows])
        counted = [pa.table({"pair": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})]
        begin = np.cumsum([0, *map(len, raws)]) // ALIGN_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(begin[:-1])) + 1).tolist(), len(rows)]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            done, pairs = self._aligned([ids.slice(start, end - start) for ids in lists], raws[start:end])
            for i, row in done:
                out[rows[start + i]] = row
            counted += pairs
        return out, _merged(counted)

    def _aligned(self, lists: list[pa.ListArray], raws: list[bytes]) -> tuple[list[tuple[int, tuple]], list[pa.Table]]:
        """The rows of texts that both tokenizers give back, and their counted pairs."""
        (a, a_same), (b, b_same) = (
            tokens_of(ids, side.pieces, raws) for side, ids in zip((self.a, self.b), lists, strict=True))
        whole = np.flatnonzero(a_same & b_same)
        if not len(whole):
            return [], []
        if len(whole) < len(raws):
            a, b = (tokens_of(ids.take(pa.array(whole)), side.pieces, [raws[i] for i in whole])[0]
                    for side, ids in zip((self.a, self.b), lists, strict=True))
        links = _links(a, b)
        n_groups, digests = _group_digests(a, b, links, self.names, len(whole))
        pairs = links["a"].to_numpy().astype(np.int64) * self.width + links["b"].to_numpy()
        cuts = np.searchsorted(links["text"].to_numpy(), np.arange(len(whole) + 1))
        rows = [(int(i), (int(a.counts[k]), int(b.counts[k]), int(n_groups[k]), int(cuts[k + 1] - cuts[k]),
                          digests[k], pairs[cuts[k]:cuts[k + 1]].tobytes())) for k, i in enumerate(whole)]
        counted = pa.table({"pair": pairs}).group_by("pair", use_threads=False).aggregate([([], "count_all")])
        return rows, [counted.rename_columns(["pair", "n"])]


_ROW = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"
_ENCODED = _ROW + ", pairs binary, counts binary"


def _encoder(a_path: str, b_path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = per_process(("align", a_path, b_path), lambda: Aligner(a_path, b_path))
        chunk, size, held = TaskContext.get().partitionId() << 32, 0, []
        for batch in batches:
            texts = filled(batch.column("text"))
            offsets = text_bytes(texts)[1]
            for start, end in slices(texts, ENCODE_BYTES):
                rows, pairs = tools.rows(texts.slice(start, end - start).to_pylist())
                yield _encoded(chunk, batch.column("doc_id").slice(start, end - start).to_pylist(), rows)
                held.append(pairs)
                size += int(offsets[end] - offsets[start])
                if size >= CHUNK_BYTES:
                    yield _pairs_row(chunk, held)
                    chunk, size, held = chunk + 1, 0, []
                elif len(held) >= 16:
                    held = [_merged(held)]
        if held:
            yield _pairs_row(chunk, held)

    return encode


def _encoded(chunk: int, ids: list, rows: list[tuple], pairs: bytes | None = None, counts: bytes | None = None):
    columns = [[chunk] * len(rows), ids, *(list(c) for c in zip(*rows, strict=True)), [pairs] * len(rows), [counts] * len(rows)]
    kinds = [pa.int64()] * 6 + [pa.string()] + [pa.binary()] * 3
    names = [part.split()[0] for part in _ENCODED.split(", ")]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _merged(held: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(held).group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(["pair", "n"])


def _pairs_row(chunk: int, held: list[pa.Table]) -> pa.RecordBatch:
    """One row for the distinct pairs of a chunk, packed."""
    merged = _merged(held)
    pairs, counts = (merged[c].to_numpy().tobytes() for c in ("pair", "n"))
    return _encoded(chunk, [None], [(0, 0, 0, 0, "", None)], pairs, counts)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, pairs, counts in zip(*(batch.column(c) for c in ("chunk", "pairs", "counts")), strict=True):
            pairs, counts = (np.frombuffer(x.as_buffer(), dtype=np.int64) for x in (pairs, counts))
            for at in range(0, len(pairs), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield pa.record_batch(
                    [pa.array(np.full(len(pairs[part]), chunk.as_py())), pa.array(pairs[part]), pa.array(counts[part])],
                    ["chunk", "pair", "n"])


def _lookup(rows: pa.Table, pairs: pa.Table) -> pa.Table:
    """The rows of a chunk with the corpus-wide counts of their links."""
    order = np.argsort(pairs["pair"].to_numpy())
    keys, totals, best = (pairs[c].to_numpy()[order] for c in ("pair", "total", "best"))
    sums, bests = [], []
    for links in rows["links"]:
        at = np.searchsorted(keys, np.frombuffer(links.as_buffer(), dtype=np.int64))
        sums.append(int(totals[at].sum()))
        bests.append(int(np.count_nonzero(best[at])))
    kept = rows.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    return kept.append_column("n_best", pa.array(bests, pa.int64())).append_column(
        "count_sum", pa.array(sums, pa.int64())).append_column("groups_sha256", rows["groups_sha256"])


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    `a_path` is a byte-level vocabulary of `tokenizers`, which encodes a space
    and the text, `b_path` one of `sentencepiece`, which puts the space before.
    A link's count is how many links of the corpus have its two ids; `n_best`
    counts the links that no pair with the same B id exceeds, `count_sum` adds
    the counts. The B ids' highest counts are at most one row an id of the
    vocabulary and so are broadcast.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    encoded = shared_table(rows.mapInArrow(_encoder(a_path, b_path), _ENCODED), "aligned")
    width = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    counted = encoded.where(F.col("pairs").isNotNull()).select("chunk", "pairs", "counts").mapInArrow(
        _unpack, "chunk long, pair long, n long")
    totals = shared_table(counted.groupBy("pair").agg(F.sum("n").alias("total")), "pair-counts")
    of_b = F.pmod("pair", F.lit(width)).alias("b")
    highest = totals.groupBy(of_b).agg(F.max("total").alias("most"))
    totals = totals.select("pair", "total", of_b).join(F.broadcast(highest), "b").select(
        "pair", "total", (F.col("total") == F.col("most")).alias("best"))
    pairs = counted.select("chunk", "pair").join(totals, "pair").select("chunk", "pair", "total", "best")
    texts = encoded.where(F.col("pairs").isNull()).drop("pairs", "counts")
    return texts.groupBy("chunk").cogroup(pairs.groupBy("chunk")).applyInArrow(
        _lookup, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
        "groups_sha256 string")
