"""Exact substring dedup: bytes of strings that occur more than once, by sorting suffixes.

A suffix matters only if its first `size` bytes occur elsewhere. Its leading
token is content-defined: of the `span` (half of `size`) positions from its
start, the one whose 8 bytes hash lowest, the last of equals. Equal strings have
it at the same offset, and the `size - span + 1` bytes from it on, the core, lie
inside both. So only suffixes whose core occurs twice in the corpus are sorted,
and all suffixes with the same leading token travel as one record: the bytes
they cover together and the range of their offsets.

Records are range-partitioned by their leading tokens and cores between sampled
splitters, a core never over two partitions. Each partition sorts its suffixes
by multikey quicksort, eight bytes a step, equal records once. Of cores that
more records have than fill a bucket, equal records become one first, so a
passage that a third of all documents share is a few records. Where the
distinct ones still fill more than a bucket, they are spread over tasks and
compared by digests of ranges of offsets, cut finer only where it matters.

Every text counts as UTF-8 bytes (null: empty) and nothing matches across
texts. A text of `size` bytes that another row repeats goes whole. Rows with
equal or null ids are told apart; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import shared_table
from .text_hash import mix, text_bytes

MIN_BYTES = 400
_PIECE = 1 << 20
_PLACE_BITS = 24
BUCKET_BYTES = 6 << 20
_SORTED_AT_ONCE = 300_000
#: At most this many keys can each hold one row in so many; their list is broadcast.
HOT_SHARE = 1000
#: A range of offsets is cut into so many.
_FINER = 8
_WORD = 8
_TOKENS_AT_ONCE = 2048
_LOW = (1 << 64) - 1


def _names(schema: str) -> list[str]:
    return [column.split()[0] for column in schema.split(", ")]


def _words(data: np.ndarray, order: str = "<") -> np.ndarray:
    """The 8 bytes from every position on as one number."""
    return np.ndarray(max(len(data) - _WORD + 1, 0), dtype=f"{order}u8", buffer=data, strides=(1,))


def leading(data: np.ndarray, span: int) -> np.ndarray:
    """For each start with `span` + 7 bytes, the offset of its leading token: `data` has at most 2^24 bytes."""
    n = len(data) - _WORD + 1
    starts = n - span + 1
    if starts <= 0:
        return np.zeros(0, dtype=np.int64)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    # Of equal hashes the last place has the smallest number.
    key = (mix(_words(data).astype(np.uint64)) & ~low) | (low - np.arange(n, dtype=np.uint64))
    blocks = -(-n // span)
    padded = np.full(blocks * span, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = key
    padded = padded.reshape(blocks, span)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[:starts], ahead[span - 1:span - 1 + starts])
    return (low - (least & low)).astype(np.int64)


def anchors(data: np.ndarray, bounds: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, place, first start, last start) of the leading tokens of texts that lie one after the other.

    `bounds` has the texts' starts and the end. Long texts are worked through
    in pieces, so a token may come twice with different starts.
    """
    span = size // 2
    for at in range(0, len(data), _PIECE):
        places = leading(data[at:at + _PIECE + span + _WORD - 2], span)[:_PIECE]
        starts = np.arange(at, at + len(places))
        text = np.searchsorted(bounds, starts, side="right") - 1
        fits = starts + size <= bounds[text + 1]
        starts, text, places = starts[fits], text[fits], places[fits] + at
        if not len(starts):
            continue
        new = np.flatnonzero(np.diff(places, prepend=-1) | np.diff(text, prepend=-1))
        last = np.concatenate([new[1:], [len(starts)]]) - 1
        begin = bounds[text[new]]
        yield text[new], places[new] - begin, starts[new] - begin, starts[last] - begin


_ANCHOR = "core long, k1 long, k2 long, place int, first int, last int"


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def _anchor_rows(size: int):
    core = size - size // 2 + 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column("text"))
            view = memoryview(data)
            for text, place, first, last in anchors(data, bounds, size):
                at = (bounds[text] + place).tolist()
                cores = _signed([xxhash.xxh3_64_intdigest(view[i:i + core]) for i in at])
                text = pa.array(text)
                yield pa.record_batch(
                    [cores, batch.column("k1").take(text), batch.column("k2").take(text),
                     *(pa.array(x, pa.int32()) for x in (place, first, last))],
                    _names(_ANCHOR))

    return rows


_RECORD = ("k1 long, k2 long, place int, core long, often boolean, lead long, c1 long, c2 long, shortest int, longest int, "
           "content binary")


def _records(size: int):
    """Rows of a text and its repeated leading tokens: the bytes that the suffixes of each cover together.

    `shortest` and `longest` are how far the suffixes' starts lie before the token.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column("text"))
            view = memoryview(data)
            tokens = batch.column("tokens")
            for row in range(len(tokens)):
                begin = int(bounds[row])
                found = pa.Table.from_arrays(tokens[row].values.flatten(), ["core", "often", "place", "first", "last"])
                for part in found.to_batches(_TOKENS_AT_ONCE):
                    place, first, last = (part.column(c).to_numpy().astype(np.int64) for c in ("place", "first", "last"))
                    contents = [bytes(view[begin + a:begin + b + size]) for a, b in zip(first, last, strict=True)]
                    digests = [xxhash.xxh3_128_intdigest(c + bytes(f"{p - b},{p - a}", "ascii"))
                               for c, p, a, b in zip(contents, place, first, last, strict=True)]
                    lead = _words(data, ">")[begin + place].astype(np.uint64) ^ np.uint64(1 << 63)  # orders as bytes do
                    one = np.ones(len(place), dtype=np.int64)
                    yield pa.record_batch(
                        [pa.array(batch.column("k1")[row].as_py() * one), pa.array(batch.column("k2")[row].as_py() * one),
                         pa.array(place, pa.int32()), part.column("core"), part.column("often"),
                         pa.array(lead.view(np.int64)),
                         _signed([d >> 64 for d in digests]), _signed([d & _LOW for d in digests]),
                         pa.array(place - last, pa.int32()), pa.array(place - first, pa.int32()),
                         pa.array(contents, pa.binary())],
                        _names(_RECORD))

    return rows


def repeated(data: np.ndarray, starts: np.ndarray, groups: np.ndarray, size: int) -> np.ndarray:
    """Which suffixes agree with another one of their group in `size` bytes: multikey quicksort of all groups at once.

    In each round every group is cut in three by the eight bytes at its depth
    against those of its middle suffix; the equal part goes eight bytes on.
    Groups of one are done, those that reach `size` bytes are repeats.
    """
    out = np.zeros(len(starts), dtype=bool)
    words = _words(data, ">")
    steps = -(-size // _WORD)
    row = np.argsort(groups, kind="stable")
    cut = np.flatnonzero(np.diff(groups[row], prepend=groups[row][:1] - 1)) if len(row) else row
    depth = np.zeros(len(cut), dtype=np.int64)
    while len(row):
        lengths = np.diff(cut, append=len(row))
        whole = (depth == steps) & (lengths > 1)
        go = (lengths > 1) & ~whole
        out[row[np.repeat(whole, lengths)]] = True
        row, depth, lengths = row[np.repeat(go, lengths)], depth[go], lengths[go]
        if not len(row):
            break
        cut = np.cumsum(lengths) - lengths
        group = np.repeat(np.arange(len(cut)), lengths)
        # The last word ends where the suffix does.
        at = starts[row] + np.minimum(depth * _WORD, size - _WORD)[group]
        word = words[at]
        pivot = word[cut + lengths // 2][group]
        side = (word > pivot).astype(np.int64) - (word < pivot)
        key = group * 3 + side + 1
        if side.any():
            mixed = np.bitwise_or.reduceat(side != 0, cut)[group]
            moved = np.flatnonzero(mixed)
            order = moved[np.argsort(key[moved], kind="stable")]
            row[moved], key[moved] = row[order], key[order]
        cut = np.flatnonzero(np.diff(key, prepend=-1))
        depth = depth[key[cut] // 3] + (key[cut] % 3 == 1)
    return out


_FOUND = "c1 long, c2 long, low int, high int"


def _runs(record: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record, lowest, highest) of unbroken offsets, from pairs sorted by record and offset."""
    new = np.flatnonzero((np.diff(record, prepend=-1) != 0) | (np.diff(offset, prepend=-2) != 1))
    return record[new], offset[new], offset[np.concatenate([new[1:], [len(record)]]) - 1] if len(new) else offset


def _sort_bucket(size: int):
    """Rows of a partition sorted by (lead, core, c1, c2): the offsets of repeated suffixes."""

    def one_part(part: list[tuple]) -> pa.RecordBatch:
        core = np.array([p[0] for p in part], dtype=np.int64)
        c1, c2 = (np.array([p[i] for p in part], dtype=np.int64) for i in (1, 2))
        shortest, longest = (np.array([p[i] for p in part], dtype=np.int64) for i in (3, 4))
        several = np.array([p[6] for p in part]) > 1
        data = np.frombuffer(b"".join(p[5] for p in part), dtype=np.uint8)
        lengths = np.array([len(p[5]) for p in part])
        begin = np.cumsum(lengths) - lengths
        cores = np.unique(core, return_inverse=True)[1]
        counts = longest - shortest + 1
        widest = int(longest.max()) + 1
        found, at = [], 0
        # Suffixes with different offsets of their leading token differ: sort a range of offsets at a time.
        step = max(_SORTED_AT_ONCE // len(part), 1)
        for at in range(int(shortest.min()), widest, step):
            low, high = np.maximum(shortest, at), np.minimum(longest, at + step - 1)
            number = np.maximum(high - low + 1, 0)
            record = np.repeat(np.arange(len(part)), number)
            offset = np.arange(len(record)) - np.repeat(np.cumsum(number) - number, number) + low[record]
            start = begin[record] + longest[record] - offset
            hit = several[record].copy()
            alone = repeated(data, start, cores[record] * widest + offset, size)
            found.append((record[hit | alone], offset[hit | alone]))
        record, offset = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((offset, record))
        record, low, high = _runs(record[order], offset[order])
        return pa.record_batch(
            [pa.array(c1[record]), pa.array(c2[record]), pa.array(low, pa.int32()), pa.array(high, pa.int32())],
            _names(_FOUND))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, whole = [], 0
        for batch in batches:
            columns = [batch.column(c) for c in ("core", "c1", "c2", "n", "shortest", "longest", "content")]
            keys = list(zip(*(c.to_numpy() for c in columns[:4]), strict=True))
            for i, (core, *digest, n) in enumerate(keys):
                if part and part[-1][1:3] == digest and part[-1][0] == core:
                    part[-1][6] += n
                    continue
                if part and whole > _SORTED_AT_ONCE and part[-1][0] != core:  # whole cores are sorted together
                    yield one_part(part)
                    part, whole = [], 0
                shortest, longest = columns[4][i].as_py(), columns[5][i].as_py()
                part.append([core, *digest, shortest, longest, columns[6][i].as_py(), n])
                whole += longest - shortest + 1
        if part:
            yield one_part(part)

    return rows


_WINDOW = "c1 long, c2 long, low int, high int, n long, s1 long, s2 long, w1 long, w2 long"


def _windows(size: int, width: int):
    """Ranges of offsets cut at multiples of `width`, with two digests each: of the bytes that all suffixes
    with an offset between those multiples have in common, and of all bytes that the record's own cover."""
    last = size // 2 - 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column("content"))
            view = memoryview(data)
            out = [[] for _ in range(6)]
            longest = batch.column("longest").to_pylist()
            for row, ranges in enumerate(batch.column("ranges").to_pylist()):
                zero = int(bounds[row]) + longest[row]  # where the leading token lies
                for r in ranges:
                    for at in range(r["low"] // width * width, r["high"] + 1, width):
                        low, high = max(r["low"], at), min(r["high"], at + width - 1)
                        inner = view[zero - at:zero - min(at + width - 1, last) + size]
                        own = view[zero - high:zero - low + size]
                        for column, value in zip(out, (
                                row, low, high, r["n"], xxhash.xxh3_128_intdigest(inner, seed=at),
                                xxhash.xxh3_128_intdigest(own, seed=low)), strict=True):
                            column.append(value)
            row, low, high, n, inner, own = out
            yield pa.record_batch(
                [batch.column("c1").take(pa.array(row, pa.int64())), batch.column("c2").take(pa.array(row, pa.int64())),
                 pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array(n, pa.int64()),
                 *(_signed(part) for d in (inner, own) for part in ([x >> 64 for x in d], [x & _LOW for x in d]))],
                _names(_WINDOW))

    return rows


def _compared(kinds: DataFrame, size: int) -> DataFrame:
    """(c1, c2, low, high) of repeated suffixes among distinct records, without meeting in one task.

    Equal suffixes lie in windows whose common bytes are equal. A window whose
    whole bytes are repeated is found; one alone with its common bytes has no
    repeats; of all others each kind is cut finer, down to single offsets,
    where common and whole bytes are the same.
    """
    width = 1
    while width * _FINER < size // 2:
        width *= _FINER
    todo, found = kinds.withColumn("ranges", F.array(F.struct(
        F.col("shortest").alias("low"), F.col("longest").alias("high"), "n"))), []
    inner, own = ["s1", "s2"], ["w1", "w2"]
    while True:
        rows = shared_table(
            todo.select("c1", "c2", "longest", "content", "ranges").mapInArrow(_windows(size, width), _WINDOW), "windows")
        wholes = shared_table(rows.groupBy(*inner, *own).agg(
            F.min(F.struct("c1", "c2")).alias("one"), F.min("low").alias("low"), F.max("high").alias("high"),
            F.sum("n").alias("n")), "wholes")
        found.append(_join_hot(rows, wholes.where("n > 1").select(own), own).select(_names(_FOUND)))
        if width == 1:
            return reduce(DataFrame.unionByName, found)
        several = wholes.groupBy(*inner).agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select(inner)
        todo = _join_hot(wholes, several, inner).groupBy("one.c1", "one.c2").agg(
            F.collect_list(F.struct("low", "high", "n")).alias("ranges")).join(kinds, ["c1", "c2"])
        width //= _FINER


def _join_hot(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join with one `other` row a key, where a key may hold a third of the rows.

    Keys with more than 1 in HOT_SHARE of the rows are at most HOT_SHARE; their
    side is broadcast, the other keys are shuffled.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.count()
    hot = shared_table(sizes.where(F.col("_n") * HOT_SHARE > max(total, HOT_SHARE * 1000)).select(*keys), "hot")
    if hot.isEmpty():
        return rows.join(other, keys)
    return rows.join(F.broadcast(other.join(F.broadcast(hot), keys, "left_semi")), keys).unionByName(
        rows.join(F.broadcast(hot), keys, "left_anti").join(other, keys))


def text_keys(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(101), text).alias("k2")]


def _whole_cores(records: DataFrame, size: int) -> tuple[DataFrame, DataFrame | None]:
    """Records whose cores fit into a bucket each, and distinct records of larger cores, if there are any.

    `n` says how many records a row stands for.
    """
    columns = ["lead", "core", "c1", "c2", "n", "shortest", "longest", "content"]
    single = records.withColumn("n", F.lit(1).cast("long"))
    kinds = shared_table(single.where("often").groupBy(*columns[:4]).agg(
        F.sum("n").alias("n"), *(F.first(c).alias(c) for c in columns[5:])), "kinds")
    # A large core fills a bucket, so their list is short.
    large = shared_table(kinds.groupBy("core").agg(F.sum(size + F.col("longest") - F.col("shortest")).alias("bytes")).where(
        F.col("bytes") > BUCKET_BYTES).select("core"), "large")
    sortable = single.where(~F.col("often")).select(columns)
    if large.isEmpty():
        return sortable.unionByName(kinds), None
    return (sortable.unionByName(kinds.join(F.broadcast(large), "core", "left_anti")),
            kinds.join(F.broadcast(large), "core", "left_semi"))


def repeated_spans(docs: DataFrame, size: int = MIN_BYTES, text_col: str = "text") -> DataFrame:
    """(k1, k2, spans): for each distinct text, where its bytes are covered by repeats of `size` bytes.

    `spans` are (start, end) in bytes, in no order and overlapping. Texts that
    several rows have are compared once with the others; that they repeat as a
    whole is left to `without_repeats`.
    """
    if size < 64:
        raise ValueError("repeats of fewer than 64 bytes are not looked for")
    text = F.col(text_col)
    texts = docs.select(*text_keys(text), text.alias("text")).where(F.octet_length("text") >= size)
    keys = ["k1", "k2"]
    found = shared_table(texts.mapInArrow(_anchor_rows(size), _ANCHOR), "tokens")
    who = F.xxhash64("k1", "k2", "place")
    cores = shared_table(found.groupBy("core").agg(
        F.min(who).alias("a"), F.max(who).alias("b"), F.sum(size + F.col("last") - F.col("first")).alias("bytes")).where(
        "a <> b").select("core", (F.col("bytes") > BUCKET_BYTES).alias("often")), "cores")
    tokens = _join_hot(found, cores, ["core"]).groupBy(*keys).agg(
        F.collect_set(F.struct("core", "often", "place", "first", "last")).alias("tokens"))
    once = texts.groupBy(*keys).agg(F.first("text").alias("text"))
    records = shared_table(
        once.join(tokens, keys).mapInArrow(_records(size), _RECORD), "suffixes")
    sortable, large = _whole_cores(records, size)
    total = sortable.agg(F.sum(size + F.col("longest") - F.col("shortest"))).first()[0] or 0
    sorted_rows = sortable.repartitionByRange(int(total // BUCKET_BYTES) + 1, "lead", "core").sortWithinPartitions(
        "lead", "core", "c1", "c2")
    matches = shared_table(sorted_rows.mapInArrow(_sort_bucket(size), _FOUND), "matches")
    if large is not None:
        matches = matches.unionByName(_compared(large, size))
    ranges = matches.groupBy("c1", "c2").agg(F.collect_set(F.struct("low", "high")).alias("ranges"))
    ranges = shared_table(ranges, "ranges")
    covered = _join_hot(records.select(*keys, "place", "c1", "c2"), ranges, ["c1", "c2"])
    spans = F.transform("ranges", lambda r: F.struct(
        (F.col("place") - r["high"]).alias("start"), (F.col("place") - r["low"] + size).alias("end")))
    return covered.groupBy(*keys).agg(F.flatten(F.collect_list(spans)).alias("spans"))


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the spans' union; runs that touch are one."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > ends[:-1]]))
    return starts[new], ends[np.concatenate([new[1:], [len(starts)]]) - 1]


_CUT = "k1 long, k2 long, removed long, n_spans long, kept binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, bounds = text_bytes(batch.column("text"))
        spans = batch.column("spans")
        removed, number, kept = [], [], []
        for row in range(len(spans)):
            starts, ends = merged(*(x.to_numpy().astype(np.int64) for x in spans[row].values.flatten()))
            own = data[bounds[row]:bounds[row + 1]]
            cuts = [own[a:b] for a, b in zip([0, *ends], [*starts, len(own)], strict=True)]
            removed.append(int((ends - starts).sum()))
            number.append(len(starts))
            kept.append(b"".join(c.tobytes() for c in cuts))
        yield pa.record_batch(
            [batch.column("k1"), batch.column("k2"), pa.array(removed, pa.int64()), pa.array(number, pa.int64()),
             pa.array(kept, pa.binary())], ["k1", "k2", "removed", "n_spans", "kept"])


def without_repeats(
    docs: DataFrame, size: int = MIN_BYTES, id_col: str = "doc_id", text_col: str = "text", digest: bool = False,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row: its bytes without those of repeats.

    `kept` is binary: a cut may fall inside a character. With `digest` it is
    `kept_sha256`, the hexadecimal SHA-256 of the bytes, and texts that stay as
    they are do not travel.
    """
    keys = ["k1", "k2"]
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = (lambda c: F.sha2(c, 256)) if digest else (lambda c: c)
    name = "kept_sha256" if digest else "kept"
    rows = docs.select(
        F.col(id_col).alias("doc_id"), *text_keys(text), F.octet_length(text).cast("long").alias("n_bytes"),
        out(F.encode(text, "utf-8")).alias("own"))
    spans = repeated_spans(docs, size, text_col)
    long = rows.where(F.col("n_bytes") >= size)
    copies = shared_table(
        long.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "copies")
    # Copies of one text may be many rows: the commonest are at most HOT_SHARE and are told apart first.
    total = max(docs.count(), 1)
    hot = copies.where(F.col("copies") * HOT_SHARE > total).select(*keys, F.lit(True).alias("hot"))
    pieces = docs.select(*text_keys(text), text.alias("text")).where(F.octet_length("text") >= size).join(
        F.broadcast(hot), keys, "left_anti")
    cut = pieces.join(spans.join(copies, keys, "left_anti"), keys).mapInArrow(_cut, _CUT)
    cut = cut.select(*keys, "removed", "n_spans", out(F.col("kept")).alias("rest"))
    rest = copies.where(F.col("copies") * HOT_SHARE <= total).select(*keys, F.lit(True).alias("copy"))
    first = rows.withColumn("long", F.col("n_bytes") >= size).join(F.broadcast(hot), keys, "left")
    settled = first.where(~F.col("long") | F.col("hot").isNotNull()).withColumn("copy", F.col("hot"))
    open_rows = first.where(F.col("long") & F.col("hot").isNull()).join(rest, keys, "left").join(cut, keys, "left")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("removed", "long"), ("n_spans", "long"))]
    settled = settled.select("*", *nothing, F.lit(None).cast("string" if digest else "binary").alias("rest"))
    whole = F.col("copy").isNotNull()
    empty = out(F.encode(F.lit(""), "utf-8"))
    columns = ["doc_id", "n_bytes", "own", "copy", "removed", "n_spans", "rest"]
    return reduce(DataFrame.unionByName, (part.select(columns) for part in (settled, open_rows))).select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, empty).otherwise(F.coalesce("rest", "own")).alias(name))
