"""MinHash near-duplicates by a chosen-path set similarity join.

Each of several independent trees sends a document down a path of chosen
minwise tokens: the root chooses one signature coordinate, and every node that
is still large chooses a few more, so documents share a node when they agree on
the tokens chosen along its path. Nodes of up to EXACT_BLOCKS blocks, and those
of the last level, are compared exhaustively. A pair of similarity s meets below
one root with probability s and below one of c children with 1 - (1 - s)^c, so
T trees over D levels of large nodes miss (1 - s (1 - (1 - s)^c)^D)^T of the
pairs. T and c are the least for which this is at most TARGET_MISS at the asked
similarity, for a pair whose nodes stay large to the end: at 0.80, 8 trees with
3 children miss 6.6e-6 there and 2.6e-6 in small nodes.

Pairs are found on signatures and then confirmed on full shingle sets. To
return components it is enough to confirm links between documents that are not
yet known to be connected. So equal sets are joined into one class first; each
class is then tried against the first class of its nodes, and only classes that
this leaves apart are compared pair by pair. In a node, the largest component's
members are never compared with each other. The pairs are confirmed where they
are found, in the task that holds a block of a node and its members' sets, most
similar ones first, and only links that connect something new leave it. A group
of copies, however large, thus costs rows in proportion to its size. A pair that
several trees find is confirmed by the first of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text_hash
from .components import components
from .tables import shared_table

COORDINATES = 128
TREES = 8
NODE_LIMIT = 512
EXACT_BLOCKS = 8
MAX_DEPTH = 4
TARGET_MISS = 1e-5
MAX_TREES = 63  # bits of `done`
ID_BUCKETS = 1 << 20

_MULTIPLY = text_hash.stream(101, COORDINATES) | np.uint64(1)
_ADD = text_hash.stream(102, COORDINATES)


def signatures(sets: list[np.ndarray], trees: int) -> tuple[np.ndarray, np.ndarray]:
    """Minwise values of each set (zeros for empty sets).

    The last byte of each coordinate's value, which tells unequal values apart
    but for one in 256, and the whole values of the coordinates the roots choose.
    """
    marks = np.zeros((len(sets), COORDINATES), dtype=np.uint8)
    roots = np.zeros((len(sets), trees), dtype=np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return marks, roots
    items = np.concatenate([sets[i] for i in full])
    starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
    for k in range(0, COORDINATES, 2):
        # Both halves of a 64-bit product: two independent orders of the items.
        halves = (items * _MULTIPLY[k] + _ADD[k]).view(np.uint32).reshape(-1, 2)
        for half in range(2):
            least = np.minimum.reduceat(np.ascontiguousarray(halves[:, half]), starts)
            marks[full, k + half] = text_hash.mix(least.astype(np.uint64)).astype(np.uint8)
            if k + half < trees:
                roots[full, k + half] = least
    return marks, roots


def _signed(x) -> pa.Array:
    return pa.array(np.asarray(x, dtype=np.uint64).view(np.int64))


def _binary(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    ends = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows.tobytes())])


def _profile(batches: Iterator[pa.RecordBatch], size: int, trees: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = text_hash.filled(batch.column("text"))
        for start, end in text_hash.slices(texts, text_hash.SMALL_SLICE_BYTES):
            sets = text_hash.shingle_sets(texts.slice(start, end - start), size)
            marks, roots = signatures(sets, trees)
            yield pa.RecordBatch.from_arrays([
                batch.column("id").slice(start, end - start), *_identity(sets), _binary(marks), _binary(roots),
            ], names=["id", *_SET, "signature", "roots"])


_SET = ["n_shingles", "sum", "xor"]


def _identity(sets: list[np.ndarray]) -> list[pa.Array]:
    """Size, sum and mixed exclusive-or: equal for equal sets only."""
    return [pa.array([len(s) for s in sets], pa.int64()), _signed([s.sum(dtype=np.uint64) for s in sets]),
            _signed([np.bitwise_xor.reduce(text_hash.mix(s), initial=np.uint64(0)) for s in sets])]


def profiles(texts: DataFrame, size: int, trees: int = TREES) -> DataFrame:
    """(id, n_shingles, sum, xor, signature, roots) of a table (id, text)."""
    return texts.mapInArrow(
        lambda batches: _profile(batches, size, trees),
        "id long, n_shingles long, sum long, xor long, signature binary, roots binary")


def _tokens(batches: Iterator[pa.RecordBatch], trees: int) -> Iterator[pa.RecordBatch]:
    """The root's choice in each tree: one row per document and tree."""
    for batch in batches:
        n = batch.num_rows
        roots = np.frombuffer(b"".join(batch.column("roots").to_pylist()), dtype=np.uint32).reshape(n, trees)
        for tree in range(trees):
            node = text_hash.mix(roots[:, tree].astype(np.uint64) + np.uint64((tree + 1) << 32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, tree, dtype=np.int32)), _signed(node), batch.column("id"), batch.column("n_shingles")],
                names=["tree", "node", "id", "n_shingles"])


def _matrix(column: pa.Array) -> np.ndarray:
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, dtype=np.uint8).reshape(len(column), COORDINATES)


def missed(percent: int, trees: int, children: int, depth: int) -> float:
    """Share of the pairs at the asked similarity that no tree finds under `depth` levels of large nodes."""
    s = percent / 100.0
    return (1.0 - s * (1.0 - (1.0 - s) ** children) ** depth) ** trees


def trees_for(percent: int) -> int:
    """Trees that leave half of TARGET_MISS to the branching, TREES at least."""
    found = next((t for t in range(TREES, MAX_TREES + 1) if missed(percent, t, 1, 0) <= TARGET_MISS / 2), None)
    if found is None:
        raise ValueError(f"{MAX_TREES} trees miss too many pairs of similarity {percent} %")
    return found


def children_for(percent: int, trees: int) -> int:
    """Children of a large node that bring the miss to TARGET_MISS, or to twice that of the roots alone if that is more."""
    goal = max(TARGET_MISS, 2.0 * missed(percent, trees, 1, 0))
    return next((c for c in range(1, COORDINATES) if missed(percent, trees, c, MAX_DEPTH) <= goal), COORDINATES)


def _branch(batches: Iterator[pa.RecordBatch], children: int) -> Iterator[pa.RecordBatch]:
    """Children of large nodes: the node's own hash chooses as many coordinates, all different."""
    for batch in batches:
        sig = _matrix(batch.column("signature"))
        node = batch.column("node").to_numpy().view(np.uint64)
        rows = np.arange(len(node))
        first, stride = text_hash.mix(node + np.uint64(7919)), text_hash.mix(node + np.uint64(2 * 7919)) | np.uint64(1)
        for k in range(children):
            chosen = (first + np.uint64(k) * stride) % np.uint64(COORDINATES)
            token = sig[rows, chosen.astype(np.int64)].astype(np.uint64) + (chosen << np.uint64(8))
            child = text_hash.mix(text_hash.mix(node + token) + np.uint64(k))
            yield pa.RecordBatch.from_arrays(
                [batch.column("tree"), _signed(child), *[batch.column(c) for c in _CARRIED]], names=["tree", "node", *_CARRIED])


_CARRIED = ["id", "n_shingles", "signature", "roots", "done", "component"]
_MEMBERS = "tree int, node long, id long, n_shingles long, signature binary, roots binary, done long, component long"
_NODE = ["tree", "node"]
_GROUP = [*_NODE, "kind", "low", "high"]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of sorted rows and their numbers; only an unfinished one waits for the next batch."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        group = _group_numbers(table)
        done = int(np.searchsorted(group, group[-1])) if len(group) else 0
        if done:
            yield table.slice(0, done), group[:done]
        rest = table.slice(done)
    if rest is not None and rest.num_rows:
        yield rest, _group_numbers(rest)


def _group_numbers(table: pa.Table) -> np.ndarray:
    change = np.zeros(table.num_rows, dtype=np.int64)
    for name in _GROUP:
        values = table.column(name).to_numpy()
        change[1:] |= values[1:] != values[:-1]
    return np.cumsum(change)


def _likely_pairs(
    table: pa.Table, group: np.ndarray, enough: int, percent: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows that may be similar and are not connected, and their equal coordinates.

    Each row meets the rows 1, 2, 3, ... places below it in its group, all
    groups at once.
    """
    sig = _matrix(table.column("signature").combine_chunks())
    roots = np.frombuffer(b"".join(table.column("roots").to_pylist()), dtype=np.uint32).reshape(len(sig), -1)
    size, comp, tree, done = (table.column(c).to_numpy() for c in ("n_shingles", "component", "tree", "done"))
    left, right, deep = (table.column(c).to_numpy() for c in ("left", "right", "deep"))
    trees = np.arange(roots.shape[1])
    one, other, equal = [], [], []
    rows, lag = np.arange(len(size) - 1), 1
    while len(rows):
        rows = rows[rows + lag < len(size)]
        rows = rows[group[rows] == group[rows + lag]]
        below = rows + lag
        lag += 1
        open_ = (comp[rows] != comp[below]) & ((left[rows] & right[below]) | (right[rows] & left[below]))
        open_ &= 100 * np.minimum(size[rows], size[below]) >= percent * np.maximum(size[rows], size[below])
        i, j = rows[open_], below[open_]
        same = (sig[i] == sig[j]).sum(axis=1)
        near = same >= enough
        i, j, same = i[near], j[near], same[near]
        # Another tree's node that is compared as a whole has the pair, too.
        whole = (roots[i] == roots[j]) & ((done[i][:, None] >> trees) & 1 == 1)
        fresh = ~(whole & (deep[i][:, None] | (trees < tree[i][:, None]))).any(axis=1)
        one.append(i[fresh])
        other.append(j[fresh])
        equal.append(same[fresh])
    return tuple(np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (one, other, equal))


def _with_partner(batches: Iterator[pa.RecordBatch], enough: int, percent: int) -> Iterator[pa.RecordBatch]:
    """The rows of sorted groups that are part of a likely pair."""
    for table, group in _groups(batches):
        i, j, _ = _likely_pairs(table, group, enough, percent)
        kept = table.take(pa.array(np.unique(np.concatenate([i, j]))))
        yield from kept.combine_chunks().to_batches()


def _linked(batches: Iterator[pa.RecordBatch], enough: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Confirmed links of sorted groups, most similar pairs first; pairs already connected are skipped."""
    for table, group in _groups(batches):
        i, j, same = _likely_pairs(table, group, enough, percent)
        order = np.lexsort((same * -1, group[i]))
        sets = [np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in table.column("set")]
        ids, comp = table.column("id").to_numpy().tolist(), table.column("component").to_numpy().tolist()
        root: dict[tuple[int, int], tuple[int, int]] = {}

        def find(key: tuple[int, int]) -> tuple[int, int]:
            while key in root:
                key = root[key]
            return key

        links = []
        for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
            one, other = find((group[a], comp[a])), find((group[b], comp[b]))
            if one == other:
                continue
            both, either = _jaccard_counts(sets[a], sets[b])
            if 100 * both >= percent * either:
                links.append((ids[a], ids[b]))
                root[max(one, other)] = min(one, other)
        yield pa.RecordBatch.from_arrays(
            [pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])


def _jaccard_counts(one: np.ndarray, other: np.ndarray) -> tuple[int, int]:
    both = len(np.intersect1d(one, other, assume_unique=True))
    return both, len(one) + len(other) - both


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for one, other in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
            both, either = _jaccard_counts(
                np.frombuffer(one.as_buffer(), dtype=np.uint64), np.frombuffer(other.as_buffer(), dtype=np.uint64))
            keep.append(100 * both >= percent * either)
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _full_sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = text_hash.filled(batch.column("text"))
        for start, end in text_hash.slices(texts, text_hash.SMALL_SLICE_BYTES):
            sets = text_hash.shingle_sets(texts.slice(start, end - start), size)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(start, end - start), *_identity(sets),
                 pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", *_SET, "set"])


def full_sets(ids: DataFrame, heads: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(id, set) of the given ids, from `texts` (id, text), which is read again.

    A semi join on ID_BUCKETS hash buckets at most, small enough for a
    broadcast, drops most other documents before anything is shuffled; an exact
    semi join follows.
    """
    wanted = heads.select("id", *_SET).join(ids.distinct(), "id", "left_semi")
    bucket = F.pmod(F.xxhash64("id"), F.lit(ID_BUCKETS))
    near = wanted.select(bucket.alias("bucket")).distinct()
    sets = texts.withColumn("bucket", bucket).join(F.broadcast(near), "bucket", "left_semi").select("id", "text")
    sets = sets.mapInArrow(lambda batches: _full_sets(batches, size), "id long, n_shingles long, sum long, xor long, set binary")
    return shared_table(sets.join(wanted, ["id", *_SET], "left_semi").select("id", "set"), "sets")


def confirmed(pairs: DataFrame, heads: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    sets = full_sets(ids, heads, texts, size)
    return (
        pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
        .mapInArrow(lambda batches: _confirm(batches, percent), "a long, b long")
    )


def _blocks(members: DataFrame, limit: int) -> DataFrame:
    """Cut nodes into groups of at most about two times `limit` rows.

    A node's minor members, those outside its largest component, are cut into
    blocks; each pair of these blocks is a group (kind 0), and so is each of
    them with each block of the major members (kind 1). Rows are marked as
    left, right or both, and only left is compared with right. So members of
    the largest component, however many, are copied once for each block of
    minor ones, and a node within the limit is one or two groups.
    """
    parts = F.greatest(F.ceil(F.col("n_minor") / F.lit(limit)), F.lit(1)).cast("int")
    major_parts = F.greatest(F.ceil(F.col("n_major") / F.lit(limit)), F.lit(1)).cast("int")
    placed = members.withColumns({"parts": parts, "major_parts": major_parts}).withColumn(
        "own", F.pmod(F.xxhash64("id"), F.when(F.col("is_major"), F.col("major_parts")).otherwise(F.col("parts"))).cast("int"))

    def group(kind: int, rows: DataFrame, over: str, low, high, left, right) -> DataFrame:
        spread = rows.select("*", F.explode(F.sequence(F.lit(0), F.col(over) - 1)).alias("other"))
        return spread.select(
            *_NODE, F.lit(kind).alias("kind"), low.alias("low"), high.alias("high"), *_CARRIED, "deep",
            left.alias("left"), right.alias("right"))

    own, other, yes, no = F.col("own"), F.col("other"), F.lit(True), F.lit(False)
    minor, major = placed.where(~F.col("is_major")), placed.where("is_major")
    return group(0, minor, "parts", F.least(own, other), F.greatest(own, other), own <= other, own >= other).unionByName(
        group(1, minor, "major_parts", own, other, yes, no)).unionByName(
        group(1, major, "parts", other, own, no, yes))


def least_equal(percent: int) -> int:
    """Coordinates that must agree for a pair to be confirmed on full sets.

    Four standard deviations below the mean at the asked similarity: at that
    very similarity, 3 pairs in 100,000 have fewer.
    """
    s = percent / 100.0
    return max(1, int(np.floor(COORDINATES * s - 4 * np.sqrt(COORDINATES * s * (1 - s)))))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    percent: int = 80,
    trees: int | None = None,
    node_limit: int = NODE_LIMIT,
) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    Two documents are linked when 100 * intersection >= percent * union of
    their distinct `size`-word shingles (a document with fewer words has its
    whole word sequence as one shingle). component_id is the smallest id that
    links reach, kept says that it is the document's own.

    A null, empty or blank text has no shingles and links with nothing. A
    repeated id is one document: it has one row, with the set of the largest
    (n_shingles, sum, xor of its hashes) if its texts differ. A null id keeps its
    row, with a null component, and is kept. Other columns are ignored, so
    their names cannot clash. An empty table gives an empty result.
    """
    trees = trees or trees_for(percent)
    children = children_for(percent, trees)
    renamed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    table = shared_table(profiles(renamed, size, trees), "profiles")
    # One row per id, then one class per distinct set, named by its smallest id.
    named = table.where("id IS NOT NULL").groupBy("id").agg(
        F.max(F.struct(*_SET)).alias("p")).select("id", "p.*")
    has_set = F.col("n_shingles") > 0
    classes = shared_table(named.where(has_set).groupBy(*_SET).agg(F.min("id").alias("class_id")), "classes")
    heads = table.join(classes.withColumnRenamed("class_id", "id"), ["id", *_SET], "left_semi")
    heads = shared_table(heads.dropDuplicates(["id"]), "heads")

    # The root's choices; documents alone in their node drop out before signatures travel.
    rows = heads.mapInArrow(lambda b: _tokens(b, trees), "tree int, node long, id long, n_shingles long")
    nodes = rows.groupBy(*_NODE).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "n_shingles")).alias("first")).where("n > 1")
    members = shared_table(rows.join(nodes.select(
        *_NODE, F.col("first.id").alias("pivot"), F.col("first.n_shingles").alias("n_pivot")), _NODE), "members")

    # First: each document against the first one of its nodes.
    enough = least_equal(percent)
    marks = heads.select("id", "signature")
    tries = members.where(F.col("id") != F.col("pivot")).where(
        100 * F.least("n_shingles", "n_pivot") >= percent * F.greatest("n_shingles", "n_pivot"))
    tries = tries.select("id", "pivot").distinct().join(marks, "id").join(
        marks.select(F.col("id").alias("pivot"), F.col("signature").alias("pivot_signature")), "pivot")
    tries = shared_table(tries.mapInArrow(lambda b: _likely(b, enough), "a long, b long"), "tries")
    links = shared_table(confirmed(tries, heads, renamed, size, percent), "links")

    # Then whoever is still apart, pair by pair.
    apart = members.select(*_NODE, "id", "n_shingles").join(components(links), "id", "left").withColumn(
        "component", F.coalesce("component", "id"))
    blocks = _search(apart, heads.select("id", "signature", "roots"), children, node_limit)
    open_ = shared_table(_dealt(blocks).mapInArrow(lambda b: _with_partner(b, enough, percent), blocks.schema), "open")
    sets = full_sets(open_.select("id"), heads, renamed, size)
    more = _dealt(open_.join(sets, "id")).mapInArrow(lambda b: _linked(b, enough, percent), "a long, b long")
    links = links.unionByName(shared_table(more.distinct(), "links"))
    reached = components(links).select(F.col("id").alias("class_id"), "component")
    classes = classes.join(reached, "class_id", "left").select(
        *_SET, F.coalesce("component", "class_id").alias("component_id"))
    placed = named.join(classes, _SET, "left").select(
        "id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    placed = placed.unionByName(table.where("id IS NULL").select(
        "id", "n_shingles", F.lit(None).cast("long").alias("component_id")))
    return placed.select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _likely(batches: Iterator[pa.RecordBatch], enough: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        same = (_matrix(batch.column("signature")) == _matrix(batch.column("pivot_signature"))).sum(axis=1)
        yield pa.RecordBatch.from_arrays(
            [batch.column("pivot"), batch.column("id")], names=["a", "b"]).filter(pa.array(same >= enough))


def _mixed(members: DataFrame) -> DataFrame:
    """Members of nodes that hold several components, and what is known of the node."""
    sizes = members.groupBy(*_NODE, "component").agg(F.count(F.lit(1)).alias("n"))
    nodes = sizes.groupBy(*_NODE).agg(
        F.count(F.lit(1)).alias("components"), F.max(F.struct("n", "component")).alias("major"), F.sum("n").alias("n"))
    nodes = nodes.where("components > 1").select(
        *_NODE, F.col("major.component").alias("major"), F.col("major.n").alias("n_major"),
        (F.col("n") - F.col("major.n")).alias("n_minor"))
    return members.join(nodes, _NODE).withColumn("is_major", F.col("component") == F.col("major")).drop("major")


def _dealt(blocks: DataFrame) -> DataFrame:
    return blocks.repartition(*_GROUP).sortWithinPartitions(*_GROUP)


def _search(members: DataFrame, marks: DataFrame, children: int, node_limit: int) -> DataFrame:
    """Blocks of nodes from all trees whose members are to be compared."""
    level = shared_table(_mixed(members), "level")
    small = F.col("n_minor") <= node_limit * EXACT_BLOCKS
    # In which trees a document's root node is compared as a whole.
    done = level.groupBy("id").agg(
        F.bit_or(F.when(small, F.expr("shiftleft(1L, tree)")).otherwise(F.lit(0).cast("long"))).alias("done"))
    level = level.join(done, "id").join(marks, "id")
    ready = []
    for depth in range(MAX_DEPTH + 1):
        level = shared_table(level.withColumn("deep", F.lit(depth > 0)), "level")
        last = depth == MAX_DEPTH
        ready.append(level if last else level.where(small))
        large = level.where(~small)
        if last or large.isEmpty():
            break
        level = _mixed(large.select(*_NODE, *_CARRIED).mapInArrow(lambda b: _branch(b, children), _MEMBERS))
    whole = ready[0]
    for more in ready[1:]:
        whole = whole.unionByName(more)
    return _blocks(whole, node_limit)


_ROW = "_near_dedup_row"


def first_of_each(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates: the one of the smallest id, null ids last.

    Rows are told apart by id and text together, so of an id with several texts
    each is judged on its own, rows that repeat both are copies, and so is a
    row without an id. Texts without words are in no group: all their rows stay.
    """
    worded = F.coalesce(F.col(text_col).rlike("[^\\x09-\\x0D\\x20]"), F.lit(False))
    keyed = docs.where(worded).withColumn(_ROW, F.xxhash64(F.col(id_col), F.col(text_col)))
    placed = near_duplicates(keyed.select(F.col(_ROW).alias("row"), F.col(text_col).alias("text")), "row", "text", percent=percent)
    ids = keyed.select(F.col(_ROW).alias("doc_id"), F.col(id_col).alias("id")).groupBy("doc_id").agg(F.first("id").alias("id"))
    chosen = placed.select("doc_id", "component_id").join(ids, "doc_id").groupBy("component_id").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "doc_id")).alias("least"))
    chosen = chosen.select(F.col("least.doc_id").alias(_ROW))
    # Equal rows are combined before the shuffle; the join finds them dealt by the same key.
    kept = keyed.dropDuplicates([_ROW]).join(chosen, _ROW, "left_semi").select(docs.columns)
    return kept.unionByName(docs.where(~worded))
