"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors u, v have |u - v|^2 = 2 - 2 cos. The vectors are rotated (seeded
signs, then a Walsh-Hadamard transform, which keeps distances) and split into
blocks of few dimensions. If the whole squared distance is within the budget,
at least one block is within its proportional share. So each block is joined by
range: rows are cut into grid cells as wide as the block's diameter, and a row
also visits the neighbouring cells its ball touches. The union of the blocks'
candidates is then verified with exact cosines. A pair counts in the first
block that finds it, so no list of pairs is needed to count links once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .tables import shared_table
from .text_hash import mix, stream

BLOCK_DIMS = 8
CELL_ROWS = 1000
GROUP_ROWS = 2048
PAIRS_AT_ONCE = 1 << 15
_SLACK = 1e-9


def _valid(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes of numbers; null where a vector can link with nothing."""
    for batch in batches:
        out = []
        for value in batch.column("vector"):
            row = value.as_py()
            ok = row is not None and len(row) > 0 and None not in row
            x = np.asarray(row, dtype=kind) + np.zeros(1, dtype=kind) if ok else None  # no negative zeros
            out.append(x.tobytes() if ok and np.isfinite(x).all() and x.any() else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("label"), pa.array(out, pa.binary())], names=["id", "label", "bytes"])


def _matrix(column: pa.Array, dims: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), dims).astype(np.float64)


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def rotated(units: np.ndarray) -> np.ndarray:
    """Seeded signs and a Walsh-Hadamard transform, padded to a power of two."""
    n, dims = units.shape
    width = 1 << (dims - 1).bit_length()
    x = np.zeros((n, width))
    x[:, :dims] = units * np.where(stream(5, dims) >> np.uint64(63), 1.0, -1.0)
    step = 1
    while step < width:
        x = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        step *= 2
    return x.reshape(n, width) / np.sqrt(width)


def _layout(dims: int) -> tuple[int, int]:
    width = 1 << (dims - 1).bit_length()
    size = min(BLOCK_DIMS, width)
    return width // size, size


def _cells(batches: Iterator[pa.RecordBatch], budget: float, kind: str) -> Iterator[pa.RecordBatch]:
    """Each row in its own cell of every block, and as a visitor in later cells it reaches."""
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            yield from _cells_of(batch.slice(start, 1000), budget, kind)


def _cells_of(batch: pa.RecordBatch, budget: float, kind: str) -> Iterator[pa.RecordBatch]:
    dims, grid = batch.column("dims").to_numpy(), batch.column("grid").to_numpy()
    for d in np.unique(dims):
        blocks, size = _layout(int(d))
        reach = np.sqrt(budget / blocks + _SLACK) * (1 + 1e-6)
        for g in np.unique(grid[dims == d]):
            rows = np.flatnonzero((dims == d) & (grid == g))
            part = batch.take(pa.array(rows))
            x = rotated(unit(_matrix(part.column("bytes"), int(d), kind))).reshape(len(rows), blocks, size)
            for block in range(blocks):
                yield from _block_cells(part, x[:, block, :min(int(g), size)] / (2 * reach), block)


def _block_cells(part: pa.RecordBatch, at: np.ndarray, block: int) -> Iterator[pa.RecordBatch]:
    """`at`: coordinates in cell widths, so that a ball's radius is a half."""
    n, g = at.shape
    home = np.floor(at)
    offset = at - home
    side = np.where(offset < 0.5, -1.0, 1.0)
    gap = np.minimum(offset, 1 - offset)
    for subset in range(1 << g):
        chosen = [k for k in range(g) if subset >> k & 1]
        touched = (gap[:, chosen] ** 2).sum(axis=1) <= 0.25 + 1e-12
        if chosen:
            touched &= side[:, chosen[0]] > 0  # only the lower of two cells visits
        rows = np.flatnonzero(touched)
        if not len(rows):
            continue
        cell = home[rows].copy()
        cell[:, chosen] += side[rows][:, chosen]
        key = np.full(len(rows), block + 1, dtype=np.uint64)
        for k in range(g):
            key = mix(key ^ cell[:, k].astype(np.int64).view(np.uint64)) + np.uint64(k)
        own = part.take(pa.array(rows))
        yield pa.RecordBatch.from_arrays(
            [own.column("label"), own.column("dims"), pa.array(np.full(len(rows), block, dtype=np.int32)),
             pa.array(key.view(np.int64)), pa.array(np.full(len(rows), not chosen)), own.column("id"),
             own.column("copies"), own.column("bytes")],
            names=["label", "dims", "block", "cell", "own", "id", "copies", "bytes"])


_GROUP = ["label", "dims", "block", "cell", "low", "high"]


def _join(batches: Iterator[pa.RecordBatch], budget: float, cosine: float, kind: str) -> Iterator[pa.RecordBatch]:
    """Verified links of sorted groups: each linked row's count and smallest neighbour."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        starts = _starts(table)
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            yield from _links(table.slice(a, b - a), budget, cosine, kind)
        rest = table.slice(starts[-1])
    if rest is not None and rest.num_rows:
        yield from _links(rest, budget, cosine, kind)


def _starts(table: pa.Table) -> np.ndarray:
    change = np.zeros(table.num_rows, dtype=bool)
    change[:1] = True
    for name in _GROUP:
        values = table.column(name).to_numpy()
        change[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(change) if len(change) else np.zeros(1, dtype=np.int64)


def _links(group: pa.Table, budget: float, cosine: float, kind: str) -> Iterator[pa.RecordBatch]:
    if group.num_rows < 2:
        return
    dims, block = group.column("dims")[0].as_py(), group.column("block")[0].as_py()
    blocks, size = _layout(dims)
    vectors = _matrix(group.column("bytes").combine_chunks(), dims, kind)
    units = unit(vectors)
    x = rotated(units).reshape(len(units), blocks, size)
    share = budget / blocks + _SLACK
    ids, copies = group.column("id").to_numpy(), group.column("copies").to_numpy()
    own, left, right = (group.column(c).to_numpy() for c in ("own", "left", "right"))
    one, other = [], []
    whole = group.column("low")[0].as_py() == group.column("high")[0].as_py()
    lefts, rights = np.flatnonzero(left), np.flatnonzero(right)
    for start in range(0, len(lefts), 256):
        rows = lefts[start:start + 256]
        near = _within(x[rows, block], x[rights, block], share)
        near &= own[rows][:, None] | own[rights][None, :]
        if whole:
            near &= rows[:, None] < rights[None, :]
        for earlier in range(block):
            if np.count_nonzero(near) <= 8 * len(rows):
                break
            near &= ~_within(x[rows, earlier], x[rights, earlier], share - 2 * _SLACK)
        i, j = np.nonzero(near)
        i, j = rows[i], rights[j]
        for at in range(0, len(i), PAIRS_AT_ONCE):
            a, b = i[at:at + PAIRS_AT_ONCE], j[at:at + PAIRS_AT_ONCE]
            apart = x[a, :block + 1] - x[b, :block + 1]
            within = (apart * apart).sum(axis=2) <= share
            hit = within[:, block] & ~within[:, :block].any(axis=1)
            hit &= np.einsum("ij,ij->i", units[a], units[b]) >= cosine
            one.append(a[hit])
            other.append(b[hit])
    if not one:
        return
    a, b = np.concatenate(one), np.concatenate(other)
    if not len(a):
        return
    n = len(ids)
    links = np.bincount(a, weights=copies[b], minlength=n) + np.bincount(b, weights=copies[a], minlength=n)
    root = ids.copy()
    while True:
        before = root.copy()
        np.minimum.at(root, a, before[b])
        np.minimum.at(root, b, before[a])
        if (root == before).all():
            break
    linked = links > 0
    yield pa.RecordBatch.from_arrays(
        [pa.array(ids[linked]), pa.array(links[linked].astype(np.int64)), pa.array(root[linked])],
        names=["id", "links", "root"])


def _within(one: np.ndarray, other: np.ndarray, limit: float) -> np.ndarray:
    squares = (one * one).sum(axis=1)[:, None] + (other * other).sum(axis=1)[None, :]
    return squares - 2 * (one @ other.T) <= limit + _SLACK


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = 0.98,
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors with equal, non-null labels and equal lengths link when their
    cosine, in doubles, is at least `cosine`. n_links counts the other vectors
    linked directly, component_id is the smallest id that links reach, kept
    says that it is the vector's own.

    Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing, and so do those with a null label; they keep their rows.
    Equal vectors of a label form one class, compared once and counted with its
    copies. A repeated id is one vector: of differing rows the one with the
    greatest (label, bytes) counts. A null id keeps its row, links with nothing
    and is kept. Other columns are ignored. An empty table gives no rows.
    """
    budget = 2 - 2 * cosine
    label_type = vectors.schema[label_col].dataType
    # Single-precision vectors travel as such; all arithmetic is in doubles.
    single = isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType)
    kind, width = ("<f4", 4) if single else ("<f8", 8)
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    schema = T.StructType([
        T.StructField("id", T.LongType()), T.StructField("label", label_type), T.StructField("bytes", T.BinaryType())])
    rows = shared_table(rows.mapInArrow(lambda b: _valid(b, kind), schema), "vectors")
    named = rows.where("id IS NOT NULL").groupBy("id").agg(
        F.max(F.struct("label", "bytes")).alias("v")).select("id", "v.*")
    usable = F.col("label").isNotNull() & F.col("bytes").isNotNull()
    classes = shared_table(named.where(usable).groupBy("label", "bytes").agg(
        F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies")
    ).withColumn("dims", (F.length("bytes") / width).cast("int")), "classes")

    # As many grid coordinates as bring a label's cells to the wanted size.
    counts = classes.groupBy("label", "dims").agg(F.count(F.lit(1)).alias("n"))
    grid = F.greatest(F.lit(0), F.least(F.lit(BLOCK_DIMS), F.ceil(
        F.log(F.col("n") / CELL_ROWS) / F.log(F.lit(3.0))))).cast("int")
    placed = classes.join(counts.select("label", "dims", grid.alias("grid")), ["label", "dims"]).select(
        F.xxhash64("label").alias("label"), "dims", "grid", F.col("class_id").alias("id"), "copies", "bytes")
    cells = placed.mapInArrow(
        lambda b: _cells(b, budget, kind),
        "label long, dims int, block int, cell long, own boolean, id long, copies long, bytes binary")
    found = shared_table(_blocks(cells).repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(
        lambda b: _join(b, budget, cosine, kind), "id long, links long, root long"), "links")
    counted = found.groupBy("id").agg(F.sum("links").alias("links"))
    reached = components(found.select("id", "root"))
    classes = classes.join(counted.withColumnRenamed("id", "class_id"), "class_id", "left").join(
        reached.select(F.col("id").alias("class_id"), "component"), "class_id", "left").select(
        "label", "bytes", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "class_id").alias("component_id"))
    out = named.join(classes, ["label", "bytes"], "left").select(
        "id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    none = rows.where("id IS NULL").select(
        "id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(none).select(
        F.col("id").alias("vec_id"), F.col("n_links").cast("long").alias("n_links"), "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _blocks(cells: DataFrame) -> DataFrame:
    """Cut crowded cells into blocks and pair the blocks, as rows marked left or right."""
    cell = ["label", "dims", "block", "cell"]
    counts = cells.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("n"), F.max("own").alias("has_own")).where("n > 1 AND has_own")
    many = F.ceil(F.col("n") / F.lit(GROUP_ROWS)).cast("int")
    placed = cells.join(counts, cell).withColumn("many", many).withColumn(
        "part", F.pmod(F.xxhash64("id"), F.col("many")).cast("int"))
    spread = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("partner"))
    return spread.select(
        *cell, F.least("part", "partner").alias("low"), F.greatest("part", "partner").alias("high"),
        (F.col("part") <= F.col("partner")).alias("left"), (F.col("part") >= F.col("partner")).alias("right"),
        "own", "id", "copies", "bytes")
