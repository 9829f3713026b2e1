"""Exact top-k by inner product with two cover trees, over queries and data together.

The top of the tree is a farthest-first net of a bounded sample. Every row,
query or not, goes to its nearest net point, and crowded net points are cut
into blocks. Inside a task, queries and data of a block each get a cover tree
with levels of halving radius, nested, separated and covering (see CoverTree).
For any q and r in two nodes with centres a, b and covering radii s, t,
    q . r <= a . b + |a| t + |b| s + s t,
so a pair of nodes is pruned when this is below the worst k-th score of the
query node's group. Queries first search their own block, which gives every
group its worst k-th score; net points that cannot beat it are never visited.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import shared_table

NET_POINTS = 256
SAMPLE_ROWS = 4096
NODE_ROWS = 2048  # rows a net point should have while the net is smaller than NET_POINTS
BLOCK_ROWS = 8192
QUERY_ROWS = 2048
LEAF_ROWS = 64
CHUNK = 256  # rows that are tried as centres at once
ROWS_AT_ONCE = 4096
OPEN_ROWS = 512  # rows of leaves that are multiplied at once
EXACT = float(1 << 53)
_LOWEST = np.iinfo(np.int64).min
_LARGE = 10 ** 300
_HIGHEST = np.iinfo(np.int64).max


def _scaled(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    """floor(scale * x) of valid vectors, as bytes of doubles; other rows leave."""
    for batch in batches:
        keep, out = [], []
        for k, value in enumerate(batch.column("vector")):
            row = value.as_py()
            if row is None or not len(row) or None in row:
                continue
            x = np.floor(np.asarray(row, dtype=np.float64) * scale) + 0.0
            if np.isfinite(x).all():
                keep.append(k)
                out.append(x.tobytes())
        yield pa.RecordBatch.from_arrays([
            batch.column("id").take(pa.array(keep, pa.int64())), pa.array(out, pa.binary()),
            batch.column("is_query").take(pa.array(keep, pa.int64()))], names=["id", "bytes", "is_query"])


def _matrix(column, dims: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros, which add nothing to a product."""
    return np.frombuffer(b"".join(v.ljust(8 * dims, b"\0") for v in column.to_pylist()), dtype=np.float64).reshape(-1, dims)


def net(points: np.ndarray, size: int) -> np.ndarray:
    """Farthest-first points: a net of every radius they are cut at."""
    if not len(points):
        return points
    chosen = [0]
    gap = _distances(points, points[:1])[:, 0]
    while len(chosen) < size and gap.max() > 0:
        far = int(gap.argmax())
        chosen.append(far)
        gap = np.minimum(gap, _distances(points, points[far:far + 1])[:, 0])
    return points[chosen]


def _lengths(rows: np.ndarray) -> np.ndarray:
    """Lengths of rows whose squares may be too large for a float."""
    top = float(np.abs(rows).max(initial=0.0))
    return top * np.sqrt(((rows / top) ** 2).sum(axis=1)) if top > 0 else np.zeros(len(rows))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    top = max(float(np.abs(a).max(initial=0.0)), float(np.abs(b).max(initial=0.0)))
    if top > 1e100:
        return top * _distances(a / top, b / top)
    squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0.0))


class CoverTree:
    """A cover tree over the rows of a matrix, as nodes over runs of `order`.

    Level l has centres `heads[l]`, rows of the matrix:
    - nesting: a centre of a level is one of every lower level;
    - separation: two centres of level l are more than 2^l apart;
    - covering: a centre that enters at level l has a parent among the centres
      of the levels above that lies within 2^(l + 1).
    Levels at which no centre enters are skipped. A centre with at most
    LEAF_ROWS rows is not refined; its rows are a leaf. Small leaves of one
    parent share a run, so that a step of the search has enough to multiply.
    `radius` is the true covering radius of a node over all rows below it.
    """

    def __init__(self, points: np.ndarray):
        self.points = points
        self.levels: list[tuple[float, list[int], list[int]]] = []  # (2^l, new centres, their parents)
        self.centre, self.radius, self.children, self.span = [], [], [], []
        self.order = np.arange(len(points))
        if len(points):
            self._nodes(self._refine())

    def _away(self, rows: np.ndarray, heads: np.ndarray, size: float) -> np.ndarray:
        """Distances of rows and heads; by differences where products would round them away."""
        if size > 1e-4 * self.top and self.top < 1e100:
            return _distances(self.points[rows] - self.points[0], self.points[heads] - self.points[0])
        return np.stack([_lengths(self.points[rows] - self.points[head]) for head in heads], axis=1)

    def _refine(self) -> np.ndarray:
        """Add levels from the top down; the nearest centre of every row."""
        n = len(self.points)
        self.top = float(_lengths(self.points - self.points[0]).max())
        self.levels.append((_power_above(self.top), [0], [0]))
        owner, gap = np.zeros(n, dtype=np.int64), _lengths(self.points - self.points[0])
        while True:
            large = np.bincount(owner, minlength=n)[owner] > LEAF_ROWS
            gap[large] = _lengths(self.points[large] - self.points[owner[large]])
            widest = float(gap[large].max(initial=0.0))
            if widest == 0:
                return owner
            size = _power_above(widest) / 2
            above, heads = owner.copy(), []
            open_rows = np.flatnonzero(large)
            waiting = open_rows[gap[open_rows] > size]
            while len(waiting):
                some = waiting[:CHUNK]
                apart = self._away(some, some, size) > size
                free = np.ones(len(some), dtype=bool)
                chosen = []
                for k in range(len(some)):
                    if free[k]:
                        chosen.append(k)
                        free &= apart[k]
                new = some[chosen]
                heads.extend(new.tolist())
                # A centre that is not refined keeps its rows, so distances only ever fall.
                for start in range(0, len(open_rows), ROWS_AT_ONCE):
                    rows = open_rows[start:start + ROWS_AT_ONCE]
                    away = self._away(rows, new, size)
                    near = away.argmin(axis=1)
                    least = away[np.arange(len(rows)), near]
                    closer = least < gap[rows]
                    gap[rows[closer]], owner[rows[closer]] = least[closer], new[near[closer]]
                gap[new], owner[new] = 0.0, new
                waiting = waiting[CHUNK:]
                waiting = waiting[gap[waiting] > size]
            self.levels.append((size, heads, above[heads].tolist()))

    def _nodes(self, owner: np.ndarray) -> None:
        """Nodes of the tree, and rows in the order of its leaves."""
        by_owner = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[by_owner], np.arange(len(owner) + 1))
        under: dict[int, list[list[int]]] = {}  # for each centre, the new centres of each level below it
        for _, heads, parents in self.levels[1:]:
            entered: dict[int, list[int]] = {}
            for head, parent in zip(heads, parents, strict=True):
                entered.setdefault(parent, []).append(head)
            for parent, group in entered.items():
                under.setdefault(parent, []).append(group)
        rows_below: dict[tuple[int, int], int] = {}
        stack = [(0, 0, False)]
        while stack:
            head, depth, ready = stack.pop()
            groups = under.get(head, [])
            if depth == len(groups):
                rows_below[head, depth] = int(cuts[head + 1] - cuts[head])
            elif ready:
                rows_below[head, depth] = rows_below[head, depth + 1] + sum(rows_below[h, 0] for h in groups[depth])
            else:
                stack.append((head, depth, True))
                stack += [(head, depth + 1, False), *((h, 0, False) for h in groups[depth])]
        order: list[np.ndarray] = []
        at = 0
        # Entries: a node (bags of small subtrees have several), its centre, its parent.
        todo = [([(0, 0)], 0, -1)]
        while todo:
            members, head, parent = todo.pop()
            node, size = len(self.span), sum(rows_below[m] for m in members)
            if parent >= 0:
                self.children[parent].append(node)
            self.centre.append(self.points[head])
            self.children.append([])
            self.span.append((at, at + size))
            if len(members) > 1 or size <= LEAF_ROWS or members[0][1] == len(under.get(members[0][0], [])):
                for member in members:
                    for centre in self._centres(member, under):
                        order.append(by_owner[cuts[centre]:cuts[centre + 1]])
                at += size
                continue
            top, depth = members[0]
            parts = [(top, depth + 1), *((h, 0) for h in under[top][depth])]
            bags, held = [[]], 0
            entries = []
            for part in parts:
                if rows_below[part] > LEAF_ROWS:
                    entries.append(([part], part[0], node))
                    continue
                if held + rows_below[part] > LEAF_ROWS and bags[-1]:
                    bags.append([])
                    held = 0
                bags[-1].append(part)
                held += rows_below[part]
            entries += [(bag, bag[0][0], node) for bag in bags if bag]
            # Spans of an inner node are those of the nodes that follow it, last in, first out.
            todo += reversed(entries)
        self.order = np.concatenate(order)

    @staticmethod
    def _centres(member: tuple[int, int], under: dict[int, list[list[int]]]) -> Iterator[int]:
        """All centres of a subtree."""
        waiting = [member]
        while waiting:
            head, depth = waiting.pop()
            yield head
            waiting += [(h, 0) for group in under.get(head, [])[depth:] for h in group]

    def finish(self) -> CoverTree:
        self.centre = np.array(self.centre)
        # A little larger than computed, to stay above rounding.
        self.radius = np.array([
            float(_lengths(self.points[self.order[a:b]] - centre).max()) * (1 + 1e-12)
            for (a, b), centre in zip(self.span, self.centre, strict=True)])
        return self


def _power_above(x: float) -> float:
    """The least power of two that is at least x."""
    part, power = math.frexp(x)
    return math.ldexp(1.0, min(power - (part == 0.5), 1023))


def bounds(a: np.ndarray, b: np.ndarray, t: np.ndarray, s: float = 0.0) -> np.ndarray:
    """Largest inner products between balls of radius s around the rows of `a` and balls around those of `b`."""
    norm_a, norm_b = _lengths(a)[:, None], _lengths(b)[None, :]
    with np.errstate(over="ignore", invalid="ignore"):
        top = a @ b.T + norm_a * t + norm_b * s + s * t + 1e-9 * (norm_a + s) * (norm_b + t)
    return np.where(np.isnan(top), np.inf, top)  # what is too large for a float is never pruned


def bound(a: np.ndarray, s: float, b: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The same for one ball around `a`."""
    return bounds(a[None], b, t, s)[0]


def _floats(scores: np.ndarray) -> np.ndarray:
    """Scores as floats; whole numbers too large for one count as the largest that are compared."""
    return np.clip(scores, -_LARGE, _LARGE).astype(np.float64) if scores.dtype == object else scores


class Best:
    """The k best (score, id) of each query, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, k: int, floor: np.ndarray, exact: bool):
        self.k, self.ids = k, ids
        self.scores = np.full((len(ids), k), -np.inf if exact else _LOWEST, dtype=np.float64 if exact else object)
        self.found = np.full((len(ids), k), _HIGHEST, dtype=np.int64)
        self.compared = 0  # pairs multiplied
        self.floor = floor  # a score that k other rows are known to reach

    def lowest(self, rows: np.ndarray) -> np.ndarray:
        """The k-th score of each query, or what it is known to be at least."""
        return np.maximum(_floats(self.scores[rows, -1]), self.floor[rows])

    def worst(self, rows: np.ndarray) -> float:
        """The worst k-th score of a group of queries."""
        return float(self.lowest(rows).min())

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        lowest = self.lowest(rows)
        other = self.ids[rows][:, None] != ids[None, :]
        useful = other & (_floats(scores) >= lowest[:, None])
        some = np.flatnonzero(useful.any(axis=1))
        if not len(some):
            return
        cols = np.flatnonzero(useful[some].any(axis=0))
        hidden = -np.inf if scores.dtype != object else _LOWEST
        offered = np.where(useful[np.ix_(some, cols)], scores[np.ix_(some, cols)], hidden)
        named = np.where(useful[np.ix_(some, cols)], ids[cols][None, :], _HIGHEST)
        all_scores = np.concatenate([self.scores[rows[some]], offered], axis=1)
        all_ids = np.concatenate([self.found[rows[some]], named], axis=1)
        order = np.lexsort((all_ids, -all_scores), axis=1)[:, :self.k]
        self.scores[rows[some]] = np.take_along_axis(all_scores, order, axis=1)
        self.found[rows[some]] = np.take_along_axis(all_ids, order, axis=1)


def dual_search(queries: CoverTree, data: CoverTree, data_ids: np.ndarray, best: Best) -> None:
    """Walk down both trees, query groups first, and prune by covering radii."""
    exact = best.scores.dtype != object

    waiting = [(0, np.array([0]))] if len(queries.points) and len(data.points) else []
    while waiting:
        node, frontier = waiting.pop()
        start, end = queries.span[node]
        rows = queries.order[start:end]
        top = bound(queries.centre[node], queries.radius[node], data.centre[frontier], data.radius[frontier])
        frontier = frontier[top >= best.worst(rows)]
        if not len(frontier):
            continue
        if queries.children[node]:
            opened = [c for f in frontier for c in (data.children[f] or [f])]
            waiting += [(child, np.array(opened)) for child in reversed(queries.children[node])]
            continue
        while len(frontier):
            # A leaf of queries: each has its own bound, the most promising data nodes come first.
            tops = bounds(queries.points[rows], data.centre[frontier], data.radius[frontier])
            order = np.argsort(-tops.max(axis=0), kind="stable")
            frontier, tops = frontier[order], tops[:, order]
            inner, first = [], 0
            while first < len(frontier):
                hopeful = tops[:, first:] >= best.lowest(rows)[:, None]
                taken, leaves, size, seen = [], [], 0, len(frontier)
                for at in np.flatnonzero(hopeful.any(axis=0)).tolist():
                    node_at = int(frontier[first + at])
                    if data.children[node_at]:
                        inner.extend(data.children[node_at])
                        continue
                    taken.append(at)
                    leaves.append(data.order[data.span[node_at][0]:data.span[node_at][1]])
                    size += len(leaves[-1])
                    if size >= OPEN_ROWS:
                        seen = first + at + 1
                        break
                if not leaves:
                    break
                asked, others = rows[hopeful[:, taken].any(axis=1)], np.concatenate(leaves)
                first = seen
                left, right = queries.points[asked], data.points[others]
                if exact:
                    scores = left @ right.T
                else:
                    scores = np.array([[int(x) for x in row] for row in left], dtype=object) @ np.array(
                        [[int(x) for x in row] for row in right], dtype=object).T
                best.compared += len(asked) * len(others)
                best.offer(asked, scores, data_ids[others])
            frontier = np.array(inner, dtype=np.int64)


def _search(queries: pa.Table, data: pa.Table, k: int, dims: int) -> pa.Table:
    q, r = _matrix(queries.column("bytes"), dims), _matrix(data.column("bytes"), dims)
    largest = max(np.abs(q).max(initial=0), 1) * max(np.abs(r).max(initial=0), 1) * dims
    floor = queries.column("floor").to_numpy().astype(np.float64)
    ids = queries.column("id").to_numpy()
    best = Best(ids, k, floor, largest < EXACT)
    dual_search(CoverTree(q).finish(), CoverTree(r).finish(), data.column("id").to_numpy(), best)
    row, place = np.nonzero(best.found != _HIGHEST)
    scores = best.scores[row, place]
    scores = [min(max(int(s), _LOWEST), _HIGHEST) for s in scores.tolist()]
    return pa.table({"query_id": pa.array(ids[row], pa.int64()), "id": pa.array(best.found[row, place], pa.int64()),
                     "score": pa.array(scores, pa.int64())})


def _assign(batches: Iterator[pa.RecordBatch], points: np.ndarray) -> Iterator[pa.RecordBatch]:
    dims = points.shape[1]
    for batch in batches:
        for start in range(0, batch.num_rows, 2048):
            part = batch.slice(start, 2048)
            gaps = _distances(_matrix(part.column("bytes"), dims), points)
            node = gaps.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(node.astype(np.int32)), pa.array(gaps[np.arange(len(node)), node])],
                names=[*part.schema.names, "node", "gap"])


def _reachable(
    batches: Iterator[pa.RecordBatch], points: np.ndarray, radii: np.ndarray, nodes: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """For each query group, the net points whose ball may beat its worst k-th score."""
    for batch in batches:
        groups, found = [], []
        for k, (node, gap, worst) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("node", "gap", "worst")], strict=True)):
            top = bound(points[node], gap * (1 + 1e-9) + 1e-6, points[nodes], radii * (1 + 1e-9) + 1e-6)
            hits = nodes[top >= worst]
            found.append(hits)
            groups.append(np.full(len(hits), k))
        rows = pa.array(np.concatenate(groups) if groups else np.zeros(0, dtype=np.int64))
        hits = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([
            batch.column("node").take(rows), batch.column("part").take(rows), pa.array(hits.astype(np.int32))],
            names=["node", "part", "data_node"])


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 10, scale: float = 1024.0,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """The k best rows of `vectors` for each id of `queries` (one column of ids).

    Scores are integer inner products of floor(scale * x). Returns query_id,
    rank (from 1), vec_id, score; fewer rows when fewer candidates exist. A
    query's own row, and any row with its id, is no candidate; ties go to the
    smaller id. Vectors that are null, empty, or hold null or non-finite
    components take no part, nor do null ids. A shorter vector counts as ending
    in zeros. A repeated id is one vector, the one with the greatest bytes.
    Products beyond 2^53 are computed with whole numbers; a score outside the
    64-bit range becomes its nearest bound. Other columns are ignored. An empty
    table gives no rows.

    The net is drawn from at most SAMPLE_ROWS rows and has at most NET_POINTS
    points; it only steers the search, every row is indexed and the result is exact.
    """
    wanted = queries.select(F.col(queries.columns[0]).cast("long").alias("id")).distinct().withColumn(
        "is_query", F.lit(True))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where(
        "id IS NOT NULL").join(wanted, "id", "left").withColumn("is_query", F.coalesce("is_query", F.lit(False)))
    rows = rows.mapInArrow(lambda b: _scaled(b, scale), "id long, bytes binary, is_query boolean")
    rows = shared_table(rows.groupBy("id").agg(
        F.max("bytes").alias("bytes"), F.max("is_query").alias("is_query")), "vectors")
    n, asked, size = rows.agg(
        F.count(F.lit(1)), F.count_if("is_query"), F.coalesce(F.max(F.length("bytes")), F.lit(8))).first()
    dims = size // 8
    every = max(n // SAMPLE_ROWS, 1)
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).limit(SAMPLE_ROWS).select("bytes").toArrow()
    size = min(NET_POINTS, max(16, n // NODE_ROWS))
    points = net(_matrix(sample.column("bytes"), dims), size) if sample.num_rows else np.zeros((1, dims))
    placed = shared_table(rows.mapInArrow(
        lambda b: _assign(b, points), "id long, bytes binary, is_query boolean, node int, gap double"), "placed")
    # One row for each of at most NET_POINTS net points.
    stats = placed.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius")).toArrow()
    nodes = stats.column("node").to_numpy().astype(np.int64)
    radii = stats.column("radius").to_numpy()
    spark = vectors.sparkSession
    parts = spark.createDataFrame(
        [(int(v), int(-(-c // BLOCK_ROWS))) for v, c in zip(nodes, stats.column("n").to_pylist(), strict=True)],
        "node int, parts int")
    placed = placed.join(F.broadcast(parts), "node").withColumn(
        "part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    block = ["node", "part"]
    asked_rows = placed.where("is_query")

    # Every query in its own block.
    result = "query_id long, id long, score long"
    own_blocks = asked_rows.select(*block).distinct()
    home = placed.join(own_blocks, block, "left_semi").select(*block, "id", "bytes")
    askers = shared_table(asked_rows.select(*block, "id", "bytes", F.lit(float("-inf")).alias("floor")), "askers")
    first = shared_table(askers.groupBy(*block).cogroup(home.groupBy(*block)).applyInArrow(
        lambda q, r: _search(q, r, k, dims), result), "first")
    floors = first.groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"))
    floors = floors.where(F.col("n") >= k).select("id", F.col("low").cast("double").alias("low"))
    ready = shared_table(asked_rows.select(*block, "id", "bytes", "gap").join(floors, "id", "left").withColumn(
        "floor", F.coalesce("low", F.lit(float("-inf")))).drop("low"), "queries")

    # Each group of queries in the blocks it cannot rule out.
    groups = ready.groupBy(*block).agg(F.max("gap").alias("gap"), F.min("floor").alias("worst"))
    ways = groups.mapInArrow(
        lambda b: _reachable(b, points, radii, nodes), "node int, part int, data_node int")
    ways = ways.join(F.broadcast(parts.select(F.col("node").alias("data_node"), "parts")), "data_node").select(
        *block, "data_node", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("data_part")).where(
        "NOT (node = data_node AND part = data_part)")
    chunks = max(-(-asked // QUERY_ROWS), 1)
    ways = ways.withColumn("chunk", F.pmod(F.xxhash64(*block), F.lit(chunks)).cast("int"))
    target = ["data_node", "data_part", "chunk"]
    visitors = ready.join(ways, block).select(*target, "id", "bytes", "floor")
    hosts = placed.select(F.col("node").alias("data_node"), F.col("part").alias("data_part"), "id", "bytes").join(
        ways.select(*target).distinct(), ["data_node", "data_part"]).select(
        *[F.col(c).alias(c) for c in [*target, "id", "bytes"]])
    second = visitors.groupBy(*target).cogroup(hosts.groupBy(*target)).applyInArrow(
        lambda q, r: _search(q, r, k, dims), result)
    ranked = first.unionByName(second).withColumn(
        "rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
