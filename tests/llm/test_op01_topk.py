import numpy as np
import pytest

from lumenact.llm import topk_search
from lumenact.llm.topk_search import top_k

SCHEMA = "vec_id long, embedding array<double>, query_id string"  # a clashing extra column


def brute(rows, k, scale=1024.0):
    best = {}
    for i, v, _ in rows:
        ok = i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)
        if ok:
            best[i] = max(best.get(i, b""), np.floor(np.array(v) * scale).tobytes())
    ints = {i: [int(x) for x in np.frombuffer(b)] for i, b in best.items()}
    out = {}
    for q in ints:
        if q % 100 == 0:
            scored = [(-sum(a * b for a, b in zip(ints[q], ints[r], strict=False)), r) for r in ints if r != q]
            out[q] = [(i + 1, r, -s) for i, (s, r) in enumerate(sorted(scored)[:k])]
    return out


def run(spark, rows, k=10):
    df = spark.createDataFrame(rows, SCHEMA)
    found = {}
    for r in top_k(df, df.where("vec_id % 100 = 0").select("vec_id"), k).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return found


def test_clusters_ties_and_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK_ROWS", 100)
    monkeypatch.setattr(topk_search, "QUERY_ROWS", 4)
    random = np.random.default_rng(3)
    centres = random.normal(size=(5, 12))
    rows = [(int(i), [float(x) for x in centres[i % 5] + (0 if i % 3 == 0 else 0.05) * random.normal(size=12)], "x")
            for i in range(0, 2400, 2)]
    assert run(spark, rows) == brute(rows, 10)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], "a"), (100, [1.0], "a"), (100, [1.0], "a"), (200, [nan, 1.0], "a"), (300, None, "a"),
            (400, [], "a"), (1, [None, 1.0], "a"), (2, [inf, 0.0], "a"), (3, [0.5, 0.5, 7.0], "a"), (None, [9.0, 9.0], "a"),
            (4, [1e12, -1e12], "a"), (5, [0.5, 0.5], "a"), (6, [0.5, 0.5], None)]
    assert run(spark, rows, 3) == brute(rows, 3)


def test_empty(spark):
    assert run(spark, []) == {}


@pytest.mark.parametrize("dims", [1, 3])
def test_bound_holds(dims):
    random = np.random.default_rng(dims)
    points = np.floor(random.normal(size=(400, dims)) * 100)
    tree = topk_search.CoverTree(points).finish()
    for node, (start, end) in enumerate(tree.span):
        rows = points[tree.order[start:end]]
        gaps = np.sqrt(((rows - tree.centre[node]) ** 2).sum(axis=1))
        assert gaps.max() <= tree.radius[node] + 1e-9
        top = topk_search.bound(points[7], 0.0, tree.centre[node:node + 1], tree.radius[node:node + 1])[0]
        assert (rows @ points[7]).max() <= top


def test_very_wide_ranges_make_deep_trees():
    """Distances that halve a thousand times, and squares beyond the floats."""
    points = np.array([[s * 2.0 ** i] for i in range(1000) for s in (1, -1)])
    tree = topk_search.CoverTree(points).finish()
    assert sorted(tree.order.tolist()) == list(range(2000))
    for node, (start, end) in enumerate(tree.span):
        away = np.abs(points[tree.order[start:end], 0] - tree.centre[node][0])
        assert away.max() <= tree.radius[node]
    asked = topk_search.CoverTree(points[::400]).finish()
    ids = np.arange(2000)
    best = topk_search.Best(ids[::400], 3, np.full(5, -np.inf), False)
    with np.errstate(all="ignore"):
        topk_search.dual_search(asked, tree, ids, best)
    for i, found in zip(ids[::400], best.found, strict=True):
        scores = [(-int(points[i, 0]) * int(points[j, 0]), j) for j in ids if j != i]
        assert found.tolist() == [j for _, j in sorted(scores)[:3]]


def check_levels(points):
    """Nesting, separation and covering of every level; all rows in the leaves."""
    tree = topk_search.CoverTree(points).finish()
    assert sorted(tree.order.tolist()) == list(range(len(points)))
    centres = []
    for size, heads, parents in tree.levels:
        if centres:
            assert set(parents) <= set(centres)
            away = np.sqrt(((points[heads] - points[parents]) ** 2).sum(axis=1))
            assert away.max() <= 2 * size * (1 + 1e-6)
        centres += heads
        gaps = topk_search._distances(points[centres], points[centres])
        gaps[np.arange(len(centres)), np.arange(len(centres))] = np.inf
        assert len(set(centres)) == len(centres) and gaps.min() > size * (1 - 1e-6)
    sizes = [size for size, _, _ in tree.levels]
    assert sizes == sorted(sizes, reverse=True) and all(np.frexp(size)[0] == 0.5 for size in sizes)
    for node, (start, end) in enumerate(tree.span):
        gaps = np.sqrt(((points[tree.order[start:end]] - tree.centre[node]) ** 2).sum(axis=1))
        assert gaps.max() <= tree.radius[node] + 1e-9
        inner = [tree.span[child] for child in tree.children[node]]
        assert not inner or (inner[0][0], inner[-1][1]) == (start, end)
        assert all(a[1] == b[0] for a, b in zip(inner, inner[1:], strict=False))
    return tree


def test_levels_of_the_given_embeddings(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("embedding").toPandas()["embedding"]
    points = np.floor(np.stack(rows.to_numpy()).astype(np.float64) * 1024)
    assert len(check_levels(points).levels) > 1


@pytest.mark.parametrize("dims", [1, 2, 5])
def test_levels_of_clusters_and_copies(dims, monkeypatch):
    monkeypatch.setattr(topk_search, "LEAF_ROWS", 4)
    random = np.random.default_rng(dims)
    points = np.floor(random.normal(size=(40, dims)) * 1000)[random.integers(0, 40, 1500)]
    points[:700] += np.floor(random.normal(size=(700, dims)) * 3)
    assert len(check_levels(points).levels) > 5


def test_search_prunes_far_clusters():
    random = np.random.default_rng(1)
    centres = random.normal(size=(60, 8)) * 4000
    points = np.floor(centres[random.integers(0, 60, 6000)] + random.normal(size=(6000, 8)) * 20)
    ids = np.arange(6000)
    asked = topk_search.CoverTree(points[::100]).finish()
    best = topk_search.Best(ids[::100], 10, np.full(60, -np.inf), True)
    topk_search.dual_search(asked, topk_search.CoverTree(points).finish(), ids, best)
    scores = points[::100] @ points.T
    scores[np.arange(60), ids[::100]] = -np.inf
    assert (best.scores == -np.sort(-scores, axis=1)[:, :10]).all()
    assert best.compared < 0.3 * 60 * 6000
