"""The index over parts of bit vectors against all pairs."""

import random

import pytest

from lumenact.operators import neighbor_index as ni

VECTORS, ASKED = "neighbor_id long, bits array<long>", "query_id long, bits array<long>"


def words(value, n_bits):
    return [value >> start & (1 << 63) - 1 for start in range(0, n_bits, 63)]


def search(spark, train, test, k, n_bits, block_rows):
    near, report = ni.nearest_by_index(
        spark.createDataFrame([(i, words(v, n_bits)) for i, v in train], VECTORS),
        spark.createDataFrame([(i, words(v, n_bits)) for i, v in test], ASKED), k, n_bits, block_rows)
    got = {i: [] for i, _ in test}
    for r in near.collect():
        got[r["query_id"]].append((r["distance"], r["neighbor_id"]))
    want = {i: sorted(((a ^ b).bit_count(), j) for j, b in train)[:k] for i, a in test}
    assert {i: sorted(v) for i, v in got.items()} == want
    report = {r["query_id"]: r for r in report.collect()}
    assert set(report) == set(want)
    return report


@pytest.mark.parametrize("block_rows", [50, 10_000])
def test_clusters_are_met_without_all_pairs(spark, block_rows):
    """Near copies of random 100-bit vectors, over two words: a small share of the pairs is compared."""
    rng = random.Random(1)
    heads = [rng.getrandbits(100) for _ in range(40)]
    vectors = {rng.choice(heads) ^ sum(1 << i for i in rng.sample(range(100), 3)) for _ in range(900)}
    train = list(enumerate(sorted(vectors)))
    test = [(1000 + i, rng.choice(heads) ^ 1 << rng.randrange(100)) for i in range(30)]
    report = search(spark, train, test, 5, 100, block_rows)
    assert sum(r["compared"] for r in report.values()) < 0.35 * len(train) * len(test)


def test_sparse_vectors_share_their_parts(spark):
    """Mostly zeros: one part value holds most vectors and is cut into blocks, queries too."""
    rng = random.Random(2)
    vectors = {sum(1 << i for i in rng.sample(range(80), rng.randrange(4))) for _ in range(600)}
    search(spark, list(enumerate(sorted(vectors))), [(900 + i, 1 << i | 1) for i in range(60)], 4, 80, 25)


@pytest.mark.parametrize("train", [[], [(1, 5)], [(1, 5), (2, 6)]])
def test_fewer_vectors_than_wanted(spark, train):
    search(spark, train, [(10, 5), (11, 1 << 69)], 3, 70, 10)


def test_no_queries(spark):
    assert search(spark, [(1, 5)], [], 3, 8, 10) == {}
