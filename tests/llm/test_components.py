import random

from lumenact.llm.components import components


def test_random_graphs(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(100, 140)] + [(500, k) for k in range(501, 560)]
    edges += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(110)] + [(7, 7), (None, 3), (3, None)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = dict(components(spark.createDataFrame(edges, "one long, other long")).collect())
    assert {i: got.get(i, i) for i in root} == {i: find(i) for i in root}


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
