import numpy as np

import __spark_entry__ as entry
from lumenact.llm import embedding_dedup
from lumenact.llm.embedding_dedup import near_vectors
from tests.conftest import SF

SCHEMA = "vec_id long, embedding array<double>, label int, component_id string"


def brute(rows, cosine=0.98):
    kept = {}
    for i, v, label, *_ in rows:
        if i is None:
            continue
        ok = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) and label is not None
        x = np.array(v, dtype=float) if ok else None
        kept[i] = (label, x / np.abs(x).max()) if ok else None
    ids = sorted(kept)
    root = {i: i for i in ids}
    links = dict.fromkeys(ids, 0)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1:]:
            a, b = kept[i], kept[j]
            if a is None or b is None or a[0] != b[0] or len(a[1]) != len(b[1]):
                continue
            if a[1] @ b[1] / np.sqrt(a[1] @ a[1]) / np.sqrt(b[1] @ b[1]) >= cosine:
                links[i] += 1
                links[j] += 1
                u, w = sorted((find(i), find(j)))
                root[w] = u
    return {i: (links[i], find(i), find(i) == i) for i in ids}


def run(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(df).collect()}


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"])
           for r in entry.queries()["op8_subspace_embedding_dedup"](spark, SF).collect()}
    assert got == brute(rows)


def test_crowded_cells_and_grids(spark, monkeypatch):
    random = np.random.default_rng(5)
    rows, i = [], 0
    for size in (150, 60, 1, 1, 1, 8):
        centre = random.normal(size=24)
        for _ in range(size):
            rows.append((i, [float(x) for x in centre + 0.15 * random.normal(size=24)], i % 2, "c"))
            i += 1
    rows += [(1000 + k, rows[k][1], rows[k][2], "c") for k in range(0, 90, 3)]
    expected = brute(rows)
    assert sum(v[0] for v in expected.values()) > 1000
    for cells, group in ((10_000, 32), (5, 40), (1, 1024)):
        monkeypatch.setattr(embedding_dedup, "CELL_ROWS", cells)
        monkeypatch.setattr(embedding_dedup, "GROUP_ROWS", group)
        assert run(spark.createDataFrame(rows, SCHEMA)) == expected


def test_odd_rows(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 1, "a"), (2, [2.0, 0.0], 1, "a"), (2, [2.0, 0.0], 1, "a"), (3, [1.0, 0.0], None, "a"),
            (4, [1.0, 0.0], 2, "a"), (5, [0.0, 0.0], 1, "a"), (6, [nan, 0.0], 1, "a"), (7, [None, 1.0], 1, "a"), (8, None, 1, "a"),
            (9, [], 1, "a"), (10, [1.0, 0.0, 0.0], 1, "a"), (11, [1e300, 1e-300], 1, "a"), (12, [-0.0, 1.0], 1, "a"),
            (13, [0.0, 1.0], 1, "a")]
    df = spark.createDataFrame(rows + [(None, [1.0, 0.0], 1, "a")], SCHEMA)
    got = run(df)
    assert got.pop(None) == (0, None, True)
    assert got == brute(rows)
    assert run(df.limit(0)) == {}
