import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lumenact.llm import labelled, quality, toxicity
from lumenact.llm.queries import fold

SMALL = "/root/testdata/sf0.01"
ODD = [(1, None, "x"), (2, "", "x"), (None, "some words here", "x"), (3, "a " * 50_000, None), (3, "a " * 50_000, None), (4, "!", "y")]


def read(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


def test_quality_of_held_out_documents(spark):
    rows = entry.queries()["op6_nb_svm_quality"](spark, SMALL)
    assert rows.count() == read(spark, "documents").count()
    both = rows.join(read(spark, "labels"), "doc_id").where("held_out").toPandas()
    assert ((both.predicted == both.quality).mean()) > 0.95
    assert both.score.between(0, 1).all()
    assert both.score[both.quality == 1].mean() > both.score[both.quality == 0].mean() + 0.5


def test_held_out_labels_are_not_used(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    held_out = fold("doc_id", 4) == 2
    turned = labels.withColumn("quality", F.when(held_out, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, other = (quality.quality_scores(docs, quality.fit(docs, x, only=~held_out)).orderBy("doc_id").toPandas().score
                  for x in (labels, turned))
    assert (one == other).all()


def test_quality_odd_rows(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    model = quality.fit(docs, labels.unionByName(labels).unionByName(
        spark.createDataFrame([(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")))
    df = spark.createDataFrame(ODD, "doc_id long, text string, score string")
    rows = quality.quality_scores(df, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.quality_scores(df.limit(0), model).count() == 0
    flat = quality.fit(docs, labels.where("quality = 1"))
    assert {round(r["score"], 6) for r in quality.quality_scores(df, flat).collect()} == {1.0}


def test_support_vectors_reach_the_optimum():
    """Dual coordinate descent against the hinge objective by plain subgradient steps."""
    random = np.random.default_rng(0)
    target = np.where(random.random(200) < 0.5, 1.0, -1.0)
    rows = [np.flatnonzero(random.random(12) < np.where(t > 0, np.linspace(0.1, 0.9, 12), np.linspace(0.9, 0.1, 12))) for t in target]
    ratios = random.normal(size=12) + 2
    model = quality._fit_rows(np.arange(12, dtype=np.uint64), ratios, np.concatenate(rows), np.array([len(r) for r in rows]), target)
    x = np.zeros((200, 13))
    for k, r in enumerate(rows):
        x[k, r] = ratios[r] / max(np.sqrt((ratios[r] ** 2).sum()), 1e-6)
    x[:, 12] = 1
    train = np.arange(200) % quality.CALIBRATION_PART != quality.CALIBRATION_PART - 1

    def loss(w):
        return 0.5 * w @ w + quality.COST * np.maximum(0, 1 - target[train] * (x[train] @ w)).sum()

    best, w = np.inf, np.zeros(13)
    for step in range(1, 20_000):
        bad = target[train] * (x[train] @ w) < 1
        w = w - (0.5 / step) * (w - quality.COST * (target[train][bad, None] * x[train][bad]).sum(axis=0))
        best = min(best, loss(w))
    assert loss(np.append(model.weights / ratios, model.bias)) <= best * 1.02


def test_toxic_documents_are_found_and_clean_ones_kept(spark):
    rows = entry.queries()["op9_ordinal_toxicity"](spark, SMALL)
    both = rows.join(read(spark, "labels"), "doc_id").toPandas()
    assert both.rejected[both.toxic == 1].mean() > 0.8
    assert both.rejected[both.toxic == 0].mean() < 0.01
    assert both.severity.between(0, 2).all()


def test_toxicity_of_held_out_documents(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    model = toxicity.fit(docs, labels.where(fold("doc_id", 3) != 0))
    both = toxicity.severity(docs, model).join(labels.where(fold("doc_id", 3) == 0), "doc_id").toPandas()
    assert both.rejected[both.toxic == 1].mean() > 0.6
    assert both.rejected[both.toxic == 0].mean() < 0.02


def test_toxicity_odd_rows(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    model = toxicity.fit(docs, labels)
    df = spark.createDataFrame(ODD, "doc_id long, text string, rejected string")
    rows = toxicity.severity(df, model).collect()
    assert len(rows) == len(ODD) and not any(r["rejected"] for r in rows)
    assert toxicity.severity(df.limit(0), model).count() == 0
    kept = toxicity.without_toxic(df, model)
    assert kept.columns == df.columns and kept.count() == len(ODD)
    none = toxicity.fit(docs, labels.where("toxic = 0"))
    assert not any(r["rejected"] for r in toxicity.severity(docs, none).collect())


def test_ordered_thresholds_share_weights():
    random = np.random.default_rng(1)
    strength = random.integers(0, 6, 600)
    grades = np.digitize(strength + random.normal(size=600) * 0.5, [1.5, 3.0, 4.5])
    model = toxicity._fit_rows(np.array([9], np.uint64), np.arange(600), np.zeros(600, dtype=int), strength.astype(float), grades)
    assert (np.diff(model.thresholds) > 0).all() and model.weights[0] > 0
    expected = model.above(model.weights[0] * strength).sum(axis=1)
    assert np.corrcoef(expected, grades)[0, 1] > 0.85
    # The gradient vanishes at the fit: nudging a parameter does not help.
    def loss(w, cuts):
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        p = labelled.sigmoid(edges[grades + 1] - w * strength) - labelled.sigmoid(edges[grades] - w * strength)
        return -np.log(p).sum() + toxicity.PENALTY / 2 * w * w
    here = loss(model.weights[0], model.thresholds)
    for k in range(4):
        for nudge in (-0.05, 0.05):
            cuts, w = model.thresholds.copy(), model.weights[0]
            if k < 3:
                cuts[k] += nudge
            else:
                w += nudge
            assert loss(w, cuts) >= here - 1e-3


def test_prefixes_are_those_of_the_words():
    from lumenact.llm import text_hash
    found = text_hash.words(pa.array(["abcdefgh abcd", "xabcdefz"]))
    docs, hashes = found.prefixes(4)
    assert docs.tolist() == [0, 1]
    again = text_hash.words(pa.array(["abcdzzz"])).prefixes(4)[1]
    assert hashes[0] == again[0] != hashes[1]


def test_samples_are_bounded_and_do_not_depend_on_the_layout(spark):
    docs = spark.createDataFrame(
        [(i, f"text {i}") for i in range(300)] + [(7, f"copy {i}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    both = labels.unionByName(labels.where("doc_id = 7"))
    rows = [sorted(map(tuple, labelled.labelled_sample(d, both, "quality", limit=n).collect()))
            for n in (49, 300) for d in (docs, docs.repartition(7))]
    assert rows[0] == rows[1] and rows[2] == rows[3]
    assert [len(r) for r in rows[::2]] == [49, 300]
    assert {i: t for i, t, _ in rows[2]}[7] == "text 7"
