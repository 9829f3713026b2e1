import math
from collections import Counter

import pytest

import __spark_entry__ as entry
from lumenact.llm.mixing import Target, exponent, mix, mixed_documents
from tests.conftest import SF

SCHEMA = "doc_id long, text string, source string, weight string"


def sample(spark):
    rows = [(i, "w " * (1 + i % 7), "big", "x") for i in range(900)]
    rows += [(1000 + i, "w " * 5, "small", None) for i in range(60)] + [(2000 + i, "w w w", None, "x") for i in range(150)]
    return spark.createDataFrame(rows, SCHEMA), rows


def entropy(weights):
    return -sum(w * math.log(w) for w in weights if w)


def test_entropy_is_met(spark):
    df, rows = sample(spark)
    tokens = Counter()
    for _, text, source, _ in rows:
        tokens[source] += len(text.split())
    got = mix(df, Target(entropy=0.9)).select("source", "weight").distinct().collect()
    weights = {r["source"]: r["weight"] for r in got}
    assert sum(weights.values()) == pytest.approx(1)
    assert entropy(weights.values()) == pytest.approx(0.9 * math.log(3), abs=1e-6)
    a = exponent(spark.createDataFrame(list(tokens.items()), "source string, tokens long"), Target(entropy=0.9))
    for s in tokens:
        assert weights[s] == pytest.approx(tokens[s] ** a / sum(t ** a for t in tokens.values()), rel=1e-9)


def test_every_document_once_and_budgets(spark):
    df, rows = sample(spark)
    drawn = mix(df, Target(max_repeats=3.0), blocks=10).collect()
    assert {r["doc_id"] for r in drawn} == {r[0] for r in rows}
    times = Counter(r["doc_id"] for r in drawn)
    assert max(times.values()) == 3
    total = sum(r["n_tokens"] for r in drawn)
    for source, weight in {(r["source"], r["weight"]) for r in drawn}:
        own = sum(r["n_tokens"] for r in drawn if r["source"] == source)
        assert own / total == pytest.approx(weight, abs=0.01)
        blocks = Counter()
        for r in drawn:
            if r["source"] == source:
                blocks[r["block"]] += r["n_tokens"]
        assert len(blocks) == 10 and max(blocks.values()) - min(blocks.values()) <= 15
    # Two epochs of a source are different permutations.
    small = [r for r in drawn if r["source"] == "small"]
    first = [r["doc_id"] for r in sorted(small, key=lambda r: (r["block"], r["place_key"])) if r["epoch"] == 0]
    later = [r["doc_id"] for r in sorted(small, key=lambda r: (r["block"], r["place_key"])) if r["epoch"] == 1]
    assert sorted(first) == sorted(later) and first != later


def test_given_budget_cuts_an_epoch(spark):
    df, _ = sample(spark)
    drawn = mix(df, Target(entropy=0.99), budget=1000).collect()
    for source, weight in {(r["source"], r["weight"]) for r in drawn}:
        own = sum(r["n_tokens"] for r in drawn if r["source"] == source)
        assert round(1000 * weight) <= own < round(1000 * weight) + 7


def test_documents_follow_the_draws(spark):
    df, _ = sample(spark)
    for target, budget in ((Target(max_repeats=1.5), None), (Target(entropy=0.99), 1000)):
        drawn = Counter(r["doc_id"] for r in mix(df, target, budget).collect())
        out = mixed_documents(df, target, budget)
        assert out.columns == df.columns
        assert Counter(r["doc_id"] for r in out.collect()) == drawn


def test_odd_rows(spark):
    rows = [(1, None, "a", "x"), (2, "", "a", "x"), (3, " ", None, "x"), (4, "one", "a", "x"), (4, "one", "a", "x"), (None, "two words", "b", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    for target in (Target(entropy=1.0), Target(max_repeats=1.0)):
        assert Counter(r["doc_id"] for r in mix(df, target).collect()) == Counter(r[0] for r in rows)
        assert mixed_documents(df, target).count() == 6
        assert mix(df.limit(0), target).count() == 0 and mixed_documents(df.limit(0), target).count() == 0
    blank = df.where("doc_id < 3")
    assert mix(blank, Target(entropy=0.5)).count() == 2
    with pytest.raises(ValueError):
        Target()


def test_whole_table(spark):
    ids = {r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    rows = entry.queries()["op4_temperature_mixing"](spark, SF).collect()
    assert {r["doc_id"] for r in rows} == ids
    weights = {r["source"]: r["weight"] for r in rows if r["weight"] > 0}
    assert sum(weights.values()) == pytest.approx(1)
    assert entropy(weights.values()) >= 0.95 * math.log(len(weights)) - 1e-6
