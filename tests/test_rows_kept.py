"""No row goes missing: null groups, unknown keys, equal keys, steps sent again."""

import random
from collections import Counter

import numpy as np
import pytest

from lumenact.functions.joins import match
from lumenact.functions.ranking import hash_rank
from lumenact.operators import activations, corpus, discover, encode, prompts, temporal
from lumenact.operators.linear import BIAS
from lumenact.streaming import guardrail as gr
from lumenact.streaming import run

STEPS = "sample_id long, label int, layer int, step int, is_last boolean, fired array<int>"


def test_match_joins_null_with_null(spark):
    left = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "k int, v string")
    right = spark.createDataFrame([(1, 10), (None, 20)], "k int, w int")
    assert Counter(map(tuple, match(left, right, ["k"], "left").collect())) == Counter(
        [(1, "a", 10), (None, "b", 20), (3, "c", None)])


def test_ranks_and_splits_of_a_null_group(spark):
    rows = [(i, None if i % 2 else "t") for i in range(200)]
    df = spark.createDataFrame(rows, "sample_id long, topic string")
    ranked = hash_rank(df, "sample_id", 1, ["topic"])
    for topic in (None, "t"):
        assert sorted(r["rank"] for r in ranked.collect() if r["topic"] == topic) == list(range(100))
    split = Counter((r["topic"], r["split"]) for r in corpus.stratified_split(df, 0.8).collect())
    assert split == {(None, "train"): 80, (None, "test"): 20, ("t", "train"): 80, ("t", "test"): 20}
    labels = corpus.labeled_set(df, corpus.topic_dictionary(df, "topic", "sample_id"))
    assert Counter(r["label"] for r in labels.collect()) == {0: 100, 1: 100}


def test_unknown_subtopics_raise(spark):
    taxonomy = spark.createDataFrame([("a", "x")], "subtopic string, description string")
    specs = "batch_index long, pos int, subtopic string, target_adversarial_level int"
    good = spark.createDataFrame([(0, 0, "a", 1), (0, 1, "a", 2)], specs)
    assert prompts.user_prompts(good, taxonomy).first()["n_specs"] == 2
    for other in ("b", None):
        bad = spark.createDataFrame([(0, 0, "a", 1), (0, 1, other, 2)], specs)
        with pytest.raises(Exception, match="no subtopic"):
            prompts.user_prompts(bad, taxonomy).collect()


def test_capture_without_prompts_and_null_keys(spark):
    rows = [(1, "decode", 5, "a"), (1, "decode", 9, "b"), (2, "prefill", 0, "p"), (2, "decode", 3, "c"),
            (None, "decode", 0, "n"), (None, "prefill", 4, "q")]
    df = spark.createDataFrame(rows, "sample_id long, kind string, step long, h string")
    got = Counter((r["sample_id"], r["step"], r["h"]) for r in activations.select_capture(
        df, activations.PREFILL_DECODE, ["sample_id"]).collect())
    assert got == Counter([(1, 0, "a"), (1, 1, "b"), (2, 0, "p"), (2, 1, "c"), (None, 0, "q"), (None, 1, "n")])


@pytest.mark.parametrize("kind", [encode.TOPK, encode.JUMPRELU])
def test_tiles_keep_vectors_with_equal_carry(spark, kind):
    rng = np.random.default_rng(0)
    rows = [(1, 0, 0, 0, rng.normal(size=6).tolist()) for _ in range(20)]
    hidden = spark.createDataFrame(rows, "sample_id long, label int, layer int, step int, h array<double>")
    weights = spark.createDataFrame(
        [(0, f, rng.normal(size=6).tolist(), 0.0, 0.1) for f in range(23)],
        "layer int, feature_id int, w array<double>, b_enc double, threshold double")
    whole, tiled = (
        Counter(tuple(r["fired"]) for r in encode.encode(
            hidden, weights, kind, k=5, precision="float64", max_tile_bytes=size).collect())
        for size in (encode.MAX_TILE_BYTES, 4 * 6 * 8))
    assert whole == tiled and sum(whole.values()) == 20


def test_tiled_encoder_runs_on_a_stream(spark, tmp_path):
    rng = np.random.default_rng(1)
    schema = "sample_id long, label int, layer int, step int, is_last boolean, h array<double>"
    rows = [(s, 0, 0, t, t == 2, rng.normal(size=4).tolist()) for s in range(5) for t in range(3)]
    weights = spark.createDataFrame(
        [(0, f, rng.normal(size=4).tolist(), 0.0, 0.1) for f in range(12)],
        "layer int, feature_id int, w array<double>, b_enc double, threshold double")
    for k in range(0, 15, 5):
        spark.createDataFrame(rows[k:k + 5], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    carry = ("sample_id", "label", "layer", "step", "is_last")
    coded = [encode.encode(df, weights, encode.JUMPRELU, carry=carry, precision="float64", max_tile_bytes=5 * 4 * 8)
             for df in (stream, spark.createDataFrame(rows, schema))]
    got = run.drain_append(gr.track_first_fire(coded[0]))
    assert sorted(got.collect()) == sorted(discover.first_fire(coded[1]).select(got.columns).collect())


def test_steps_sent_again_change_nothing(spark, tmp_path):
    rng = random.Random(3)
    rows = [(s, s % 2, 0, t, t == n - 1, sorted(rng.sample(range(6), 2)))
            for s, n in ((i, 1 + i % 4) for i in range(10)) for t in range(n)]
    split = [(*r[:5], r[5][:1]) for r in rows] + [(*r[:5], r[5][1:]) for r in rows]  # one step in two rows
    for part in (rows[:12], rows[:12], rows[12:], rows, rows[-3:]):
        spark.createDataFrame(part, STEPS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame(split, STEPS).coalesce(1).write.parquet(str(tmp_path / "two"))
    batch = spark.createDataFrame(rows, STEPS)
    first = discover.first_fire(batch)
    weights = spark.createDataFrame(
        [(f, [0.3 * f - 0.5, 0.4 - 0.2 * f]) for f in range(6)] + [(BIAS, [0.1, 0.0])], "feature_id int, w array<double>")
    curve = temporal.confidence_curve(
        first, batch.select("sample_id", "label").distinct(), weights, [0, 1], [1, 2, 3, 4, 5, 6])
    want = temporal.early_stop(curve, [0.75], 2, 6).select("sample_id", "label", "tokens", "pred")
    for folder in ("in", "two"):
        stream = spark.readStream.schema(STEPS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / folder))
        fired = run.drain_append(gr.track_first_fire(stream)).select(first.columns)
        assert sorted(fired.collect()) == sorted(first.collect())
        decided = run.drain_append(gr.guard(stream, gr.collect_weights(weights, 6), [0, 1], 0.75, 2, 6))
        assert sorted(decided.select("sample_id", "label", "tokens", "pred").collect()) == sorted(want.collect())


def test_a_silent_sample_gets_its_default_decision():
    guardrail = gr.Guardrail({BIAS: [0.0, 0.1], 1: [2.0, 0.0]}, [0, 1], 0.99, 2, 6, idle_ms=1000)
    state = guardrail.start()
    assert guardrail.advance(state, (7,), 0, 1, {1}, False) == []
    kept = guardrail.load(guardrail.store(state))
    assert guardrail.expire(kept, (7,))[0][:4] == (7, 1, 6, 0)
    kept[4] = True
    assert guardrail.expire(kept, (7,)) == []
