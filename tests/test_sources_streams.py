"""Files in and out, run folders, and streams fed in several pieces."""

import random

import pytest
from pyspark.sql import functions as F

from lumenact.operators import discover, neighbors, temporal
from lumenact.operators.linear import BIAS
from lumenact.schemas import PROMPT
from lumenact.sources import records as src
from lumenact.sources.nested import read_topic_rows
from lumenact.streaming import guardrail as gr
from lumenact.streaming import run


def test_prompt_records_round_trip_and_fail_on_bad_lines(spark, tmp_path):
    rows = [("s", "t", 1, "q", "ok", None, 1, "x"), ("s", "t", 1, None, "bad_item", None, None, None)]
    df = spark.createDataFrame(rows, PROMPT)
    src.write_prompts(df, str(tmp_path / "a"))
    lines = [x for f in (tmp_path / "a").glob("part-*") for x in f.read_text().splitlines()]
    assert any('"prompt":null' in x for x in lines)
    assert src.read_prompts(spark, str(tmp_path / "a")).orderBy("_status").collect() == df.orderBy("_status").collect()
    (tmp_path / "b.jsonl").write_text('{"topic": "t", "_status": "ok"}\n\n   \n{"topic": "u", "_status": "ok"}\n')
    assert src.read_prompts(spark, str(tmp_path / "b.jsonl")).count() == 2
    (tmp_path / "c.jsonl").write_text('{"topic": "t"}\n{"topic": \n')
    with pytest.raises(Exception):
        src.read_prompts(spark, str(tmp_path / "c.jsonl")).select("topic").collect()


def test_run_folder(spark, tmp_path):
    scores = spark.createDataFrame([(0, 0.5), (1, 0.25)], "layer int, score double")
    for prefix in ("model-b_20240101_000000", "model-a_20240202_000000"):
        src.write_manifest(spark, str(tmp_path / prefix), {"accuracy": 0.9, "model": prefix, "layer_scores": scores})
    newest = src.latest_run(spark, str(tmp_path))
    assert newest.endswith("model-a_20240202_000000")
    with pytest.raises(FileNotFoundError, match="test"):
        src.load_run(spark, newest)
    spark.createDataFrame([("p", 0)], "prompt string, label int").write.parquet(f"{tmp_path}/model-a_20240202_000000_test.parquet")
    scores.write.parquet(f"{tmp_path}/model-a_20240202_000000_weights.parquet")
    loaded = src.load_run(spark, newest)
    meta = loaded["meta"].first()
    assert meta["accuracy"] == 0.9 and [s["score"] for s in meta["layer_scores"]] == [0.5, 0.25]
    assert src.read_prompt_labels(spark, f"{newest}_test.parquet").columns == ["prompt", "label"]
    with pytest.raises(FileNotFoundError):
        src.latest_run(spark, str(tmp_path / "nothing"))


def test_feature_and_variance_tables(spark, tmp_path):
    wide = spark.createDataFrame([(1.0, 0.0, 1.0, 2)], "feat_9 float, feat_2 float, feat_5 float, label int")
    wide.withColumn("split", F.lit("train")).transform(lambda d: src.write_split_tables(d, str(tmp_path / "f")) or d)
    table, names, n_classes = src.read_features(spark, str(tmp_path / "f" / "split=train"), 2)
    assert (names, n_classes, table.columns) == (["feat_9", "feat_2"], 3, ["feat_9", "feat_2", "label"])
    variance = spark.createDataFrame([(2, 0, 0.5), (4, 1, 0.1)], "t int, feature_id int, variance double")
    src.write_variances(variance, str(tmp_path / "v"), ["t"])
    assert spark.read.parquet(str(tmp_path / "v")).where("t = 4").count() == 1


def test_weights_are_checked(spark, tmp_path):
    rows = [(layer, f, [0.0] * 4, 0.0, 0.0) for layer in range(4) for f in range(2)]
    path = str(tmp_path / "w")
    spark.createDataFrame(rows, "layer int, feature_id int, w array<float>, b_enc float, threshold float").write.partitionBy("layer").parquet(path)
    assert src.read_sae_weights(spark, path, [1, 2], expected_d_model=4).count() == 4
    assert src.read_sae_weights(spark, path, stride=2).select("layer").distinct().count() == 2
    for bad in ({"expected_d_model": 5}, {"layers": [9]}):
        with pytest.raises(ValueError):
            src.read_sae_weights(spark, path, **bad)


def test_nested_source_falls_back_to_all_columns(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"id": 1, "q": "  hi  ", "m": [{"r": "x"}]}\n{"id": 2, "q": " ", "m": [{"r": " a b"}]}\n{"id": 3, "q": "", "m": []}\n')
    spec = {"topic": "t", "path": str(tmp_path / "d.json"), "format": "json", "columns": ["q", "gone"], "id": "id"}
    assert sorted((r["id"], r["text"]) for r in read_topic_rows(spark, [spec]).collect()) == [(1, "hi"), (2, "a b")]


STEPS = "sample_id long, label int, layer int, step int, is_last boolean, fired array<int>"


def _pieces(spark, path, rows, n_files, shuffled):
    rows = list(rows)
    if shuffled:
        random.Random(1).shuffle(rows)
    else:
        rows.sort(key=lambda r: r[3])
    size = -(-len(rows) // n_files)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i:i + size], STEPS).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(STEPS).option("maxFilesPerTrigger", 1).parquet(path)


def _rows():
    rng = random.Random(2)
    return [(s, s % 2, 0, t, t == n - 1, sorted(rng.sample(range(6), 2)))
            for s, n in ((i, 1 + i % 5) for i in range(12)) for t in range(n)]


@pytest.mark.parametrize("shuffled", [False, True])
def test_streams_equal_batch(spark, tmp_path, shuffled):
    rows = _rows()
    batch = spark.createDataFrame(rows, STEPS)
    first = discover.first_fire(batch)
    stream = _pieces(spark, str(tmp_path / "in"), rows, 4, shuffled)
    got = run.drain_append(gr.track_first_fire(stream)).select(first.columns)
    assert sorted(got.collect()) == sorted(first.collect())

    weights = spark.createDataFrame(
        [(f, [0.3 * f - 0.5, 0.4 - 0.2 * f]) for f in range(6)] + [(BIAS, [0.1, 0.0])], "feature_id int, w array<double>")
    samples = batch.select("sample_id", "label").distinct()
    curve = temporal.confidence_curve(first, samples, weights, [0, 1], [1, 2, 3, 4, 5, 6])
    want = temporal.early_stop(curve, [0.75], 2, 6).select("sample_id", "label", "tokens", "pred")
    decided = run.drain_append(gr.guard(stream, gr.collect_weights(weights, 10), [0, 1], 0.75, 2, 6))
    assert sorted(decided.select("sample_id", "label", "tokens", "pred").collect()) == sorted(want.collect())


def test_stream_totals_follow_several_files(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([("ok", "a", i), ("bad_item", "a", i)], "_status string, subtopic string, i int").coalesce(1).write.mode(
            "append").json(str(tmp_path / "r"))
    stream = spark.readStream.schema("_status string, subtopic string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "r"))
    rows = run.totals_summary(run.drain_complete(run.running_totals(stream))).collect()
    assert {(r["section"], r["key"]): r["n"] for r in rows} == {
        ("status", "ok"): 3, ("status", "bad_item"): 3, ("ok_by_subtopic", "a"): 3}


def test_totals_without_input_and_of_the_committed_epoch(spark, tmp_path):
    empty = tmp_path / "none"
    empty.mkdir()
    stream = spark.readStream.schema("_status string, subtopic string").json(str(empty))
    assert run.drain_complete(run.running_totals(stream)).count() == 0
    # Epoch 2 was written but not committed: epoch 1 is the result, as after a restart.
    folder = str(tmp_path / "s")
    (tmp_path / "s" / "state" / "commits").mkdir(parents=True)
    for epoch in range(3):
        spark.range(epoch + 1).write.parquet(f"{folder}/out/epoch={epoch}")
        if epoch < 2:
            (tmp_path / "s" / "state" / "commits" / str(epoch)).write_text("v1")
    assert run.newest_epoch(spark, folder, spark.range(1).schema).count() == 2


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_neighbors_equal_brute_force(spark, block_rows):
    rng = random.Random(4)
    train = [(i, i % 3, [rng.getrandbits(6), rng.getrandbits(3)]) for i in range(40)]
    test = [(100 + i, 0, [rng.getrandbits(6), rng.getrandbits(3)]) for i in range(15)]
    schema = "sample_id long, label int, bits array<long>"
    near = neighbors.nearest_neighbors(spark.createDataFrame(train, schema), spark.createDataFrame(test, schema), 5, block_rows)
    got = {}
    for r in near.orderBy("sample_id", "rank").collect():
        got.setdefault(r["sample_id"], []).append((r["distance"], r["neighbor_id"]))
    for i, _, bits in test:
        want = sorted((sum((a ^ b).bit_count() for a, b in zip(bits, t[2])), t[0]) for t in train)[:5]
        assert got[i] == want
