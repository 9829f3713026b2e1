"""Properties of the operators on small hand-made inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenact.functions.ranking import hash_cutoffs, hash_rank, seeded_key
from lumenact.functions.stats import grouped_quantile
from lumenact.functions.text import collect_text, normalize_space, strip
from lumenact.operators import corpus, discover, encode, linear, lockin, prompts, temporal
from lumenact.operators import activations as acts
from lumenact.operators.dynamics import snapshot_variance
from lumenact.operators.evaluate import layout_label, parameter_count, topic_metrics
from lumenact.operators.taxonomy import default_levels, default_taxonomy


def _weights(spark, n_layers, d_sae, d_model, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(layer, f, rng.normal(size=d_model).tolist(), float(rng.normal()), float(rng.uniform(0, 1)))
            for layer in range(n_layers) for f in range(d_sae)]
    return spark.createDataFrame(rows, "layer int, feature_id int, w array<double>, b_enc double, threshold double"), rows


def _hidden(spark, n, d_model, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i // 3, i // 3 % 2, 0, i % 3, rng.normal(size=d_model).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "sample_id long, label int, layer int, step int, h array<double>"), rows


@pytest.mark.parametrize("tile_bytes", [encode.MAX_TILE_BYTES, 5 * 6 * 8])
@pytest.mark.parametrize("kind", [encode.TOPK, encode.JUMPRELU])
def test_encoder_equals_numpy_whole_and_tiled(spark, kind, tile_bytes):
    weights, w_rows = _weights(spark, 1, 23, 6)
    hidden, h_rows = _hidden(spark, 60, 6)
    bias = spark.createDataFrame([(0, [0.1, -0.2, 0.0, 0.3, 0.0, 0.05])], "layer int, b_dec array<double>")
    fired = encode.encode(hidden, weights, kind, k=5, bias=bias, precision="float64", max_tile_bytes=tile_bytes)
    got = {(r["sample_id"], r["step"]): list(r["fired"]) for r in fired.collect()}
    w = np.array([r[2] for r in w_rows]).T
    b, threshold = np.array([r[3] for r in w_rows]), np.array([r[4] for r in w_rows])
    for sample, _, _, step, h in h_rows:
        if kind == encode.TOPK:
            want = sorted(np.argsort(-(np.array(h) @ w + b))[:5].tolist())
        else:
            centred = np.array(h) - np.array(bias.first()["b_dec"])
            want = np.flatnonzero(centred @ w + b > threshold).tolist()
        assert got[(sample, step)] == want


def test_topk_breaks_ties_by_lower_feature():
    mask = encode._top_mask(np.array([[1.0, 2.0, 1.0, 1.0], [0.0, 0.0, 0.0, 0.0]]), 2)
    assert mask.tolist() == [[True, True, False, False], [True, True, False, False]]


def test_encoder_rejects_wrong_width_and_kind(spark):
    weights, _ = _weights(spark, 1, 4, 5)
    hidden, _ = _hidden(spark, 3, 6)
    with pytest.raises(Exception, match="d_model=5"):
        encode.encode(hidden, weights, encode.JUMPRELU).collect()
    with pytest.raises(ValueError):
        encode.encode(hidden, weights, "other")
    with pytest.raises(ValueError):
        encode.encode(hidden, weights, encode.TOPK)


def _sparse(spark, n=120, d=15, n_labels=4, seed=3):
    """Random firings in which label 3 never fires and some features never do."""
    rng = np.random.default_rng(seed)
    labels = rng.integers(0, n_labels, n)
    steps = np.full((n, d), -1)
    for i in range(n):
        if labels[i] != 3:
            for f in range(d - 3):
                if rng.random() < 0.1 + 0.05 * f:
                    steps[i, f] = rng.integers(0, 6)
    rows = [(i, int(labels[i]), 0, f, int(steps[i, f])) for i in range(n) for f in range(d) if steps[i, f] >= 0]
    first = spark.createDataFrame(rows, "sample_id long, label int, layer int, feature_id int, first_step int")
    samples = spark.createDataFrame([(i, int(labels[i]), 6) for i in range(n)], "sample_id long, label int, n_steps int")
    return first, samples, labels, steps


def test_variance_counts_absent_topics_and_features_as_zero(spark):
    first, samples, labels, steps = _sparse(spark)
    dense = np.stack([(steps[labels == c] >= 0).mean(axis=0) for c in range(4)]).var(axis=0)
    layers = spark.createDataFrame([(0,)], "layer int")
    variance = discover.cross_topic_variance(discover.topic_firing_rate(first, samples))
    got = {r["feature_id"]: r["variance"] for r in discover.dense_variance(variance, layers, 15).collect()}
    assert np.allclose([got[f] for f in range(15)], dense)
    stats = discover.variance_summary(variance, 15, [50, 90, 99]).first()
    assert np.allclose(
        [stats["mean"], stats["std"], stats["p50"], stats["p90"], stats["p99"], stats["max"]],
        [dense.mean(), dense.std(), *np.percentile(dense, [50, 90, 99]), dense.max()])
    assert stats["n_nonzero"] == (dense > 0).sum()


def test_ranking_is_padded_with_silent_features(spark):
    first, samples, _, _ = _sparse(spark)
    layers = spark.createDataFrame([(0,)], "layer int")
    assert discover.discover(first, samples, 15, 15, layers=layers).count() == 15


def test_snapshot_variance_equals_dense(spark):
    first, samples, labels, steps = _sparse(spark)
    got = {(r["t"], r["feature_id"]): r["variance"] for r in snapshot_variance(first, samples, [2, 4]).collect()}
    for t in (2, 4):
        fired = (steps >= 0) & (steps < t)
        dense = np.stack([fired[labels == c].mean(axis=0) for c in range(4)]).var(axis=0)
        assert np.allclose([got.get((t, f), 0.0) for f in range(15)], dense)


def test_bayes_and_curve_equal_numpy(spark):
    first, samples, labels, steps = _sparse(spark)
    ids = list(range(15))
    weights = linear.as_arrays(linear.bernoulli_weights(linear.bernoulli_counts(first, samples, ids)))
    grid = [1, 3, 6]
    curve = temporal.confidence_curve(first, samples, weights, [0, 1, 2, 3], grid).collect()
    fired = steps >= 0
    n_c = np.bincount(labels, minlength=4)
    p = np.stack([(fired[labels == c].sum(axis=0) + 1) / (n_c[c] + 2) for c in range(4)])
    for row in curve:
        x = (steps[row["sample_id"]] >= 0) & (steps[row["sample_id"]] < row["t"])
        scores = np.log(n_c / n_c.sum()) + (np.where(x, np.log(p), np.log(1 - p))).sum(axis=1)
        probs = np.exp(scores - scores.max())
        probs /= probs.sum()
        assert row["pred"] == int(np.argmax(np.round(scores, 9)))
        assert abs(row["confidence"] - probs.max()) < 1e-8
        assert abs(row["p_true"] - probs[row["label"]]) < 1e-8
    # Higher targets never stop earlier.
    stops = temporal.early_stop(spark.createDataFrame(curve), [0.3, 0.6, 0.9], 1, 6)
    tokens = {}
    for r in stops.orderBy("target").collect():
        assert tokens.get(r["sample_id"], 0) <= r["tokens"]
        tokens[r["sample_id"]] = r["tokens"]


def test_short_limit_uses_all_steps(spark):
    curve = spark.createDataFrame([(1, 0, 1, 0, 0.99, 0.99)], "sample_id long, label int, t int, pred int, confidence double, p_true double")
    row = temporal.early_stop(curve, [0.5], 10, 3).first()
    assert (row["tokens"], row["pred"]) == (3, 0)


def test_grid_matches_its_definition(spark):
    for last in (8, 50, 57, 200, 219, 512):
        want = sorted({t for t in [*range(1, 51), *range(55, 201, 5), *range(220, last + 1, 20)] if t <= last})
        frame = spark.createDataFrame([(last,)], "max_steps int")
        assert temporal.evaluation_grid(last) == want
        assert sorted(r[0] for r in temporal.evaluation_grid_frame(frame).collect()) == want
    assert temporal.evaluation_grid(512)[-1] == 500
    assert temporal.snapshot_grid(10, 35) == [10, 20, 30]


def test_quantile_is_exact_inside_and_beyond_the_sketch(spark):
    rng = np.random.default_rng(5)
    values = np.round(rng.beta(5, 1, 30_000), 6)
    values[:10_000] = 0.987  # a third of the rows share one value
    rows = [(int(i % 2), float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k int, v double")
    for accuracy in (10_000, 100):  # whole range; bracket
        got = {r["k"]: r["q"] for r in grouped_quantile(df, ["k"], "v", 0.5, "q", accuracy).collect()}
        for k in (0, 1):
            assert abs(got[k] - np.median(values[k::2])) < 1e-12


def test_ranks_and_cuts_equal_a_plain_sort(spark):
    df = spark.range(5000).withColumn("g", F.when(F.col("id") % 3 == 0, 0).otherwise((F.col("id") % 7).cast("int")))
    ranked = {r["id"]: r["rank"] for r in hash_rank(df, "id", 9, ["g"]).collect()}
    keys = {r["id"]: (r["g"], r["k"], r["id"]) for r in df.withColumn("k", seeded_key(9, F.col("id"))).collect()}
    seen = {}
    for g, _, i in sorted(keys.values()):
        assert ranked[i] == seen.get(g, 0)
        seen[g] = seen.get(g, 0) + 1
    split = corpus.stratified_split(df.withColumnRenamed("id", "sample_id"), 0.8, 9, ["g"])
    for r in split.groupBy("g").agg(F.count_if(F.col("split") == "train").alias("t")).collect():
        assert r["t"] == int(seen[r["g"]] * 0.8)
    assert all(ranked[r["sample_id"]] < int(seen[r["g"]] * 0.8) for r in split.where("split = 'train'").collect())
    cuts = hash_cutoffs(df, [], "id", 9, lambda n: F.lit(100), totals=True).first()
    assert (cuts["total"], cuts["taken"]) == (5000, 100)


def test_cut_of_nothing_and_of_everything(spark):
    df = spark.range(10).withColumn("g", F.lit(0))
    for n in (0, 10, 50):
        picked, report = corpus.seeded_sample(df, "id", n, 1, ["g"])
        assert picked.count() == min(n, 10)
        assert report.first()["short"] == (n > 10)


def test_capture_modes(spark):
    rows = [(1, 0, "prefill", s, s) for s in range(3)] + [(1, 0, "decode", s, 10 + s) for s in range(2)]
    df = spark.createDataFrame(rows, "sample_id long, layer int, kind string, step int, h int")
    def steps(mode):
        return sorted((r["step"], r["h"]) for r in acts.select_capture(df, mode).collect())
    assert steps("prefill") == [(0, 2)]
    assert steps("decode") == [(0, 10), (1, 11)]
    assert steps("prefill+decode") == [(0, 2), (1, 10), (2, 11)]
    with pytest.raises(ValueError):
        acts.select_capture(df, "other")


def test_text_helpers(spark):
    text = "\u3000 a\u00a0\t b\x1c\u2028c \n"
    df = spark.createDataFrame([(text, [{"k": [" x ", ""]}], 5)], "t string, n array<map<string,array<string>>>, i int")
    row = df.select(
        normalize_space(F.col("t")).alias("a"), strip(F.col("t")).alias("b"),
        collect_text(F.col("n"), df.schema["n"].dataType).alias("c"),
        collect_text(F.col("i"), df.schema["i"].dataType).alias("d")).first()
    assert row["a"] == " ".join(text.split()) and row["b"] == text.strip()
    assert row["c"] == ["x"] and row["d"] == []


def test_plans_reject_bad_arguments(spark):
    slots = spark.range(4)
    for values, mode, weights in (([], "random", None), ([1], "other", None), ([1], "weighted", None),
                                  ([1, 2], "weighted", [1]), ([1, 2], "weighted", [-1, 2]), ([1, 2], "weighted", [0, 0])):
        with pytest.raises(ValueError):
            prompts.sampling_plan(slots, "id", values, mode, 1, weights)
    uniform = prompts.sampling_plan(spark.range(9), "id", [1, 2, 3], "uniform", 1)
    assert sorted(r["count"] for r in uniform.groupBy("value").count().collect()) == [3, 3, 3]
    weighted = prompts.sampling_plan(spark.range(500), "id", [1, 2], "weighted", 1, [0, 5])
    assert [r["value"] for r in weighted.select("value").distinct().collect()] == [2]


def test_default_prompts(spark):
    taxonomy, levels = default_taxonomy(spark), default_levels(spark)
    assert (taxonomy.count(), taxonomy.select("topic").distinct().count()) == (28, 7)
    pool = prompts.spec_pool(taxonomy, [0], 36, 42)
    assert pool.count() == 1008
    batches = prompts.batches(pool, 8, 42)
    assert batches.groupBy("batch_index").count().where("count = 8").count() == 126
    text = prompts.system_prompt(taxonomy, levels).first()[0]
    assert "Level 4 (maximum_camouflage)" in text and "  - Tax & accounting:" in text
    assert prompts.spec_pool(taxonomy, [0], 0, 42).count() == 0


def test_large_subtopic_is_built_in_ranges(spark):
    taxonomy = spark.createDataFrame([("a", "t")], "subtopic string, topic string")
    pool = prompts.spec_pool(taxonomy, [0, 1], 10_000, 1)
    assert pool.select("i").distinct().count() == 10_000


def test_metrics_of_a_topic_never_predicted(spark):
    pairs = spark.createDataFrame([(0, 0), (1, 0), (1, 1)], "label int, pred int")
    topics = spark.createDataFrame([(0,), (1,), (2,)], "label int")
    got = {r["label"]: (r["precision"], r["recall"], r["f1"], r["n_test"]) for r in topic_metrics(pairs, topics).collect()}
    assert got[0] == (0.5, 1.0, pytest.approx(2 / 3), 1)
    assert got[1] == (1.0, 0.5, pytest.approx(2 / 3), 2)
    assert got[2] == (0.0, 0.0, 0.0, 0)


def test_layout_bookkeeping(spark):
    df = spark.createDataFrame([([],), ([64],), ([64, 32],)], "h array<int>")
    rows = df.select(layout_label(F.col("h")).alias("l"), parameter_count(F.lit(100), F.lit(7), F.col("h")).alias("n")).collect()
    assert [r["l"] for r in rows] == ["linear", "64", "64→32"]
    assert [r["n"] for r in rows] == [707, 100 * 64 + 64 + 64 * 7 + 7, 100 * 64 + 64 + 64 * 32 + 32 + 32 * 7 + 7]


def test_step_without_a_topic_has_no_variance(spark):
    samples = spark.createDataFrame([(0, 0, 2), (1, 1, 1)], "sample_id long, label int, n_steps int")
    fired = spark.createDataFrame([(0, 0, 0, [1]), (1, 1, 0, [2]), (0, 0, 1, [1])], "sample_id long, label int, step int, fired array<int>")
    coverage = lockin.step_coverage(samples)
    rows = {r["step"]: r["variance"] for r in lockin.single_step_variance(fired, samples, coverage, 4, 2).collect()}
    assert rows == {0: pytest.approx(2 * 0.25 / 4), 1: 0.0}
