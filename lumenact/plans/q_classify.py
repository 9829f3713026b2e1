"""Queries: linear classifiers as weight tables, evaluation, sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import linear as lin
from ..operators.corpus import split_cuts, with_split
from ..session import stage
from .catalog import query
from .oracle import bayes, cte, decisions, with_ctes
from .study import K, RATIO, Study

SIZES = (1, 2, 4, 8)
ALPHAS = (0.1, 0.5, 1.0, 2.0, 10.0)
SEEDS = (0, 1, 2, 3, 4)


@query("c09_bernoulli_weights", with_ctes("nb_w nb_b", """
  SELECT cls AS label, feature_id, round(w, 9) AS weight FROM nb_w
  UNION ALL SELECT cls, -1, round(b, 9) FROM nb_b"""))
def c09(spark, sf_dir):
    s = Study(spark, sf_dir)
    return lin.bernoulli_weights(s.counts).withColumn("weight", F.round("weight", 9))


@query("c02_softmax_predictions", with_ctes("pred", "SELECT * FROM pred"))
def c02(spark, sf_dir):
    return Study(spark, sf_dir).predictions


@query("e01_accuracy", with_ctes("pred", """
  SELECT round(avg((pred = label)::INTEGER), 9) AS accuracy, count(*) AS n_samples FROM pred"""))
def e01(spark, sf_dir):
    return ev.accuracy(Study(spark, sf_dir).predictions).withColumn("accuracy", F.round("accuracy", 9))


@query("e02_topic_metrics", with_ctes("pred samples", """
  SELECT l.label,
    round(coalesce(tp / nullif(np, 0), 0), 9) AS precision, round(coalesce(tp / nullif(nt, 0), 0), 9) AS recall,
    round(coalesce(2 * (tp / np) * (tp / nt) / nullif(tp / np + tp / nt, 0), 0), 9) AS f1,
    nt::BIGINT AS n_test
  FROM (SELECT l.label, count(*) FILTER (p.pred = l.label AND p.label = l.label)::DOUBLE AS tp,
          count(*) FILTER (p.pred = l.label)::DOUBLE AS np, count(*) FILTER (p.label = l.label)::DOUBLE AS nt
        FROM (SELECT DISTINCT label FROM samples) l CROSS JOIN pred p GROUP BY l.label) l"""))
def e02(spark, sf_dir):
    s = Study(spark, sf_dir)
    metrics = ev.topic_metrics(s.predictions, s.samples.select("label").distinct())
    return metrics.select("label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "n_test")


def _size_weights(s: Study, counts, keys=()):
    """Models on the 1, 2, 4, 8 best features, from one set of counts."""
    ranked = F.broadcast(s.chosen.select("feature_id", "rank"))
    sizes = F.filter(F.array(*[F.lit(n) for n in SIZES]), lambda n: F.col("rank") <= n)
    grown = counts.join(ranked, "feature_id").withColumn("n_features", F.explode(sizes))
    keys = [*keys, "n_features"]
    return lin.as_arrays(lin.bernoulli_weights(grown.drop("rank"), keys), keys)


def grid_scores(name: str, keys: str, people: str = "test") -> None:
    """Scores of every sample under every model of a grid."""
    names = [k.strip() for k in keys.split(",")]
    same = " AND ".join(f"w.{k} = b.{k}" for k in names)
    b_keys = ", ".join(f"b.{k}" for k in names)
    on = "b.seed = s.seed" if "seed" in names else "true"
    cte(f"{name}_scores", (people, f"{name}_w", f"{name}_b", "picks"), f"""
      SELECT s.sample_id, s.label, {b_keys}, b.cls, max(b.b) + coalesce(sum(w.w), 0) AS score
      FROM {people} s JOIN {name}_b b ON {on}
      LEFT JOIN picks p ON p.sample_id = s.sample_id
      LEFT JOIN {name}_w w ON w.cls = b.cls AND w.feature_id = p.feature_id AND {same}
      GROUP BY s.sample_id, s.label, {b_keys}, b.cls""")
    decisions(name, f"{name}_scores", f"sample_id, label, {keys}")


cte("size_counts", ("nb_counts",), """
  SELECT c.*, n.n_features::INTEGER AS n_features
  FROM nb_counts c JOIN (VALUES (1), (2), (4), (8)) n(n_features) ON c.rank <= n.n_features""")
bayes("size", "size_counts", "n_features")
grid_scores("size", "n_features")


@query("c11_feature_count_sweep", with_ctes("size", """
  SELECT n_features, round(avg((pred = label)::INTEGER), 9) AS accuracy, count(*) AS n_samples
  FROM size GROUP BY n_features"""))
def c11(spark, sf_dir):
    s = Study(spark, sf_dir)
    weights = _size_weights(s, s.counts)
    scored = lin.score(lin.with_bias(s.picks(s.test_first), s.test), weights, s.classes, keys=["n_features"])
    return ev.accuracy(scored, ["n_features"]).withColumn("accuracy", F.round("accuracy", 9))


cte("alpha_counts", ("nb_counts",), """
  SELECT c.*, a.alpha FROM nb_counts c
  CROSS JOIN (SELECT unnest([0.1::DOUBLE, 0.5::DOUBLE, 1::DOUBLE, 2::DOUBLE, 10::DOUBLE]) AS alpha) a""")
bayes("alpha", "alpha_counts", "alpha", "alpha")
grid_scores("alpha", "alpha")


def _alpha_accuracy(s: Study):
    counts = s.counts.withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in ALPHAS])))
    weights = lin.as_arrays(lin.bernoulli_weights(counts, ["alpha"], F.col("alpha")), ["alpha"])
    scored = lin.score(lin.with_bias(s.picks(s.test_first), s.test), weights, s.classes, keys=["alpha"])
    return ev.accuracy(scored, ["alpha"])


@query("c13_smoothing_sweep", with_ctes("alpha", """
  SELECT alpha, round(avg((pred = label)::INTEGER), 9) AS accuracy, count(*) AS n_samples
  FROM alpha GROUP BY alpha"""))
def c13(spark, sf_dir):
    return _alpha_accuracy(Study(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 9))


cte("seed_split", ("alive",), """
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY seed, label ORDER BY md5(seed || ':' || sample_id), sample_id)
      <= floor(count(*) OVER (PARTITION BY seed, label) * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split
  FROM alive CROSS JOIN (SELECT unnest(range(5))::INTEGER AS seed)""")
cte("seed_test", ("seed_split",), "SELECT * FROM seed_split WHERE split = 'test'")
cte("seed_counts", ("seed_split", "picks", "tr_chosen"), """
  SELECT l.seed, l.label AS cls, c.feature_id, n.n_features::INTEGER AS n_features, coalesce(k.n, 0) AS n_fired, l.n_label,
    sum(l.n_label) OVER (PARTITION BY l.seed, c.feature_id, n.n_features) AS n
  FROM (SELECT seed, label, count(*) AS n_label FROM seed_split WHERE split = 'train' GROUP BY seed, label) l
  CROSS JOIN tr_chosen c JOIN (VALUES (1), (2), (4), (8)) n(n_features) ON c.rank <= n.n_features
  LEFT JOIN (SELECT s.seed, p.label, p.feature_id, count(*) AS n
             FROM picks p JOIN seed_split s USING (sample_id) WHERE s.split = 'train'
             GROUP BY s.seed, p.label, p.feature_id) k
    ON k.seed = l.seed AND k.label = l.label AND k.feature_id = c.feature_id""")
bayes("seed", "seed_counts", "seed, n_features")
grid_scores("seed", "seed, n_features", "seed_test")
cte("seed_acc", ("seed",), """
  SELECT seed, n_features, avg((pred = label)::INTEGER) AS accuracy FROM seed GROUP BY seed, n_features""")
cte("seed_mean", ("seed_acc",), """
  SELECT n_features, avg(accuracy) AS mean_acc, stddev_pop(accuracy) AS std_acc,
    list(round(accuracy, 9) ORDER BY seed) AS seed_accs FROM seed_acc GROUP BY n_features""")


@query("c14_sweep_summary", with_ctes("seed_mean alpha", """
  SELECT 'feature_count' AS section, n_features, NULL::DOUBLE AS alpha, round(mean_acc, 9) AS mean_acc,
    round(std_acc, 9) AS std_acc, seed_accs, n_features || '→4' AS layout,
    (8 * n_features + n_features + n_features * 4 + 4 + 4 * 10 + 10)::BIGINT AS n_params,
    n_features = (SELECT n_features FROM seed_mean ORDER BY round(mean_acc, 9) DESC, n_features LIMIT 1) AS is_best
  FROM seed_mean
  UNION ALL
  SELECT 'smoothing', NULL, alpha, round(avg((pred = label)::INTEGER), 9), NULL, NULL, NULL, NULL, NULL
  FROM alpha GROUP BY alpha"""))
def c14(spark, sf_dir):
    """Five seeded splits per feature count, and the smoothing sweep, as one table."""
    s = Study(spark, sf_dir)
    seeded = s.alive.withColumn("seed", F.explode(F.array(*[F.lit(i) for i in SEEDS])))
    cuts = split_cuts(seeded, RATIO, F.col("seed"), ["seed", "label"])
    people = with_split(seeded, cuts, F.col("seed"), ["seed", "label"])
    first = s.picks(s.first).withColumn("seed", F.explode(F.array(*[F.lit(i) for i in SEEDS])))
    first = with_split(first, cuts, F.col("seed"), ["seed", "label"])
    train, test = F.col("split") == "train", F.col("split") == "test"
    counts = lin.bernoulli_counts(first.where(train), people.where(train), s.ids, ["seed"])
    weights = _size_weights(s, counts, ["seed"])
    scored = lin.score(
        lin.with_bias(first.where(test), people.where(test), ["seed"]), weights, s.classes,
        on=["seed"], keys=["n_features"])
    results = stage(ev.over_seeds(ev.accuracy(scored, ["seed", "n_features"]), ["n_features"]))
    best = ev.best_per(results.withColumn("_one", F.lit(1)), ["_one"], "n_features").select(
        "n_features", F.lit(True).alias("_best"))
    hidden = F.array(F.col("n_features"), F.lit(4))
    sizes = results.join(F.broadcast(best), "n_features", "left").select(
        F.lit("feature_count").alias("section"), "n_features",
        F.round("mean_acc", 9).alias("mean_acc"), F.round("std_acc", 9).alias("std_acc"),
        F.transform("seed_accs", lambda a: F.round(a, 9)).alias("seed_accs"),
        ev.layout_label(hidden).alias("layout"),
        ev.parameter_count(F.lit(K), F.lit(len(s.classes)), hidden).alias("n_params"),
        F.coalesce("_best", F.lit(False)).alias("is_best"))
    smoothing = _alpha_accuracy(s).select(
        F.lit("smoothing").alias("section"), "alpha", F.round("accuracy", 9).alias("mean_acc"))
    return ev.union_sections([sizes, smoothing])
