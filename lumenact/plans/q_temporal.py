"""Queries: confidence curves, early stopping, snapshots, lock-in."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import discover as dis
from ..operators import dynamics as dyn
from ..operators import encode as enc
from ..operators import lockin as lock
from ..operators import temporal as tmp
from ..operators.corpus import split_cuts, with_split
from ..session import stage
from . import fixtures as fx
from .catalog import query
from .oracle import bayes, cte, decisions, with_ctes
from .study import RATIO, SEED, Study

GRID = list(range(1, fx.MAX_STEPS + 1))
SNAPSHOTS = tmp.snapshot_grid(2, fx.MAX_STEPS)
# The steps at which example traces are reported.
TRACE_STEPS = (1, 5, 10, 20, 30, 50, 75, 100, 150, 200, 300, 512)
TARGETS = (0.2, 0.3, 0.5, 0.9, 0.95, 0.99)
MIN_STEPS = 2
LOCKIN_LEVEL = 0.2


def _round(df, *names, digits=9):
    return df.select(*[F.round(c, digits).alias(c) if c in names else c for c in df.columns])


@query("d01_evaluation_grid", with_ctes("samples", """
  SELECT g.t::INTEGER AS t, count(*) FILTER (s.n_steps >= g.t) AS n_active
  FROM (SELECT t FROM range(1, 51) g(t) UNION SELECT t FROM range(55, 201, 5) g(t)
        UNION SELECT t FROM range(220, 513, 20) g(t)) g, samples s
  WHERE g.t <= (SELECT max(n_steps) FROM samples) GROUP BY g.t"""))
def d01(spark, sf_dir):
    """The grid up to the longest sample, and the samples reaching each point."""
    samples = fx.samples(spark, sf_dir)
    grid = tmp.evaluation_grid_frame(samples.agg(F.max("n_steps").alias("max_steps")))
    reached = (
        samples.where(F.col("n_steps") > 0).groupBy("n_steps").agg(F.count(F.lit(1)).alias("_n"))
        .select("_n", F.explode(F.sequence(F.lit(1), F.col("n_steps"))).alias("t"))
        .groupBy("t").agg(F.sum("_n").alias("n_active"))
    )
    return grid.join(reached, "t", "left").select("t", F.coalesce("n_active", F.lit(0).cast("long")).alias("n_active"))


@query("d02_snapshot_grid", with_ctes("samples", """
  SELECT g.t::INTEGER AS t, count(*) FILTER (s.n_steps >= g.t) AS n_active
  FROM range(2, 9, 2) g(t), samples s GROUP BY g.t"""))
def d02(spark, sf_dir):
    points = F.explode(F.filter(tmp._literal(SNAPSHOTS), lambda t: t <= F.col("n_steps"))).alias("t")
    active = fx.samples(spark, sf_dir).select(points).groupBy("t").agg(F.count(F.lit(1)).alias("n_active"))
    grid = spark.createDataFrame([(t,) for t in SNAPSHOTS], "t int")
    return grid.join(active, "t", "left").fillna(0, ["n_active"])


@query("d03_cumulative_fired", with_ctes("picks", """
  SELECT p.sample_id, p.feature_id, g.t::INTEGER AS t FROM picks p JOIN range(1, 9) g(t) ON p.first_step < g.t"""))
def d03(spark, sf_dir):
    s = Study(spark, sf_dir)
    return tmp.fired_by(s.picks(s.first), GRID)


@query("d04_confidence", with_ctes("curve", "SELECT * FROM curve"))
def d04(spark, sf_dir):
    return Study(spark, sf_dir).curve(GRID)


@query("d05_confidence_curve", with_ctes("curve", """
  SELECT t, round(avg((pred = label)::INTEGER), 7) AS accuracy, round(avg(confidence), 7) AS mean_confidence,
    round(quantile_cont(confidence, 0.5), 7) AS median_confidence
  FROM curve WHERE t <= 200 OR t % 40 = 0 GROUP BY t"""))
def d05(spark, sf_dir):
    curve = stage(Study(spark, sf_dir).curve(GRID))
    return _round(tmp.curve_summary(curve), "accuracy", "mean_confidence", "median_confidence", digits=7)


cte("stops", ("curve",), """
  SELECT s.sample_id, s.label, g.target,
    CAST(coalesce(min(s.t) FILTER (s.t >= 2 AND s.confidence >= g.target), 8) AS INTEGER) AS tokens,
    coalesce(arg_min(s.pred, s.t) FILTER (s.t >= 2 AND s.confidence >= g.target), arg_max(s.pred, s.t)) AS pred
  FROM curve s CROSS JOIN (SELECT unnest([0.2::DOUBLE, 0.3::DOUBLE, 0.5::DOUBLE, 0.9::DOUBLE, 0.95::DOUBLE,
    0.99::DOUBLE]) AS target) g
  GROUP BY s.sample_id, s.label, g.target""")


def _stops(s: Study, targets=TARGETS):
    changes = tmp.confidence_changes(
        s.picks(s.test_first), s.test, s.weights, s.classes, GRID, MIN_STEPS)
    return tmp.early_stop(changes, targets, MIN_STEPS, fx.MAX_STEPS)


@query("d06_first_crossing", with_ctes("stops", "SELECT sample_id, label, target, tokens FROM stops"))
def d06(spark, sf_dir):
    return _stops(Study(spark, sf_dir)).drop("pred")


@query("d07_median_stop", with_ctes("stops", """
  SELECT target, label, CAST(trunc(quantile_cont(tokens, 0.5)) AS INTEGER) AS median_stop
  FROM stops GROUP BY GROUPING SETS ((target, label), (target))"""))
def d07(spark, sf_dir):
    return tmp.median_stop(_stops(Study(spark, sf_dir)))


EARLY_STOP = """
  round(avg((pred = label)::INTEGER), 9) AS accuracy, round(avg(tokens), 9) AS mean_tokens,
  quantile_cont(tokens, 0.5)::DOUBLE AS median_tokens, round(avg((tokens < 8)::INTEGER), 9) AS pct_early"""


@query("d08_early_stop", with_ctes("stops", f"SELECT target, {EARLY_STOP} FROM stops GROUP BY target"))
def d08(spark, sf_dir):
    summary = tmp.early_stop_summary(_stops(Study(spark, sf_dir)), fx.MAX_STEPS)
    return _round(summary, "accuracy", "mean_tokens", "pct_early")


@query("d09_early_stop_by_topic", with_ctes("stops", f"""
  SELECT label, {EARLY_STOP} FROM stops WHERE target = 0.3::DOUBLE GROUP BY label"""))
def d09(spark, sf_dir):
    summary = tmp.early_stop_summary(_stops(Study(spark, sf_dir), (0.3,)), fx.MAX_STEPS, ["label"])
    return _round(summary, "accuracy", "mean_tokens", "pct_early")


@query("d10_example_traces", with_ctes("curve test", """
  SELECT c.label, c.sample_id, c.t, c.confidence, c.pred, c.pred = c.label AS correct
  FROM curve c JOIN (SELECT label, min(sample_id) AS sample_id FROM test GROUP BY label) f
    ON f.sample_id = c.sample_id
  WHERE c.t IN {steps}""".replace("{steps}", str(TRACE_STEPS))))
def d10(spark, sf_dir):
    """Only the firings and samples that are shown go through the curve."""
    s = Study(spark, sf_dir)
    shown = tmp.first_samples(s.test)
    curve = tmp.confidence_curve(
        s.picks(s.test_first).join(shown, "sample_id", "left_semi"), s.test.join(shown, "sample_id", "left_semi"),
        s.weights, s.classes, GRID)
    return tmp.example_traces(curve, TRACE_STEPS)


# Snapshots count every sample, dead ones as never firing.
cte("split_every", ("samples",), """
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5('42:' || sample_id), sample_id)
      <= floor(count(*) OVER (PARTITION BY label) * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split
  FROM samples""")
cte("train_every", ("split_every",), "SELECT * FROM split_every WHERE split = 'train'")
cte("test_every", ("split_every",), "SELECT * FROM split_every WHERE split = 'test'")
cte("snap_rates", ("first_fire", "train_every", "tr_best"), """
  SELECT g.t::INTEGER AS t, f.f::INTEGER AS feature_id, n.label, count(p.sample_id)::DOUBLE / n.n_label AS rate
  FROM range(2, 9, 2) g(t) CROSS JOIN range(32) f(f)
  CROSS JOIN (SELECT label, count(*) AS n_label FROM train_every GROUP BY label) n
  LEFT JOIN (SELECT * FROM first_fire WHERE layer = (SELECT layer FROM tr_best)
             AND sample_id IN (SELECT sample_id FROM train_every)) p
    ON p.label = n.label AND p.feature_id = f.f AND p.first_step < g.t
  GROUP BY g.t, f.f, n.label, n.n_label""")
cte("snap_var", ("snap_rates",), """
  SELECT t, feature_id, var_pop(rate) AS variance FROM snap_rates GROUP BY t, feature_id""")


class Snapshots(Study):
    """The study over all samples, split without dropping dead ones."""

    def __init__(self, spark, sf_dir):
        super().__init__(spark, sf_dir)
        self.every_cuts = split_cuts(self.samples, RATIO, SEED, ["label"])

    def every(self, df, split):
        return with_split(df, self.every_cuts, SEED, ["label"]).where(F.col("split") == split).drop("split")

    def variance(self):
        layer_first = self.first.where(F.col("layer") == self.layer)
        return dyn.snapshot_variance(
            self.every(layer_first, "train"), self.every(self.samples, "train"), SNAPSHOTS)

    def weights_by_step(self):
        return dyn.snapshot_weights(
            self.picks(self.every(self.first, "train")), self.every(self.samples, "train"), self.ids, SNAPSHOTS)

    def predictions_by_step(self):
        return dyn.snapshot_predictions(
            self.picks(self.every(self.first, "test")), self.every(self.samples, "test"),
            self.weights_by_step(), self.classes, SNAPSHOTS)


@query("d11_snapshot_variance", with_ctes("snap_var", """
  SELECT t, feature_id, round(variance, 9) AS variance FROM snap_var WHERE round(variance, 12) > 0"""))
def d11(spark, sf_dir):
    rows = Snapshots(spark, sf_dir).variance()
    return _round(rows.where(F.round("variance", 12) > 0), "variance")


@query("d12_snapshot_variance_stats", with_ctes("snap_var", """
  SELECT t, round(avg(variance), 9) AS mean, round(stddev_pop(variance), 9) AS std,
    round(quantile_cont(variance, 0.5), 9) AS p50, round(quantile_cont(variance, 0.9), 9) AS p90,
    round(quantile_cont(variance, 0.99), 9) AS p99, round(max(variance), 9) AS max,
    count(*) FILTER (round(variance, 12) > 0) AS n_nonzero
  FROM snap_var GROUP BY t"""))
def d12(spark, sf_dir):
    rows = Snapshots(spark, sf_dir).variance().withColumn("variance", F.round("variance", 12))
    stats = dis.variance_summary(rows, fx.D_SAE, [50, 90, 99], ["t"])
    return _round(stats, "mean", "std", "p50", "p90", "p99", "max")


@query("d13_snapshot_top_features", with_ctes("snap_var", """
  SELECT t, CAST(rank AS INTEGER) AS rank, feature_id, round(variance, 9) AS variance, rank <= 3 AS in_top3 FROM (
    SELECT *, row_number() OVER (PARTITION BY t ORDER BY round(variance, 12) DESC, feature_id) AS rank FROM snap_var)
  WHERE rank <= 10 AND round(variance, 12) > 0"""))
def d13(spark, sf_dir):
    rows = Snapshots(spark, sf_dir).variance().where(F.round("variance", 12) > 0)
    top = dis.top_features(rows, 10, ["t"])
    return _round(top, "variance").withColumn("in_top3", F.col("rank") <= 3)


cte("snap_counts", ("picks", "train_every", "tr_chosen"), """
  SELECT g.t::INTEGER AS t, n.label AS cls, c.feature_id, count(p.sample_id) AS n_fired, n.n_label,
    (SELECT count(*) FROM train_every) AS n
  FROM range(2, 9, 2) g(t) CROSS JOIN tr_chosen c
  CROSS JOIN (SELECT label, count(*) AS n_label FROM train_every GROUP BY label) n
  LEFT JOIN (SELECT * FROM picks WHERE sample_id IN (SELECT sample_id FROM train_every)) p
    ON p.label = n.label AND p.feature_id = c.feature_id AND p.first_step < g.t
  GROUP BY g.t, n.label, c.feature_id, n.n_label""")
bayes("snap", "snap_counts", "t")
cte("snap_scores", ("test_every", "snap_w", "snap_b", "picks"), """
  SELECT s.sample_id, s.label, b.t, b.cls, max(b.b) + coalesce(sum(w.w), 0) AS score
  FROM test_every s CROSS JOIN snap_b b
  LEFT JOIN picks p ON p.sample_id = s.sample_id AND p.first_step < b.t
  LEFT JOIN snap_w w ON w.t = b.t AND w.cls = b.cls AND w.feature_id = p.feature_id
  GROUP BY s.sample_id, s.label, b.t, b.cls""")
decisions("snap_pred", "snap_scores", "sample_id, label, t")
cte("snap_summary", ("snap_pred",), """
  SELECT t, label, round(avg((pred = label)::INTEGER), 7) AS accuracy, round(avg(confidence), 7) AS mean_confidence
  FROM snap_pred GROUP BY GROUPING SETS ((t), (t, label))""")


@query("d14_snapshot_classifiers", with_ctes("snap_pred", "SELECT * FROM snap_pred"))
def d14(spark, sf_dir):
    return Snapshots(spark, sf_dir).predictions_by_step()


@query("d15_snapshot_accuracy", with_ctes("snap_summary", "SELECT * FROM snap_summary"))
def d15(spark, sf_dir):
    return _round(dyn.snapshot_summary(Snapshots(spark, sf_dir).predictions_by_step()), "accuracy", "mean_confidence",
                  digits=7)


@query("d16_topic_crossing", with_ctes("snap_summary", """
  SELECT label, target, CAST(coalesce(min(t) FILTER (mean_confidence >= target), 8) AS INTEGER) AS step
  FROM snap_summary CROSS JOIN (SELECT unnest([0.2::DOUBLE, 0.25::DOUBLE, 0.9::DOUBLE]) AS target)
  WHERE label IS NOT NULL GROUP BY label, target"""))
def d16(spark, sf_dir):
    summary = dyn.snapshot_summary(Snapshots(spark, sf_dir).predictions_by_step())
    return dyn.topic_crossing(summary, (0.2, 0.25, 0.9), fx.MAX_STEPS)


cte("coverage", ("test",), """
  SELECT g.t::INTEGER AS step, count(*) FILTER (s.n_steps > g.t) AS n_active,
    count(*) FILTER (s.n_steps > g.t) / count(*)::DOUBLE AS coverage
  FROM range(0, 8) g(t), test s GROUP BY g.t
  HAVING count(*) FILTER (s.n_steps > g.t) / count(*)::DOUBLE >= 0.5::DOUBLE""")


@query("d17_step_coverage", with_ctes("coverage", """
  SELECT step, n_active, round(coverage, 9) AS coverage FROM coverage"""))
def d17(spark, sf_dir):
    return _round(lock.step_coverage(Study(spark, sf_dir).test), "coverage").withColumn(
        "n_active", F.col("n_active").cast("long"))


cte("step_rates", ("fired", "test", "tr_best", "coverage"), """
  SELECT a.step, f.f AS feature_id, a.label, count(p.sample_id)::DOUBLE / a.n AS rate
  FROM (SELECT c.step, s.label, count(*) AS n FROM coverage c JOIN test s ON s.n_steps > c.step
        GROUP BY c.step, s.label) a
  CROSS JOIN range(32) f(f)
  LEFT JOIN (SELECT * FROM fired WHERE layer = (SELECT layer FROM tr_best)
             AND sample_id IN (SELECT sample_id FROM test)) p
    ON p.step = a.step AND p.label = a.label AND p.feature_id = f.f
  GROUP BY a.step, f.f, a.label, a.n""")
cte("step_var", ("step_rates", "coverage", "test"), """
  SELECT c.step, c.coverage, CASE WHEN n_present < (SELECT count(DISTINCT label) FROM test) THEN 0.0::DOUBLE
    ELSE v.variance END AS variance
  FROM coverage c JOIN (SELECT step, avg(variance) AS variance, min(n) AS n_present FROM (
      SELECT step, feature_id, var_pop(rate) AS variance, count(*) AS n FROM step_rates GROUP BY step, feature_id)
    GROUP BY step) v USING (step)""")


def _step_variance(s: Study):
    rows = enc.encode(
        fx.activations(s.spark, s.sf_dir), fx.sae_weights(s.spark), enc.JUMPRELU,
        bias=fx.sae_bias(s.spark), layers=[s.layer], precision="float64")
    return lock.single_step_variance(
        s.part(rows, "test"), s.test, lock.step_coverage(s.test), fx.D_SAE, len(s.classes))


@query("d18_single_step_variance", with_ctes("step_var", """
  SELECT step, round(coverage, 9) AS coverage, round(variance, 9) AS variance FROM step_var"""))
def d18(spark, sf_dir):
    return _round(_step_variance(Study(spark, sf_dir)), "coverage", "variance")


STEP_GRID = list(range(fx.MAX_STEPS))


def _analysed(s: Study):
    return lock.analysed(s.curve(STEP_GRID, inclusive=True), lock.step_coverage(s.test))


@query("d19_topic_confidence", with_ctes("steps_curve coverage", """
  SELECT label, t, round(avg(p_true), 7) AS mean_p_true
  FROM steps_curve WHERE t IN (SELECT step FROM coverage) GROUP BY label, t"""))
def d19(spark, sf_dir):
    return _round(lock.topic_confidence(_analysed(Study(spark, sf_dir))), "mean_p_true", digits=7)


cte("lockin", ("steps_curve", "coverage"), """
  SELECT sample_id, label, CAST(coalesce(min(t) FILTER (p_true >= 0.2::DOUBLE), -1) AS INTEGER) AS lockin
  FROM steps_curve WHERE t IN (SELECT step FROM coverage) GROUP BY sample_id, label""")
cte("lockin_summary", ("lockin",), """
  SELECT label, quantile_cont(lockin, 0.5) FILTER (lockin >= 0)::DOUBLE AS median,
    stddev_pop(lockin) FILTER (lockin >= 0) AS std, count(*) FILTER (lockin >= 0) AS n_reached,
    count(*) AS n_samples, 100.0::DOUBLE * count(*) FILTER (lockin >= 0) / count(*) AS pct_reached
  FROM lockin GROUP BY label""")


def _lockin(s: Study):
    return lock.lockin_steps(_analysed(s), LOCKIN_LEVEL)


@query("d20_lockin_step", with_ctes("lockin", "SELECT * FROM lockin"))
def d20(spark, sf_dir):
    return _lockin(Study(spark, sf_dir))


@query("d21_lockin_summary", with_ctes("lockin_summary", """
  SELECT label, median, round(std, 9) AS std, n_reached, n_samples, round(pct_reached, 9) AS pct_reached
  FROM lockin_summary"""))
def d21(spark, sf_dir):
    return _round(lock.lockin_summary(_lockin(Study(spark, sf_dir))), "std", "pct_reached")


@query("d22_lockin_spread", with_ctes("lockin_summary", """
  SELECT CASE WHEN count(median) > 1 THEN max(median) - min(median) END AS spread,
    CASE WHEN count(median) > 1 THEN max(median) - min(median) < 10 END AS consistent FROM lockin_summary"""))
def d22(spark, sf_dir):
    return lock.median_spread(lock.lockin_summary(_lockin(Study(spark, sf_dir))))


@query("d23_peak_step", with_ctes("step_var", """
  SELECT step, round(variance, 9) AS variance FROM step_var ORDER BY round(step_var.variance, 12) DESC, step LIMIT 1"""))
def d23(spark, sf_dir):
    return _round(lock.peak_step(_step_variance(Study(spark, sf_dir))), "variance")


@query("d24_lockin_boxes", with_ctes("lockin", """
  SELECT label, max(q1) AS q1, max(q2) AS q2, max(q3) AS q3,
    min(lockin) FILTER (near) AS whisker_low, max(lockin) FILTER (near) AS whisker_high,
    count(*) FILTER (NOT near) AS n_outliers
  FROM (SELECT l.label, l.lockin, q.q1, q.q2, q.q3,
          l.lockin BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS near
        FROM lockin l JOIN (
          SELECT label, quantile_cont(lockin, 0.25)::DOUBLE AS q1, quantile_cont(lockin, 0.5)::DOUBLE AS q2,
            quantile_cont(lockin, 0.75)::DOUBLE AS q3 FROM lockin WHERE lockin >= 0 GROUP BY label) q USING (label)
        WHERE l.lockin >= 0)
  GROUP BY label"""))
def d24(spark, sf_dir):
    return lock.lockin_boxes(_lockin(Study(spark, sf_dir)))
