"""Queries: curves and early stops over long generations.

The words of a document are its steps. A word fires the feature its digest
names, and a fixed linear model scores the languages, so every part of the
evaluation grid up to 512 is reached.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from ..operators import temporal as tmp
from ..operators.linear import BIAS
from ..session import stage
from . import fixtures as fx
from .catalog import query
from .oracle import cte, decisions, with_ctes

LANGUAGES = ("de", "en", "es", "fr")
N_FEATURES = 256
MAX_STEPS = 512
MIN_STEPS = 16
GRID = tmp.evaluation_grid(MAX_STEPS)
TARGETS = (0.5, 0.9, 0.99, 0.999)
WORD_GAP = "[ \\t\\n\\r]+"
HEX = "0123456789abcdef"


class LongStudy:
    """First firings, samples and model over the words of the documents."""

    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def words(self):
        """(sample_id, label, words) of the documents that have a text."""
        label = F.coalesce(*[F.when(F.col("lang") == c, F.lit(i)) for i, c in enumerate(LANGUAGES)])
        return fx.table(self.spark, self.sf_dir, "documents").where(F.col("text").isNotNull()).select(
            F.col("doc_id").alias("sample_id"), label.alias("label"), F.split("text", WORD_GAP).alias("words"))

    @cached_property
    def steps(self):
        return self.words.select("sample_id", "label", F.posexplode("words").alias("step", "word"))

    @cached_property
    def first(self):
        digest = F.md5("word")
        feature = (F.instr(F.lit(HEX), F.substring(digest, 1, 1)) - 1) * 16 + F.instr(
            F.lit(HEX), F.substring(digest, 2, 1)) - 1
        return self.steps.groupBy("sample_id", "label", feature.cast("int").alias("feature_id")).agg(
            F.min("step").alias("first_step"))

    @cached_property
    def samples(self):
        return self.words.groupBy("sample_id", "label").agg(F.sum(F.size("words")).cast("int").alias("n_steps"))

    @cached_property
    def weights(self):
        """Multiples of a sixteenth, whose sums are exact in any order."""
        rows = [(f, [((f * (c + 3)) % 17 - 8) / 16.0 for c in range(len(LANGUAGES))]) for f in range(N_FEATURES)]
        rows.append((BIAS, [c / 8.0 for c in range(len(LANGUAGES))]))
        return self.spark.createDataFrame(rows, "feature_id int, w array<double>")

    @cached_property
    def curve(self):
        return tmp.confidence_curve(
            self.first, self.samples, self.weights, list(range(len(LANGUAGES))), GRID)

    @cached_property
    def stops(self):
        changes = tmp.confidence_changes(
            self.first, self.samples, self.weights, list(range(len(LANGUAGES))), GRID, MIN_STEPS)
        return tmp.early_stop(changes, TARGETS, MIN_STEPS, MAX_STEPS)


cte("long_steps", (), f"""
  SELECT doc_id AS sample_id, list_position({list(LANGUAGES)}, lang) - 1 AS label,
    unnest(string_split_regex(text, '{WORD_GAP}')) AS word,
    generate_subscripts(string_split_regex(text, '{WORD_GAP}'), 1) - 1 AS step
  FROM documents""")
cte("long_first", ("long_steps",), f"""
  SELECT sample_id, label, feature_id, min(step) AS first_step FROM (
    SELECT *, (instr('{HEX}', substr(md5(word), 1, 1)) - 1) * 16 + instr('{HEX}', substr(md5(word), 2, 1)) - 1 AS feature_id
    FROM long_steps) GROUP BY sample_id, label, feature_id""")
cte("long_samples", ("long_steps",), """
  SELECT sample_id, label, count(*) AS n_steps FROM long_steps GROUP BY sample_id, label""")
cte("long_grid", (), f"SELECT unnest({GRID}) AS t")
cte("long_scores", ("long_first", "long_samples", "long_grid"), """
  SELECT s.sample_id, s.label, g.t, c.cls,
    c.cls / 8.0::DOUBLE + coalesce(sum((((f.feature_id * (c.cls + 3)) % 17) - 8) / 16.0::DOUBLE), 0) AS score
  FROM long_samples s CROSS JOIN long_grid g CROSS JOIN range(4) c(cls)
  LEFT JOIN long_first f ON f.sample_id = s.sample_id AND f.first_step < g.t
  GROUP BY s.sample_id, s.label, g.t, c.cls""")
decisions("long_curve", "long_scores", "sample_id, label, t")
cte("long_stops", ("long_curve",), f"""
  SELECT s.sample_id, s.label, g.target,
    CAST(coalesce(min(s.t) FILTER (s.t >= {MIN_STEPS} AND s.confidence >= g.target), {MAX_STEPS}) AS INTEGER) AS tokens,
    coalesce(arg_min(s.pred, s.t) FILTER (s.t >= {MIN_STEPS} AND s.confidence >= g.target), arg_max(s.pred, s.t)) AS pred
  FROM long_curve s CROSS JOIN (SELECT unnest([{", ".join(f"{t}::DOUBLE" for t in TARGETS)}]) AS target) g
  GROUP BY s.sample_id, s.label, g.target""")


def _rounded(df, *names):
    return df.select(*[F.round(c, 7).alias(c) if c in names else c for c in df.columns])


@query("d01_long_grid", with_ctes("long_samples long_grid", """
  SELECT g.t::INTEGER AS t, count(*) FILTER (s.n_steps >= g.t) AS n_active
  FROM long_grid g CROSS JOIN long_samples s WHERE g.t <= (SELECT max(n_steps) FROM long_samples) GROUP BY g.t"""))
def d01_long(spark, sf_dir):
    s = LongStudy(spark, sf_dir)
    longest = s.samples.agg(F.least(F.max("n_steps"), F.lit(MAX_STEPS)).alias("max_steps"))
    lengths = s.samples.groupBy("n_steps").agg(F.count(F.lit(1)).alias("_n"))
    reached = lengths.select("_n", F.explode(F.sequence(F.lit(1), F.col("n_steps"))).alias("t")).groupBy("t").agg(
        F.sum("_n").alias("n_active"))
    return tmp.evaluation_grid_frame(longest).join(reached, "t")


@query("d05_long_curve", with_ctes("long_curve", """
  SELECT t, round(avg((pred = label)::INTEGER), 7) AS accuracy, round(avg(confidence), 7) AS mean_confidence,
    round(quantile_cont(confidence, 0.5), 7) AS median_confidence
  FROM long_curve WHERE t <= 200 OR t % 40 = 0 GROUP BY t"""))
def d05_long(spark, sf_dir):
    """The curve is computed once: the means, the sketch and the medians read it back, only what they need of it."""
    curve = stage(tmp.reported(LongStudy(spark, sf_dir).curve).select("t", "label", "pred", "confidence"))
    return _rounded(tmp.curve_summary(curve), "accuracy", "mean_confidence", "median_confidence")


@query("d06_long_stops", with_ctes("long_stops", "SELECT sample_id, label, target, tokens, pred FROM long_stops"))
def d06_long(spark, sf_dir):
    return LongStudy(spark, sf_dir).stops


@query("d08_long_early_stop", with_ctes("long_stops", f"""
  SELECT target, round(avg((pred = label)::INTEGER), 7) AS accuracy, round(avg(tokens), 7) AS mean_tokens,
    quantile_cont(tokens, 0.5)::DOUBLE AS median_tokens, round(avg((tokens < {MAX_STEPS})::INTEGER), 7) AS pct_early
  FROM long_stops GROUP BY target"""))
def d08_long(spark, sf_dir):
    stops = LongStudy(spark, sf_dir).stops
    return _rounded(tmp.early_stop_summary(stops, MAX_STEPS), "accuracy", "mean_tokens", "pct_early")
