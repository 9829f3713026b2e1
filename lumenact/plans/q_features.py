"""Queries: sparse encoding, firing statistics, feature discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import activations as acts
from ..operators import discover as dis
from ..operators import encode as enc
from ..operators.corpus import with_split
from . import fixtures as fx
from .catalog import query
from .oracle import with_ctes
from .study import K, Study, encoded


def _all_variance(s: Study):
    return dis.cross_topic_variance(dis.topic_firing_rate(s.first, s.alive))


@query("a01_capture_modes", """
  WITH rows AS (
    SELECT conv_id, turn, role, text FROM conversations),
  prompt AS (SELECT conv_id, arg_max(text, turn) AS text FROM rows
             WHERE role IS DISTINCT FROM 'assistant' GROUP BY conv_id),
  reply AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS step
            FROM rows WHERE role = 'assistant')
  SELECT 'decode' AS mode, conv_id, 'decode' AS kind, step, md5(text) AS h FROM reply
  UNION ALL SELECT 'prefill', conv_id, 'prefill', 0, md5(text) FROM prompt
  UNION ALL SELECT 'prefill+decode', conv_id, 'prefill', 0, md5(text) FROM prompt
  UNION ALL SELECT 'prefill+decode', r.conv_id, 'decode',
    step + CASE WHEN p.conv_id IS NULL THEN 0 ELSE 1 END, md5(r.text)
  FROM reply r LEFT JOIN prompt p ON p.conv_id = r.conv_id""")
def a01(spark, sf_dir):
    """Every capture mode over the turns: system and user turns are prompt positions."""
    rows = (
        fx.table(spark, sf_dir, "conversations")
        .select("conv_id", F.when(F.col("role") == "assistant", acts.DECODE).otherwise(acts.PREFILL).alias("kind"),
                F.col("turn").alias("step"), F.md5("text").alias("h"))
    )
    out = None
    for mode in (acts.DECODE, acts.PREFILL, acts.PREFILL_DECODE):
        part = acts.select_capture(rows, mode, ["conv_id"]).select(
            F.lit(mode).alias("mode"), "conv_id", "kind", "step", "h")
        out = part if out is None else out.unionByName(part)
    return out


@query("a02_active_steps", """
  WITH steps AS (
    SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step
    FROM events),
  ends AS (SELECT user_id, min(step) AS stop FROM steps WHERE event_type = 'purchase' GROUP BY user_id)
  SELECT s.user_id, s.step, s.event_type FROM steps s LEFT JOIN ends e USING (user_id)
  WHERE s.step < least(coalesce(e.stop, 512), 512)""")
def a02(spark, sf_dir):
    """Events of each user up to the first purchase, numbered from 0."""
    events = fx.table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    hours = F.floor(F.unix_timestamp("ts") / 3600)
    steps = acts.bucketed_rank(events, ["ts", "event_id"], hours, ["user_id"], "step")
    return acts.active_steps(steps, F.col("event_type") == "purchase", 512, "user_id").select(
        "user_id", "step", "event_type")


@query("a03_topk_encode", with_ctes("pre", """
  SELECT sample_id, layer, step, feature_id FROM (
    SELECT *, row_number() OVER (PARTITION BY sample_id, layer, step ORDER BY plain DESC, feature_id) AS rn FROM pre)
  WHERE rn <= 4"""))
def a03(spark, sf_dir):
    rows = encoded(spark, fx.activations(spark, sf_dir), enc.TOPK)
    return rows.select("sample_id", "layer", "step", F.explode("fired").alias("feature_id"))


@query("a04_jumprelu_encode", with_ctes("fired", "SELECT sample_id, layer, step, feature_id FROM fired"))
def a04(spark, sf_dir):
    rows = encoded(spark, fx.activations(spark, sf_dir))
    return rows.select("sample_id", "layer", "step", F.explode("fired").alias("feature_id"))


@query("a05_stored_bytes", with_ctes("hidden split", """
  SELECT split, layer, count(*) // 8 AS n_vectors, count(*) * 2 AS n_bytes
  FROM hidden JOIN split USING (sample_id) GROUP BY split, layer"""))
def a05(spark, sf_dir):
    s = Study(spark, sf_dir)
    rows = with_split(fx.activations(spark, sf_dir).select("sample_id", "label", "layer", "h"), s.cuts, groups=["label"])
    return acts.stored_bytes(rows, 2, ["split", "layer"])


@query("f01_first_fire", with_ctes("first_fire", "SELECT * FROM first_fire"))
def f01(spark, sf_dir):
    return dis.first_fire(Study(spark, sf_dir).fired)


@query("f02_firing_rate", with_ctes("first_fire alive", """
  SELECT layer, feature_id, count(*) AS n_fired,
    round(count(*)::DOUBLE / (SELECT count(*) FROM alive), 9) AS rate
  FROM first_fire GROUP BY layer, feature_id"""))
def f02(spark, sf_dir):
    s = Study(spark, sf_dir)
    return dis.firing_rate(dis.first_fire(s.fired), s.alive).withColumn("rate", F.round("rate", 9))


@query("f03_topic_rate", with_ctes("all_rates", """
  SELECT layer, label, feature_id, round(rate, 9) AS rate FROM all_rates WHERE rate > 0"""))
def f03(spark, sf_dir):
    s = Study(spark, sf_dir)
    return dis.topic_firing_rate(dis.first_fire(s.fired), s.alive).select(
        "layer", "label", "feature_id", F.round("rate", 9).alias("rate"))


@query("f04_topic_variance", with_ctes("all_var", """
  SELECT layer, feature_id, round(variance, 9) AS variance FROM all_var"""))
def f04(spark, sf_dir):
    s = Study(spark, sf_dir)
    rates = dis.topic_firing_rate(dis.first_fire(s.fired), s.alive)
    dense = dis.dense_variance(dis.cross_topic_variance(rates), fx.layer_frame(spark), fx.D_SAE)
    return dense.withColumn("variance", F.round("variance", 9))


FLAGSHIP_SQL = with_ctes("all_ranked", """
  SELECT layer, rank, feature_id, round(variance, 9) AS variance FROM all_ranked WHERE rank <= 8""")


@query("f05_topk_features", FLAGSHIP_SQL)
def f05(spark, sf_dir):
    s = Study(spark, sf_dir)
    variance = dis.cross_topic_variance(dis.topic_firing_rate(dis.first_fire(s.fired), s.alive))
    return dis.top_features(variance, K).select(
        "layer", "rank", "feature_id", F.round("variance", 9).alias("variance"))


@query("f06_layer_score", with_ctes("all_scores all_best", """
  SELECT s.layer, round(s.score, 9) AS score, s.layer = b.layer AS is_best FROM all_scores s, all_best b"""))
def f06(spark, sf_dir):
    s = Study(spark, sf_dir)
    scores = dis.layer_scores(_all_variance(s), K, fx.D_SAE)
    best = F.broadcast(dis.best_layer(scores).select("layer", F.lit(True).alias("_best")))
    return scores.join(best, "layer", "left").select(
        "layer", F.round("score", 9).alias("score"), F.coalesce("_best", F.lit(False)).alias("is_best"))


@query("f07_layer_override", with_ctes("all_ranked", """
  SELECT layer, rank, feature_id, round(variance, 9) AS variance FROM all_ranked WHERE rank <= 8 AND layer = 1"""))
def f07(spark, sf_dir):
    """A fixed layer: the other layers are never encoded."""
    s = Study(spark, sf_dir)
    rows = enc.encode(
        fx.activations(spark, sf_dir), fx.sae_weights(spark), enc.JUMPRELU,
        bias=fx.sae_bias(spark), layers=[1], precision="float64")
    return dis.discover(dis.first_fire(rows), s.alive, K, fx.D_SAE, layer=1).select(
        "layer", "rank", "feature_id", F.round("variance", 9).alias("variance"))


@query("f08_variance_stats", with_ctes("all_var all_ranked", """
  SELECT v.*, c.feature_ids, c.feature_variances FROM (
    SELECT layer, round(avg(variance), 9) AS mean, round(stddev_pop(variance), 9) AS std,
      round(quantile_cont(variance, 0.5), 9) AS p50, round(quantile_cont(variance, 0.9), 9) AS p90,
      round(quantile_cont(variance, 0.95), 9) AS p95, round(quantile_cont(variance, 0.99), 9) AS p99,
      round(max(variance), 9) AS max, count(*) FILTER (variance > 0) AS n_nonzero
    FROM all_var GROUP BY layer) v
  JOIN (SELECT layer, string_agg(feature_id, ',' ORDER BY rank) AS feature_ids,
          list(round(variance, 9) ORDER BY rank) AS feature_variances
        FROM all_ranked WHERE rank <= 8 GROUP BY layer) c USING (layer)"""))
def f08(spark, sf_dir):
    s = Study(spark, sf_dir)
    variance = _all_variance(s)
    stats = dis.variance_summary(variance, fx.D_SAE, [50, 90, 95, 99])
    ranked = dis.ranked_variances(dis.top_features(variance, K))
    cols = [F.round(c, 9).alias(c) for c in ("mean", "std", "p50", "p90", "p95", "p99", "max")]
    return stats.join(ranked, "layer").select(
        "layer", *cols, "n_nonzero",
        F.array_join("feature_ids", ",").alias("feature_ids"),
        F.transform("feature_variances", lambda v: F.round(v, 9)).alias("feature_variances"))


@query("f09_feature_table", with_ctes("first_fire split tr_chosen", """
  SELECT s.sample_id, s.split, s.label, """ + ", ".join(
    f"coalesce(max(CASE WHEN c.rank = {i} THEN 1.0 END), 0.0)::FLOAT AS rank_{i}" for i in range(1, K + 1)) + """
  FROM split s LEFT JOIN first_fire f USING (sample_id)
    LEFT JOIN tr_chosen c ON c.layer = f.layer AND c.feature_id = f.feature_id
  GROUP BY s.sample_id, s.split, s.label"""))
def f09(spark, sf_dir):
    """0/1 columns of the chosen features; named by rank so both sides agree."""
    s = Study(spark, sf_dir)
    ids = dis.feature_ids_in_order(s.chosen)
    wide = dis.feature_table(s.first, s.alive, s.chosen, ids)
    renamed = wide.toDF("sample_id", *[f"rank_{i + 1}" for i in range(len(ids))], "label")
    return with_split(renamed, s.cuts, groups=["label"])


@query("f10_feature_prefix", with_ctes("first_fire tr_chosen", """
  SELECT f.sample_id, n.n AS n_features, count(*) AS n_fired
  FROM first_fire f JOIN tr_chosen c ON c.layer = f.layer AND c.feature_id = f.feature_id
    JOIN (VALUES (1), (2), (4), (8)) n(n) ON c.rank <= n.n
  GROUP BY f.sample_id, n.n"""))
def f10(spark, sf_dir):
    s = Study(spark, sf_dir)
    sizes = F.explode(F.filter(
        F.array(*[F.lit(n) for n in (1, 2, 4, 8)]), lambda n: F.col("rank") <= n)).alias("n_features")
    fired = s.first.join(F.broadcast(dis.feature_prefix(s.chosen, 8)), ["layer", "feature_id"])
    return fired.select("sample_id", sizes).groupBy("sample_id", "n_features").agg(
        F.count(F.lit(1)).alias("n_fired"))
