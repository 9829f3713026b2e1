"""Queries: what is written to files comes back as it was."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import discover as dis
from ..operators import prompts as pr
from ..operators.corpus import stratified_split
from ..schemas import GEN, PROMPT
from ..session import shared_dir
from ..sources import records as rec
from . import fixtures as fx
from .catalog import query
from .oracle import with_ctes
from .q_prompts import event_levels
from .study import RATIO, SEED, Study


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _prompt_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as prompt records; every third lacks a level, all lack a surface topic."""
    batch = F.floor(F.col("doc_id") / 8)
    given = {"batch_index": batch, "request_id": F.concat(F.lit("r"), batch.cast("string"))}
    gen = F.struct(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in GEN.fields])
    level = (F.col("doc_id") % 5).cast("int")
    return fx.table(spark, sf_dir, "documents").select(
        F.col("source").alias("subtopic"), F.col("lang").alias("topic"), level.alias("target_adversarial_level"),
        F.col("text").alias("prompt"), F.lit("ok").alias("_status"), gen.alias("_gen"),
        F.when(F.col("doc_id") % 3 != 0, level).alias("adversarial_level"),
        F.lit(None).cast("string").alias("surface_topic")).select(PROMPT.fieldNames())


@query("s01_prompt_records", """
  SELECT source AS subtopic, lang AS topic, (doc_id % 5)::INTEGER AS target_adversarial_level, md5(text) AS prompt,
    'ok' AS _status, doc_id // 8 AS batch_index, 'r' || (doc_id // 8) AS request_id,
    CASE WHEN doc_id % 3 <> 0 THEN (doc_id % 5)::INTEGER END AS adversarial_level, NULL::VARCHAR AS surface_topic
  FROM documents""")
def s01(spark, sf_dir):
    path = _folder(spark, "prompts")
    rec.write_prompts(_prompt_records(spark, sf_dir), path)
    return rec.read_prompts(spark, path).select(
        "subtopic", "topic", "target_adversarial_level", F.md5("prompt").alias("prompt"), "_status",
        "_gen.batch_index", "_gen.request_id", "adversarial_level", "surface_topic")


@query("s07_null_fields", """
  SELECT doc_id % 3 = 0 AS no_level, count(*) AS n FROM documents GROUP BY 1""")
def s07(spark, sf_dir):
    """Every line names all fields, also those without a value."""
    path = _folder(spark, "prompts")
    rec.write_prompts(_prompt_records(spark, sf_dir), path)
    lines = spark.read.text(path).where(F.col("value").endswith('"surface_topic":null}'))
    return lines.groupBy(F.col("value").contains('"adversarial_level":null,').alias("no_level")).agg(
        F.count(F.lit(1)).alias("n"))


@query("s04_prompt_labels", "SELECT md5(text) AS prompt, quality AS label FROM documents JOIN labels USING (doc_id)")
def s04(spark, sf_dir):
    path = _folder(spark, "labels")
    fx.table(spark, sf_dir, "documents").join(fx.table(spark, sf_dir, "labels"), "doc_id").select(
        "doc_id", F.col("text").alias("prompt"), F.col("quality").alias("label"), "lang").write.parquet(path)
    return rec.read_prompt_labels(spark, path).select(F.md5("prompt").alias("prompt"), "label")


@query("s05_latest_run", """
  SELECT label, count(*) AS n, 'c' AS model, (SELECT count(*) FROM embeddings) AS n_weights
  FROM embeddings WHERE vec_id % 3 = 2 GROUP BY label""")
def s05(spark, sf_dir):
    """Three runs of three models; the newest stamp wins."""
    folder = _folder(spark, "runs")
    rows = fx.table(spark, sf_dir, "embeddings")
    for part, model, stamp in ((0, "a", "20250301_120000"), (1, "b", "20250301_115959"), (2, "c", "20250302_000000")):
        prefix = f"{folder}/{model}_{stamp}"
        rec.write_manifest(spark, prefix, {"model": model, "seed": SEED})
        rows.where(F.col("vec_id") % 3 == part).select("vec_id", "label").write.parquet(f"{prefix}_test.parquet")
        rows.select("vec_id", "embedding").write.parquet(f"{prefix}_weights.parquet")
    run = rec.load_run(spark, rec.latest_run(spark, folder))
    counts = run["test"].groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumns({
        "model": F.lit(run["meta"].first()["model"]), "n_weights": F.lit(run["weights"].count()).cast("long")})


@query("s06_encoder_weights", """
  SELECT label AS layer, vec_id AS feature_id, len(embedding)::INTEGER AS d_model, embedding[1]::DOUBLE AS first
  FROM embeddings WHERE label % 2 = 0""")
def s06(spark, sf_dir):
    """Vectors in the place of weights, their labels as layers: every second layer, 64 wide."""
    path = _folder(spark, "weights")
    fx.table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("layer"), F.col("vec_id").alias("feature_id"), F.col("embedding").alias("w")
    ).write.partitionBy("layer").parquet(path)
    weights = rec.read_sae_weights(spark, path, stride=2, expected_d_model=64)
    return weights.select("layer", "feature_id", F.size("w").alias("d_model"), F.col("w")[0].cast("double").alias("first"))


@query("s08_split_tables", with_ctes("split", "SELECT sample_id, label, split FROM split"))
def s08(spark, sf_dir):
    path = _folder(spark, "splits")
    rec.write_split_tables(stratified_split(Study(spark, sf_dir).alive, RATIO, SEED, ["label"]), path)
    out = None
    for split in ("train", "test"):
        part = spark.read.parquet(f"{path}/split={split}").select("sample_id", "label", F.lit(split).alias("split"))
        out = part if out is None else out.unionByName(part)
    return out


@query("s09_manifest", """
  SELECT label, count(*) AS n, 'documents' AS name, (SELECT count(*) FROM embeddings) AS total
  FROM embeddings GROUP BY label""")
def s09(spark, sf_dir):
    prefix = f"{_folder(spark, 'manifest')}_20250101_000000"
    rows = fx.table(spark, sf_dir, "embeddings")
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    rec.write_manifest(spark, prefix, {"name": "documents", "counts": counts, "total": rows.count()})
    read = spark.read.json(f"{prefix}_meta.json", multiLine=True)
    return read.select("name", "total", F.explode("counts").alias("c")).select(
        F.col("c.label").cast("int").alias("label"), "c.n", "name", "total")


@query("s10_variances", with_ctes("all_var", """
  SELECT layer, feature_id, round(variance, 9) AS variance FROM all_var"""))
def s10(spark, sf_dir):
    path = _folder(spark, "variances")
    s = Study(spark, sf_dir)
    rates = dis.topic_firing_rate(dis.first_fire(s.fired), s.alive)
    rec.write_variances(dis.dense_variance(dis.cross_topic_variance(rates), fx.layer_frame(spark), fx.D_SAE), path)
    return spark.read.parquet(path).select("layer", "feature_id", F.round("variance", 9).alias("variance"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query("p15_system_prompt", with_ctes("taxonomy", f"""
  SELECT replace(replace({_quoted(pr.SYSTEM_TEMPLATE.replace('{tag}', pr.TAG))}, '{{levels}}', l.block),
    '{{taxonomy}}', t.block) AS system_prompt
  FROM (
    SELECT string_agg(block, chr(10) ORDER BY first) AS block FROM (
      SELECT min(ord) AS first, topic || ':' || chr(10)
        || string_agg('  - ' || subtopic || ': ' || description, chr(10) ORDER BY ord) AS block
      FROM taxonomy GROUP BY topic)) t,
  (
    SELECT string_agg('  Level ' || level || ' (' || event_type || '): ' || n || ' events' || chr(10)
      || '    -> by ' || users || ' users', chr(10) ORDER BY level) AS block
    FROM (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS level, count(*) AS n,
            count(DISTINCT user_id) AS users FROM events GROUP BY event_type)) l"""))
def p15(spark, sf_dir):
    """Languages as topics and event kinds as levels, in one set of instructions."""
    return pr.system_prompt(fx.doc_taxonomy(spark, sf_dir), event_levels(spark, sf_dir))
