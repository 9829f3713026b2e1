"""Queries: spec pools, plans, rendered prompts, reply parsing, run summary."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import prompts as pr
from ..operators import replies as rp
from ..session import stage
from . import fixtures as fx
from .catalog import query
from .oracle import cte, with_ctes

SEED = 42
VALUES = (0.2, 0.5, 0.7, 0.9, 1.0)
WEIGHTS = (1, 0, 3, 2, 4)
VALUES_SQL = "[0.2::DOUBLE, 0.5::DOUBLE, 0.7::DOUBLE, 0.9::DOUBLE, 1.0::DOUBLE]"

cte("taxonomy", (), """
  SELECT lang || '/' || source AS subtopic, lang AS topic, min(doc_id) AS ord, count(*) AS n_docs,
    'texts of up to ' || max(n_chars) || ' characters' AS description
  FROM documents GROUP BY lang, source""")
cte("pool", ("taxonomy",), """
  SELECT t.subtopic, t.topic, i.i,
    (('0x' || substr(md5('42:' || t.subtopic || ':' || i.i), 1, 8))::BIGINT % 5)::INTEGER AS target_adversarial_level
  FROM taxonomy t JOIN range(100000) i(i) ON i.i < t.n_docs""")
cte("batched", ("pool",), """
  SELECT *, row_number() OVER (ORDER BY md5('42:order:' || subtopic || ':' || i), subtopic, i) - 1 AS rn FROM pool""")


def _pool(spark, sf_dir):
    return pr.spec_pool(fx.doc_taxonomy(spark, sf_dir), [0, 1, 2, 3, 4], F.col("n_docs"), SEED)


@query("p01_spec_pool", with_ctes("pool", "SELECT * FROM pool"))
def p01(spark, sf_dir):
    """As many specs per subtopic as it has documents."""
    return _pool(spark, sf_dir)


@query("p02_batches", with_ctes("batched", """
  SELECT subtopic, topic, i, target_adversarial_level, rn // 8 AS batch_index, (rn % 8)::INTEGER AS pos FROM batched"""))
def p02(spark, sf_dir):
    return pr.batches(_pool(spark, sf_dir), 8, SEED)


def _slots(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id")


@query("p03a_plan_random", f"""
  SELECT doc_id, ({VALUES_SQL})[1 + ('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT % 5] AS value FROM documents""")
def p03a(spark, sf_dir):
    return pr.sampling_plan(_slots(spark, sf_dir), "doc_id", VALUES, "random", SEED)


@query("p03b_plan_uniform", f"""
  SELECT doc_id, ({VALUES_SQL})[1 + (row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1) % 5] AS value
  FROM documents""")
def p03b(spark, sf_dir):
    return pr.sampling_plan(_slots(spark, sf_dir), "doc_id", VALUES, "uniform", SEED)


WEIGHTED_SQL = f"""({VALUES_SQL})[1 + len(list_filter([1, 1, 4, 6, 10],
  lambda c: c <= ('0x' || substr(md5('42:' || x), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 10.0::DOUBLE))]"""


@query("p03c_plan_weighted", f"SELECT x AS doc_id, {WEIGHTED_SQL} AS value FROM (SELECT doc_id AS x FROM documents)")
def p03c(spark, sf_dir):
    return pr.sampling_plan(_slots(spark, sf_dir), "doc_id", VALUES, "weighted", SEED, WEIGHTS)


@query("p04_temperature_plan", f"""
  WITH b AS (SELECT DISTINCT doc_id // 8 AS x FROM documents)
  SELECT 'plan' AS source, x AS batch_index, {WEIGHTED_SQL} AS temperature FROM b
  UNION ALL SELECT 'scalar', x, 0.4::DOUBLE FROM b UNION ALL SELECT 'none', x, NULL FROM b""")
def p04(spark, sf_dir):
    requests = fx.reply_specs(spark, sf_dir).select("batch_index").distinct()
    plan = pr.temperature_plan(requests, SEED, VALUES, "weighted", WEIGHTS)
    scalar = pr.temperature_plan(requests, SEED, temperature=0.4)
    none = pr.temperature_plan(requests, SEED)
    return (
        plan.withColumn("source", F.lit("plan"))
        .unionByName(scalar.withColumn("source", F.lit("scalar")))
        .unionByName(none.withColumn("source", F.lit("none")))
    )


@query("p05_taxonomy_block", with_ctes("taxonomy", """
  SELECT string_agg(block, chr(10) ORDER BY first) AS block FROM (
    SELECT min(ord) AS first, topic || ':' || chr(10)
      || string_agg('  - ' || subtopic || ': ' || description, chr(10) ORDER BY ord) AS block
    FROM taxonomy GROUP BY topic)"""))
def p05(spark, sf_dir):
    return pr.taxonomy_block(fx.doc_taxonomy(spark, sf_dir))


@query("p06_levels_block", """
  SELECT string_agg('  Level ' || level || ' (' || event_type || '): ' || n || ' events' || chr(10)
    || '    -> by ' || users || ' users', chr(10) ORDER BY level) AS block
  FROM (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS level, count(*) AS n,
          count(DISTINCT user_id) AS users FROM events GROUP BY event_type)""")
def p06(spark, sf_dir):
    return pr.levels_block(event_levels(spark, sf_dir))


def event_levels(spark, sf_dir):
    """Event kinds in the place of levels."""
    kinds = fx.table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))
    return kinds.select(
        (F.row_number().over(Window.orderBy("event_type")) - 1).alias("level"), F.col("event_type").alias("name"),
        F.format_string("%d events", "n").alias("description"),
        F.format_string("by %d users", "users").alias("instruction"))


@query("p07_user_prompts", with_ctes("batched taxonomy", """
  SELECT batch_index, count(*)::INTEGER AS n_specs,
    'Write exactly ' || count(*) || ' question(s), one per spec.' || chr(10) || chr(10)
    || string_agg('Spec ' || (pos + 1) || ':' || chr(10) || '  target_subtopic: ' || subtopic || ' -- ' || description
         || chr(10) || '  adversarial_level: ' || level, chr(10) || chr(10) ORDER BY pos)
    || chr(10) || chr(10) || 'The array has one entry for each spec above, ' || count(*)
    || ' in all; open it with <PROMPTS> and close it with </PROMPTS>.' AS user_prompt
  FROM (SELECT b.rn // 8 AS batch_index, b.rn % 8 AS pos, b.subtopic, b.target_adversarial_level AS level, t.description
        FROM batched b JOIN taxonomy t USING (subtopic))
  GROUP BY batch_index"""))
def p07(spark, sf_dir):
    return pr.user_prompts(pr.batches(_pool(spark, sf_dir), 8, SEED), fx.doc_taxonomy(spark, sf_dir))


SPACE_SQL = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]"


def strip_sql(text: str) -> str:
    return f"regexp_replace({text}, '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g')"


cte("items", (), fx.ITEMS_SQL.replace("DOCUMENTS_TABLE", "documents"))
cte("replies", (), fx.REPLIES_SQL.replace("DOCUMENTS_TABLE", "documents").replace("LISTED_ITEMS", fx.DUCK_LISTED))
cte("outcome", ("items", "replies"), f"""
  SELECT i.*, CASE
      WHEN i.b = 8 THEN 'request_failed'
      WHEN i.b = 5 THEN 'parse_error:empty_model_output'
      WHEN i.b = 7 THEN 'parse_error:prompts_tag_not_found'
      WHEN i.b IN (4, 9, 14) THEN 'parse_error:json_decode_error'
      WHEN i.b = 6 THEN 'parse_error:json_not_array'
      WHEN i.b = 3 THEN 'count_mismatch'
      WHEN i.k <= 4 OR {strip_sql('i.text')} = '' THEN 'bad_item'
      ELSE 'ok' END AS _status,
    CASE WHEN i.b = 8 THEN NULL ELSE {strip_sql('r.reply')} END AS raw_output,
    CASE WHEN i.b IN (8, 13) THEN NULL ELSE 'thought ' || i.batch || chr(10) || chr(10) || 'done' END AS reasoning
  FROM items i JOIN replies r ON r.batch = i.batch""")


def _parsed(spark, sf_dir):
    return rp.parse_responses(fx.responses(spark, sf_dir))


@query("p08_reply_text", with_ctes("outcome", """
  SELECT DISTINCT batch AS batch_index, md5(raw_output) AS digest, length(raw_output)::INTEGER AS n_chars
  FROM outcome WHERE b <> 8"""))
def p08(spark, sf_dir):
    return _parsed(spark, sf_dir).select(
        "batch_index", F.md5("raw_output").alias("digest"), F.length("raw_output").alias("n_chars"))


@query("p09_reasoning_text", with_ctes("outcome", """
  SELECT DISTINCT batch AS batch_index, reasoning FROM outcome WHERE b <> 8"""))
def p09(spark, sf_dir):
    return _parsed(spark, sf_dir).select("batch_index", "reasoning")


@query("p10_extract_array", with_ctes("outcome", """
  SELECT batch AS batch_index, max(CASE WHEN _status LIKE 'parse_error:%' THEN substr(_status, 13) END) AS parse_error,
    max(CASE WHEN _status NOT LIKE 'parse_error:%' THEN 1 END)::INTEGER
      * (count(*) - max((b = 3)::INTEGER))::INTEGER AS n_items
  FROM outcome WHERE b <> 8 GROUP BY batch"""))
def p10(spark, sf_dir):
    return _parsed(spark, sf_dir).select("batch_index", "parse_error", F.size("items").alias("n_items")).withColumn(
        "n_items", F.when(F.col("parse_error").isNull(), F.col("n_items")))


def _records(spark, sf_dir):
    specs = fx.reply_specs(spark, sf_dir)
    plan = pr.temperature_plan(specs.select("batch_index").distinct(), SEED, VALUES, "weighted", WEIGHTS)
    return rp.prompt_records(
        specs, fx.responses(spark, sf_dir), "run", "model-a", plan,
        F.lit("2024-01-02 03:04:05").cast("timestamp"))


@query("p11_record_status", with_ctes("outcome", """
  SELECT doc_id, batch AS batch_index, pos, source AS subtopic, lang AS topic, _status FROM outcome"""))
def p11(spark, sf_dir):
    return _records(spark, sf_dir).select("doc_id", "batch_index", "pos", "subtopic", "topic", "_status")


@query("p12_item_fields", with_ctes("outcome", f"""
  SELECT doc_id, CASE WHEN _status = 'ok' THEN md5({strip_sql('text')}) END AS prompt,
    CASE WHEN _status = 'ok' THEN CASE k WHEN 5 THEN 2 WHEN 6 THEN NULL WHEN 7 THEN 1 WHEN 9 THEN NULL
      ELSE target END END AS adversarial_level,
    CASE WHEN _status = 'ok' AND k <> 8 THEN 'about ' || source END AS surface_topic
  FROM outcome"""))
def p12(spark, sf_dir):
    return _records(spark, sf_dir).select("doc_id", F.md5("prompt").alias("prompt"), "adversarial_level", "surface_topic")


@query("p13_provenance", with_ctes("outcome", f"""
  SELECT x.doc_id, x.batch_index, md5('run:' || x.batch_index) AS request_id, 'model-a' AS model,
    {WEIGHTED_SQL.replace("|| x)", "|| x.batch_index)")} AS temperature, '2024-01-02T03:04:05' AS generated_at,
    CASE WHEN _status <> 'ok' THEN md5(raw_output) END AS raw_output,
    CASE WHEN _status <> 'ok' THEN reasoning END AS reasoning
  FROM (SELECT *, batch AS batch_index FROM outcome) x"""))
def p13(spark, sf_dir):
    return _records(spark, sf_dir).select(
        "doc_id", "_gen.batch_index", "_gen.request_id", "_gen.model", "_gen.temperature",
        F.date_format("_gen.generated_at", "yyyy-MM-dd'T'HH:mm:ss").alias("generated_at"),
        F.md5("_gen.raw_output").alias("raw_output"), "_gen.reasoning")


SUMMARY_SQL = """
  SELECT 'status' AS section, _status AS key, count(*) AS n FROM outcome GROUP BY _status
  UNION ALL SELECT 'ok_by_subtopic', source, count(*) FROM outcome WHERE _status = 'ok' GROUP BY source
  UNION ALL SELECT 'num_specs', 'total', count(*) FROM outcome
  UNION ALL SELECT 'num_batches', 'total', count(DISTINCT batch) FROM outcome"""


@query("p14_run_summary", with_ctes("outcome", SUMMARY_SQL))
def p14(spark, sf_dir):
    return rp.run_summary(stage(_records(spark, sf_dir).select(
        "_status", "subtopic", F.struct("_gen.batch_index").alias("_gen"))))
