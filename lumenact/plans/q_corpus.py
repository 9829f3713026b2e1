"""Queries: text projection, filters, sampling, splitting, labelling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import collect_text, normalize_space
from ..operators import corpus as co
from ..sources.nested import read_topic_rows, topic_texts
from . import fixtures as fx
from .catalog import query
from .oracle import cte, with_ctes
from .q_prompts import SPACE_SQL

SEED = 42


def norm_sql(text: str) -> str:
    return f"trim(regexp_replace({text}, '{SPACE_SQL}+', ' ', 'g'))"


cte("prompts", (), """
  SELECT doc_id AS sample_id, lang AS topic, source AS subtopic, text AS prompt,
    CASE WHEN n_chars < 20 THEN 'bad_item' ELSE 'ok' END AS _status FROM documents""")
cte("ok", ("prompts",), "SELECT * FROM prompts WHERE _status = 'ok'")
cte("topics", ("ok",), """
  SELECT topic, (row_number() OVER (ORDER BY min(sample_id)) - 1)::INTEGER AS label FROM ok GROUP BY topic""")
cte("doc_split", ("ok",), """
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY topic ORDER BY md5('42:' || sample_id), sample_id)
    <= floor(count(*) OVER (PARTITION BY topic) * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM ok""")


def _ok(spark, sf_dir):
    return co.require_rows(co.keep_ok(fx.prompts(spark, sf_dir)), "prompt records")


@query("t01_normalize_space", f"""
  SELECT 'documents' AS source, doc_id AS id, md5({norm_sql('text')}) AS digest FROM documents
  UNION ALL SELECT 'pages', page_id, md5({norm_sql('html')}) FROM pages""")
def t01(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select(
        F.lit("documents").alias("source"), F.col("doc_id").alias("id"), F.col("text").alias("_t"))
    pages = fx.table(spark, sf_dir, "pages").select(
        F.lit("pages").alias("source"), F.col("page_id").alias("id"), F.col("html").alias("_t"))
    return docs.unionByName(pages).select("source", "id", F.md5(normalize_space(F.col("_t"))).alias("digest"))


@query("t02_collect_text", f"""
  SELECT conv_id, turn, len(found)::INTEGER AS n_texts, md5(array_to_string(found, '|')) AS digest FROM (
    SELECT conv_id, turn, list_filter([{norm_sql('role')}, {norm_sql('text')}, 'a b', {norm_sql('text')}, {norm_sql('role')}],
      lambda t: t <> '') AS found FROM conversations)""")
def t02(spark, sf_dir):
    """A message nested in structs, arrays and a map; numbers are left out."""
    rows = fx.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn",
        F.struct(
            F.array(F.struct("role", "text"), F.struct(F.lit("  ").alias("role"), F.lit(" a  b ").alias("text"))).alias("messages"),
            F.col("turn").alias("number"),
            F.create_map(F.lit("k"), F.array("text", "role")).alias("extra"),
        ).alias("nested"))
    found = collect_text(F.col("nested"), rows.schema["nested"].dataType)
    return rows.select("conv_id", "turn", F.size(found).alias("n_texts"), F.md5(F.array_join(found, "|")).alias("digest"))


@query("t03_row_text", f"""
  SELECT doc_id, md5(CASE WHEN lang = 'en' AND {norm_sql('text')} <> '' THEN {norm_sql('text')}
    ELSE trim(concat_ws(' ', nullif({norm_sql('text')}, ''), lang, source)) END) AS digest FROM documents""")
def t03(spark, sf_dir):
    """English rows have the target column; the others fall back to all text."""
    rows = fx.table(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("lang") == "en", F.array("text")).alias("question"),
        F.when(F.col("lang") != "en", F.col("text")).alias("text"), "lang", "source")
    return rows.select("doc_id", F.md5(co.row_text(rows, ["question", "missing"])).alias("digest"))


@query("t04_seeded_sample", with_ctes("prompts", f"""
  SELECT topic, sample_id, md5(text) AS digest FROM (
    SELECT *, row_number() OVER (PARTITION BY topic ORDER BY md5('42:' || sample_id), sample_id) AS rn
    FROM (SELECT *, {norm_sql('prompt')} AS text FROM prompts) WHERE text <> '') WHERE rn <= 120"""))
def t04(spark, sf_dir):
    rows = fx.prompts(spark, sf_dir).withColumn("text", normalize_space(F.col("prompt")))
    picked, _ = co.seeded_sample(rows, "sample_id", 120, SEED, ["topic"], "text")
    return picked.select("topic", "sample_id", F.md5("text").alias("digest"))


@query("t04_sample_report", with_ctes("prompts", """
  SELECT topic, count(*) AS total, least(count(*), 120) AS taken, count(*) < 120 AS short
  FROM prompts WHERE trim(prompt) <> '' GROUP BY topic"""))
def t04_report(spark, sf_dir):
    rows = fx.prompts(spark, sf_dir).withColumn("text", normalize_space(F.col("prompt")))
    return co.seeded_sample(rows, "sample_id", 120, SEED, ["topic"], "text")[1]


@query("t05_keep_ok", with_ctes("prompts", """
  SELECT count(*) AS n_records, count(*) FILTER (_status = 'ok') AS n_ok,
    count(*) FILTER (_status <> 'ok') AS n_skipped FROM prompts"""))
def t05(spark, sf_dir):
    return co.count_skipped(fx.prompts(spark, sf_dir))


@query("t06_cap_per_topic", with_ctes("ok", """
  SELECT topic, sample_id FROM (
    SELECT *, row_number() OVER (PARTITION BY topic ORDER BY sample_id) AS rn FROM ok) WHERE rn <= 100"""))
def t06(spark, sf_dir):
    return co.cap_per_topic(_ok(spark, sf_dir).select("topic", "sample_id"), 100, "topic", "sample_id")


@query("t07_topic_dictionary", with_ctes("topics", "SELECT * FROM topics"))
def t07(spark, sf_dir):
    return co.topic_dictionary(_ok(spark, sf_dir), "topic", "sample_id")


@query("t08_stratified_split", with_ctes("doc_split", "SELECT topic, sample_id, split FROM doc_split"))
def t08(spark, sf_dir):
    return co.stratified_split(_ok(spark, sf_dir).select("topic", "sample_id"), 0.8, SEED)


@query("t09_labeled_set", with_ctes("ok topics", """
  SELECT sample_id, md5(prompt) AS digest, label FROM ok JOIN topics USING (topic)"""))
def t09(spark, sf_dir):
    rows = _ok(spark, sf_dir)
    return co.labeled_set(rows, co.topic_dictionary(rows, "topic", "sample_id")).select(
        "sample_id", F.md5("prompt").alias("digest"), "label")


@query("t10_dead_samples", with_ctes("samples", """
  SELECT label, count(*) FILTER (n_steps = 0) AS n_dead, count(*) AS n_total,
    count(*) FILTER (n_steps > 0) AS n_alive FROM samples GROUP BY label"""))
def t10(spark, sf_dir):
    samples, rows = fx.samples(spark, sf_dir), fx.activations(spark, sf_dir)
    alive = co.drop_dead(samples, rows, 0).groupBy("label").agg(F.count(F.lit(1)).alias("n_alive"))
    return co.dead_report(samples, rows, 0, ["label"]).join(alive, "label", "left").fillna(0, ["n_alive"])


@query("t11_sample_stats", with_ctes("ok topics samples", f"""
  SELECT o.sample_id, t.label, o.topic, length(o.prompt)::INTEGER AS char_len,
    (CASE WHEN {norm_sql('o.prompt')} = '' THEN 0 ELSE len(string_split({norm_sql('o.prompt')}, ' ')) END)::INTEGER AS word_count,
    coalesce(s.n_steps, 0)::BIGINT AS n_gen_steps
  FROM ok o JOIN topics t USING (topic) LEFT JOIN samples s ON s.sample_id = o.sample_id"""))
def t11(spark, sf_dir):
    rows = _ok(spark, sf_dir)
    topics = co.topic_dictionary(rows, "topic", "sample_id")
    labeled = co.labeled_set(rows, topics).select("sample_id", "label", "prompt")
    return co.sample_stats(labeled, fx.activations(spark, sf_dir), topics, 0)


@query("t12_topic_counts", with_ctes("doc_split", """
  SELECT topic, count(*) AS n_total, count(*) FILTER (split = 'train') AS n_train,
    count(*) FILTER (split = 'test') AS n_test FROM doc_split GROUP BY topic"""))
def t12(spark, sf_dir):
    return co.topic_counts(co.stratified_split(_ok(spark, sf_dir).select("topic", "sample_id"), 0.8, SEED))


def _sources(sf_dir):
    return [
        {"topic": "documents", "path": f"{sf_dir}/documents.parquet", "columns": ["text"], "id": "doc_id"},
        {"topic": "pages", "path": f"{sf_dir}/pages.parquet", "columns": ["body"], "id": "page_id"},
        {"topic": "benchmark", "path": f"{sf_dir}/benchmark.parquet", "columns": ["text"], "id": "item_id"},
    ]


@query("s02_nested_sources", f"""
  SELECT topic, id, md5(text) AS digest FROM (
    SELECT 'documents' AS topic, doc_id AS id, CASE WHEN {norm_sql('text')} <> '' THEN {norm_sql('text')}
      ELSE trim(concat_ws(' ', lang, source)) END AS text FROM documents
    UNION ALL SELECT 'pages', page_id, concat_ws(' ', nullif({norm_sql('url')}, ''), nullif({norm_sql('html')}, '')) FROM pages
    UNION ALL SELECT 'benchmark', item_id, {norm_sql('text')} FROM benchmark)
  WHERE text <> ''""")
def s02(spark, sf_dir):
    """Three tables as topics; pages lack the target column and use all text."""
    return read_topic_rows(spark, _sources(sf_dir)).select("topic", "id", F.md5("text").alias("digest"))


@query("s02_topic_texts", f"""
  SELECT topic, id, md5(text) AS digest FROM (
    SELECT *, row_number() OVER (PARTITION BY topic ORDER BY md5('42:' || id), id) AS rn FROM (
      SELECT 'documents' AS topic, doc_id AS id, CASE WHEN {norm_sql('text')} <> '' THEN {norm_sql('text')}
        ELSE trim(concat_ws(' ', lang, source)) END AS text FROM documents
      UNION ALL SELECT 'pages', page_id, concat_ws(' ', nullif({norm_sql('url')}, ''), nullif({norm_sql('html')}, '')) FROM pages
      UNION ALL SELECT 'benchmark', item_id, {norm_sql('text')} FROM benchmark)
    WHERE text <> '') WHERE rn <= 100""")
def s02_sample(spark, sf_dir):
    return topic_texts(spark, _sources(sf_dir), 100, SEED).select("topic", "id", F.md5("text").alias("digest"))
