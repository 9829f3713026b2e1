"""Input tables of the operators, derived from the given tables by formula.

Each has a twin in `oracle.py`, so that both engines start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

N_LAYERS = 2
D_MODEL = 8
MAX_STEPS = 8
D_SAE = 32
END_LEVEL = 0.2
SHORT_TEXT = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _n_steps() -> Column:
    """Steps before the first slice of the vector that starts above END_LEVEL."""
    ends = F.transform(
        F.sequence(F.lit(0), F.lit(MAX_STEPS - 1)),
        lambda s: F.get(F.col("embedding"), s * D_MODEL).cast("double") > F.lit(END_LEVEL))
    at = F.array_position(ends, True)
    return F.when(at == 0, F.lit(MAX_STEPS)).otherwise(at - 1).cast("int")


def samples_from(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(F.col("vec_id").alias("sample_id"), "label", _n_steps().alias("n_steps"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, label, n_steps); a sample with 0 steps is dead."""
    return samples_from(table(spark, sf_dir, "embeddings"))


def activations_from(embeddings: DataFrame) -> DataFrame:
    def hidden(layer: int) -> Column:
        if layer == 0:
            return F.slice("embedding", F.col("step") * D_MODEL + 1, D_MODEL)
        return F.transform(
            F.sequence(F.lit(0), F.lit(D_MODEL - 1)),
            lambda d: F.get(F.col("embedding"), d * D_MODEL + F.col("step")))

    rows = (
        embeddings.withColumn("_n", _n_steps()).where(F.col("_n") > 0)
        .select(F.col("vec_id").alias("sample_id"), "label", "embedding", "_n",
                F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("step"))
    )
    return rows.select(
        "sample_id", "label", "step", (F.col("step") == F.col("_n") - 1).alias("is_last"),
        F.posexplode(F.array(*[hidden(i) for i in range(N_LAYERS)])).alias("layer", "h"))


def activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, label, step, is_last, layer, h)."""
    return activations_from(table(spark, sf_dir, "embeddings"))


def sae_weights(spark: SparkSession) -> DataFrame:
    f, layer = F.col("feature_id"), F.col("layer")
    grid = spark.range(N_LAYERS * D_SAE).select(
        (F.col("id") / D_SAE).cast("int").alias("layer"), (F.col("id") % D_SAE).cast("int").alias("feature_id"))
    w = F.transform(
        F.sequence(F.lit(0), F.lit(D_MODEL - 1)),
        lambda i: (((f * 7 + i * 3 + layer * 5 + (f * i) % 7) % 11 - 5) / F.lit(4.0)))
    return grid.select(
        "layer", "feature_id", w.alias("w"),
        ((f % 5 - 2) / F.lit(16.0)).alias("b_enc"),
        (F.lit(0.25) + (f % 4) / F.lit(10.0)).alias("threshold"))


def sae_bias(spark: SparkSession) -> DataFrame:
    b = F.transform(F.sequence(F.lit(0), F.lit(D_MODEL - 1)), lambda i: (i % 3 - 1) / F.lit(64.0))
    return spark.range(N_LAYERS).select(F.col("id").cast("int").alias("layer"), b.alias("b_dec"))


def layer_frame(spark: SparkSession) -> DataFrame:
    return spark.range(N_LAYERS).select(F.col("id").cast("int").alias("layer"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt records: one per document, topic = language, subtopic = source."""
    return prompts_from(table(spark, sf_dir, "documents"))


def prompts_from(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("doc_id").alias("sample_id"), F.col("lang").alias("topic"),
        F.col("source").alias("subtopic"), F.col("text").alias("prompt"),
        F.when(F.col("n_chars") < SHORT_TEXT, "bad_item").otherwise("ok").alias("_status"))


# Replies of an imagined model, written in the SQL both engines share. The
# digest of an id picks how an item or a whole batch goes wrong.
BATCH = 8
_BS = "chr(92)"


def _esc(text: str) -> str:
    out = text
    for find, put in ((_BS, f"{_BS} || {_BS}"), ("'\"'", f"{_BS} || '\"'"), ("chr(10)", f"{_BS} || 'n'"),
                      ("chr(13)", f"{_BS} || 'r'"), ("chr(9)", f"{_BS} || 't'")):
        out = f"replace({out}, {find}, {put})"
    return out


def _pick(text: str) -> str:
    return f"instr('0123456789abcdef', substr(md5({text}), 1, 1))"


ITEMS_SQL = f"""
  SELECT *, CASE k
      WHEN 1 THEN '{{"prompt": 7, "adversarial_level": 1}}'
      WHEN 2 THEN '{{"prompt": "  ' || {_BS} || 'n ", "adversarial_level": 1}}'
      WHEN 3 THEN '"' || {_esc('text')} || '"'
      WHEN 4 THEN 'null'
      ELSE '{{"prompt": "  ' || {_esc('text')} || ' ' || {_BS} || 'n", "adversarial_level": '
        || CASE k WHEN 5 THEN '2.7' WHEN 6 THEN '"3"' WHEN 7 THEN 'true' WHEN 9 THEN 'null'
             ELSE cast(target AS VARCHAR(9)) END
        || ', "surface_topic": "' || CASE k WHEN 8 THEN '  ' ELSE ' about ' || source || ' ' END || '"}}'
      END AS item
  FROM (
    SELECT doc_id, cast(floor(doc_id / {BATCH}.0) AS BIGINT) AS batch, cast(doc_id % {BATCH} AS INTEGER) AS pos,
      lang, source, text, cast(doc_id % 5 AS INTEGER) AS target,
      {_pick("cast(doc_id AS VARCHAR(20))")} AS k,
      {_pick(f"'b' || cast(cast(floor(doc_id / {BATCH}.0) AS BIGINT) AS VARCHAR(20))")} AS b
    FROM DOCUMENTS_TABLE) d"""

REPLIES_SQL = f"""
  SELECT batch, b, CASE b
      WHEN 1 THEN 'Here you are: ' || arr || ' as asked.'
      WHEN 2 THEN '<prompts>' || arr || ' done </prompts>'
      WHEN 4 THEN '<PROMPTS>[{{"prompt": "x"</PROMPTS>'
      WHEN 5 THEN '  '
      WHEN 6 THEN '<PROMPTS>{{"prompt": "x"}}</PROMPTS>'
      WHEN 7 THEN 'I cannot do that.'
      WHEN 9 THEN '<PROMPTS> </PROMPTS>'
      WHEN 14 THEN '[{{"prompt": x}}]'
      ELSE 'Sure.' || chr(10) || '<PROMPTS>' || chr(10) || arr || chr(10) || '</PROMPTS>' || ' ' END AS reply
  FROM (
    SELECT batch, max(b) AS b, '[' || coalesce(LISTED_ITEMS, '') || ']' AS arr
    FROM (SELECT i.*, max(pos) OVER (PARTITION BY batch) AS last_pos FROM ({ITEMS_SQL}) i) i
    GROUP BY batch) r"""

_TEXT = '{"type": "output_text", "text": "'
RESPONSES_SQL = f"""
  SELECT batch AS batch_index, CASE WHEN b = 11 THEN reply ELSE ' ' END AS output_text,
    CASE WHEN b = 8 THEN NULL ELSE '{{"output": [' ||
      CASE WHEN b = 13 THEN '' ELSE '{{"type": "reasoning", "summary": [{{"text": " thought '
        || cast(batch AS VARCHAR(20)) || '"}}, {{"text": " "}}, 7, {{"text": "done"}}]}}, ' END ||
      CASE b WHEN 10 THEN '{{"type": "message", "content": "' || {_esc('reply')} || '"}}'
        WHEN 11 THEN '{{"type": "message", "content": "not this"}}'
        WHEN 12 THEN '{{"type": "message", "content": [{_TEXT}Sure. "}}, {_TEXT}'
          || {_esc("substr(reply, 7)")} || '"}}, {{"text": 5}}]}}'
        ELSE '{{"type": "message", "content": [{_TEXT}' || {_esc('reply')} || '"}}]}}' END
      || ', "other"]}}' END AS response
  FROM ({REPLIES_SQL}) q"""

SPARK_LISTED = ("listagg(CASE WHEN b = 3 AND pos = last_pos THEN NULL ELSE item END, ', ') "
                "WITHIN GROUP (ORDER BY pos)")
DUCK_LISTED = "string_agg(CASE WHEN b = 3 AND pos = last_pos THEN NULL ELSE item END, ', ' ORDER BY pos)"


def _over_documents(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    table(spark, sf_dir, "documents").createOrReplaceTempView("lumenact_documents")
    return spark.sql(sql.replace("DOCUMENTS_TABLE", "lumenact_documents").replace("LISTED_ITEMS", SPARK_LISTED))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(batch_index, output_text, response): one model reply per eight documents."""
    return _over_documents(spark, sf_dir, RESPONSES_SQL)


def reply_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The specs the replies answer."""
    return _over_documents(spark, sf_dir, ITEMS_SQL).select(
        "doc_id", F.col("batch").alias("batch_index"), "pos", F.col("source").alias("subtopic"),
        F.col("lang").alias("topic"), F.col("target").alias("target_adversarial_level"))


def doc_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages as topics, their sources as subtopics: (subtopic, topic, description, ord, n_docs)."""
    return (
        table(spark, sf_dir, "documents").groupBy("lang", "source")
        .agg(F.min("doc_id").alias("ord"), F.count(F.lit(1)).alias("n_docs"), F.max("n_chars").alias("_m"))
        .select(F.concat_ws("/", "lang", "source").alias("subtopic"), F.col("lang").alias("topic"),
                F.concat(F.lit("texts of up to "), F.col("_m").cast("string"), F.lit(" characters")).alias("description"),
                "ord", "n_docs")
    )
