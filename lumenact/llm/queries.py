"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, lattice_lm, line_dedup, mixing, quality, toxicity
from .embedding_dedup import near_vectors
from .near_dedup import near_duplicates
from .spelling import variant_groups, word_counts
from .suffix_dedup import without_repeats
from .tables import small_batches
from .token_align import align
from .topk_search import top_k

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BPE_RANKS = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
BYTE_LEVEL = "byte_bpe_50k.json"


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = lambda spark, sf_dir: build(small_batches(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, folds: int) -> Column:
    """Remainder of the checksum of an id's digits."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


TOP_K_SQL = """
WITH valid AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, r.vec_id,
        CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(r.v AS DOUBLE[])) AS BIGINT) AS score
    FROM valid q, valid r WHERE q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id),
ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
    FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query("op1_cover_tree_top_k", TOP_K_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 100 = 0").select("vec_id"), k=10, scale=1024.0)


@query("op2_prefix_target_chat")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_format.digests(chat_format.expand(turns))


@query("op3_subword_lattice_lm")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 10) == 0
    model = lattice_lm.fit(docs, ~held_out, public_tokenizers.path(PIECES))
    return lattice_lm.score(docs, model).withColumn("held_out", held_out)


@query("op4_temperature_mixing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.Target(entropy=0.95), blocks=64).select(
        "doc_id", "source", "n_tokens", "weight", "epoch", "block", "place_key")


@query("op5_byte_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip_digests(
        table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)


@query("op6_nb_svm_quality")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4) == 2
    model = quality.fit(docs, table(spark, sf_dir, "labels"), only=~held_out)
    return quality.quality_scores(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


LINE_SQL = f"""
WITH pages AS (SELECT row_number() OVER () AS row, doc_id, source, text FROM documents),
hosts AS (SELECT source, count(*) AS host_pages FROM pages GROUP BY source),
lines AS (
    SELECT row, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM pages),
plain AS (SELECT *, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM lines),
counted AS (SELECT source, bare, count(DISTINCT row) AS n FROM plain WHERE bare <> '' GROUP BY ALL),
boilerplate AS (
    SELECT c.source, c.bare FROM counted c JOIN hosts h ON c.source IS NOT DISTINCT FROM h.source
    WHERE host_pages >= {line_dedup.MIN_PAGES} AND n > 1 AND n > host_pages * CAST({line_dedup.RATIO} AS DOUBLE)),
kept AS (
    SELECT p.row, string_agg(p.line, chr(10) ORDER BY p.place) FILTER (b.bare IS NULL) AS text,
        count(b.bare) AS removed
    FROM plain p LEFT JOIN boilerplate b ON p.source IS NOT DISTINCT FROM b.source AND p.bare = b.bare
    GROUP BY p.row)
SELECT doc_id, pages.source, CAST(removed AS BIGINT) AS lines_removed,
    CASE WHEN pages.text IS NULL THEN NULL ELSE md5(coalesce(kept.text, '')) END AS text_md5
FROM pages JOIN kept USING (row)
"""


@query("op7_site_line_dedup", LINE_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have lines, and their source is the site they come from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.without_boilerplate(docs, "source").select(
        "doc_id", "source", F.col("_removed").alias("lines_removed"), F.md5("text").alias("text_md5"))


@query("op8_subspace_embedding_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.98)


@query("op9_ordinal_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query("op10_minhash_near_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


@query("op11_suffix_dedup")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"), size=400, digest=True)


@query("op12_token_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return align(docs, public_tokenizers.path(BYTE_LEVEL), public_tokenizers.path(PIECES))


@query("op13_spelling_variants")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return variant_groups(word_counts(docs, min_length=5, min_count=3, misspell=97))
