from collections import Counter

import public_tokenizers as P

import corpus_pipeline
from lumenact.llm.byte_bpe import load
from lumenact.llm.queries import BPE_RANKS
from tests.conftest import SF
from tests.llm.test_op10_near_dedup import brute


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        after[name] = docs = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            docs = docs.cache()
            after[name] = docs
            assert docs.columns == spark.read.parquet(f"{SF}/documents.parquet").columns
    toxic, lines, near, mixed, ids = (after[n] for n, _ in corpus_pipeline.STAGES)
    # Only documents that the model rejects go, and labelled clean ones stay.
    clean = {r[0] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").select("doc_id").collect()}
    assert clean <= {r["doc_id"] for r in toxic.collect()}
    assert lines.count() == toxic.count()
    texts = {r["doc_id"]: r["text"] for r in lines.collect()}
    kept = {i for i, v in brute(texts, 80).items() if v[2]}
    assert {r["doc_id"] for r in near.collect()} == kept
    assert {r["doc_id"] for r in mixed.collect()} == kept
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())
    encoder = load(P.path(BPE_RANKS), P.PATTERN)
    assert Counter(r["doc_id"] for r in ids.collect()) == Counter(r["doc_id"] for r in mixed.collect())
    want = {r["doc_id"]: len(encoder.encode_all([r["text"] or ""])[0]) // 4 for r in mixed.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in ids.collect()} == want


def test_run_is_the_chain_of_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).collect())) == Counter(map(tuple, docs.collect()))


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
