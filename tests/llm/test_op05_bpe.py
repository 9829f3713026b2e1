import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from lumenact.llm import byte_bpe
from lumenact.llm.queries import BPE_RANKS
from tests.conftest import SF

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(BPE_RANKS), "rb"))}
THEIRS = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
OURS = byte_bpe.load(P.path(BPE_RANKS), P.PATTERN)


def ids(texts):
    return [np.frombuffer(x, dtype="<u4").tolist() for x in OURS.encode_all(texts)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), max_size=4))
def test_equals_reference_encoder(texts):
    assert ids(texts) == [THEIRS.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("text", [
    "a" * 30_000, "ab" * 9_000, "=" * 5_000 + "é" * 3_000, "the" * 4_000, " " * 2_000, "\n" * 999 + "x", "", "Ààß" * 700,
    "abcdefghijklmnopqrstuvwxyz" * 300, "aaabaaab" * 500])
def test_very_long_pretokens(text):
    assert ids([text]) == [THEIRS.encode_ordinary(text)]


def test_order_of_lower_ranks_found_late():
    # Joining x+y (rank 9) creates the pair (xy, z) of rank 4, which must go before a second x+y.
    ranks = {bytes([b]): b + 100 for b in range(256)} | {b"xy": 9, b"xyz": 4, b"zx": 30, b"yz": 40}
    own = byte_bpe.Encoder(ranks, r".+")
    theirs = tiktoken.Encoding("t", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
    for text in ("xyzxy", "xyxyz", "zxyzxyxyz" * 3):
        assert np.frombuffer(own.encode_all([text])[0], dtype="<u4").tolist() == theirs.encode_ordinary(text)


def test_cache_may_be_dropped(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_ENTRIES", 3)
    texts = ["one two three four five six seven", "one eight nine"]
    assert ids(texts) + ids(texts) == 2 * [THEIRS.encode_ordinary(t) for t in texts]


def test_whole_table(spark):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    rows = entry.queries()["op5_byte_bpe"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        tokens = THEIRS.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(tokens)
        assert r["ids_sha256"] == hashlib.sha256(np.array(tokens, dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (None, "x y", "b"), (2, "", None)],
                               "doc_id long, text string, ids string")
    rows = byte_bpe.round_trip_digests(df, P.path(BPE_RANKS), P.PATTERN).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in rows) == [(0, 2), (1, 0), (1, 0), (2, 0)]
    assert byte_bpe.encode(df.limit(0), P.path(BPE_RANKS), P.PATTERN).count() == 0
