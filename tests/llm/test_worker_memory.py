"""Hashing texts takes little working memory beside the batch."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from lumenact.llm import near_dedup, text_hash, toxicity

LIMIT = 18 << 20  # hashing 1 MB of text at a time took 24 to 40 MB for these 4 MB


def long_batch() -> pa.RecordBatch:
    words = np.array([f"w{k}" for k in range(5000)])
    rng = np.random.default_rng(5)
    texts = [" ".join(words[rng.integers(0, 5000, 700)]) for _ in range(1200)]
    return pa.RecordBatch.from_arrays([pa.array(range(1200), pa.int64()), pa.array(texts)], names=["id", "text"])


def profile(batch):
    return near_dedup._profile(iter([batch]), 5, 8)


def full_sets(batch):
    return near_dedup._full_sets(iter([batch]), 5)


def score(batch):
    keys = np.unique(text_hash.stream(5, 1000))
    return toxicity._score(iter([batch]), toxicity.OrdinalModel(keys, np.ones(len(keys)), np.array([0.0])))


@pytest.mark.parametrize("work", [profile, full_sets, score])
def test_working_memory(work):
    batch = long_batch()
    tracemalloc.start()
    try:
        rows = sum(part.num_rows for part in work(batch))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == batch.num_rows
    assert peak < LIMIT, peak / 2**20
