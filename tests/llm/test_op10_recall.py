import random

import numpy as np
import pyarrow as pa
import pytest

from lumenact.llm import near_dedup
from lumenact.llm.near_dedup import children_for, missed, near_duplicates, trees_for
from tests.llm.test_op10_near_dedup import brute, result


@pytest.mark.parametrize("percent", [50, 60, 70, 80, 85, 90])
def test_target_includes_the_branching(percent):
    trees = trees_for(percent)
    assert trees >= 8
    assert missed(percent, trees, children_for(percent, trees), near_dedup.MAX_DEPTH) <= 1e-5


@pytest.mark.parametrize("percent", [80, 85])
def test_pairs_live_on_under_large_nodes(percent):
    """Signatures that agree on each coordinate with the asked probability, sent down all levels of branching."""
    random, pairs, trees = np.random.default_rng(3), 2000, trees_for(percent)
    one = random.integers(0, 256, (pairs, near_dedup.COORDINATES), dtype=np.uint8)
    other = np.where(random.random(one.shape) < percent / 100, one, one ^ 1)
    ids = np.arange(2 * pairs)
    node = np.tile(random.integers(0, 2**62, pairs), 2)
    columns = {"tree": np.zeros(2 * pairs, np.int32), "node": node, "id": ids, "n_shingles": ids, "done": ids, "component": ids}
    batch = pa.RecordBatch.from_pydict(
        {k: pa.array(v) for k, v in columns.items()}
        | {k: pa.array([r.tobytes() for r in np.concatenate([one, other])], pa.binary()) for k in ("signature", "roots")})
    batches = [batch]
    for _ in range(near_dedup.MAX_DEPTH):
        batches = list(near_dedup._branch(iter(batches), children_for(percent, trees)))
    at = {}
    for batch in batches:
        for i, n in zip(batch.column("id").to_pylist(), batch.column("node").to_pylist(), strict=True):
            at.setdefault(i, set()).add(n)
    met = sum(bool(at[i] & at[i + pairs]) for i in range(pairs)) / pairs
    s = percent / 100
    promised = (1 - (1 - s) ** children_for(percent, trees)) ** near_dedup.MAX_DEPTH
    assert met > promised - 0.02 and (1 - s * met) ** trees < 2e-5


def test_large_nodes_of_unlike_documents(spark, monkeypatch):
    """Every node branches: a passage shared by all, and pairs near the threshold inside."""
    monkeypatch.setattr(near_dedup, "EXACT_BLOCKS", 1)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(60)]
    texts = {}
    for i in range(0, 240, 2):
        own = [word() for _ in range(60)]
        texts[i] = " ".join(passage + own)
        texts[i + 1] = " ".join(passage + own[:-11] + [word() for _ in range(11)])
    expected = brute(texts, 80)
    assert len({v[1] for v in expected.values()}) == 120
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert result(near_duplicates(df, percent=80, node_limit=4)) == expected
