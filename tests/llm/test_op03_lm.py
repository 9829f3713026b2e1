import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers as P

import __spark_entry__ as entry
from lumenact.llm import lattice_lm
from lumenact.llm.queries import PIECES, fold
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCORES = {b" ": -2.0, b" a": -1.5, b"a": -1.0, b"b": -2.5, b"ab": -0.7, b"ba": -1.9, b" ab": -3.0, b"aba": -2.2, "é".encode(): -1.0}


def cuts(word):
    """All segmentations of a word."""
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        if word[:k] in SCORES:
            for rest in cuts(word[k:]):
                yield [word[:k], *rest]


def test_marginal_is_the_sum_over_all_segmentations():
    pieces = lattice_lm.Pieces(SCORES)
    words = [b"a", b"abab", b"bbaba", b"abababab", "éa".encode(), b"b"]
    got = lattice_lm.word_logs(words, pieces, pieces.prior)
    for word, value in zip(words, got, strict=True):
        whole = sum(math.exp(sum(SCORES[p] for p in cut)) for cut in cuts(b" " + word))
        assert value == pytest.approx(math.log(whole), rel=1e-12)


def test_expected_counts():
    import pyarrow as pa

    path = P.path(PIECES)
    pieces = lattice_lm.load_pieces(path)
    batch = pa.RecordBatch.from_pydict({"word": [b"the", b"there", b"x" * 50], "c": [3, 2, 1]})
    got = next(iter(lattice_lm._expected(iter([batch]), path, pieces.prior)))
    found = {pieces.names[i]: n for i, n in zip(got["piece"].to_pylist(), got["n"].to_pylist(), strict=True)}
    # However a word is cut, its bytes are covered once.
    assert sum(n * len(p) for p, n in found.items()) == pytest.approx(3 * 4 + 2 * 6 + 51)


def expected(rows):
    counts, texts = Counter(), 0
    words = {}
    for i, text in rows:
        words[i] = WORD.findall((text or "").translate(LOWER))
        if zlib.crc32(str(i).encode()) % 10:
            counts.update(words[i])
            texts += 1
    total, kinds = sum(counts.values()) + texts, len(counts) + (texts > 0)
    out = {}
    for i, own in words.items():
        each = [counts[w] for w in own] + [texts]
        base = sum(math.log10((c + 0.1) / (total + 0.1 * (kinds + 1))) for c in each)
        out[i] = (zlib.crc32(str(i).encode()) % 10 == 0, len(each), sum(c > 0 for c in each), total, base)
    return out


@pytest.mark.parametrize("head", [1 << 19, 40])
def test_counts_and_base_over_the_whole_table(spark, monkeypatch, head):
    monkeypatch.setattr(lattice_lm, "HEAD_WORDS", head)
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = expected(rows)
    got = entry.queries()["op3_subword_lattice_lm"](spark, SF).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == want[r["doc_id"]][:4]
        assert r["base_score"] == pytest.approx(want[r["doc_id"]][4], rel=1e-9)
        assert r["score"] < 0


def test_score_is_the_product_of_words(spark):
    rows = [(1, "the cat", "a"), (2, "The  cat the", "a"), (3, None, "a"), (4, "", None), (5, "zzzqqq é x", "b"),
            (None, "cat", "b"), (6, "the cat", "c"), (6, "the cat", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, hash string")
    model = lattice_lm.fit(df, fold("doc_id", 10) != 0, P.path(PIECES))
    table = {r["hash"]: r["marginal"] for r in model.words.collect()}
    assert len(table) == 4
    got = lattice_lm.score(df, model).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r["score"] for r in got}
    end = model.end_log10
    assert by_id[3] == by_id[4] == pytest.approx(end)
    the_cat, twice = by_id[1] - end, by_id[2] - end
    cat = by_id[None] - end
    assert twice - the_cat == pytest.approx(the_cat - cat)
    # All one-word and two-word texts together can be no more than certain.
    assert sum(10 ** v for v in table.values()) < 1
    assert lattice_lm.score(df.limit(0), lattice_lm.fit(df.limit(0), fold("doc_id", 10) != 0, P.path(PIECES))).count() == 0


def test_training_raises_the_likelihood(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    scores = []
    for rounds in (0, 1, 2):
        monkeypatch.setattr(lattice_lm, "ROUNDS", rounds)
        model = lattice_lm.fit(df, fold("doc_id", 10) != 0, P.path(PIECES))
        scores.append(np.sum([r["score"] for r in lattice_lm.score(df, model).select("score").collect()]))
    assert scores[0] < scores[1] < scores[2]
