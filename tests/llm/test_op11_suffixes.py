import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from lumenact.llm import suffix_dedup
from tests.conftest import SF


def expected(texts, size):
    """Every window of every text counted; (n_bytes, n_removed, n_spans, kept) of each text."""
    raws = [(t or "").encode() for t in texts]
    counts = Counter(raw[i:i + size] for raw in raws for i in range(len(raw) - size + 1))
    out = []
    for raw in raws:
        gone = np.zeros(len(raw) + 1, dtype=np.int64)
        for i in range(len(raw) - size + 1):
            if counts[raw[i:i + size]] > 1:
                gone[i] += 1
                gone[i + size] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        spans = int(np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1))
        out.append((len(raw), int(gone.sum()), spans, np.frombuffer(raw, np.uint8)[~gone].tobytes()))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=200) | st.text("ab", max_size=300).map(str.encode), max_size=6), st.integers(4, 40))
def test_leading_tokens_depend_on_their_window_alone(raws, span):
    for raw in raws:
        data = np.frombuffer(raw, dtype=np.uint8)
        places = suffix_dedup.leading(data, span)
        assert len(places) == max(len(raw) - span - 6, 0)
        for start, place in enumerate(places.tolist()):
            own = suffix_dedup.leading(data[start:start + span + 7], span)
            assert own.tolist() == [place - start] and 0 <= place - start < span


@settings(max_examples=60, deadline=None)
@given(st.text("ab", min_size=40, max_size=200), st.integers(8, 30), st.data())
def test_multikey_quicksort_finds_equal_suffixes(text, size, data):
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    starts = np.array(data.draw(st.lists(st.integers(0, len(raw) - size), min_size=1, max_size=60)))
    groups = np.array(data.draw(st.lists(st.integers(0, 2), min_size=len(starts), max_size=len(starts))))
    keys = [(g, text[s:s + size]) for g, s in zip(groups, starts, strict=True)]
    assert suffix_dedup.repeated(raw, starts, groups, size).tolist() == [keys.count(k) > 1 for k in keys]


@pytest.mark.parametrize("small", [False, True])
def test_planted_repeats(spark, monkeypatch, small):
    if small:  # buckets of a few records, texts in pieces, every suffix sorted in several steps
        for name, value in (("BUCKET_BYTES", 500), ("_PIECE", 150), ("_SORTED_AT_ONCE", 40), ("_TOKENS_AT_ONCE", 3)):
            monkeypatch.setattr(suffix_dedup, name, value)
    rng = np.random.default_rng(3)

    def words(n):
        return " ".join("".join(rng.choice(list("abcdeé"), 5)) for _ in range(n))

    passage = words(20)
    texts = [words(40), words(12) + passage + words(9), passage + words(5), words(7) + passage, passage[:63], passage[:64],
             "x" + passage[1:64] + "yy", None, "", "é" * 31, "é" * 32, "é" * 33, "ab" * 150, "ha " * 80 + words(10), "z" * 63, "q" * 65]
    texts += [words(30)] * 3 + [texts[1].replace("a", "b", 2)] * 2
    texts += [passage[:40] + c + passage[41:] + words(3) for c in "uvwxyz" * 4]  # a core in many records
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(texts)], "doc_id long, text string, k1 int, core string")
    got = sorted(tuple(r) for r in suffix_dedup.without_repeats(df, 64).collect())
    assert [(r[0], *r[1:4], bytes(r[4])) for r in got] == [(i, *row) for i, row in enumerate(expected(texts, 64))]


def test_hot_core_and_hot_text(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_SHARE", 20)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 2000)
    shared = "".join(chr(97 + i * i % 23) for i in range(90))
    texts = [f"{i:05d}{shared}{i * 7:05d}" * (1 + i % 2) for i in range(60)] + ["the same text " * 6] * 40
    df = spark.createDataFrame([(i % 50 or None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = [tuple(r)[1:] for r in suffix_dedup.without_repeats(df, 64, digest=True).collect()]
    want = [(*row[:3], hashlib.sha256(row[3]).hexdigest()) for row in expected(texts, 64)]
    assert sorted(got) == sorted(want)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = expected([d["text"] for d in docs], 400)
    got = {r["doc_id"]: r for r in entry.queries()["op11_suffix_dedup"](spark, SF).collect()}
    assert sum(row[1] for row in want) > 0 and len(got) == len(docs)
    for d, (n, removed, spans, kept) in zip(docs, want, strict=True):
        r = got[d["doc_id"]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (n, removed, spans)
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.without_repeats(df).collect() == []
    with pytest.raises(ValueError):
        suffix_dedup.repeated_spans(df, 10)


def rows_made(spark, monkeypatch, texts, size):
    """(distinct records, rows that their comparison made); the result is checked against all windows."""
    kept = []

    def tap(df, label, write=suffix_dedup.shared_table):
        kept.append((label, write(df, label)))
        return kept[-1][1]

    with monkeypatch.context() as patch:
        patch.setattr(suffix_dedup, "shared_table", tap)
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = sorted(tuple(r) for r in suffix_dedup.without_repeats(df, size).collect())
    assert [(r[0], *r[1:4], bytes(r[4])) for r in got] == [(i, *row) for i, row in enumerate(expected(texts, size))]
    records = sum(t.select("c1", "c2").distinct().count() for label, t in kept if label == "suffixes")
    return records, sum(t.count() for label, t in kept if label in ("matches", "windows"))


@pytest.mark.parametrize("bucket", [20_000, 200_000])
def test_rows_made_follow_distinct_records(spark, monkeypatch, bucket):
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", bucket)
    rng = np.random.default_rng(8)

    def letters(n):
        return "".join(rng.choice(list("abcdefghijklmnop "), n))

    passage, other = letters(900), letters(700)

    def copies(n):  # of one passage, and copies of another that differ in a letter
        at = rng.integers(0, len(other), n)
        return [letters(20) + passage + letters(20) for _ in range(n)] + [other[:i] + "#" + letters(3) + other[i:] for i in at]

    few, some = rows_made(spark, monkeypatch, copies(60), 400)
    more, many = rows_made(spark, monkeypatch, copies(180), 400)
    per_record = 3 if bucket > 180 * 600 else 20
    assert some <= per_record * few and many <= per_record * more
    assert many / more <= 1.3 * some / few
