import hashlib
from collections import Counter

import public_tokenizers as P
import pytest

import __spark_entry__ as entry
from lumenact.llm import token_align
from lumenact.llm.queries import BYTE_LEVEL, PIECES
from tests.conftest import SF

PATHS = P.path(BYTE_LEVEL), P.path(PIECES)
A, B = token_align.ByteLevel(PATHS[0]), token_align.Pieces(PATHS[1])
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def ends(ids, pieces):
    at, out = 0, {}
    for place, i in enumerate(ids):
        at += len(pieces[i].as_py())
        out[at] = place
    return out


def expected(texts):
    """Of each text, token by token."""
    seen, counts = [], Counter()
    for text in texts:
        if not text:
            seen.append(None)
            continue
        (a,), (b,) = A.encode([text]), B.encode([text])
        for ids, side in ((a, A), (b, B)):
            assert b"".join(side.pieces[i].as_py() for i in ids) == f" {text}".encode()
        at_a, at_b = ends(a, A.pieces), ends(b, B.pieces)
        links, groups, x, y = [], [], 0, 0
        for end in sorted(at_a.keys() & at_b.keys()):
            i, j = at_a[end] + 1, at_b[end] + 1
            links.append((a[i - 1], b[j - 1]))
            groups.append(",".join(map(str, a[x:i])) + "|" + ",".join(map(str, b[y:j])))
            x, y = i, j
        counts.update(links)
        seen.append((len(a), len(b), groups, links))
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return [(0, 0, 0, 0, 0, 0, "") if s is None else (
        s[0], s[1], len(s[2]), len(s[3]), sum(counts[p] == top[p[1]] for p in s[3]), sum(counts[p] for p in s[3]),
        hashlib.sha256(";".join(s[2]).encode()).hexdigest()) for s in seen]


def aligned(df):
    return sorted((r["doc_id"], *(r[c] for c in COLUMNS)) for r in df.collect())


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((d["doc_id"], *row) for d, row in zip(docs, expected([d["text"] for d in docs]), strict=True))
    assert aligned(entry.queries()["op12_token_alignment"](spark, SF)) == want


@pytest.mark.parametrize("chunk", [1 << 24, 64])
def test_odd_texts(spark, monkeypatch, chunk):
    monkeypatch.setattr(token_align, "CHUNK_BYTES", chunk)  # in one chunk, or each text in its own
    monkeypatch.setattr(token_align, "ENCODE_BYTES", 50 if chunk == 64 else 1 << 22)
    monkeypatch.setattr(token_align, "ALIGN_BYTES", 30)
    monkeypatch.setattr(token_align, "CACHE_UNITS", 4)
    texts = ["the cat", "the cat", " ", "\n\n  x\ty  ", "été ÷ ½ ﬁ", "日本語 🙂🙂 ​", "<|endoftext|> <s> <0x41> ▁a", "\x00\x01",
             "", None, "a" * 30_000, "word " * 9_000, "=-" * 4_000]
    df = spark.createDataFrame([(i, t, "clash", 7) for i, t in enumerate(texts)],
                               "doc_id long, text string, pair string, chunk int")
    lossy = [i for i, t in enumerate(texts) if t and any(
        b"".join(side.pieces[k].as_py() for k in side.encode([t])[0]) != f" {t}".encode() for side in (A, B))]
    kept = expected([None if i in lossy else t for i, t in enumerate(texts)])
    assert aligned(token_align.align(df, *PATHS)) == [(i, *row) for i, row in enumerate(kept)]
    assert token_align.align(df.limit(0), *PATHS).count() == 0


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (3, "a b"), (3, "a b")], "doc_id long, text string")
    rows = token_align.align(df, *PATHS).collect()
    assert sorted((r["doc_id"] or 0, r["n_links"], r["n_best"], r["count_sum"]) for r in rows) == [
        (0, 2, 2, 6), (3, 2, 2, 6), (3, 2, 2, 6)]


def test_units_kept_by_a_worker_are_bounded():
    aligner = token_align.Aligner(*PATHS)
    for start in range(0, 400_000, 100_000):
        aligner.encode([" ".join(f"n{i}" for i in range(start, start + 100_000))])
        assert len(aligner.known) <= 300_000
        assert sum(ids.nbytes for ids in aligner.ids) + aligner.known.nbytes < 24 << 20
