import random
import re

import pytest

import __spark_entry__ as entry
from lumenact.llm import near_dedup
from lumenact.llm.near_dedup import first_of_each, near_duplicates
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size=5):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[k:k + size]) for k in range(len(words) - size + 1)}


def brute(texts, percent):
    sets = {i: shingles(t) for i, t in texts.items()}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for i in ids:
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    common = {}
    for own in holders.values():
        for x, i in enumerate(own):
            for j in own[x + 1:]:
                common[i, j] = common.get((i, j), 0) + 1
    for (i, j), n in common.items():
        if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def test_whole_table(spark):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    assert result(entry.queries()["op10_minhash_near_dedup"](spark, SF)) == brute(texts, 85)


@pytest.mark.parametrize("limit", [5, 2048])
def test_hot_groups_and_shared_passages(spark, monkeypatch, limit):
    """A passage in every text, a large group of copies, chains of near copies."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(40))
    texts = {}
    for i in range(150):
        texts[i] = passage + " " + " ".join(word() for _ in range(30))
    base = [word() for _ in range(120)]
    for i in range(150, 250):
        texts[i] = " ".join(base)
    for i in range(250, 330):  # a long chain: each two steps drift apart
        base[(i * 7) % 120] = word()
        texts[i] = " ".join(base)
    expected = brute(texts, 80)
    assert len({v[1] for v in expected.values()}) < 200
    df = spark.createDataFrame([(i, t, "extra") for i, t in texts.items()], "doc_id long, text string, kept string")
    assert result(near_duplicates(df, percent=80, node_limit=limit)) == expected
    monkeypatch.setattr(near_dedup, "MAX_DEPTH", 0)
    assert result(near_duplicates(df, percent=80, node_limit=limit)) == expected


def test_odd_rows(spark):
    texts = {1: None, 2: "", 3: " \t\n", 4: "One two", 5: "one  TWO", 6: "one two three", 7: "a b c d e", 8: "A B C D E", 9: "É b c d e",
             10: "é b c d e", 11: "x " * 20_000}
    rows = [(i, t) for i, t in texts.items()] + [(4, "One two"), (7, "a b c d e")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(near_duplicates(df)) == brute(texts, 80)
    with_null = spark.createDataFrame(rows + [(None, "a b c d e")], "doc_id long, text string")
    found = near_duplicates(with_null)
    assert result(found)[None] == (1, None, True)
    left = first_of_each(with_null).select("doc_id").collect()
    assert sorted(r[0] for r in left) == [1, 2, 3, 4, 6, 7, 9, 10, 11]
    assert first_of_each(df.limit(0)).collect() == []
    assert near_duplicates(df.limit(0)).count() == 0


def test_repeated_id_with_two_texts(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "one two"), (2, "a b c d e f")], "doc_id long, text string")
    assert result(near_duplicates(df)) == {1: (2, 1, True), 2: (2, 1, False)}


def test_one_row_of_each_text_group(spark):
    """An id with two texts loses none, a text under several ids or none is kept once."""
    shared, own = "a b c d e f g h", "unique text of its own that stays"
    df = spark.createDataFrame(
        [(1, shared, 1), (2, shared, 2), (2, own, 3)] + [(3, shared, 4)] * 3 + [(None, own, 5), (None, "nobody has this text at all", 6)],
        "doc_id long, text string, row int")
    left = first_of_each(df)
    assert left.columns == df.columns
    assert sorted((r["row"], r["text"]) for r in left.collect()) == [(1, shared), (3, own), (6, "nobody has this text at all")]
