import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from lumenact.llm import spelling
from tests.conftest import SF


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def groups(words):
    """By brute force: every word against every other."""
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda v: (-words[v], v))
            if words[best] >= 2 * words[w]:
                form[w] = best
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return out


def rows(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abcé", min_size=1, max_size=7), min_size=1, max_size=25, unique=True), st.data())
def test_index_finds_one_error_before_the_exact_part(words, data):
    index = spelling.FMIndex(words)
    asked = data.draw(st.lists(st.text("abcéz", min_size=1, max_size=7), min_size=1, max_size=8))
    exact = np.array([data.draw(st.integers(0, len(w))) for w in asked])
    got = {(int(i), index.words[j]) for i, j in zip(*index.one_error(asked, exact), strict=True)}
    want = set()
    for i, w in enumerate(asked):
        head, tail = w[:len(w) - exact[i]], w[len(w) - exact[i]:]
        want |= {(i, v) for v in words if v.endswith(tail) and len(v) >= len(w)
                 and one_apart(head, v[:len(v) - len(tail)])}
    assert got == want


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=2, max_size=40))
def test_suffix_order(text):
    order = spelling.suffix_order(np.array(text))
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_blocks_of_a_shared_half(spark, monkeypatch):
    words = {f"commonstart{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}end": i + 3 for i in range(100)}
    words |= {"commonstartaaend"[:-1]: 500, "lonely": 3, "lonelyy": 6, "lonelyyy": 12, "x" * 300: 5, "x" * 301: 10}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    want = groups(words)
    assert rows(spelling.variant_groups(df)) == want
    monkeypatch.setattr(spelling, "SHARD_SYMBOLS", 300)  # every common half is cut into blocks
    monkeypatch.setattr(spelling, "_QUERY_BLOCK", 3)
    assert rows(spelling.variant_groups(df)) == want


def test_whole_table(spark):
    counts = Counter()
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{r['doc_id']}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    cells = defaultdict(set)  # words that agree but for one place
    for w in words:
        for i in range(len(w)):
            cells[(w[:i], w[i + 1:])].add(w)
            cells[(w[:i], w[i:])].add(w)
        cells[(w, "")].add(w)
    near = defaultdict(set)
    for cell in cells.values():
        for a in cell:
            near[a] |= {b for b in cell if one_apart(a, b)}
    got = rows(entry.queries()["op13_spelling_variants"](spark, SF))
    assert {(r[0], r[3], r[4]) for r in got} == {(w, n, len(near[w])) for w, n in words.items()}
    by_word = {r[0]: r for r in got}
    for w, form, root, n, _, form_n in got:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        assert form == (best if best is not None and words[best] >= 2 * n else None)
        assert form_n == words.get(form)
        assert root == (by_word[form][2] if form else w)


def test_odd_rows(spark):
    df = spark.createDataFrame(
        [(1, None, "a"), (None, "Ünder under UNDER", "b"), (2, "", "c"), (2, "under×der a-under", "d"),
         (2, "under×der a-under", "d")], "doc_id long, text string, word string")
    assert {(r["word"], r["n"]) for r in spelling.word_counts(df, min_count=1).collect()} == {
        ("Ünder", 1), ("under", 4), ("under×der", 2)}
    assert spelling.variant_groups(spelling.word_counts(df.limit(0))).count() == 0
    long = spark.createDataFrame([(1, "word " + "q" * 50_000 + " " + "q" * 50_000)], "doc_id long, text string")
    found = spelling.variant_groups(spelling.word_counts(long, min_length=3, min_count=1)).collect()
    assert {(len(r["word"]), r["n"], r["n_near"]) for r in found} == {(4, 1, 0), (50_000, 2, 0)}
