import hashlib

from hypothesis import given
from hypothesis import strategies as st

from lumenact.llm import chat_format

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def expected(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[0], []).append(row[1:4])
    out = {}
    for conv, turns in groups.items():
        turns.sort(key=lambda t: [(x is not None, x or 0) if k == 0 else (x is not None, x or "") for k, x in enumerate(t)])
        every = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns)
        loss = "".join(t or "" for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss),
                     hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_read_back(spark):
    said = "\\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", said, "z"), (-7, 1, "assistant", said, "z"), (1, 2, "assistant", "late", None),
            (1, 0, "system", None, None), (1, 1, "user", "a\n</turn>\n### user:\nb", None), (1, 3, "user", "bye", None),
            (2, None, None, "no role", None), (None, 0, "assistant", "", None), (3, 0, "us:er\n", "x" * 5000, None),
            (4, 0, "user", "same", None), (4, 0, "user", "same", None), (4, 1, "assistant", "\U0001F600é", None)]
    rows += [(5, k, ("user", "assistant")[k % 2], f"turn {k}\\", None) for k in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    examples = chat_format.expand(df)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"])
           for r in chat_format.digests(examples).collect()}
    assert got == expected(rows)
    sizes = {r["conv_id"]: r["formatted_chars"] for r in chat_format.digests(examples).collect()}
    made = examples.collect()
    for conv, size in sizes.items():
        assert size == sum(len(r["formatted"]) for r in made if r["conv_id"] == conv)
    # Each assistant turn has an example, in which only its own text is trainable.
    own = [r for r in made if r["conv_id"] == 5]
    assert len(own) == 200
    for k, r in enumerate(sorted(own, key=lambda r: r["example"])):
        assert chat_format.unescape(r["formatted"][r["loss_start"]:r["loss_end"]]) == f"turn {2 * k + 1}\\"
        assert len(chat_format.read_turns(r["formatted"])) == 2 * k + 2


@given(st.lists(st.tuples(st.text(st.characters(exclude_categories=["Cs"])), st.text("\\#</turn>: \nab")), max_size=4))
def test_turns_come_back(turns):
    whole = "".join(chat_format.format_turn(r, t)[0] for r, t in turns)
    assert chat_format.read_turns(whole) == turns


def test_empty(spark):
    assert chat_format.digests(chat_format.expand(spark.createDataFrame([], SCHEMA))).count() == 0
