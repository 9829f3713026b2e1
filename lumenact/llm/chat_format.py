"""Conversations as training examples, one for each assistant turn.

An example holds all turns before a reply as context and the reply itself, and
only the reply is trainable: its span, in characters of the example, is the
loss mask. Turns are written as

    ### role:
    text
    </turn>

and inside roles and texts a backslash goes before every backslash, "#", "<"
and, in roles, ":", so no text can look like a turn's marks and `read_turns`
gives back exactly what went in.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, BETWEEN, CLOSE = "### ", ":\n", "\n</turn>\n"
_TEXT_MARKS = str.maketrans({c: "\\" + c for c in "\\#<"})
_ROLE_MARKS = str.maketrans({c: "\\" + c for c in "\\#<:"})
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ((?:\\.|[^\\:])*):\n((?:\\.|[^\\<])*)\n</turn>\n", re.DOTALL)
BATCH_CHARS = 1 << 22
ASSISTANT = "assistant"

EXAMPLES = ("conv_id long, example int, formatted string, loss_start long, loss_end long, "
            "first_turn int, n_turns int, last boolean")


def escape(text: str) -> str:
    return text.translate(_TEXT_MARKS)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its text begins and ends."""
    head = OPEN + role.translate(_ROLE_MARKS) + BETWEEN
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def read_turns(formatted: str, start: int = 0) -> list[tuple[str, str]]:
    """(role, text) of all turns from `start` on; fails on anything else."""
    turns = []
    while start < len(formatted):
        found = _TURN.match(formatted, start)
        if found is None:
            raise ValueError(f"no turn at {start}")
        turns.append((unescape(found[1]), unescape(found[2])))
        start = found.end()
    return turns


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Examples of sorted turns; the running context is the only thing kept of a conversation."""
    rows: list[tuple] = []
    size = 0
    state = None  # conversation, its formatted context, examples and turns so far, turns shown in an example
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "role", "text")]
        for conv, role, text in zip(*columns, strict=True):
            if state is None or state[0] != conv:
                if state is not None:
                    rows += _rest(state)
                state = [conv, "", 0, 0, 0]
            turn, start, end = format_turn(role or "", text or "")
            _, context, number, turns, shown = state
            if role == ASSISTANT:
                at = len(context)
                context += turn
                rows.append((conv, number, context, at + start, at + end, shown, turns + 1, False))
                size += len(context)
                state[2], state[4] = number + 1, turns + 1
            else:
                context += turn
            state[1], state[3] = context, turns + 1
            if size > BATCH_CHARS:
                yield _record(rows)
                rows, size = [], 0
    if state is not None:
        rows += _rest(state)
    if rows:
        yield _record(rows)


def _rest(state: list) -> list[tuple]:
    """The closing example: all turns, nothing trainable. Written if turns follow the last reply."""
    conv, context, number, turns, shown = state
    return [(conv, number, context, 0, 0, shown, turns, True)] if shown < turns else []


def _record(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
    names = ["conv_id", "example", "formatted", "loss_start", "loss_end", "first_turn", "n_turns", "last"]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def expand(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per example: conv_id, example, formatted, loss_start, loss_end, first_turn, n_turns, last.

    Every assistant turn ends an example whose context is all preceding turns;
    the characters loss_start to loss_end (the reply's escaped text) are
    trainable. If turns follow the last reply, a closing row with an empty span
    holds them, so no turn is lost; `last` marks it. first_turn is the first
    turn that no earlier example of the conversation shows.

    Turns are ordered by (turn, role, text), nulls first; repeated rows are turns of
    their own. Null roles and texts count as empty. A null conv_id is a
    conversation of its own. Other columns are ignored. An empty table gives no
    rows. A conversation is read as a sorted stream in one task, which holds
    its formatted context and no other turn.
    """
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(_examples, EXAMPLES)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Read examples back: each must begin with the whole one before it; what follows is parsed."""
    done: list[tuple] = []
    state = None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "example", "formatted", "loss_start", "loss_end")]
        for conv, example, formatted, start, end in zip(*columns, strict=True):
            if state is None or example == 0:
                if state is not None:
                    done.append(_closed(state))
                state = {"conv": conv, "seen": "", "turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(),
                         "loss_chars": 0, "chars": 0}
            if not formatted.startswith(state["seen"]):
                raise ValueError(f"example {example} of conversation {conv} does not repeat the one before it")
            for role, text in read_turns(formatted, len(state["seen"])):
                state["all"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                state["turns"] += 1
            state["seen"] = formatted
            reply = unescape(formatted[start:end])
            state["loss"].update(reply.encode("utf-8", "surrogatepass"))
            state["loss_chars"] += len(reply)
            state["chars"] += len(formatted)
    if state is not None:
        done.append(_closed(state))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], kind) for k, kind in enumerate(kinds)],
                                     names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def _closed(state: dict) -> tuple:
    return (state["conv"], state["turns"], state["all"].hexdigest(), state["loss_chars"],
            state["loss"].hexdigest(), state["chars"])


def digests(examples: DataFrame) -> DataFrame:
    """What `expand` wrote, read back: one row per conversation.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline of each turn),
    loss_chars and loss_sha256 (all trainable text, unescaped), formatted_chars
    (all characters of the examples). `examples` must come straight from
    `expand`, whose order it relies on.
    """
    return examples.select("conv_id", "example", "formatted", "loss_start", "loss_end").mapInArrow(
        _digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long")
