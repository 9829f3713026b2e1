"""Malformed replies, one status each."""

import json

from pyspark.sql import functions as F

from lumenact.operators.replies import prompt_records, run_summary

GOOD = {"prompt": " q ", "adversarial_level": 2, "surface_topic": " s "}


def _reply(text):
    return json.dumps({"output": [{"type": "message", "content": [{"text": text}]}]})


CASES = [
    ("ok", _reply("<PROMPTS>" + json.dumps([GOOD]) + "</PROMPTS>")),
    ("ok", _reply("see: " + json.dumps([GOOD]) + " done")),
    ("ok", _reply("<prompts>\n" + json.dumps([GOOD]) + " trailing</Prompts>")),
    ("ok", _reply("<PROMPTS>[{\"prompt\": \"first\", \"prompt\": \"q\"}]</PROMPTS>")),
    ("request_failed", None),
    ("parse_error:empty_model_output", _reply(" \n")),
    ("parse_error:empty_model_output", json.dumps({"output": "text"})),
    ("parse_error:prompts_tag_not_found", _reply("] nothing [")),
    ("parse_error:json_decode_error", _reply("<PROMPTS></PROMPTS>")),
    ("parse_error:json_decode_error", _reply("<PROMPTS>[{'prompt': 'q'}]</PROMPTS>")),
    ("parse_error:json_decode_error", _reply("<PROMPTS>[{\"prompt\": \"q\"</PROMPTS>")),
    ("parse_error:json_not_array", _reply("<PROMPTS>" + json.dumps(GOOD) + "</PROMPTS>")),
    ("count_mismatch", _reply("<PROMPTS>[]</PROMPTS>")),
    ("count_mismatch", _reply("<PROMPTS>" + json.dumps([GOOD, GOOD]) + "</PROMPTS>")),
    ("bad_item", _reply("<PROMPTS>[null]</PROMPTS>")),
    ("bad_item", _reply("<PROMPTS>[\"text\"]</PROMPTS>")),
    ("bad_item", _reply("<PROMPTS>[{\"prompt\": 3}]</PROMPTS>")),
    ("bad_item", _reply("<PROMPTS>[{\"prompt\": \" \\t\"}]</PROMPTS>")),
]


def _records(spark, replies):
    specs = spark.createDataFrame(
        [(i, 0, "sub", "top", 2) for i in range(len(replies))],
        "batch_index long, pos int, subtopic string, topic string, target_adversarial_level int")
    responses = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "batch_index long, response string")
    return prompt_records(specs, responses, "run", "model")


def test_each_status(spark):
    records = _records(spark, [r for _, r in CASES])
    got = {r["batch_index"]: r for r in records.collect()}
    assert [got[i]["_status"] for i in range(len(CASES))] == [status for status, _ in CASES]
    for i, (status, _) in enumerate(CASES):
        assert got[i]["prompt"] == ("q" if status == "ok" else None)
        assert (got[i]["_gen"]["raw_output"] is None) == (status in ("ok", "request_failed"))
    assert got[0]["surface_topic"] == "s" and got[0]["adversarial_level"] == 2


def test_levels_keep_their_type(spark):
    levels = ["2.7", "true", "false", "-1.5", "\"3\"", "null", "[1]", "1e1"]
    replies = [_reply(f'<PROMPTS>[{{"prompt": "q", "adversarial_level": {x}}}]</PROMPTS>') for x in levels]
    got = {r["batch_index"]: r["adversarial_level"] for r in _records(spark, replies).collect()}
    assert [got[i] for i in range(len(levels))] == [2, 1, 0, -1, None, None, None, 10]


def test_summary_counts_everything(spark):
    summary = {(r["section"], r["key"]): r["n"] for r in run_summary(_records(spark, [r for _, r in CASES])).collect()}
    assert summary[("num_specs", "total")] == summary[("num_batches", "total")] == len(CASES)
    assert summary[("ok_by_subtopic", "sub")] == summary[("status", "ok")] == 4


def test_missing_response_is_a_failed_request(spark):
    specs = spark.createDataFrame([(7, 0, "s", "t", 0)], "batch_index long, pos int, subtopic string, topic string, target_adversarial_level int")
    none = spark.createDataFrame([], "batch_index long, response string")
    row = prompt_records(specs, none, "run", "m").select("_status", F.col("_gen.request_id").alias("i")).first()
    assert row["_status"] == "request_failed" and len(row["i"]) == 32
