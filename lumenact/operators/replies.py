"""Reading model replies: text, JSON array, per-item status, provenance.

JSON is handled as VARIANT, which keeps the type of every item, so one bad
item never spoils its array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, strip
from .prompts import TAG

ITEMS = "array<variant>"


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit(""))


def _text(value: Column, path: str) -> Column:
    """The string at a path, trimmed; null when it is blank or no string."""
    found = F.try_variant_get(value, path, "variant")
    return F.when(
        _kind(found) == "STRING", F.nullif(strip(F.try_variant_get(found, "$", "string")), F.lit("")))


def _outputs(response: Column, kind: str) -> Column:
    outputs = F.coalesce(F.try_variant_get(response, "$.output", ITEMS), F.array().cast(ITEMS))
    return F.filter(outputs, lambda o: F.coalesce(_text(o, "$.type"), F.lit("")) == kind)


def _members(value: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(value, path, ITEMS), F.array().cast(ITEMS))


def _present(texts: Column) -> Column:
    return F.filter(texts, lambda t: t.isNotNull())


def reply_text(response: Column, output_text: Column | None = None) -> Column:
    """The reply: `output_text` if it says anything, else the message texts."""
    pieces = F.flatten(F.transform(
        _outputs(response, "message"),
        lambda o: F.concat(
            F.transform(_members(o, "$.content"), lambda p: _text(p, "$.text")),
            F.array(_text(o, "$.content")))))
    joined = F.coalesce(F.array_join(_present(pieces), "\n"), F.lit(""))
    if output_text is None:
        return joined
    return F.when(is_blank(output_text), joined).otherwise(strip(output_text))


def reasoning_text(response: Column) -> Column:
    """The summaries of reasoning items, or null when there are none."""
    chunks = _present(F.flatten(F.transform(
        _outputs(response, "reasoning"),
        lambda o: F.transform(_members(o, "$.summary"), lambda c: _text(c, "$.text")))))
    return F.when(F.size(chunks) > 0, F.array_join(chunks, "\n\n"))


def extract_array(df: DataFrame, raw: str, tag: str = TAG) -> DataFrame:
    """Add `items` (the tagged JSON array) and `parse_error` (why there is none).

    Without tags the span from the first "[" to the last "]" is taken. Text
    after the array is allowed.
    """
    pattern = f"(?is)<{tag}>(.*?)</{tag}>"
    text = F.col(raw)
    first = F.locate("[", text)
    last = F.length(text) - F.locate("]", F.reverse(text)) + 1
    span = F.when((first > 0) & text.contains("]") & (last > first), F.substring(text, first, last - first + 1))
    tagged = F.when(text.rlike(pattern), strip(F.regexp_extract(text, pattern, 1))).otherwise(span)
    return (
        df.withColumn("_candidate", tagged)
        .withColumn("_json", F.try_parse_json("_candidate"))
        .withColumn("items", F.when(_kind(F.col("_json")).startswith("ARRAY"), F.try_variant_get("_json", "$", ITEMS)))
        .withColumn(
            "parse_error",
            F.when(is_blank(text), "empty_model_output")
            .when(F.col("_candidate").isNull(), "prompts_tag_not_found")
            .when(F.col("_json").isNull(), "json_decode_error")
            .when(F.col("items").isNull(), "json_not_array"))
        .drop("_candidate", "_json")
    )


def parse_responses(responses: DataFrame, tag: str = TAG) -> DataFrame:
    """One row per batch: raw_output, reasoning, items, parse_error.

    `responses` has batch_index, response (JSON text, null when the request
    failed) and, optionally, output_text.
    """
    direct = F.col("output_text") if "output_text" in responses.columns else None
    parsed = responses.where(F.col("response").isNotNull()).withColumn("_v", F.try_parse_json("response"))
    texts = parsed.select(
        "batch_index", reply_text(F.col("_v"), direct).alias("raw_output"),
        reasoning_text(F.col("_v")).alias("reasoning"))
    return extract_array(texts, "raw_output", tag)


NUMBERS = "^(BIGINT|INT|SMALLINT|TINYINT|FLOAT|DOUBLE|DECIMAL|BOOLEAN)"


def _level(item: Column) -> Column:
    """A number as a whole level; anything else, text included, is null."""
    level = F.try_variant_get(item, "$.adversarial_level", "variant")
    return F.when(_kind(level).rlike(NUMBERS), F.try_variant_get(level, "$", "int"))


def prompt_records(
    specs: DataFrame, responses: DataFrame, run_id: str, model: str,
    temperatures: DataFrame | None = None, generated_at: Column | None = None, tag: str = TAG,
) -> DataFrame:
    """One record per spec, whatever happened to its batch.

    Failures of a whole batch mark all its specs; a bad item marks one. Each
    reply is parsed once, and joined to the specs of its batch by position.
    """
    replies = parse_responses(responses, tag).withColumn("_answered", F.lit(True))
    if temperatures is not None:
        replies_plan = temperatures.select("batch_index", "temperature")
    else:
        replies_plan = None
    in_batch = Window.partitionBy("batch_index")
    rows = specs.withColumn("_n", F.count(F.lit(1)).over(in_batch)).join(replies, "batch_index", "left")
    if replies_plan is not None:
        rows = rows.join(replies_plan, "batch_index", "left")
    else:
        rows = rows.withColumn("temperature", F.lit(None).cast("double"))
    rows = rows.withColumn(
        "_failure",
        F.when(F.col("_answered").isNull(), "request_failed")
        .when(F.col("parse_error").isNotNull(), F.concat(F.lit("parse_error:"), F.col("parse_error")))
        .when(F.size("items") != F.col("_n"), "count_mismatch"))
    rows = rows.withColumn("_item", F.when(F.col("_failure").isNull(), F.get("items", F.col("pos"))))
    rows = rows.withColumn("_prompt", _text(F.col("_item"), "$.prompt"))
    ok = F.col("_prompt").isNotNull()
    status = F.coalesce("_failure", F.when(ok, "ok").otherwise("bad_item"))
    at = F.current_timestamp() if generated_at is None else generated_at
    gen = F.struct(
        F.col("batch_index").cast("long").alias("batch_index"),
        F.md5(F.concat_ws(":", F.lit(run_id), F.col("batch_index").cast("string"))).alias("request_id"),
        F.col("temperature"),
        F.lit(model).alias("model"),
        at.cast("timestamp").alias("generated_at"),
        F.when(~ok, F.col("raw_output")).alias("raw_output"),
        F.when(~ok, F.col("reasoning")).alias("reasoning"))
    return rows.select(
        *specs.columns, F.col("_prompt").alias("prompt"), status.alias("_status"), gen.alias("_gen"),
        F.when(ok, _level(F.col("_item"))).alias("adversarial_level"),
        F.when(ok, _text(F.col("_item"), "$.surface_topic")).alias("surface_topic"))


def run_summary(records: DataFrame) -> DataFrame:
    """Totals by status, ok records by subtopic, numbers of specs and batches.

    (section, key, n), from one pass of counts plus the distinct batches.
    """
    ok = F.count_if(F.col("_status") == "ok")
    counts = (
        records.groupingSets([["_status"], ["subtopic"], []], "_status", "subtopic")
        .agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("_n"), ok.alias("_ok"))
    )
    section = F.when(F.col("_g") == 1, "status").when(F.col("_g") == 2, "ok_by_subtopic").otherwise("num_specs")
    rows = counts.select(
        section.alias("section"), F.coalesce("_status", "subtopic", F.lit("total")).alias("key"),
        F.when(F.col("_g") == 2, F.col("_ok")).otherwise(F.col("_n")).alias("n"))
    n_batches = records.select("_gen.batch_index").distinct().agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("num_batches").alias("section"), F.lit("total").alias("key"), "n")
    return rows.where(~((F.col("section") == "ok_by_subtopic") & (F.col("n") == 0))).unionByName(n_batches)
