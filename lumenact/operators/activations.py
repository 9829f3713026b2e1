"""Selecting steps of activation tables and measuring them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import match
from ..functions.ranking import bucketed_rank

DECODE = "decode"
PREFILL = "prefill"
PREFILL_DECODE = "prefill+decode"

STEPS_PER_BUCKET = 4096


def select_capture(
    df: DataFrame,
    mode: str,
    keys: Sequence[str] = ("sample_id", "layer"),
    contiguous: bool = False,
) -> DataFrame:
    """Keep the steps of a capture mode and number them from 0.

    `kind` tells prompt positions ("prefill") from generated steps ("decode").
    Of the prompt only the last position is ever kept, and it comes first.
    Decode steps are ranked, and shifted where the sample has a prompt. A
    caller who knows that they already run from 0 and that every sample has its
    prompt can say so with `contiguous`; then the vectors are not moved.
    """
    keys = list(keys)
    payload = [c for c in df.columns if c not in (*keys, "kind", "step")]
    parts = []
    if mode in (PREFILL, PREFILL_DECODE):
        last = df.where(F.col("kind") == PREFILL).groupBy(*keys).agg(
            F.max_by(F.struct(*payload), F.col("step")).alias("_p"))
        parts.append(last.select(
            *keys, F.lit(PREFILL).alias("kind"), F.lit(0).cast("long").alias("step"), "_p.*"))
    if mode in (DECODE, PREFILL_DECODE):
        decode = df.where(F.col("kind") == DECODE)
        if not contiguous:
            decode = bucketed_rank(
                decode, ["step"], F.floor(F.col("step") / STEPS_PER_BUCKET), keys, "_rank")
            decode = decode.withColumn("step", F.col("_rank")).drop("_rank")
        decode = decode.withColumn("step", F.col("step").cast("long"))
        if mode == PREFILL_DECODE and contiguous:
            decode = decode.withColumn("step", F.col("step") + 1)
        elif mode == PREFILL_DECODE:
            has_prompt = parts[0].select(*keys, F.lit(1).alias("_shift"))
            decode = match(decode, has_prompt, keys, "left").withColumn(
                "step", F.col("step") + F.coalesce("_shift", F.lit(0))).drop("_shift")
        parts.append(decode.select(*keys, "kind", "step", *payload))
    if not parts:
        raise ValueError(f"unknown capture mode {mode!r}")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def active_steps(
    df: DataFrame, is_end: Column, max_steps: int, sample: str = "sample_id"
) -> DataFrame:
    """Steps before the sample's first end token, at most `max_steps` of them.

    Meant for the narrow table of tokens; vectors are attached to what is left.
    """
    capped = df.where(F.col("step") < max_steps)
    ends = capped.where(is_end).groupBy(sample).agg(F.min("step").alias("_end"))
    return (
        match(capped, ends, [sample], "left")
        .where(F.col("_end").isNull() | (F.col("step") < F.col("_end")))
        .drop("_end")
    )


def stored_bytes(df: DataFrame, bytes_per_value: int = 2, keys: Sequence[str] = ("layer",)) -> DataFrame:
    """Size of the stored hidden states."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_vectors"),
        (F.sum(F.size("h").cast("long")) * bytes_per_value).alias("n_bytes"))
