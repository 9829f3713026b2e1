"""Temperature mixing of sources, as columns and SQL functions only.

Weights are the sources' token shares raised to an exponent and normalised: 1
keeps the shares, 0 makes sources equal. The exponent is bisected until the
weights meet a target entropy, or until no source repeats more often than a
limit. Each source then gets its share of a token budget. Its documents are
laid out epoch after epoch, every epoch a permutation of its own, and the
place in that order, as a share of the source's budget, decides the block. A
block thus holds each source close to its weight, and inside a block the
documents are permuted again.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import shared_table

STEPS = 40
CANDIDATES = 15  # exponents tried at once: each step leaves a sixteenth of the interval
BUCKET_DOCS = 4096
TOKENS = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Target:
    """Either a share (0 to 1) of the greatest possible entropy, or a repetition limit."""

    entropy: float | None = None
    max_repeats: float | None = None

    def __post_init__(self):
        if (self.entropy is None) == (self.max_repeats is None):
            raise ValueError("give either an entropy or a repetition limit")


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKENS)), F.lit(0)).cast("long")


def exponent(sources: DataFrame, target: Target) -> float:
    """Bisect the exponent on a table of sources (tokens > 0); only sums reach the driver.

    With an entropy: the greatest exponent whose weights have it. With a limit:
    the smallest exponent at which the rarest source, next to a largest source
    that is used once, repeats at most that often.
    """
    total, most, least, n = sources.agg(
        F.sum("tokens"), F.max("tokens"), F.min("tokens"), F.count(F.lit(1))).first()
    if not n or n == 1:
        return 1.0
    if target.max_repeats is not None:
        def fits(_, a):
            return (most / least) ** (1.0 - a) <= target.max_repeats
        low, high = 0.0, 1.0
        if fits(None, 0.0):
            return 0.0
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (low, middle) if fits(None, middle) else (middle, high)
        return high
    goal = target.entropy * math.log(n)
    share = F.log(F.col("tokens") / F.lit(float(total)))
    low, high = 0.0, 1.0
    for _ in range(STEPS // 4):
        tried = [low + (high - low) * k / (CANDIDATES + 1) for k in range(1, CANDIDATES + 1)]
        sums = sources.agg(*[x for k, a in enumerate(tried) for x in (
            F.sum(F.exp(share * a)).alias(f"z{k}"), F.sum(F.exp(share * a) * share * a).alias(f"s{k}"))]).first()
        entropies = [math.log(sums[f"z{k}"]) - sums[f"s{k}"] / sums[f"z{k}"] for k in range(CANDIDATES)]
        enough = [a for a, h in zip(tried, entropies, strict=True) if h >= goal]
        under = [a for a, h in zip(tried, entropies, strict=True) if h < goal]
        low, high = max(enough, default=low), min(under, default=high)
    return low


def plan(sources: DataFrame, target: Target, budget: int | None = None) -> DataFrame:
    """source, tokens, weight, source_budget.

    Without a budget, the least one at which every source is used in full at
    least once, so that no document is left out.
    """
    alpha = exponent(sources, target)
    # Powers are taken relative to the largest source, so that nothing underflows.
    most = sources.agg(F.max("tokens")).first()[0] or 1
    raised = sources.withColumn("raised", F.pow(F.col("tokens") / F.lit(float(most)), F.lit(alpha)))
    total = raised.agg(F.sum("raised")).first()[0] or 1.0
    weighted = raised.withColumn("weight", F.col("raised") / F.lit(float(total))).drop("raised")
    if budget is None:
        whole = weighted.agg(F.max(F.col("tokens") / F.col("weight"))).first()[0] or 0.0
        share = F.greatest(F.round(F.col("weight") * F.lit(float(whole))).cast("long"), F.col("tokens"))
    else:
        share = F.round(F.col("weight") * F.lit(float(budget))).cast("long")
    return weighted.withColumn("source_budget", share)


def mix(
    docs: DataFrame, target: Target, budget: int | None = None, blocks: int = 64, seed: int = 7,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """The mixture: row_id, doc_id, source, n_tokens, weight, epoch, block, place_key.

    One row per draw. A draw belongs to the mixture while the tokens before it
    in its source's order are below the source's budget, so a source overshoots
    by less than one document. Reading by (block, place_key) gives the order.

    A null source is a source of its own. Documents without tokens (null, empty
    or blank text) come once, in epoch 0, whatever the budget. Repeated rows
    are documents of their own; null ids are kept. Other columns are ignored.
    An empty table gives no rows.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        token_count(F.col(text_col)).alias("n_tokens"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    rows = shared_table(rows, "tokens")
    return draws(rows, target, budget, blocks, seed)


def _key(seed: int) -> Column:
    """Where a document stands in an epoch's permutation."""
    return F.xxhash64(F.lit(seed), "epoch", "doc_id", "text_hash")


def _bucket(key: Column, buckets: Column) -> Column:
    """Buckets of even width over all keys, rising with the key."""
    at = F.floor((key.cast("double") / F.lit(2.0**64) + F.lit(0.5)) * buckets)
    return F.least(at, buckets - 1).cast("long")


def draws(rows: DataFrame, target: Target, budget: int | None, blocks: int, seed: int) -> DataFrame:
    """`mix` on a table of (doc_id, source, n_tokens, text_hash)."""
    sources = rows.groupBy("source").agg(
        F.sum("n_tokens").alias("tokens"), F.count_if(F.col("n_tokens") > 0).alias("docs"))
    sources = shared_table(sources, "sources")
    planned = plan(sources.where("tokens > 0"), target, budget)
    planned = planned.select(
        F.col("source").alias("own_source"), "tokens", "docs", "weight", "source_budget")
    join = F.col("source").eqNullSafe(F.col("own_source"))
    # Epochs begun within the budget; the last one is cut where the budget ends.
    epochs = F.ceil(F.col("source_budget") / F.col("tokens")).cast("int")
    drawn = rows.where("n_tokens > 0").join(planned, join).withColumn(
        "epoch", F.explode(F.sequence(F.lit(0), F.greatest(epochs, F.lit(1)) - 1)))
    drawn = drawn.withColumn("key", _key(seed)).withColumn(
        "bucket", _bucket(F.col("key"), F.ceil(F.col("docs") / F.lit(BUCKET_DOCS))))
    # An epoch is ordered by key. Tokens before a draw: whole lower buckets, then its place in its own.
    group = ["own_source", "epoch"]
    sums = drawn.groupBy(*group, "bucket").agg(F.sum("n_tokens").alias("bucket_tokens"))
    running = Window.partitionBy(*group).orderBy("bucket")
    offsets = sums.select(
        F.col("own_source").alias("s"), F.col("epoch").alias("e"), F.col("bucket").alias("b"),
        (F.sum("bucket_tokens").over(running) - F.col("bucket_tokens")).alias("offset"))
    inside = Window.partitionBy(*group, "bucket").orderBy("key", "doc_id", "text_hash").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    placed = drawn.withColumn("through", F.sum("n_tokens").over(inside)).join(
        offsets, F.col("own_source").eqNullSafe(F.col("s")) & (F.col("epoch") == F.col("e"))
        & (F.col("bucket") == F.col("b")))
    before = F.col("epoch") * F.col("tokens") + F.col("offset") + F.col("through") - F.col("n_tokens")
    placed = placed.withColumn("before", before).where(F.col("before") < F.col("source_budget"))
    out = placed.select(
        "doc_id", "source", "n_tokens", "weight", "epoch", "key", "text_hash",
        F.floor(F.col("before") * F.lit(float(blocks)) / F.col("source_budget")).cast("int").alias("block"))
    blank = rows.where("n_tokens = 0").select(
        "doc_id", "source", "n_tokens", F.lit(0.0).alias("weight"), F.lit(0).alias("epoch"),
        F.lit(None).cast("long").alias("key"), "text_hash",
        F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(blocks)).cast("int").alias("block"))
    return out.unionByName(blank).withColumn(
        "place_key", F.xxhash64(F.lit(seed + 1), "block", "epoch", "doc_id", "text_hash"))


def mixed_documents(
    docs: DataFrame, target: Target, budget: int | None = None, seed: int = 7,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """The documents of the mixture, all columns as they are, as often as `mix` draws them.

    An epoch is ordered by a key, so for each source the last epoch and the
    last key drawn in it say which documents are in; texts are not moved to
    find out. Cases as for `mix`; of repeated rows at the very cut, all stay.
    """
    drawn = mix(docs, target, budget, 1, seed, id_col, source_col, text_col)
    cuts = shared_table(drawn.where("key IS NOT NULL").groupBy(F.col("source").alias("_source")).agg(
        F.max(F.struct("epoch", "key")).alias("_last")), "cuts")
    names = docs.columns
    whole = docs.select(
        F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"), token_count(F.col(text_col)).alias("_n"),
        F.xxhash64(F.col(text_col)).alias("text_hash"))
    placed = whole.join(cuts, F.col("source").eqNullSafe(F.col("_source")), "left")
    last = F.when(F.col("_n") > 0, F.coalesce(F.col("_last.epoch"), F.lit(-1))).otherwise(F.lit(0))
    spread = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(last, F.lit(0)))))
    inside = (F.col("_n") == 0) | (F.col("epoch") < F.col("_last.epoch")) | (
        (F.col("epoch") == F.col("_last.epoch")) & (_key(seed) <= F.col("_last.key")))
    return spread.where(inside).select([F.col("_row")[c].alias(c) for c in names])
