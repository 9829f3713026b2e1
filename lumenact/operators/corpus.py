"""Text projection, filters, sampling, splitting and labelling of prompts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import match
from ..functions.ranking import before_cut, hash_cutoffs
from ..functions.text import collect_text, normalize_space

SALTS = 64


def row_text(df: DataFrame, columns: Sequence[str], fields: Sequence[str] | None = None) -> Column:
    """Text of the target columns, or of all `fields` when those hold none."""
    schema = df.schema
    present = [c for c in columns if c in schema.fieldNames()]
    everything = list(fields) if fields is not None else schema.fieldNames()

    def gather(names: Sequence[str]) -> Column:
        parts = [collect_text(F.col(n), schema[n].dataType) for n in names]
        return F.concat(*parts) if parts else F.array().cast("array<string>")

    target = gather(present)
    return F.array_join(F.when(F.size(target) > 0, target).otherwise(gather(everything)), " ")


def seeded_sample(
    df: DataFrame, id_col: str, n: int, seed: int, groups: Sequence[str] = (), text: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """n rows (per group) in seeded order, and a report (total, taken, short).

    The rows are found by a key cut-off and a filter, so they are not sorted
    or moved. With `text`, rows whose text is empty are not usable.
    """
    usable = df if text is None else df.where(F.col(text) != "")
    cuts = hash_cutoffs(usable, groups, id_col, seed, lambda total: F.lit(n), totals=True)
    report = cuts.select(*groups, "total", "taken", (F.col("taken") < n).alias("short"))
    return _cut(usable, cuts, groups, id_col, seed).where("_inside").drop("_inside"), report


def _cut(
    df: DataFrame, cuts: DataFrame, groups: Sequence[str], id_col: str, seed: int | Column
) -> DataFrame:
    """Rows with `_inside`. The cuts, one row a group, go to the rows: by group, a topic would meet in one task."""
    names = df.columns
    limits = cuts.select(*groups, "cut_key", "cut_id")
    if groups:
        joined = match(df, F.broadcast(limits), list(groups), "left")
    else:
        joined = df.withColumn("_one", F.lit(1)).join(
            F.broadcast(limits.withColumn("_one", F.lit(1))), "_one", "left")
    return joined.select(*names, before_cut(id_col, seed).alias("_inside"))


def keep_ok(records: DataFrame) -> DataFrame:
    """Records of clean generations."""
    return records.where(F.col("_status") == "ok")


def count_skipped(records: DataFrame) -> DataFrame:
    return records.agg(
        F.count(F.lit(1)).alias("n_records"),
        F.count_if(F.col("_status").eqNullSafe("ok")).alias("n_ok"),
        F.count_if(~F.col("_status").eqNullSafe("ok")).alias("n_skipped"))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Fail when there is nothing to work on."""
    if df.isEmpty():
        raise ValueError(f"no usable {what}")
    return df


def cap_per_topic(df: DataFrame, n: int, topic: str, order: str, salts: int = SALTS) -> DataFrame:
    """The first n rows of each topic in input order.

    A large topic is first cut to n rows in each of `salts` slices, so the
    final ranking sees at most n * salts rows of it.
    """
    salt = F.pmod(F.hash(order), F.lit(salts))
    sliced = Window.partitionBy(topic, salt).orderBy(order)
    whole = Window.partitionBy(topic).orderBy(order)
    return (
        df.withColumn("_rn", F.row_number().over(sliced)).where(F.col("_rn") <= n)
        .withColumn("_rn", F.row_number().over(whole)).where(F.col("_rn") <= n)
        .drop("_rn")
    )


def topic_dictionary(df: DataFrame, topic: str, order: str) -> DataFrame:
    """Class ids by first appearance: (topic, label)."""
    first = df.groupBy(topic).agg(F.min(order).alias("_first"))
    return first.select(
        F.col(topic).alias("topic"),
        (F.row_number().over(Window.orderBy("_first")) - 1).alias("label"))


def split_cuts(
    samples: DataFrame, ratio: float, seed: int | Column = 42,
    groups: Sequence[str] = ("topic",), id_col: str = "sample_id",
) -> DataFrame:
    """Per group, the last of its int(n * ratio) training rows in seeded order.

    A seed column among the groups makes one split per seed in the same job.
    """
    return hash_cutoffs(
        samples, groups, id_col, seed,
        lambda total: F.floor(total.cast("double") * F.lit(float(ratio))))


def with_split(
    df: DataFrame, cuts: DataFrame, seed: int | Column = 42,
    groups: Sequence[str] = ("topic",), id_col: str = "sample_id",
) -> DataFrame:
    """Add `split`. Any table with the id and group columns can be split."""
    marked = _cut(df, cuts, groups, id_col, seed)
    return marked.withColumn(
        "split", F.when(F.col("_inside"), "train").otherwise("test")).drop("_inside")


def stratified_split(
    samples: DataFrame, ratio: float, seed: int | Column = 42,
    groups: Sequence[str] = ("topic",), id_col: str = "sample_id",
) -> DataFrame:
    return with_split(samples, split_cuts(samples, ratio, seed, groups, id_col), seed, groups, id_col)


def labeled_set(df: DataFrame, topics: DataFrame, topic: str = "topic") -> DataFrame:
    """Attach the class id of each row's topic; a null topic has a class like any other."""
    dictionary = topics.select(F.col("topic").alias(topic), "label")
    return match(df, F.broadcast(dictionary), [topic])


def drop_dead(samples: DataFrame, activations: DataFrame, layer: int) -> DataFrame:
    """Samples with at least one step at the reference layer."""
    return samples.join(_alive(activations, layer), "sample_id", "left_semi")


def dead_report(samples: DataFrame, activations: DataFrame, layer: int, keys: Sequence[str]) -> DataFrame:
    """Dead and total samples per split."""
    alive = _alive(activations, layer).withColumn("_alive", F.lit(1))
    return samples.join(alive, "sample_id", "left").groupBy(*keys).agg(
        F.count_if(F.col("_alive").isNull()).alias("n_dead"), F.count(F.lit(1)).alias("n_total"))


def _alive(activations: DataFrame, layer: int) -> DataFrame:
    return activations.where(F.col("layer") == layer).select("sample_id").distinct()


def sample_stats(samples: DataFrame, activations: DataFrame, topics: DataFrame, layer: int) -> DataFrame:
    """Prompt length, word count and number of generated steps per sample."""
    steps = activations.where(F.col("layer") == layer).groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n_gen_steps"))
    words = normalize_space(F.col("prompt"))
    return (
        samples.join(steps, "sample_id", "left")
        .join(F.broadcast(topics), "label")
        .select(
            "sample_id", "label", "topic",
            F.length("prompt").alias("char_len"),
            F.when(words == "", 0).otherwise(F.size(F.split(words, " "))).alias("word_count"),
            F.coalesce("n_gen_steps", F.lit(0).cast("long")).alias("n_gen_steps"))
    )


def topic_counts(samples: DataFrame, topic: str = "topic") -> DataFrame:
    """Samples per topic, in all and per split."""
    return samples.groupBy(topic).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(F.col("split") == "train").alias("n_train"),
        F.count_if(F.col("split") == "test").alias("n_test"))
