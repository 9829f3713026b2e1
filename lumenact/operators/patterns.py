"""Distinct feature vectors with their rows counted per class, and fits on them as tasks.

Short 0/1 vectors repeat: a classifier needs each distinct one once, with the
number of its rows in every class. `patterns` counts them in one shuffle. A fit
is then a task: `run_fits` gives every task one configuration (and part of it)
and the pattern table, so many fits run side by side, and one that is lost with
its executor is done again like any other task. The table must be small for
that; it is measured, and `check_size` refuses more than MAX_CELLS numbers.
Boosting also has a form for larger tables (see `boosting.py`).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct vectors times features that one task may hold: 5,000 rows a topic, 100 features and
#: 30 topics fit in.
MAX_CELLS = 16_000_000


def patterns(vectors: DataFrame, classes: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, x, n): each distinct vector and its rows in each class, in the order of `classes`.

    `vectors` has `label` and `features`; rows of other classes, or without
    features, are left out.
    """
    counts = [F.sum(F.when(F.col("label") == int(c), 1).otherwise(0)) for c in classes]
    rows = vectors.where(F.col("label").isin([int(c) for c in classes]) & F.col("features").isNotNull())
    return rows.select(*keys, "label", vector_to_array("features").alias("x")).groupBy(*keys, "x").agg(
        F.array(*counts).alias("n"))


def check_size(table: DataFrame, keys: Sequence[str] = ()) -> int:
    """Distinct vectors of the largest table among `keys`, refused beyond MAX_CELLS numbers."""
    sizes = table.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) * F.max(F.size("x"))).alias("cells"))
    largest = sizes.agg(F.max("n"), F.max("cells")).first()
    if (largest[1] or 0) > MAX_CELLS:
        raise ValueError(f"{largest[1]} numbers of distinct vectors, more than a task may hold ({MAX_CELLS})")
    return largest[0] or 0


@dataclass
class Fit:
    """One fit: a body and its parameters; `part` tells the parts of a configuration apart.

    `body(x, n, test, **params)` gets the distinct vectors, their rows per class
    and the distinct test vectors. It returns class scores of the test vectors
    and a dictionary of what there is to say about the fit.
    """

    config: str
    body: Callable
    params: dict = field(default_factory=dict)
    part: int = 0
    keys: tuple = ()


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    lists = table[column].combine_chunks()
    width = len(lists[0]) if len(lists) else 0
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), width).astype(np.float64)


def _with_null(column: pa.ChunkedArray, kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays([column.combine_chunks().cast(pa.list_(kind)), pa.nulls(1, pa.list_(kind))])


def _task(fits: Sequence[Fit], schema_names: Sequence[str]):
    def run(table: pa.Table) -> pa.Table:
        fit = fits[table["_fit"][0].as_py()]
        train, test = table.filter(pa.compute.equal(table["_test"], False)), table.filter(table["_test"])
        order = np.lexsort(_matrix(train, "x").T[::-1]) if len(train) else []  # tasks see one order, whatever the layout
        train = train.take(pa.array(order, pa.int64()))
        x, n, asked = _matrix(train, "x"), _matrix(train, "n"), _matrix(test, "x")
        scores, facts = fit.body(x, n, asked, **fit.params) if len(train) else (np.zeros((len(test), 0)), {})
        facts = [(k, float(v)) for k, v in facts.items()]
        columns = [
            pa.array([fit.config] * (len(test) + 1)), pa.array([fit.part] * (len(test) + 1), pa.int32()),
            *(_with_null(test[name], kind) for name, kind in (("x", pa.float64()), ("n", pa.int64()))),
            pa.array([*map(list, scores), None], pa.list_(pa.float64())),
            pa.array([None] * len(test) + [facts], pa.map_(pa.string(), pa.float64()))]
        for name in schema_names[6:]:
            value = (train if len(train) else test)[name][0].as_py()
            columns.append(pa.array([value] * (len(test) + 1), table.schema.field(name).type))
        return pa.table(columns, schema_names)

    return run


def run_fits(train: DataFrame, test: DataFrame, fits: Sequence[Fit], keys: Sequence[str] = ()) -> DataFrame:
    """(config, part, x, n, scores, facts, keys): a row per test vector and fit, and one of its facts (x null).

    `train` and `test` are pattern tables. With `keys`, each value of them is a
    dataset of its own and has every fit.
    """
    check_size(train, keys)
    check_size(test, keys)
    both = train.withColumn("_test", F.lit(False)).unionByName(test.withColumn("_test", F.lit(True)))
    wanted = both.withColumn("_fit", F.explode(F.sequence(F.lit(0), F.lit(len(fits) - 1))))
    names = ["config", "part", "x", "n", "scores", "facts", *keys]
    kinds = dict(train.dtypes)
    schema = "config string, part int, x array<double>, n array<bigint>, scores array<double>, facts map<string,double>"
    schema += "".join(f", {key} {kinds[key]}" for key in keys)
    # A hash would put several fits into one task and leave others without any.
    slots = max(train.sparkSession.sparkContext.defaultParallelism, len(fits))
    dealt = wanted.repartition(slots, "_fit", *keys) if keys else wanted.repartitionById(slots, F.col("_fit"))
    return dealt.groupBy("_fit", *keys).applyInArrow(_task(fits, names), schema)


def facts(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(config, part, keys, facts) of every fit."""
    return results.where(F.col("x").isNull()).select("config", "part", *keys, "facts")


def predictions(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(config, keys, x, n, pred): the class with the highest sum of scores over all parts, the lowest of equals.

    Parts add up in their order, so equal runs give equal sums.
    """
    parts = F.array_sort(F.collect_list(F.struct("part", "scores")))
    total = F.aggregate(
        F.slice("_p", 2, F.greatest(F.size("_p") - 1, F.lit(0))), F.col("_p")[0]["scores"],
        lambda sums, p: F.zip_with(sums, p["scores"], lambda a, b: a + b))
    rows = results.where(F.col("x").isNotNull()).groupBy("config", *keys, "x", "n").agg(parts.alias("_p"))
    scored = rows.withColumn("_s", total)
    best = F.array_position("_s", F.array_max("_s")) - 1
    return scored.select("config", *keys, "x", "n", best.cast("int").alias("pred"))


def accuracies(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(config, keys, accuracy, n_test) of every configuration."""
    hits = F.sum(F.get("n", F.col("pred")))
    rows = F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, b: a + b))
    return predictions(results, keys).groupBy("config", *keys).agg(
        (hits / rows).alias("accuracy"), rows.alias("n_test"))
