"""Work that is done once: a long curve, and gradient sums by no more partitions than cores."""

import pytest
from pyspark.sql import functions as F

from lumenact.operators import estimators as est
from lumenact.plans import q_long
from tests.conftest import SF


def test_long_curve_is_computed_once(spark):
    summary = q_long.d05_long(spark, SF)
    plan = summary._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "Window [sum(_c0" not in plan and "md5" not in plan
    assert summary.count() == 87


def test_long_samples_count_the_words(spark):
    study = q_long.LongStudy(spark, SF)
    counted = study.steps.groupBy("sample_id", "label").agg(F.count(F.lit(1)).cast("int").alias("n_steps"))
    assert sorted(map(tuple, study.samples.collect())) == sorted(map(tuple, counted.collect()))


@pytest.mark.parametrize("given", [3, 50])
def test_a_fit_has_no_more_partitions_than_cores(spark, monkeypatch, given):
    rows = spark.range(100).repartition(given)
    seen = []
    monkeypatch.setattr(est, "_one", lambda config, train, test: seen.extend(
        (t.rdd.getNumPartitions(), t.count()) for t in (train, test)) or (config.name, {}, 1.0, 100))
    assert est.run_sweep(rows, rows, [est.Config("a", None)]).count() == 1
    cores = spark.sparkContext.defaultParallelism
    assert seen == [(min(given, cores), 100)] * 2
