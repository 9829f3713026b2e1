"""A topic that holds all rows stays where its rows are read, also where nothing is broadcast by size."""

import pytest
from pyspark.sql import functions as F

from lumenact.operators import corpus as co


@pytest.fixture
def no_small_tables(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield spark
    spark.conf.set(key, before)


def _tasks(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_rows_of_a_topic_are_not_gathered(no_small_tables):
    rows = no_small_tables.range(0, 400, 1, 8).select(
        F.col("id").alias("sample_id"), F.lit("t").alias("topic"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    picked, report = co.seeded_sample(rows, "sample_id", 300, 1, ["topic"], "text")
    assert picked.count() == 300 and _tasks(picked) == 8
    assert [tuple(r) for r in report.collect()] == [("t", 400, 300, False)]
    split = co.stratified_split(rows, 0.5, 1)
    assert split.where("split = 'train'").count() == 200 and _tasks(split) == 8
    topics = co.topic_dictionary(rows, "topic", "sample_id")
    labeled = co.labeled_set(rows, topics)
    assert labeled.where("label = 0").count() == 400 and _tasks(labeled) == 8
