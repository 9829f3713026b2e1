from pyspark.sql import functions as F

from lumenact.plans.q_long import LongStudy


def test_every_word_is_a_step(spark, tmp_path):
    rows = [(1, "en", " ".join(f"w{i}" for i in range(1500))), (2, "de", "ein Wort")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    study = LongStudy(spark, str(tmp_path))
    assert {r["sample_id"]: r["n_steps"] for r in study.samples.collect()} == {1: 1500, 2: 2}
    assert study.steps.agg(F.max("step")).first()[0] == 1499
