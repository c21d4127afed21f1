from pyspark.sql import functions as F

from corpuslens.streaming import jobs


def test_windows_and_state(spark, data):
    events = spark.read.parquet(f"{data}/events.parquet")
    out = jobs.drain(jobs.windowed_counts(jobs.event_stream(spark, data), "6 hours"), "complete")
    assert out.agg(F.sum("n")).first()[0] == events.count()
    assert jobs.ingest_latest(spark, data).count() == events.select("user_id").distinct().count()


def test_dedup_in_the_watermark(spark, data):
    out = jobs.drain(jobs.deduplicated(jobs.event_stream(spark, data), ["event_id"]), "append")
    assert out.count() == spark.read.parquet(f"{data}/events.parquet").count()
