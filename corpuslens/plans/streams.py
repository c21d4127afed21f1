"""Structured Streaming runs over the events table, drained to a table of results."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.plans.registry import query
from corpuslens.streaming import jobs

_HOURS = "SELECT time_bucket(INTERVAL '6 hours', ts) AS w, event_type, count(*) AS n FROM events GROUP BY 1, 2"


@query("l13_watermarked_windows", _HOURS)
def _(t):
    out = jobs.drain(jobs.windowed_counts(jobs.event_stream(t.spark, t.sf_dir), "6 hours"), "complete")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("w"), "event_type", "n")


@query("l14_stateful_totals", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def _(t):
    out = jobs.drain(jobs.running_totals(jobs.event_stream(t.spark, t.sf_dir)), "update")
    return out.groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max_by("total", "n"), 4).alias("total"))


@query("l2_micro_batch_ingest", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def _(t):
    return jobs.ingest_latest(t.spark, t.sf_dir)
