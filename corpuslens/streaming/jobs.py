"""Streaming jobs on the events table: windows with watermarks, keyed state, and foreachBatch upserts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream; ts becomes an instant for watermarks."""
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", "*.parquet")
    path = f"{sf_dir}/events.parquet"
    # a table may be one file or a folder of files
    one = spark.read.parquet(path).select("_metadata.file_path").first()[0].rstrip("/").endswith("/events.parquet")
    source = raw.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if one else raw.parquet(path)
    return source.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Run a query over what is there now and return its results."""
    name = f"drain_{uuid.uuid4().hex}"
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def windowed_counts(events: DataFrame, size: str, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"))


def deduplicated(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def running_totals(events: DataFrame) -> DataFrame:
    """Count and total of each user, kept as state from batch to batch."""

    def update(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for frame in frames:
            n, total = n + len(frame), total + float(frame["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    return events.groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def ingest_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest event of each user by an idempotent upsert in foreachBatch; each batch writes a new version."""
    from corpuslens.sources.shared import scratch

    root = scratch(spark, "latest")

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.select("user_id", "event_id")
        if number > 0:
            rows = rows.unionByName(batch.sparkSession.read.parquet(f"{root}/v{number - 1}"))
        rows.groupBy("user_id").agg(F.max("event_id").alias("event_id")).write.mode("overwrite").parquet(f"{root}/v{number}")

    q = event_stream(spark, sf_dir).writeStream.foreachBatch(merge).option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{root}/v{q.lastProgress['batchId']}")
