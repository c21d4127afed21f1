"""Scratch folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_MADE: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where that is unset, a temporary folder of the application's."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        key = spark.sparkContext.applicationId
        if key not in _MADE:
            _MADE[key] = "file://" + tempfile.mkdtemp(prefix="corpuslens-")
        found = _MADE[key]
    return found.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{root(spark)}/corpuslens/{what}-{uuid.uuid4().hex}"
