"""Sitemap sink: URLs dealt to files of a fixed size, written compressed with an index."""

from __future__ import annotations

import gzip
from html import escape

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST = 50_000


def numbered_files(urls: DataFrame, most: int = MOST) -> DataFrame:
    """``urls`` (loc, lastmod) with the number of their file, in order of loc.

    Rows are range-partitioned and numbered inside their partition; only one count for each partition is
    summed in order, so no task sees all rows.
    """
    part = urls.repartitionByRange("loc").withColumn("_p", F.spark_partition_id())
    rows = part.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy("loc")))
    counts = part.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    return rows.join(F.broadcast(before), "_p").withColumn("file", F.floor((F.col("_before") + F.col("_i") - 1) / most)).drop("_p", "_i", "_before")


def sitemap_xml(rows: list[tuple[str, str]], base: str) -> bytes:
    """One compressed file; equal input gives equal bytes."""
    items = "".join(f"<url><loc>{escape(base + loc)}</loc><lastmod>{day}</lastmod></url>" for loc, day in rows)
    return gzip.compress(f'<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">{items}</urlset>'.encode(), mtime=0)


def write_sitemaps(urls: DataFrame, base: str, most: int = MOST) -> DataFrame:
    """file, body: one row for each file, ready for a binary sink."""

    def run(key, frame):
        import pandas as pd

        frame = frame.sort_values("loc")
        return pd.DataFrame({"file": [key[0]], "body": [sitemap_xml(list(zip(frame["loc"], frame["lastmod"].astype(str), strict=True)), base)]})

    return numbered_files(urls, most).groupBy("file").applyInPandas(run, "file long, body binary")


def push_payloads(urls: DataFrame, key: str, host: str, most: int = 10_000) -> DataFrame:
    """file, payload: JSON messages of at most ``most`` URLs each, for search engines that take pushed changes."""
    listed = numbered_files(urls, most).groupBy("file").agg(F.array_sort(F.collect_list(F.concat(F.lit(f"https://{host}"), "loc"))).alias("urlList"))
    return listed.select("file", F.to_json(F.struct(F.lit(host).alias("host"), F.lit(key).alias("key"), "urlList")).alias("payload"))
