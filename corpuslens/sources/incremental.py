"""Incremental reading: manifests, resumable drops, compaction, and a pluggable folder source.

Remote APIs come in through a Python data source; the one here serves pages from a folder, as a stand-in
with the same contract (ordered pages, a watermark, replay from any offset).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def unseen(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (path, size) that the manifest lacks or knows with another size."""
    return files.join(manifest.select("path", "size"), ["path", "size"], "left_anti")


def advance(manifest: DataFrame, done: DataFrame) -> DataFrame:
    """The manifest with the files just read; the latest entry of a path wins."""
    every = manifest.withColumn("_new", F.lit(0)).unionByName(done.withColumn("_new", F.lit(1)))
    return every.withColumn("_rn", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("_new")))).filter("_rn = 1").drop("_rn", "_new")


def watermark(manifest: DataFrame) -> str | None:
    """Greatest file name read so far; stock files come before increments by name."""
    return manifest.agg(F.max(F.element_at(F.split("path", "/"), -1))).first()[0]


def compact(lines: DataFrame, uid: str, position: str, tombstones: DataFrame) -> DataFrame:
    """Lines without withdrawn ids, the last of each id."""
    alive = lines.join(tombstones.select(uid).distinct(), uid, "left_anti")
    return alive.withColumn("_rn", F.row_number().over(Window.partitionBy(uid).orderBy(F.desc(position)))).filter("_rn = 1").drop("_rn")


def reservoir(rows: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """Uniform sample of k rows, the same for the same seed: the k smallest seeded hashes."""
    return rows.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))).orderBy("_h", key).limit(k).drop("_h")


def every_nth(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The sample of rows whose whole-number key ``n`` divides."""
    return rows.filter(F.col(key) % n == 0)


def after_done(lines: DataFrame, state: DataFrame, file: str, line: str) -> DataFrame:
    """Lines beyond those that the state (file, done) counts; files it lacks are read from the start."""
    return lines.join(state, file, "left").filter(F.col(line) > F.coalesce("done", F.lit(0))).drop("done")


def months(spark: SparkSession, first: str, last: str) -> DataFrame:
    """month, last_day for each month from ``first`` to ``last`` (yyyy-MM)."""
    span = F.sequence(F.to_date(F.lit(f"{first}-01")), F.to_date(F.lit(f"{last}-01")), F.expr("INTERVAL 1 MONTH"))
    return spark.range(1).select(F.explode(span).alias("d")).select(F.date_format("d", "yyyy-MM").alias("month"), F.last_day("d").alias("last_day"))


class Page(InputPartition):
    def __init__(self, path: str):
        self.path = path


class PagedFolder(DataSource):
    """Rows (page, line) from a folder of text pages, one partition for each page."""

    @classmethod
    def name(cls) -> str:
        return "paged_folder"

    def schema(self) -> str:
        return "page string, line string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(self.options["path"], self.options.get("after", ""))


class _PagedReader(DataSourceReader):
    def __init__(self, path: str, after: str):
        self.path, self.after = path, after

    def partitions(self):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        found = store.get_file_info(fs.FileSelector(root, recursive=False))
        return [Page(i.path) for i in sorted(found, key=lambda i: i.path) if i.is_file and i.base_name[0] not in "._" and i.base_name > self.after]

    def read(self, partition: Page):
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        with store.open_input_stream(partition.path) as f:
            for line in f.read().decode("utf-8").splitlines():
                yield partition.path.rsplit("/", 1)[-1], line


def backoff(attempt: Column, share: Column, first: float = 1.0, most: float = 60.0) -> Column:
    """Seconds before a repeated call: doubled with each attempt, up to ``most``, of which ``share`` (0 to 1) of a half is chance."""
    return F.least(F.lit(most), first * F.pow(F.lit(2.0), attempt)) * (0.5 + 0.5 * share)
