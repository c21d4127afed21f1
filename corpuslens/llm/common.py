"""Helpers that the corpus operators share: shared storage, staged tables, ASCII case folding."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space as these operators know it: space and U+0009 to U+000D.
WS = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the session has no such setting (unit tests on one machine) a new temporary folder is
    made and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = current.get() if current.isDefined() else "file://" + tempfile.mkdtemp(prefix="corpuslens-")
        if not current.isDefined():
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/corpuslens/{what}-{uuid.uuid4().hex}"


def staged(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_places(docs: DataFrame) -> tuple[Column, DataFrame]:
    """Where each row of a table read from files is written, and the files (file, before: rows of those before it).

    Spark numbers the files it writes by partition, but scans them in another order.
    """
    at = docs.metadataColumn("_metadata")
    files = docs.select(at["file_name"].alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.regexp_extract("file", r"part-(\d+)", 1).cast("long"), "file").rowsBetween(Window.unboundedPreceding, -1)
    return F.struct(at["file_name"].alias("file"), at["row_index"].alias("idx")), files.select("file", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))


def identified(docs: DataFrame, id_col: str, mark: str) -> DataFrame:
    """``docs`` with a column ``mark`` of distinct whole numbers that stay the same from scan to scan.

    Ids that are distinct and whole serve as they are. Otherwise rows are numbered once and staged: numbers
    come from the scan's partitions, and another scan may be cut otherwise when executors come and go.
    """
    if distinct_ids(docs, id_col):
        return docs.withColumn(mark, F.col(f"`{id_col}`").cast("long"))
    return staged(docs.withColumn(mark, F.monotonically_increasing_id()), "rows")


def distinct_ids(docs: DataFrame, id_col: str) -> bool:
    """Whether the ids are whole numbers, none null and no two equal."""
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        return False
    rows, ids = docs.agg(F.count(F.lit(1)), F.countDistinct(F.col(f"`{id_col}`"))).first()
    return rows == ids


#: Rows of a column of numbers that may be broadcast.
BROADCAST_ROWS = 500_000


def if_small(keys: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A staged table of keys, marked for broadcast if it has at most ``rows`` rows; a shuffle join serves others."""
    return F.broadcast(keys) if keys.count() <= rows else keys


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/corpuslens/" in path:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z only. Pure ASCII strings take the JVM's fast path, with the same result."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def bound(expr: Column, body) -> Column:
    """``body(x)`` with ``expr`` computed once and bound to ``x``.

    Catalyst may inline a projected column into a lambda and then compute it for each element; a
    one-element ``transform`` pins the value.
    """
    return F.element_at(F.transform(F.array(expr), body), 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
