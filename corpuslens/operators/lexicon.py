"""Stored postings of a text column: built once, read by term.

The table (term, id, at: positions, dl: words of the document) is ranged and sorted by term, so a query's term filter
reaches the scan and skips row groups without its terms; lengths come with the postings, and statistics of the
column are a row of their own. A term that many documents hold is spread over files by id.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions import text as X
from corpuslens.operators.search import K1, B
from corpuslens.sources.shared import root


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def fingerprint(docs: DataFrame, *marks: str) -> str:
    """Of the files that a table is read from (names, sizes, times) and of the columns; another one needs another index."""
    spark, parts = docs.sparkSession, list(marks)
    for name in sorted(docs.inputFiles()):
        target, store = _path(spark, name)
        status = store.getFileStatus(target)
        parts.append(f"{name}|{status.getLen()}|{status.getModificationTime()}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:32]


class LexicalIndex:
    """Postings and statistics of one text column, at a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def stored(cls, docs: DataFrame, id_col: str, text: Column, name: str) -> LexicalIndex:
        """The index of ``text`` over the files of ``docs``; built if the shared folder has none."""
        spark = docs.sparkSession
        index = cls(spark, f"{root(spark)}/corpuslens-index/{fingerprint(docs, id_col, name)}")
        target, store = _path(spark, f"{index.path}/stats/_SUCCESS")
        if not store.exists(target):
            index.build(docs, id_col, text)
        return index

    def build(self, docs: DataFrame, id_col: str, text: Column) -> None:
        tokens = F.filter(F.transform(X.tokens(text), lambda t, i: F.struct(t.alias("term"), i.alias("pos"))), lambda x: ~X.is_stopword(x["term"]))
        parts = docs.sparkSession.sparkContext.defaultParallelism
        few = len(docs.inputFiles()) < parts  # a few files may be a single split
        rows = (docs.repartition(parts, id_col) if few else docs).select(F.col(id_col).alias("id"), tokens.alias("ts"))
        flat = rows.select("id", F.size("ts").alias("dl"), F.explode("ts").alias("t")).select("id", "dl", "t.term", "t.pos")
        held = flat.repartitionByRange("term", "id").groupBy("term", "id", "dl").agg(F.array_sort(F.collect_list("pos")).alias("at"))
        held.sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{self.path}/postings")
        lengths = self.table().groupBy("id").agg(F.max("dl").alias("dl"))
        # last, since its presence says that all is written
        lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).write.mode("overwrite").parquet(f"{self.path}/stats")

    def table(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    def stats(self) -> DataFrame:
        """n, avgdl: one row."""
        return self.spark.read.parquet(f"{self.path}/stats")

    def postings(self) -> DataFrame:
        """id, pos, term."""
        return self.table().select("id", F.explode("at").alias("pos"), "term")

    def bm25(self, terms: list[str], boost: float = 1.0, least: int = 1) -> DataFrame:
        """id, score of the documents that hold at least ``least`` of the terms; statistics are the whole column's."""
        terms = list(dict.fromkeys(terms))
        held = self.table().filter(F.col("term").isin(terms)).select("id", "term", F.size("at").alias("tf"), "dl")
        df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row for each term of the query
        rows = held.join(F.broadcast(df), "term").join(F.broadcast(self.stats()))
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = boost * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        scored = rows.groupBy("id").agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("held"))
        return scored.filter(F.col("held") >= least).select("id", "score")
