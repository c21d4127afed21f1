"""Hierarchies: level by level down and up, with depth limits and paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslens.sources.shared import scratch


def _levels(spark: SparkSession, first: DataFrame, step: Callable[[DataFrame], DataFrame], depth: int) -> DataFrame:
    """All levels, each made of the one before by ``step``, until one is empty or ``depth`` are there.

    A level is staged in the shared folder, so the next one is planned by its true size and rows are not limited, as
    those of a recursive query are (``spark.sql.cteRecursionRowLimit``, a million).
    """
    path, level, found = scratch(spark, "levels"), first, []
    while len(found) < depth:
        found.append(f"{path}/{len(found) + 1}")
        level.write.parquet(found[-1])
        level = spark.read.schema(first.schema).parquet(found[-1])
        if level.isEmpty():
            break
        level = step(level)
    return spark.read.schema(first.schema).parquet(*found)


def _staged(spark: SparkSession, rows: DataFrame) -> DataFrame:
    path = scratch(spark, "edges")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def descend(spark: SparkSession, edges: DataFrame, root: str, depth: int = 32) -> DataFrame:
    """Nodes below ``root`` of edges (parent, child, seq): node, depth, path."""
    shown = F.transform("path", lambda s: F.lpad(s.cast("string"), F.greatest(F.lit(6), F.length(s.cast("string"))), F.lit("0")))
    below = descend_all(spark, edges, spark.range(1).select(F.lit(root).alias("root")), depth)
    return below.select("node", "depth", F.array_join(shown, "/").alias("path"))


def ascend(spark: SparkSession, edges: DataFrame, leaves: DataFrame, depth: int = 12) -> DataFrame:
    """Chain from each of ``leaves`` (leaf, distinct) to its root: leaf, node, level (1 is the parent)."""
    edges = _staged(spark, edges.select("parent", "child"))

    def step(up: DataFrame) -> DataFrame:
        # few nodes may be above many leaves: their edges alone are joined, and broadcast where they are few
        held = edges.join(up.select(F.col("node").alias("child")).distinct(), "child", "left_semi")
        return up.join(held, F.col("child") == F.col("node")).select("leaf", F.col("parent").alias("node"), (F.col("level") + 1).alias("level"))

    first = edges.join(leaves, F.col("child") == F.col("leaf")).select("leaf", F.col("parent").alias("node"), F.lit(1).alias("level"))
    return _levels(spark, first, step, depth)


def in_force(edges: DataFrame, start: str, end: str, at: Column) -> DataFrame:
    """Edges that hold at a date; an open end is null."""
    return edges.filter((F.col(start).isNull() | (F.col(start) <= at)) & (F.col(end).isNull() | (F.col(end) > at)))


def descend_all(spark: SparkSession, edges: DataFrame, roots: DataFrame, depth: int = 32) -> DataFrame:
    """Nodes below each of ``roots`` (root) of edges (parent, child, seq): root, node, depth, path (the seqs on the way)."""
    edges = _staged(spark, edges.select("parent", "child", "seq"))

    def step(tree: DataFrame) -> DataFrame:
        return tree.join(edges, F.col("parent") == F.col("node")).select("root", F.col("child").alias("node"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("seq")).alias("path"))

    first = roots.join(edges, F.col("parent") == F.col("root")).select("root", F.col("child").alias("node"), F.lit(1).alias("depth"), F.array("seq").alias("path"))
    return _levels(spark, first, step, depth)


def corpus_toc(articles: DataFrame) -> DataFrame:
    """Edges of the table of contents that title paths tell: text_uid, owner, kind, label, seq.

    articles: text_uid, idx (their order), uid, title_path ("I > A", null at the top). Divisions of one label under the
    same parent are one, wherever their articles stand; children come by their first article. Texts without any path
    have no table. Articles are combined by division before they are shuffled by owner.
    """
    labels = F.filter(F.transform(F.split(F.coalesce("title_path", F.lit("")), " > "), lambda x: F.trim(x)), lambda x: x != "")
    rows = articles.join(articles.filter("title_path IS NOT NULL").select("text_uid").distinct(), "text_uid", "left_semi").select("text_uid", "idx", "uid", labels.alias("p"))
    path = lambda p, n: F.array_join(F.slice(p, 1, n), " > ")
    levels = rows.filter(F.size("p") > 0).select("text_uid", "idx", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda n: F.struct(path(F.col("p"), n - 1).alias("owner"), F.get(F.col("p"), n - 1).alias("label")))).alias("d"))
    divisions = levels.groupBy("text_uid", "d.owner", "d.label").agg(F.min("idx").alias("at")).select("text_uid", "owner", F.lit("division").alias("kind"), "label", "at")
    leaves = rows.select("text_uid", path(F.col("p"), F.size("p")).alias("owner"), F.lit("article").alias("kind"), F.col("uid").alias("label"), F.col("idx").alias("at"))
    order = Window.partitionBy("text_uid", "owner").orderBy("at", F.desc("kind"))
    return divisions.unionByName(leaves).withColumn("seq", F.row_number().over(order)).drop("at")
