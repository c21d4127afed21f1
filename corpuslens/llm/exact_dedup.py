"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest, one row per distinct text. A batch is reduced to one
row per digest before anything is shuffled by key, deduplicated against the index by a sort-merge
anti-join (the index side needs neither shuffle nor sort), and what is new is appended with the same
bucketing. Texts never move: only SHA-256 digests and ids do.

Defined results:
* null text counts as the empty text; texts are equal when identical after lower-casing A-Z only;
* of equal texts the row with the largest id stays; a null id is smaller than any other;
* of rows that repeat the same id and text, one stays (the last in scan order);
* an empty table gives an empty result; extra columns are carried by ``drop_exact_copies``, whatever their
  names;
* for an index that already holds a digest, rows of later batches with that digest are dropped, whatever their
  ids; ``group_size`` counts the batch's own rows;
* very long texts are digested like any others and never move.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.common import ascii_lower, identified, if_small, staged

#: A digest held by more than one row in HOT_SHARE is joined by broadcast; at most HOT_SHARE such digests can exist.
HOT_SHARE = 1000
#: Rows of a new index's first batch for each of its buckets, and the least number of buckets.
BUCKET_ROWS, LEAST_BUCKETS = 2_000_000, 16


class DigestIndex:
    """A bucketed table (digest, keep): the rows (id, row, batch) that represent each distinct text seen so far.

    The number of buckets is chosen with the first batch, unless given, and kept with the table.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None):
        self.spark, self.name, self.buckets = spark, name, buckets

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def frame(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def size_for(self, rows: int) -> None:
        """Settle the number of buckets, for a first batch of ``rows`` rows."""
        if self.exists():
            told = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.name}").filter("col_name = 'Num Buckets'").first()
            self.buckets = int(told.data_type)
        elif self.buckets is None:
            self.buckets = max(LEAST_BUCKETS, math.ceil(rows / BUCKET_ROWS))

    def append_new(self, batch: DataFrame) -> None:
        """Append the digests of ``batch`` (digest, keep; one row per digest) that the index doesn't hold."""
        if self.exists():
            known = self.frame().select("digest")
            batch = batch.hint("merge").join(known, "digest", "left_anti")
        (
            batch.select("digest", "keep")
            .repartition(self.buckets, "digest")
            .sortWithinPartitions("digest")
            .write.bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .mode("append")
            .saveAsTable(self.name)
        )


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(id, row, digest): ``row`` tells repeated rows apart."""
    folded = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return docs.select(
        F.col(id_col).alias("id"),
        (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"),
        F.sha2(folded, 256).alias("digest"),
    )


def dedup_rows(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2, row_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: id, row, digest, keep (id, row and batch of the one that stays), n (the batch's rows with the digest), kept.

    The batch goes in by ``rounds`` blocks of descending id, so that in each text's group the largest id
    comes first; a later block's digest that is known is dropped by the anti-join. Rows are numbered within their
    batch, so the batch's own mark is part of what the index keeps.
    """
    own = staged(digests(docs, id_col, text_col, row_col), "digests")
    batch = F.lit(uuid.uuid4().int >> 65)
    keyed = own.withColumn("keep", F.struct("id", "row", batch.alias("batch")))
    low, high, total = own.agg(F.min("id"), F.max("id"), F.count(F.lit(1))).first()
    edges = [low + (high - low) * k // rounds for k in range(rounds - 1, 0, -1)] if isinstance(low, int) else []
    index.size_for(total)
    above = None
    for edge in [*edges, None]:
        block = keyed if above is None else keyed.filter((F.col("id") < above) | F.col("id").isNull())
        block = block if edge is None else block.filter(F.col("id") >= edge)
        index.append_new(block.groupBy("digest").agg(F.max("keep").alias("keep")))
        above = edge
    sizes = own.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    known = staged(sizes.join(index.frame().hint("merge"), "digest"), "known")
    hot = known.filter(F.col("n") * HOT_SHARE > total)
    hot_rows = own.join(F.broadcast(hot), "digest")
    rest = own.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    rows = hot_rows.unionByName(rest.join(known.filter(F.col("n") * HOT_SHARE <= total), "digest"))
    return rows.withColumn("kept", (F.col("keep.batch") == batch) & (F.col("keep.row") == F.col("row")))


def _with_index(docs: DataFrame, index: DigestIndex | None, **options) -> DataFrame:
    """``dedup_rows`` with an index, or with one of its own that goes when the verdicts are staged."""
    if index is not None:
        return dedup_rows(docs, index, **options)
    index = DigestIndex(docs.sparkSession, f"digest_index_{uuid.uuid4().hex}")
    try:
        return dedup_rows(docs, index, **options)  # reads staged tables only
    finally:
        index.drop()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """Verdict on each row: id, row, keep_id, group_size, kept, digest."""
    rows = _with_index(docs, index, id_col=id_col, text_col=text_col)
    return rows.select("id", "row", F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"), "kept", "digest")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` drops."""
    mark = f"row_{uuid.uuid4().hex}"
    rows = identified(docs, id_col, mark)
    lost = _with_index(rows, index, id_col=id_col, text_col=text_col, row_col=mark).filter("NOT kept")
    return rows.join(if_small(staged(lost.select(F.col("row").alias(mark)), "lost")), mark, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
