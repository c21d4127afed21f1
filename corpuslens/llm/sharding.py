"""Global shuffle into equal shards by a two-pass external shuffle.

Pass one scatters records by a seeded hash of their id into buckets of ``bucket_bytes``; pass two shuffles each
bucket (Fisher-Yates, seeded) and writes it. Laid end to end, the shuffled buckets are one random permutation of
all records; cutting it into ``shards`` equal runs gives shards whose row counts differ by one at most
(law ``rows``). A bucket's place comes from a running sum of the buckets' row counts, a table of its own that is
joined bucket by bucket, so no global sort takes place and the driver holds no list of buckets. The JVM sorts a
partition by bucket (and spills where it must); a Python worker holds one bucket at a time and sends it on in
slices of ``SLICE_ROWS`` rows.

Defined results:
* a record's size is its text's UTF-8 bytes plus 16; null text has 0 bytes;
* a record's place follows from ids, texts, their number and the seed alone; rows of equal id and text are
  numbered, so they too are spread over the buckets, and each gets its own slot;
* a very long text makes its bucket larger by itself, nothing is cut;
* an empty table gives no rows; extra columns are written along, whatever their names.
"""

from __future__ import annotations

import math
import random
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.llm.common import distinct_ids, staged

RECORD_OVERHEAD = 16
#: Buckets that share a partition, on average; buckets whose counts are summed in one task; rows of a slice.
BUCKETS_PER_PARTITION, SUMMED, SLICE_ROWS = 4, 4096, 256
#: Parts in which rows of equal id and text are numbered.
REPEAT_PARTS = 256


def _names(taken: list[str], *wanted: str) -> list[str]:
    """The wanted column names, made longer where the table has them already."""
    low = {x.lower() for x in taken}
    return [w if w not in low else next(f"{w}_{k}" for k in range(1, 10_000) if f"{w}_{k}" not in low) for w in wanted]


def bucket_places(dealt: DataFrame, bucket: str) -> DataFrame:
    """bucket, first (records in the buckets before it), staged. Counts are summed in two steps, so no task sees all."""
    counts = staged(dealt.groupBy(bucket).agg(F.count(F.lit(1)).alias("c")).withColumn("span", F.floor(F.col(bucket) / SUMMED)), "bucket-counts")
    before = lambda w: F.coalesce(F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row for each SUMMED buckets
    spans = counts.groupBy("span").agg(F.sum("c").alias("c")).select("span", before(Window.orderBy("span")).alias("base"))
    inside = counts.select(bucket, "span", before(Window.partitionBy("span").orderBy(bucket)).alias("inside"))
    return inside.join(spans, "span").select(bucket, (F.col("base") + F.col("inside")).alias("first"))


def repeat_numbers(docs: DataFrame, id_col: str, text_col: str, tie: str) -> DataFrame:
    """``docs``, staged, with ``tie``: 0, 1, ... among the rows of equal id and text. No task sees a whole group."""
    row = f"row_{uuid.uuid4().hex}"
    rows = staged(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    own = rows.select(row, F.xxhash64(F.col(f"`{id_col}`"), F.isnull(f"`{id_col}`"), F.sha2(F.col(f"`{text_col}`").cast("string"), 256)).alias("same"), F.pmod(F.xxhash64(row), F.lit(REPEAT_PARTS)).alias("part"))
    counts = own.groupBy("same", "part").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("same").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("same", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    ranked = own.withColumn("rn", F.row_number().over(Window.partitionBy("same", "part").orderBy(row)) - 1)
    numbered = ranked.join(offsets, ["same", "part"]).select(row, (F.col("offset") + F.col("rn")).alias(tie))
    return rows.join(staged(numbered, "repeats"), row).drop(row)


def shard_records(docs: DataFrame, out: str, shards: int = 40, seed: int = 20, bucket_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` as ``shards`` folders of Parquet in shuffled order and return them as read back.

    Adds ``shard``, ``slot`` (0, 1, ... in a shard; files hold their rows by slot) and ``size``; where the
    table has columns so named, the new ones carry a number. ``bucket_bytes`` must fit in a worker's memory about
    four times; on larger clusters raise it, so that buckets stay few.
    """
    shard, slot, size, bucket, key, tie, first = _names(docs.columns, "shard", "slot", "size", "bucket", "key", "tie", "first")
    alone = distinct_ids(docs, id_col)
    rows = docs.withColumn(tie, F.lit(0).cast("long")) if alone else repeat_numbers(docs, id_col, text_col, tie)
    sized = rows.withColumn(size, F.coalesce(F.octet_length(F.col(f"`{text_col}`").cast("string")), F.lit(0)).cast("long") + RECORD_OVERHEAD)
    weight, total = sized.agg(F.sum(size), F.count(F.lit(1))).first()
    n = max(shards, math.ceil((weight or 0) / bucket_bytes))
    parts = max(1, math.ceil(n / BUCKETS_PER_PARTITION))
    dealt = sized.withColumn(key, F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), *([] if alone else [F.crc32(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary"))]), tie)).withColumn(bucket, F.pmod(F.col(key), F.lit(n)).cast("int"))
    places = bucket_places(dealt.select(bucket), bucket).withColumnRenamed("first", first)
    starts = [s * total // shards for s in range(shards + 1)]
    schema = T.StructType([f for f in dealt.schema if f.name not in (bucket, key, tie)] + [T.StructField(shard, T.IntegerType()), T.StructField(slot, T.LongType())])

    def permuted(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The records of one bucket, which come in a fixed order, shuffled and placed."""
        table = pa.Table.from_batches(batches)
        number, at = table.column(bucket)[0].as_py(), table.column(first)[0].as_py()
        order = list(range(table.num_rows))
        random.Random(seed * 1_000_003 + number).shuffle(order)  # Fisher-Yates
        table = table.drop_columns([bucket, key, tie, first])
        s = 0
        for lo in range(0, len(order), SLICE_ROWS):
            some = order[lo : lo + SLICE_ROWS]
            in_shard, in_slot = [], []
            for g in range(at + lo, at + lo + len(some)):
                while g >= starts[s + 1]:
                    s += 1
                in_shard.append(s)
                in_slot.append(g - starts[s])
            cols = table.take(pa.array(some, pa.int64())).append_column(shard, pa.array(in_shard, pa.int32())).append_column(slot, pa.array(in_slot, pa.int64()))
            yield from cols.combine_chunks().to_batches()

    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            numbers = batch.column(batch.schema.get_field_index(bucket)).to_numpy()
            edges = [0, *(numbers[1:] != numbers[:-1]).nonzero()[0] + 1, len(numbers)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if held and held[0].column(batch.schema.get_field_index(bucket))[0].as_py() != numbers[a]:
                    yield from permuted(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from permuted(held)
        pa.default_memory_pool().release_unused()

    # a stated number of partitions, which adaptive execution doesn't join; both sides are dealt alike
    together = dealt.repartition(parts, bucket).join(places.repartition(parts, bucket).hint("shuffle_hash"), bucket)
    ordered = together.select(*[f"`{c}`" for c in dealt.columns], first).sortWithinPartitions(bucket, key, f"`{id_col}`", tie)
    shuffled = ordered.mapInArrow(permute, schema).sortWithinPartitions(shard, slot)
    shuffled.write.partitionBy(shard).parquet(out)
    return docs.sparkSession.read.schema(schema).parquet(out)
