"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions alone.

A source's records, in a seeded order, form blocks of ``block_rows``. With target weight w (a share of all),
block j of a source may start no earlier than slot (j - 1) / w and is due by j / w. In each slot the released
block with the earliest deadline goes next, so that at any time each source is within one block of its share.

With whole-number weights of sum W the schedule repeats every W slots: one period is planned from the
weights alone, and a block's slot is its period's start plus a place in that plan. When a source has given
its last block, the rest share the slots by their own weights from there on (a new phase); there are as many
phases as sources. Nothing is dropped or repeated: every record gets one position. Only ids, sources and
hashes are shuffled, and a source is numbered in parts of ``part_rows``, so a source with a third of all
rows is spread like the others.

Weights may be given; else they are the source sizes to the power ``temperature``, made whole with sum
``resolution``.

Defined results: a null source is a source of its own; null ids and repeated rows get positions of their own;
ties in the seeded order go by id, then by scan order; a source whose weight is missing or 0 gets weight 1;
an empty table gives an empty result; ``mixed`` carries extra columns, whatever their names.
"""

from __future__ import annotations

import heapq
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import identified, staged

BLOCK_ROWS, PART_ROWS, RESOLUTION = 32, 2000, 1000


def whole_weights(shares: dict, resolution: int = RESOLUTION) -> dict:
    """Whole weights of at least 1 and sum ``resolution`` (more if there are more sources), by largest remainders."""
    resolution = max(resolution, 4 * len(shares))
    total = sum(shares.values()) or 1
    exact = {k: max(v, 0) / total * (resolution - len(shares)) for k, v in shares.items()}
    out = {k: 1 + int(x) for k, x in exact.items()}
    for k in sorted(exact, key=lambda k: (int(exact[k]) - exact[k], k))[: resolution - sum(out.values())]:
        out[k] += 1
    return out


def period(weights: list[int]) -> list[int]:
    """One period of the schedule: which source runs in each of sum(weights) slots."""
    total = sum(weights)
    waiting = [(0, k, 1) for k in range(len(weights))]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []  # deadline, source, block
    out = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-j * total // weights[k]), k, j))
        _, k, j = heapq.heappop(ready)
        out.append(k)
        if j < weights[k]:
            heapq.heappush(waiting, (j * total // weights[k], k, j + 1))
    return out


def plan(blocks: dict, weights: dict) -> list[dict]:
    """Phases: first slot, period, and for each source its first block in the phase and its slots in the period."""
    left = {k: n for k, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    out, at = [], 0
    while left:
        names = sorted(left)
        order = period([weights[k] for k in names])
        slots: dict = {k: [] for k in names}
        for s, k in enumerate(order):
            slots[names[k]].append(s)
        # the slot after each source's last block; the first to end ends the phase
        ends = {k: (left[k] - 1) // weights[k] * len(order) + slots[k][(left[k] - 1) % weights[k]] + 1 for k in names}
        length = min(ends.values())
        out.append({"start": at, "period": len(order), "length": length, "sources": {k: {"before": done[k], "slots": slots[k]} for k in names}})
        whole, part = divmod(length, len(order))
        for k in names:
            ran = whole * weights[k] + sum(s < part for s in slots[k])
            done[k] += ran
            left[k] -= ran
            if not left[k]:
                del left[k]
        at += length
    return out


def _numbered(own: DataFrame, sizes: DataFrame, part_rows: int) -> DataFrame:
    """``own`` (row, id, source, h) with ``idx``, the place in the source's seeded order from 0."""
    parts = own.join(F.broadcast(sizes.select("source", F.ceil(F.col("n") / part_rows).alias("parts"))), "source")
    dealt = parts.withColumn("part", F.pmod(F.col("h"), F.col("parts"))).drop("parts")
    counts = dealt.groupBy("source", "part").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("source", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    ranked = dealt.withColumn("rn", F.row_number().over(Window.partitionBy("source", "part").orderBy("h", "id", "row")))
    return ranked.join(offsets, ["source", "part"]).withColumn("idx", F.col("offset") + F.col("rn") - 1).drop("part", "rn", "offset")


def _inline(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A small table of planned values as a literal."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def positions(docs: DataFrame, weights: dict | None = None, block_rows: int = BLOCK_ROWS, part_rows: int = PART_ROWS, temperature: float = 0.5, resolution: int = RESOLUTION, seed: int = 20, id_col: str = "doc_id", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """row, id, source, weight, block (from 1), slot, phase, position (0, 1, ... over all records)."""
    spark = docs.sparkSession
    # a null source and a source so named must not meet: names get a mark in front
    name = F.when(F.col(source_col).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(source_col).cast("string")))
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    own = docs.select(row.alias("row"), F.col(id_col).alias("id"), name.alias("source"))
    own = staged(own.withColumn("h", F.xxhash64(F.lit(seed), "id", F.when(F.col("id").isNull(), F.col("row")))), "records")
    sizes = {r.source: r.n for r in own.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per source
    shares = {k: n**temperature for k, n in sizes.items()} if weights is None else {k: weights.get(None if k == "-" else k[1:], 0) for k in sizes}
    whole = whole_weights(shares, resolution)
    blocks = {k: -(-n // block_rows) for k, n in sizes.items()}
    phases = plan(blocks, whole)
    # rows of the plan: where a source's run in a phase begins, and the slots of its blocks in a period
    runs, placed = [], 0
    for p, phase in enumerate(phases):
        for k, s in phase["sources"].items():
            runs.append({"source": k, "phase": p, "before": s["before"], "start": phase["start"], "period": phase["period"], "slots": s["slots"], "weight": whole[k], "placed": placed})
        ended = [k for k, s in phase["sources"].items() if p + 1 == len(phases) or k not in phases[p + 1]["sources"]]
        placed += phase["length"] * block_rows - sum(blocks[k] * block_rows - sizes[k] for k in ended)
    next_run: dict = dict(blocks)
    for r in reversed(runs):  # blocks of a source up to its next phase
        r["until"], next_run[r["source"]] = next_run[r["source"]], r["before"]
    fields = "source string, phase int, before long, start long, period long, slots array<long>, weight long, placed long, until long"
    table = _inline(spark, runs, fields).filter(F.col("before") < F.col("until"))
    scheduled = table.select("source", "phase", "start", "placed", "weight", F.explode(F.sequence(F.col("before") + 1, F.col("until"))).alias("block"), "before", "period", "slots")
    nth = F.col("block") - F.col("before") - 1
    slot = F.col("start") + F.floor(nth / F.size("slots")) * F.col("period") + F.get("slots", (nth % F.size("slots")).cast("int"))
    scheduled = scheduled.select("source", "block", "phase", "weight", slot.cast("long").alias("slot"), (F.col("placed") + (slot - F.col("start")) * block_rows).cast("long").alias("first"))
    sized = _inline(spark, [{"source": k, "n": n} for k, n in sizes.items()], "source string, n long")
    numbered = _numbered(own, sized, part_rows).withColumn("block", F.floor(F.col("idx") / block_rows) + 1)
    placed_rows = numbered.join(scheduled, ["source", "block"])
    return placed_rows.select("row", "id", F.when(F.col("source") != "-", F.substring("source", 2, 1 << 30)).alias("source"), "weight", "block", "slot", "phase", (F.col("first") + F.col("idx") % block_rows).cast("long").alias("position"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` in mixed order: partitions follow each other by position, and so do the files written from them."""
    at, row = (f"{x}_{uuid.uuid4().hex}" for x in ("position", "row"))
    rows = identified(docs, options.get("id_col", "doc_id"), row)
    place = positions(rows, row_col=row, **options).select(F.col("row").alias(row), F.col("position").alias(at))
    placed = rows.join(staged(place, "positions"), row).select(*[F.col(f"`{c}`") for c in [*docs.columns, at]])
    return placed.repartitionByRange(at).sortWithinPartitions(at).drop(at)
