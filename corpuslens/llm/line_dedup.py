"""Line deduplication with two Bloom filters.

One filter holds the hashes of lines seen once, the other of those seen twice. Each task sets the bits of its own
pair as batches come, ``bits`` / 4 bytes whatever it reads; pairs are merged segment by segment (twice = twice | twice' | once & once'), as a stream, so no task holds
more than its segments. Only lines that the merged twice-filter suspects leave their task, as SHA-256
digests already counted per task; their exact counts confirm them and choose first occurrences. A false
suspicion costs a few bytes, never a wrong result, so a filter too small for the data only shuffles more.

Confirmed lines go to the tasks by broadcast up to ``broadcast_lines`` of them, the most frequent first; the
rest, none of which can be frequent, reach their documents by a join.

Defined results:
* a text is split at line feeds; null or empty text is one empty line;
* a line's key is the line without leading and trailing U+0020 and U+0009-U+000D, A-Z lower-cased; keys
  shorter than ``min_chars`` code points never lose lines;
* mode "all": keys found in at least ``min_docs`` rows lose all their lines; mode "first": they keep the line
  of the smallest id (null smallest) and line number;
* each row counts as a document, so a repeated row counts again; rows that repeat the id of a kept line all
  keep it; a very long text is split whole, in the task that reads it; an empty table gives an empty result;
  extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import staged

BLANK = b" \t\n\x0b\x0c\r"
SEGMENT_BITS = 1 << 19
SEGMENT_BYTES = SEGMENT_BITS // 8
#: Entries that a task counts before it hands them on.
HOLD = 200_000


def line_keys(text: bytes) -> list[bytes]:
    return [line.strip(BLANK).lower() for line in text.split(b"\n")]


def long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars)


def bit_positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Two places for each hash."""
    low = hashes & np.uint64(bits - 1)
    high = (hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) & np.uint64(bits - 1)
    return np.stack([low, high], axis=1)


def _hashes(keys: list[bytes], min_chars: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys if long_enough(k, min_chars)), np.uint64)


def _pack(own: np.ndarray) -> bytes:
    """A segment: the places of its bits while that is shorter, else the bits."""
    places = np.flatnonzero(np.unpackbits(own, bitorder="little"))
    return places.astype("<u4").tobytes() if len(places) * 4 < SEGMENT_BYTES else own.tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    if len(raw) == SEGMENT_BYTES:
        return np.frombuffer(raw, np.uint8)
    bits = np.zeros(SEGMENT_BITS, bool)
    bits[np.frombuffer(raw, "<u4")] = True
    return np.packbits(bits, bitorder="little")


def twice_filter(texts: DataFrame, bits: int, min_chars: int) -> np.ndarray:
    """The merged twice-filter over all lines of ``texts`` (id, text): ``bits`` / 8 bytes whatever the input."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

        def put(table: np.ndarray, at: np.ndarray) -> None:
            np.bitwise_or.at(table, at.ravel() >> np.uint64(3), np.left_shift(1, (at.ravel() & np.uint64(7)).astype(np.uint8), dtype=np.uint8))

        for batch in batches:
            parts = [_hashes(line_keys(t or b""), min_chars) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            fresh, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_counts=True)
            put(twice, bit_positions(fresh[(n > 1) | suspected(once, fresh)], bits))
            put(once, bit_positions(fresh, bits))
        segments, ones, twos = [], [], []
        for s in range(bits // SEGMENT_BITS):
            own = slice(s * SEGMENT_BYTES, (s + 1) * SEGMENT_BYTES)
            if once[own].any():
                segments.append(s)
                ones.append(_pack(once[own]))
                twos.append(_pack(twice[own]))
        yield pa.RecordBatch.from_arrays([pa.array(segments, pa.int32()), pa.array(ones, pa.binary()), pa.array(twos, pa.binary())], ["segment", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for s, one, two in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one, two = _unpack(one), _unpack(two)
                if s in held:
                    o, t = held[s]
                    held[s] = o | one, t | two | (o & one)
                else:
                    held[s] = one, two
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([t.tobytes() for _, t in held.values()], pa.binary())], ["segment", "twice"])

    pairs = texts.mapInArrow(fill, "segment int, once binary, twice binary")
    merged = pairs.repartition("segment").mapInArrow(merge, "segment int, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in merged.toLocalIterator():  # fixed in total
        out[row.segment * SEGMENT_BYTES : (row.segment + 1) * SEGMENT_BYTES] = np.frombuffer(row.twice, np.uint8)
    return out


def suspected(filter_bytes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = bit_positions(hashes, len(filter_bytes) * 8)
    return ((filter_bytes[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def _suspects(texts: DataFrame, shared, min_chars: int, each: bool) -> DataFrame:
    """Suspected keys counted per task (digest, hash, docs, lines, first); with ``each``, one row for each id and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, np.uint8)
        held: dict[bytes, list] = {}

        def out() -> pa.RecordBatch:
            rows = list(held.values())
            cols = [[r[k] for r in rows] for k in range(5)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(list_, t) for list_, t in zip(cols, (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)] + [pa.array([r[5] for r in rows], kind)], ["digest", "hash", "docs", "lines", "line", "id"])

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                keys = line_keys(text or b"")
                numbered = [(n, k) for n, k in enumerate(keys) if long_enough(k, min_chars)]
                if not numbered:
                    continue
                hashes = np.fromiter((xxhash.xxh3_64_intdigest(k) for _, k in numbered), np.uint64)
                mine = set()
                for at in np.flatnonzero(suspected(table, hashes)).tolist():
                    n, key = numbered[at]
                    digest = hashlib.sha256(key).digest()
                    name = (digest, i) if each else digest
                    row = held.get(name)
                    if row is None:
                        held[name] = [digest, int(hashes[at].astype(np.int64)), 1, 1, n, i]
                    else:
                        row[2] += digest not in mine
                        row[3] += 1
                        if not each and (row[5] is not None and (i is None or i < row[5])):
                            row[4], row[5] = n, i
                    mine.add(digest)
            if len(held) > HOLD:
                yield out()
        if kind is not None:
            yield out()

    return texts.mapInArrow(run, f"digest binary, hash long, docs long, lines long, line long, id {texts.schema['id'].dataType.simpleString()}")


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, mode: str = "all", bits: int = 1 << 26, broadcast_lines: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_lines, n_dropped and kept_text of each row."""
    spark = docs.sparkSession
    context = spark.sparkContext
    texts = docs.selectExpr(f"`{id_col}` AS id", f"CAST(`{text_col}` AS string) AS text")
    shared = context.broadcast(twice_filter(texts, bits, min_chars).tobytes())
    counted = _suspects(texts, shared, min_chars, each=False).groupBy("digest", "hash")
    confirmed = counted.agg(F.sum("docs").alias("docs"), F.sum("lines").alias("lines"), F.min(F.struct("id", "line")).alias("first"))
    confirmed = staged(confirmed.filter((F.col("docs") >= min_docs) & (F.col("lines") > 1)).select("digest", "hash", "docs", F.col("first.id").alias("first_id"), F.col("first.line").alias("first_line")), "lines")
    order = [F.desc("docs"), F.asc("digest")]
    top = confirmed.orderBy(*order).limit(broadcast_lines).toArrow()
    hot = context.broadcast({(h, bytes(d)): (i, n) for d, h, i, n in zip(*(top.column(c).to_pylist() for c in ("digest", "hash", "first_id", "first_line")), strict=True)})
    rest = None
    if top.num_rows == broadcast_lines:
        last, digest = top.column("docs")[-1].as_py(), bytes(top.column("digest")[-1].as_py())
        rest = confirmed.filter((F.col("docs") < last) | ((F.col("docs") == last) & (F.col("digest") > F.lit(digest))))
    first_only = mode == "first"

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = hot.value
        known = np.array(sorted({h for h, _ in table}), np.int64)
        for batch in batches:
            total, dropped, texts_out = [], [], []
            own = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
            for i, text, more in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), own, strict=True):
                lines = (text or b"").split(b"\n")
                keys = [line.strip(BLANK).lower() for line in lines]
                local = {(x["hash"], bytes(x["digest"])): (x["first_id"], x["first_line"]) for x in more or ()}
                hashes = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64).astype(np.int64)
                at = np.searchsorted(known, hashes)
                hit = known[np.minimum(at, len(known) - 1)] == hashes if len(known) else np.zeros(len(keys), bool)
                lose = set()
                for n in range(len(keys)) if local else np.flatnonzero(hit).tolist():
                    if not long_enough(keys[n], min_chars):
                        continue
                    name = int(hashes[n]), hashlib.sha256(keys[n]).digest()
                    first = table.get(name) or local.get(name)
                    if first is not None and not (first_only and first == (i, n)):
                        lose.add(n)
                total.append(len(lines))
                dropped.append(len(lose))
                texts_out.append(b"\n".join([x for n, x in enumerate(lines) if n not in lose]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts_out, pa.binary()).cast(pa.string())], ["id", "n_lines", "n_dropped", "kept_text"])

    if rest is not None:
        pairs = _suspects(texts, shared, min_chars, each=True).select("id", "digest")
        found = pairs.join(rest, "digest").groupBy("id").agg(F.collect_set(F.struct("hash", "digest", "first_id", "first_line")).alias("more"))
        texts = texts.join(found.withColumnRenamed("id", "own"), F.col("id").eqNullSafe(F.col("own")), "left").select("id", "text", "more")
    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(drop, f"id {kind}, n_lines long, n_dropped long, kept_text string")
