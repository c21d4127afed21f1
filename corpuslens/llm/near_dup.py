"""N-gram Jaccard join with Bayesian candidate pruning.

A document is the set of its five-word shingles (64-bit hashes); documents with the same set form a class, and
classes are joined where their sets' Jaccard similarity is 0.8 or more.

1. Buckets. A class's MinHash values make ``BANDS`` band keys; classes that share a key are candidates. Keys
   held by one class are dropped by a count before anything is grouped.
2. Pruning. In a bucket MinHash values (one byte each travels) are compared in steps of ``STEP``. After each
   step a pair goes on only if, by the posterior of its similarity given the matches so far, the probability
   of reaching the threshold is at least ``TOLERANCE``. What is left links the classes of a bucket as a
   forest, so a bucket of m classes sends on fewer than m links.
3. Clusters. Connected components of those links.
4. Verification. Within a cluster all pairs are compared: sizes first, then the posterior, then the exact
   similarity of the sets. A task sends on each class's number of links and a forest of them, never pairs.

A bucket or cluster above ``BLOCK`` classes is cut into blocks, and each pair of blocks is a task of its own,
so no task holds a large group, nothing is capped, and every pair of the group still meets in one task.

Defined results: words are runs without U+0020 and U+0009-U+000D, compared exactly; a text of one to four
words is one shingle; texts without words (null, empty, blank) have no links and are classes of their own
rows; a repeated row counts as a further copy; ids must be whole numbers, and a null id never represents a
class that has another id; an empty table gives an empty result; extra columns are carried by
``keep_representatives``, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import discard, identified, if_small, staged

N, THRESHOLD = 5, 0.8
#: MinHash values; band keys, each of ROWS values chosen at random among them. With f of the values equal, a pair
#: shares no key with probability (1 - f**6)**64; over f's spread at similarity 0.8 that is about 5e-6.
VALUES, BANDS, ROWS = 128, 64, 6
STEP, TOLERANCE = 16, 1e-7
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
HUBS = 1000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the text's five-word windows."""
    words = (text or b"").split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < N:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=N)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    total = h[: len(h) - N + 1] * _ODD[0]
    for k in range(1, N):
        total += h[k : len(h) - N + 1 + k] * _ODD[k]
    return np.unique(_mix(total))


_RANDOM = np.random.RandomState(20)
_FACTORS = _RANDOM.randint(0, 1 << 31, VALUES).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_TERMS = _RANDOM.randint(0, 1 << 31, VALUES).astype(np.uint32)
_CHOICE = np.stack([_RANDOM.permutation(VALUES)[:ROWS] for _ in range(BANDS)])
_WEIGHTS = _mix(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def minhash(own: np.ndarray) -> np.ndarray:
    """VALUES MinHash values of a set: linear permutations of 32 bits of the mixed hashes."""
    out = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    low = own.astype(np.uint32)
    for at in range(0, len(low), 512):
        rows = np.multiply.outer(low[at : at + 512], _FACTORS)
        rows += _TERMS
        np.minimum(out, rows.min(axis=0), out=out)
    return out


def signature(values: np.ndarray) -> bytes:
    """One byte of each value."""
    return (values * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8).tobytes()


def band_keys(values: np.ndarray) -> list[int]:
    sums = (values[_CHOICE].astype(np.uint64) * _WEIGHTS).sum(axis=1, dtype=np.uint64)
    return _mix(sums + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64).tolist()


@lru_cache
def least_matches(threshold: float = THRESHOLD) -> tuple[int, ...]:
    """After each step, the least number of matching bytes at which a pair goes on.

    The prior of the similarity s is uniform; a byte matches with probability s + (1 - s) / 256. The posterior
    probability of s >= threshold is summed over a grid.
    """
    grid = (np.arange(2000) + 0.5) / 2000
    match = grid + (1 - grid) / 256
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        least = n
        for m in range(n + 1):
            like = m * np.log(match) + (n - m) * np.log1p(-match)
            like = np.exp(like - like.max())
            if like[grid >= threshold].sum() / like.sum() >= TOLERANCE:
                least = m
                break
        out.append(least)
    return tuple(out)


def likely_pairs(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of two signature tables that sizes and posterior leave; i < j if the tables are the same."""
    xs, ys = [], []
    for lo in range(0, len(a), 64):
        fits = np.minimum(sizes_a[lo : lo + 64, None], sizes_b[None, :]) >= THRESHOLD * np.maximum(sizes_a[lo : lo + 64, None], sizes_b[None, :]) - 1e-9
        x, y = np.nonzero(fits)
        x += lo
        if same:
            x, y = x[x < y], y[x < y]
        seen = np.zeros(len(x), np.int32)
        for step, least in enumerate(least_matches()):
            at = slice(step * STEP, (step + 1) * STEP)
            seen = seen + (a[x, at] == b[y, at]).sum(axis=1, dtype=np.int32)
            go = seen >= least
            x, y, seen = x[go], y[go], seen[go]
        xs.append(x)
        ys.append(y)
    return (np.concatenate(xs), np.concatenate(ys)) if xs else (np.zeros(0, int), np.zeros(0, int))


def _forest(n: int, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """(node, root) for each node of a component but its root."""
    top = list(range(n))

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        i, j = root(i), root(j)
        if i != j:
            top[max(i, j)] = min(i, j)
    return [(i, root(i)) for i in range(n) if root(i) != i]


def _similar(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact similarity at or above the threshold for the pairs (x, y) of rows of ``sets``.

    Shingles get numbers; those of a single set can't be shared. Each row's shared ones mark a table once, and
    all its partners' are then summed at once.
    """
    if not len(x):
        return np.zeros(0, bool)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    _, number, count = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    keep = count[number] > 1
    number, owner = number[keep], owner[keep]
    starts = np.searchsorted(owner, np.arange(len(sets) + 1))
    marks = np.zeros(len(count), bool)
    shared = np.zeros(len(x), np.int64)
    order = np.argsort(x, kind="stable")
    edges = np.flatnonzero(np.diff(x[order], prepend=-1, append=-2))
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        at = order[lo:hi]
        i, js = x[at[0]], y[at]
        mine = number[starts[i] : starts[i + 1]]
        marks[mine] = True
        lengths = starts[js + 1] - starts[js]
        picks = np.repeat(starts[js] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        sums = np.concatenate([[0], np.cumsum(marks[number[picks]])])
        ends = np.cumsum(lengths)
        shared[at] = sums[ends] - sums[ends - lengths]
        marks[mine] = False
    return shared >= THRESHOLD * (sizes[x] + sizes[y] - shared) - 1e-9


def _sketches(texts: DataFrame) -> DataFrame:
    """row, id, size, print (digest of the shingle set), sig and band keys of each row; null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, prints, sigs, keys = [], [], [], []
            for text in batch.column(2).cast(pa.binary()):
                own = shingles(text.as_py())
                size.append(len(own))
                values = minhash(own)
                prints.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                sigs.append(signature(values) if len(own) else None)
                keys.append(band_keys(values) if len(own) else None)
            cols = [pa.array(size, pa.int64()), pa.array(prints, pa.binary()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["row", "id", "size", "print", "sig", "keys"])

    return texts.mapInArrow(run, "row long, id long, size long, print binary, sig binary, keys array<long>")


def _paired(rows: DataFrame, group: str, members: str, blocks: F.Column) -> DataFrame:
    """Deal the rows of a group to its tasks: one for each pair of its blocks (task's lower and higher block: lo, hi)."""
    cut = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64(members), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    return cut.withColumn("other", other).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("other", "blocks")


def _tables(table: pa.Table) -> tuple[np.ndarray, bool]:
    """Order of a task's rows (lower block first), and whether both blocks are the same."""
    return np.argsort(table.column("block").to_numpy(), kind="stable"), table.column("lo")[0].as_py() == table.column("hi")[0].as_py()


def _likely(sig: np.ndarray, sizes: np.ndarray, block: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    if same:
        return likely_pairs(sig, sig, sizes, sizes, True)
    cut = int(np.searchsorted(block, block[-1]))
    x, y = likely_pairs(sig[:cut], sig[cut:], sizes[:cut], sizes[cut:], False)
    return x, y + cut


def _prune(table: pa.Table) -> pa.Table:
    """Forest of a bucket's likely pairs."""
    order, same = _tables(table)
    if len(order) < 2 or not same and table.column("block")[int(order[0])] == table.column("block")[int(order[-1])]:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    reps, block = table.column("rep").to_numpy()[order], table.column("block").to_numpy()[order]
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, VALUES)[order]
    x, y = _likely(sig, table.column("size").to_numpy()[order], block, same)
    links = _forest(len(reps), x, y)
    return pa.table({"a": pa.array([int(reps[i]) for i, _ in links], pa.int64()), "b": pa.array([int(reps[r]) for _, r in links], pa.int64())})


def _verify(table: pa.Table) -> pa.Table:
    """Links of a cluster's classes in a task: rep, links (copies counted), root (its place in the forest)."""
    order, same = _tables(table)
    empty = pa.table({"rep": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
    if len(order) < 2 or not same and table.column("block")[int(order[0])] == table.column("block")[int(order[-1])]:
        return empty
    reps, block = table.column("rep").to_numpy()[order], table.column("block").to_numpy()[order]
    copies = table.column("copies").to_numpy()[order]
    raw = table.column("own").to_pylist()
    sets = [np.frombuffer(raw[i], np.uint64) for i in order.tolist()]
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, VALUES)[order]
    x, y = _likely(sig, np.array([len(s) for s in sets]), block, same)
    ok = _similar(sets, x, y)
    x, y = x[ok], y[ok]
    links = np.zeros(len(reps), np.int64)
    np.add.at(links, x, copies[y])
    np.add.at(links, y, copies[x])
    root = list(range(len(reps)))
    for i, r in _forest(len(reps), x, y):
        root[i] = r
    got = np.flatnonzero(links)
    return pa.table({"rep": reps[got], "links": links[got], "root": reps[np.array(root, int)[got]] if len(got) else pa.array([], pa.int64())}).cast(empty.schema)


def _spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt by keys to a stated number of partitions: few bytes may be much work, so adaptive execution isn't to join them."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component of ``links`` (a, b), for nodes that have a link.

    Alternating large-star and small-star rounds; each is staged. Nodes' least neighbours are pre-aggregated; those of
    hubs (over a thousandth of all edge ends, so at most HUBS of them) reach the hub's edges by broadcast, so no
    task gathers a hub's edges.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = staged(edges, "edges")
    spark = links.sparkSession
    state = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = state(edges)
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        hub = F.col("n") * HUBS > 2 * before[0]
        hubs = staged(least.filter(hub).select("a", "m"), "hubs")
        up, columns = both.filter("b > a"), [F.col("b").alias("a"), F.col("m").alias("b")]
        at_hubs = up.join(F.broadcast(hubs), "a").select(*columns)
        elsewhere = up.join(F.broadcast(hubs.select("a")), "a", "left_anti").join(least.filter(~hub), "a").select(*columns)
        large = at_hubs.unionByName(elsewhere).filter("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(down, "a")
        small = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b"))).distinct()
        older, edges = edges, staged(small, "edges")
        discard(spark, older)
        discard(spark, hubs)
        now = state(edges)
        if now == before:
            roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        before = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, row_col: str | None = None) -> DataFrame:
    """row, id, class_id (least id of its component of links), rep_id (least id with its shingle set), n_links."""
    if row_col is None:
        row_col = f"row_{uuid.uuid4().hex}"
        docs = identified(docs.select(id_col, text_col), id_col, row_col)
    texts = docs.select(F.col(row_col).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketches = staged(_sketches(texts), "sketches")
    rows = sketches.select("row", "id", "print")
    # a class is named by its least (id, row); null ids come last
    named = F.struct(F.coalesce("id", F.lit((1 << 63) - 1)).alias("k"), F.col("row").alias("r"))
    classes = staged(rows.filter("print IS NOT NULL").groupBy("print").agg(F.min(named).alias("m"), F.count(F.lit(1)).alias("copies")).select("print", F.col("m.r").alias("rep"), F.col("m.k").alias("rep_key"), "copies"), "reps")
    banded = sketches.select(F.col("row").alias("rep"), "size", "sig", "keys").join(classes.select("rep"), "rep", "left_semi")

    keyed = banded.select("rep", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    bucketed = keyed.join(shared, "key").join(banded.select("rep", "size", "sig"), "rep")
    dealt = _paired(bucketed, "key", "rep", F.ceil(F.col("n") / block))
    likely = _spread(dealt, "key", "lo", "hi").groupBy("key", "lo", "hi").applyInArrow(_prune, "a long, b long")
    clusters = staged(components(likely), "clusters")

    # each cluster's sets, made again from the texts of its classes
    weights = clusters.join(banded.select(F.col("rep").alias("node"), "size", "sig"), "node")
    weights = weights.join(classes.select(F.col("rep").alias("node"), "copies"), "node")
    total = clusters.join(banded.select(F.col("rep").alias("node"), "size"), "node").groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("shingles"))
    weights = staged(weights.join(total, "root"), "members")
    wanted = if_small(weights.select(F.col("node").alias("rep")))
    sets = weights.withColumnRenamed("node", "rep").join(texts.select(F.col("row").alias("rep"), "text").join(wanted, "rep", "left_semi"), "rep")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array([shingles(t.as_py()).tobytes() for t in batch.column(batch.num_columns - 1).cast(pa.binary())], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], own], [*batch.schema.names[:-1], "own"])

    filled = sets.select("root", "rep", "copies", "sig", "members", "shingles", "text").mapInArrow(fill, "root long, rep long, copies long, sig binary, members long, shingles long, own binary")
    blocks = F.greatest(F.ceil(F.col("members") / block), F.ceil(F.col("shingles") / BLOCK_SHINGLES))
    tasks = _paired(filled, "root", "rep", F.least(blocks, F.col("members"))).drop("members", "shingles")
    verified = staged(_spread(tasks, "root", "lo", "hi").groupBy("root", "lo", "hi").applyInArrow(_verify, "rep long, links long, root long"), "links")

    links = verified.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(verified.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    known = classes.join(links, "rep", "left").join(joined, "rep", "left")
    known = known.withColumn("root", F.coalesce("root", "rep"))
    least = known.groupBy("root").agg(F.min("rep_key").alias("class_key"))
    known = staged(known.join(least, "root").select("print", "rep", "rep_key", "class_key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies", "root"), "known")

    # copies of one text may be a third of all rows: such classes, few by their size, are broadcast
    count = rows.count()
    hot = known.filter(F.col("copies") * 1000 > count)
    columns = ["row", "id", "class_key", "rep_key", "n_links", "rep", "root"]
    mine = rows.join(F.broadcast(hot), "print").select(*columns)
    rest = rows.join(F.broadcast(hot.select("print")), "print", "left_anti").join(known.filter(F.col("copies") * 1000 <= count), "print", "left")
    every = mine.unionByName(rest.select(*columns))
    none = (1 << 63) - 1
    value = lambda c: F.when(F.col(c).isNull(), F.col("id")).when(F.col(c) != none, F.col(c))
    return every.select("row", "id", value("class_key").alias("class_id"), value("rep_key").alias("rep_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("rep", "row").alias("rep_row"), F.coalesce("root", "row").alias("root"))


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of linked rows: that of the least id (then the first in scan order)."""
    mark = f"row_{uuid.uuid4().hex}"
    rows = identified(docs, id_col, mark)
    found = staged(near_duplicates(rows, id_col, text_col, row_col=mark), "near")
    order = F.struct(F.coalesce("id", F.lit((1 << 63) - 1)).alias("k"), F.col("row").alias("r"))
    kept = found.groupBy("root").agg(F.min(order).alias("m"))
    lost = staged(found.select("row").join(kept.select(F.col("m.r").alias("row")), "row", "left_anti").withColumnRenamed("row", mark), "lost")
    discard(docs.sparkSession, found)
    return rows.join(if_small(lost), mark, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
