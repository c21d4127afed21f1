"""Relational operators that SQL engines lack or spell at length. Declarative throughout: Catalyst picks joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.sources.shared import scratch


def distinct_on(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of each key by ``order``."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def top_per_group(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("rk", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rk") <= k)


def asof_join(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, values: list[str]) -> DataFrame:
    """Each left row with the latest right row of its key at or before its time.

    Both sides go through one window by key and time (last value seen so far), so no pair of rows is ever
    formed and a long history costs one sort.
    """
    shape = F.struct(*[F.col(v) for v in [right_at, *values]])
    events = right.select(F.col(key).alias("_k"), F.col(right_at).alias("_t"), F.lit(0).alias("_side"), shape.alias("_v"), F.lit(None).cast(left.select(F.struct("*").alias("s")).schema["s"].dataType).alias("_l"))
    probes = left.select(F.col(key).alias("_k"), F.col(left_at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(events.schema["_v"].dataType).alias("_v"), F.struct(*[F.col(c) for c in left.columns]).alias("_l"))
    seen = Window.partitionBy("_k").orderBy("_t", "_side", F.desc("_v")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = events.unionByName(probes).withColumn("_last", F.last("_v", ignorenulls=True).over(seen))
    return both.filter("_side = 1").select("_l.*", *[F.col(f"_last.{v}").alias(v if v not in left.columns else f"{v}_asof") for v in [right_at, *values]])


def valid_at(rows: DataFrame, start: str, end: str, at: Column, inclusive_end: bool) -> DataFrame:
    """Versions in force at a date; an open end is null."""
    last = F.col(end) >= at if inclusive_end else F.col(end) > at
    return rows.filter((F.col(start) <= at) & (F.col(end).isNull() | last))


def unique_match(pending: DataFrame, candidates: DataFrame, key: str, target: str) -> DataFrame:
    """Pending rows with the target of their key if exactly one candidate has it; otherwise null."""
    one = candidates.groupBy(key).agg(F.countDistinct(target).alias("_n"), F.min(target).alias(target)).filter("_n = 1").drop("_n")
    return pending.join(one, key, "left")


def token_subset(keys: DataFrame, names: DataFrame) -> DataFrame:
    """(key_id, name_id) where each of the key's tokens is a token of the name.

    keys: key_id, toks; names: name_id, toks (distinct tokens). A name that holds all of a key's tokens holds its rarest
    one, so keys meet the names of that token alone; frequent tokens are never joined.
    """
    held = names.select("name_id", F.col("toks").alias("has"), F.explode("toks").alias("tok"))
    df = held.groupBy("tok").agg(F.count(F.lit(1)).alias("n"))
    each = keys.select("key_id", "toks", F.explode("toks").alias("tok")).join(df, "tok", "left")
    rarest = each.groupBy("key_id").agg(F.first("toks").alias("toks"), F.min_by("tok", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "tok")).alias("tok"))
    return rarest.join(held, "tok").filter(F.size(F.array_except("toks", "has")) == 0).select("key_id", "name_id")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt to all cores where they come from fewer files, which may be one split; else as they are."""
    parts = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(parts) if 0 < len(rows.inputFiles()) < parts else rows


def co_citation(edges: DataFrame, doc: str, cited: str, anchors: DataFrame, least: int = 3, top: int = 8, sample: int = 500) -> DataFrame:
    """Articles cited together with each of ``anchors`` (anchor): n / (n + 20) * ln(N / df), the best ``top``.

    At most ``sample`` citing documents of an anchor count, those of the smallest ids.
    """
    pairs = edges.select(F.col(doc).alias("d"), F.col(cited).alias("a")).distinct()
    citing = top_per_group(pairs.join(anchors, F.col("a") == F.col("anchor")).select("anchor", "d"), ["anchor"], [F.asc("d")], sample).drop("rk")
    total = pairs.agg(F.countDistinct("d").alias("total"))
    near = pairs.join(citing, "d").filter("a <> anchor").groupBy("anchor", "a").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    df = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("df"))
    score = F.round(F.col("n") / (F.col("n") + 20) * F.log(F.col("total") / F.greatest("df", F.lit(1))), 9)
    scored = near.join(df, "a").join(F.broadcast(total)).select("anchor", "a", "n", "df", score.alias("score"))
    return top_per_group(scored, ["anchor"], [F.desc("score"), F.asc("a")], top).drop("rk")


def cross_source_groups(rows: DataFrame, key: str, doc: str, source: str) -> DataFrame:
    """Keys of several documents, each of a source of its own: key, n_docs, keeper."""
    g = rows.groupBy(key).agg(F.countDistinct(doc).alias("n_docs"), F.countDistinct(source).alias("n_sources"), F.countDistinct(F.struct(doc, source)).alias("n_pairs"), F.min(doc).alias("keeper"))
    return g.filter("n_docs > 1 AND n_sources = n_pairs").select(key, "n_docs", "keeper")


def rank_percentile(rows: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """Value at the rank (n - 1) * p rounded half to even, per group."""
    at = Window.partitionBy(*keys).orderBy(value)
    ordered = rows.select(*keys, value, (F.row_number().over(at) - 1).alias("_i"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_n"))
    return ordered.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == F.bround((F.col("_n") - 1) * F.lit(p)).cast("long"), F.col(value))).alias(f"p{round(p * 100)}") for p in shares])


def islands(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Overlapping spans merged into envelopes, with the number of spans in each."""
    before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    fresh = rows.withColumn("_new", F.when(F.col(start) < F.max(end).over(before), 0).otherwise(1))
    marked = fresh.withColumn("_island", F.sum("_new").over(Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n_spans")).drop("_island")


def version_ends(rows: DataFrame, keys: list[str], start: str) -> DataFrame:
    """Versions with the missing ends taken from the next start."""
    return rows.withColumn("valid_until", F.lead(start).over(Window.partitionBy(*keys).orderBy(start)))


def cascade(pending: DataFrame, candidates: DataFrame, rules: list[list[str]], target: str) -> DataFrame:
    """``pending`` with ``target`` and ``rule``: the first rule (a list of key columns) under which exactly one candidate matches."""
    out = pending
    for k, keys in enumerate(rules):
        one = candidates.groupBy(*keys).agg(F.countDistinct(target).alias("_n"), F.min(target).alias(f"_t{k}")).filter("_n = 1").drop("_n")
        out = out.join(one, keys, "left")
    found = [F.col(f"_t{k}") for k in range(len(rules))]
    rule = F.coalesce(*[F.when(c.isNotNull(), k + 1) for k, c in enumerate(found)])
    return out.select(*pending.columns, F.coalesce(*found).alias(target), rule.alias("rule"))


def existing_article(cited: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``cited`` (key, uid, num) with num_key as the catalogue (uid, num_key) has it: the number itself, its starred form, its only
    prefixed variant (numbers without a letter), or the only one with the same digits."""
    core = lambda c: F.regexp_extract(c, r"([0-9].*)$", 1)
    known = catalogue.select("uid", "num_key").distinct()
    exact = known.select("uid", F.col("num_key").alias("num"), F.col("num_key").alias("k1"))
    star = known.filter("num_key LIKE '*%'").groupBy("uid", F.expr("ltrim('*', num_key)").alias("num")).agg(F.min("num_key").alias("k2"))
    only = lambda rows, name: rows.groupBy("uid", "num").agg(F.count(F.lit(1)).alias("n"), F.min("num_key").alias(name)).filter("n = 1").drop("n")
    prefixed = only(known.filter(F.col("num_key").rlike(r"^[lrda][0-9].*-")).select("uid", F.expr("substring(num_key, 2)").alias("num"), "num_key"), "k3")
    digits = only(known.select("uid", core(F.col("num_key")).alias("num"), "num_key"), "k4").withColumnRenamed("num", "core")
    out = cited.join(exact, ["uid", "num"], "left").join(star, ["uid", "num"], "left").join(prefixed, ["uid", "num"], "left").withColumn("core", core(F.col("num"))).join(digits, ["uid", "core"], "left")
    return out.select(*cited.columns, F.coalesce("k1", "k2", "k3", "k4").alias("num_key"))


def resolve_entities(pending: DataFrame, register: DataFrame, party_key) -> DataFrame:
    """``pending`` (id, name, place) with uid and stage of the register's (uid, name, place) only entity that fits.

    Stages, each for what the ones before left open: the name; the name without legal form; that and the place; the
    last word of the name; that and the place; all words of the name among those of one entity.
    """
    shaped = lambda rows: rows.withColumn("firm", party_key(F.col("name"))).withColumn("last", F.element_at(F.split("firm", " "), -1))
    p, r = shaped(pending), shaped(register)
    done = cascade(p, r, [["name"], ["firm"], ["firm", "place"], ["last"], ["last", "place"]], "uid")
    left = done.filter("uid IS NULL")
    words = lambda rows, key: rows.select(F.col(key).alias(f"{'key' if key == 'id' else 'name'}_id"), F.filter(F.array_distinct(F.split("firm", " ")), lambda w: w != "").alias("toks"))
    fits = token_subset(words(left, "id"), words(r, "uid")).groupBy("key_id").agg(F.count(F.lit(1)).alias("n"), F.min("name_id").alias("sixth")).filter("n = 1")
    last = done.join(fits.select(F.col("key_id").alias("id"), "sixth"), "id", "left")
    return last.select("id", F.coalesce("uid", "sixth").alias("uid"), F.coalesce("rule", F.when(F.col("sixth").isNotNull(), 6)).alias("stage"))


def frequencies(grams: DataFrame, doc: str, gram: str, display: str) -> DataFrame:
    """gram, df (documents that hold it) and its most frequent display form (ties: the first in order). Counts are combined before the shuffle."""
    forms = grams.groupBy(gram, display).agg(F.count(F.lit(1)).alias("_n"))
    shown = forms.groupBy(gram).agg(F.min_by(display, F.struct((-F.col("_n")).alias("n"), F.col(display))).alias(display))
    return grams.groupBy(gram).agg(F.countDistinct(doc).alias("df")).join(shown, gram)


def numbered(rows: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """``rows`` with their place from 1 in a total order; nulls come last.

    Rows are ranged into partitions and numbered there; only one count for each partition is summed in order, so no
    task sees all rows. Ranges are drawn from a sample and may be joined by adaptive execution, so another evaluation may
    range the rows otherwise: they are ranged once and staged.
    """
    spark, path = rows.sparkSession, scratch(rows.sparkSession, "numbered")
    keys = [c for o in order for c in (o.isNull(), o)]
    ranged = rows.select("*", F.struct(*[c.alias(f"k{n}") for n, c in enumerate(keys)]).alias("_o")).repartitionByRange("_o").sortWithinPartitions("_o")
    # a monotonic id is the partition, then the row's place in it (33 bits)
    marked = ranged.drop("_o").withColumn("_id", F.monotonically_increasing_id())
    marked.write.parquet(path)
    part = spark.read.schema(marked.schema).parquet(path).withColumn("_p", F.shiftright("_id", 33))
    counts = part.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))  # a row for each partition
    inside = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return part.join(F.broadcast(before), "_p").select(*rows.columns, (F.col("_before") + inside).cast("long").alias(name))


def usage_bags(contexts: DataFrame, uid: str, context: str, text: str, share: float = 0.03, most: int = 24) -> DataFrame:
    """uid, bag: words and neighbouring words of the contexts in which something is cited, each as often as its weight.

    A gram counts in max(2, share of the contexts) contexts or more; its weight is 2 log2(contexts + 1), at most ``most``.
    """
    low = F.regexp_replace(F.lower(text), "[^a-zà-ÿ -]", " ")
    words = contexts.select(F.col(uid).alias("uid"), F.col(context).alias("c"), F.filter(F.split(low, r"\s+"), lambda w: w != "").alias("w"))
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.concat_ws("_", F.get("w", i), F.get("w", i + 1)))).otherwise(F.array().cast("array<string>"))
    grams = words.select("uid", "c", F.explode(F.array_distinct(F.concat(F.filter("w", lambda x: F.length(x) > 1), pairs))).alias("g"))
    held = grams.groupBy("uid", "g").agg(F.countDistinct("c").alias("df"))
    n = contexts.groupBy(F.col(uid).alias("uid")).agg(F.countDistinct(context).alias("n"))
    kept = held.join(n, "uid").filter(F.col("df") >= F.greatest(F.lit(2), F.ceil(F.col("n") * share)))
    weight = F.least(F.ceil(F.round(2 * F.log2(F.col("df") + 1), 9)), F.lit(most)).cast("int")
    repeated = F.transform(F.array_sort(F.collect_list(F.struct("g", weight.alias("tf")))), lambda x: F.array_join(F.array_repeat(x["g"], x["tf"]), " "))
    return kept.groupBy("uid").agg(F.array_join(repeated, " ").alias("bag"))


def entity_pages(rows: DataFrame, entity: str, date: str, role: str, court: str, counsel: str, top: int = 3) -> DataFrame:
    """One row for each entity: total, first and last day, counts by year and role, its most frequent courts and counsel.

    Counts are combined before the shuffle; what an entity gathers are its years, roles and ``top`` names.
    """

    def counted(column: Column, name: str, best: int | None) -> DataFrame:
        n = rows.filter(column.isNotNull()).groupBy(F.col(entity).alias("entity"), column.cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
        if best:
            n = top_per_group(n, ["entity"], [F.desc("n"), F.asc("value")], best)
            key = F.struct((-F.col("n")).alias("o"), "value", "n")
        else:
            key = F.struct(F.col("value").alias("o"), "value", "n")
        return n.groupBy("entity").agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: F.concat_ws(":", x["value"], x["n"].cast("string"))), ",").alias(name))

    out = rows.groupBy(F.col(entity).alias("entity")).agg(F.count(F.lit(1)).alias("total"), F.min(date).alias("first_day"), F.max(date).alias("last_day"))
    for column, name, best in ((F.year(date), "years", None), (F.col(role), "roles", None), (F.col(court), "courts", top), (F.col(counsel), "counsel", top)):
        out = out.join(counted(column, name, best), "entity", "left")
    return out
