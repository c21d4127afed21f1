"""Ingestion state as pure transformations: triage, upserts, authority, tombstones, merges.

Each takes the present state and a batch as DataFrames and returns the next state or the plan of changes, so
the same code serves batch jobs (overwrite) and ``foreachBatch`` sinks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rank of each provenance; others rank 0.
SOURCE_RANKS = {"judilibre": 60, "opendata": 55, "jade": 50, "constit": 50, "cedh": 50, "cjue": 50, "cnda": 50, "cass": 30, "capp": 30}


def source_rank(source: Column, ranks: dict[str, int] | None = None) -> Column:
    out = F.lit(0)
    for name, rank in (SOURCE_RANKS if ranks is None else ranks).items():
        out = F.when(source == name, rank).otherwise(out)
    return out


def last_wins(batch: DataFrame, key: str, arrival: str) -> DataFrame:
    return batch.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(arrival)))).filter("_rn = 1").drop("_rn")


def triage(batch: DataFrame, state: DataFrame, key: str, checksum: str, has_vectors: str | None = None, force: bool = False) -> DataFrame:
    """Each batch row with its action: write, update, skip (same checksum), or write again for missing vectors."""
    known = state.select(F.col(key), F.col(checksum).alias("_old"), F.lit(True).alias("_known"), *([F.col(has_vectors).alias("_vec")] if has_vectors else []))
    same = F.col(checksum).eqNullSafe(F.col("_old"))
    lacking = ~F.coalesce(F.col("_vec"), F.lit(False)) if has_vectors else F.lit(False)
    action = F.when(F.col("_known").isNull(), "write").when(F.lit(force), "update").when(same & lacking, "embed").when(same, "skip").otherwise("update")
    return batch.join(known, key, "left").withColumn("action", action).drop("_old", "_known", "_vec")


def upsert(state: DataFrame, batch: DataFrame, key: str, checksum: str) -> DataFrame:
    """Next state with a status column: created, updated, skipped or kept."""
    s, b = state.alias("s"), batch.alias("b")
    joined = s.join(b, F.col(f"s.{key}") == F.col(f"b.{key}"), "full_outer")
    in_s, in_b = F.col(f"s.{key}").isNotNull(), F.col(f"b.{key}").isNotNull()
    changed = ~F.col(f"s.{checksum}").eqNullSafe(F.col(f"b.{checksum}"))
    status = F.when(~in_s, "created").when(~in_b, "kept").when(changed, "updated").otherwise("skipped")
    return joined.select(*[F.when(in_b, F.col(f"b.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in state.columns], status.alias("status"))


def authority(provenances: DataFrame, doc: str, rank: str, lang: str, pid: str) -> DataFrame:
    """Provenance that decides each document: highest rank, then French, then smallest id, withdrawn ones included."""
    order = Window.partitionBy(doc).orderBy(F.desc(rank), F.when(F.col(lang) == "fr", 0).otherwise(1), F.asc(pid))
    return provenances.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def reconcile(docs: DataFrame, deciding: DataFrame, doc: str, withdrawn: str) -> DataFrame:
    """Each document's action: delete (no provenance), blank (its authority is withdrawn) or live."""
    d = deciding.select(doc, F.col(withdrawn).alias("_gone"))
    return docs.join(d, doc, "left").withColumn("action", F.when(F.col("_gone").isNull(), "delete").when(F.col("_gone"), "blank").otherwise("live")).drop("_gone")


def replace_by_owner(state: DataFrame, batch: DataFrame, owner: str) -> DataFrame:
    """All rows of the batch's owners are replaced by the batch."""
    return state.join(batch.select(owner).distinct(), owner, "left_anti").unionByName(batch)


def changed_sets(old: DataFrame, new: DataFrame, owner: str, item: str) -> DataFrame:
    """Owners whose set of items differs: owner, n_added, n_removed."""
    o = old.groupBy(owner).agg(F.array_sort(F.collect_set(item)).alias("_o"))
    n = new.groupBy(owner).agg(F.array_sort(F.collect_set(item)).alias("_n"))
    none = F.array().cast(o.schema["_o"].dataType)
    j = o.join(n, owner, "full_outer").select(owner, F.coalesce("_o", none).alias("_o"), F.coalesce("_n", none).alias("_n"))
    return j.filter("_o <> _n").select(owner, F.size(F.array_except("_n", "_o")).cast("long").alias("n_added"), F.size(F.array_except("_o", "_n")).cast("long").alias("n_removed"))


def rebuild_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Plan of a full rebuild: key, action (insert, update, delete)."""
    j = old.select(key, F.col(value).alias("_o")).join(new.select(key, F.col(value).alias("_n")), key, "full_outer")
    action = F.when(F.col("_o").isNull(), "insert").when(F.col("_n").isNull(), "delete").when(~F.col("_o").eqNullSafe(F.col("_n")), "update")
    return j.withColumn("action", action).filter("action IS NOT NULL").select(key, "action")


def split_plan(provenances: DataFrame, doc: str, key: str) -> DataFrame:
    """How a merged document's provenances agree on a key: legit, ambiguous (keys missing) or false_merge."""
    g = provenances.groupBy(doc).agg(F.countDistinct(key).alias("n_keys"), F.count_if(F.col(key).isNull()).alias("n_null"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("plan", F.when((F.col("n_keys") > 1) & (F.col("n_null") == 0), "false_merge").when(F.col("n_null") > 0, "ambiguous").otherwise("legit"))
