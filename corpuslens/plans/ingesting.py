"""Ingestion, state, entities, hubs, text dataflow and batch forms of stream windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuslens.functions import text as X
from corpuslens.operators import chunking, ingest, texts
from corpuslens.operators import relational as R
from corpuslens.plans.registry import n_rows, query



def _sum(o):
    return F.md5(F.concat("o_orderstatus", F.col("o_orderkey").cast("string")))


_OLD = "SELECT o_orderkey AS uid, md5(o_orderstatus || o_orderkey) AS checksum, o_totalprice > 100000 AS vec FROM orders WHERE o_orderstatus <> 'P'"
_NEW = "SELECT o_orderkey AS uid, CASE WHEN o_orderpriority = '1-URGENT' THEN md5('x' || o_orderkey) ELSE md5(o_orderstatus || o_orderkey) END AS checksum FROM orders WHERE o_orderpriority <> '5-LOW'"


def _state(t):
    return t.orders.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("uid"), _sum(t).alias("checksum"), (F.col("o_totalprice") > 100_000).alias("vec"))


def _batch(t):
    other = F.md5(F.concat(F.lit("x"), F.col("o_orderkey").cast("string")))
    return t.orders.filter("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("uid"), F.when(F.col("o_orderpriority") == "1-URGENT", other).otherwise(_sum(t)).alias("checksum"))


@query("l1_triage", f"SELECT b.uid, CASE WHEN s.uid IS NULL THEN 'write' WHEN s.checksum = b.checksum AND NOT s.vec THEN 'embed' WHEN s.checksum = b.checksum THEN 'skip' ELSE 'update' END AS action FROM ({_NEW}) b LEFT JOIN ({_OLD}) s USING (uid)")
def _(t):
    return ingest.triage(_batch(t), _state(t), "uid", "checksum", "vec").select("uid", "action")


@query("b1_upsert_status", f"SELECT coalesce(s.uid, b.uid) AS uid, coalesce(b.checksum, s.checksum) AS checksum, CASE WHEN s.uid IS NULL THEN 'created' WHEN b.uid IS NULL THEN 'kept' WHEN s.checksum IS DISTINCT FROM b.checksum THEN 'updated' ELSE 'skipped' END AS status FROM ({_OLD}) s FULL JOIN ({_NEW}) b ON s.uid = b.uid")
def _(t):
    return ingest.upsert(_state(t).drop("vec"), _batch(t), "uid", "checksum")


_PROV = "SELECT doc_id AS pid, md5(text) AS doc, lang, (doc_id % 4) * 10 AS rank, doc_id % 6 = 0 AS gone FROM documents"
_AUTH = f"SELECT * FROM ({_PROV}) QUALIFY row_number() OVER (PARTITION BY doc ORDER BY rank DESC, CASE lang WHEN 'fr' THEN 0 ELSE 1 END, pid) = 1"


def _provenances(t):
    return t.documents.select(F.col("doc_id").alias("pid"), F.md5("text").alias("doc"), "lang", ((F.col("doc_id") % 4) * 10).alias("rank"), (F.col("doc_id") % 6 == 0).alias("gone"))


@query("b2_authority", f"SELECT doc, pid FROM ({_AUTH})")
def _(t):
    return ingest.authority(_provenances(t), "doc", "rank", "lang", "pid").select("doc", "pid")


@query("b3_clash_report", "SELECT p_name, p_brand, count(*) AS holders, min(p_partkey) AS first_key FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return t.part.groupBy("p_name", "p_brand").agg(n_rows().alias("holders"), F.min("p_partkey").alias("first_key")).filter("holders > 1")


@query("b4_replace_by_owner", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_orderkey, 1, 0.0 FROM orders WHERE o_orderstatus = 'P'")
def _(t):
    batch = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(0.0).alias("l_quantity"))
    return ingest.replace_by_owner(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), batch, "l_orderkey")


@query("b5_changed_edge_sets", "WITH o AS (SELECT l_orderkey AS k, list_sort(list_distinct(list(l_partkey))) AS s FROM lineitem GROUP BY 1), n AS (SELECT l_orderkey AS k, list_sort(list_distinct(list(CASE WHEN l_linenumber = 3 THEN l_partkey + 1 ELSE l_partkey END))) AS s FROM lineitem GROUP BY 1) SELECT k, len(list_filter(n.s, lambda x: NOT list_contains(o.s, x))) AS n_added, len(list_filter(o.s, lambda x: NOT list_contains(n.s, x))) AS n_removed FROM o JOIN n USING (k) WHERE o.s <> n.s")
def _(t):
    old = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("v"))
    new = t.lineitem.select(F.col("l_orderkey").alias("k"), F.when(F.col("l_linenumber") == 3, F.col("l_partkey") + 1).otherwise(F.col("l_partkey")).alias("v"))
    return ingest.changed_sets(old, new, "k", "v")


@query("b6_dimension_upsert", "SELECT coalesce(n.n_name, 'nation ' || k.k) AS label, k.k FROM (SELECT DISTINCT c_nationkey AS k FROM customer UNION SELECT 99) k LEFT JOIN nation n ON n.n_nationkey = k.k")
def _(t):
    keys = t.customer.select(F.col("c_nationkey").alias("k")).union(t.spark.range(99, 100).select(F.col("id").cast("int"))).distinct()
    return keys.join(F.broadcast(t.nation), F.col("k") == F.col("n_nationkey"), "left").select(F.coalesce("n_name", F.concat(F.lit("nation "), F.col("k").cast("string"))).alias("label"), "k")


@query("b8_denormalised_chunks", "SELECT d.doc_id, i AS chunk, CASE WHEN i = 0 THEN left(d.text, 20) END AS title, d.lang, l.quality FROM documents d LEFT JOIN labels l USING (doc_id), generate_series(0, d.n_chars // 1000) g(i) WHERE i * 1000 < d.n_chars")
def _(t):
    c = t.documents.select("doc_id", "text", "lang", "n_chars", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n_chars") / 1000))).alias("chunk")).filter("chunk * 1000 < n_chars")
    return c.join(t.labels.select("doc_id", "quality"), "doc_id", "left").select("doc_id", "chunk", F.when(F.col("chunk") == 0, F.left("text", F.lit(20))).alias("title"), "lang", "quality")


@query("b9_field_update", "SELECT c.c_custkey, coalesce(n.seg, c.c_mktsegment) AS segment FROM customer c LEFT JOIN (SELECT o_custkey, max(o_orderpriority) AS seg FROM orders WHERE o_totalprice > 450000 GROUP BY 1) n ON n.o_custkey = c.c_custkey")
def _(t):
    new = t.orders.filter("o_totalprice > 450000").groupBy("o_custkey").agg(F.max("o_orderpriority").alias("seg"))
    return t.customer.join(new, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("seg", "c_mktsegment").alias("segment"))


@query("b10_soft_delete", "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS deleted FROM documents")
def _(t):
    gone = t.labels.filter("toxic = 1").select("doc_id").withColumn("d", F.lit(True))
    return t.documents.select("doc_id").join(gone, "doc_id", "left").select("doc_id", F.coalesce("d", F.lit(False)).alias("deleted"))


@query("b11_reconcile", f"SELECT d.doc, CASE WHEN a.doc IS NULL THEN 'delete' WHEN a.gone THEN 'blank' ELSE 'live' END AS action FROM (SELECT DISTINCT doc FROM ({_PROV}) UNION SELECT 'none') d LEFT JOIN ({_AUTH}) a USING (doc)")
def _(t):
    p = _provenances(t)
    docs = p.select("doc").union(t.spark.range(1).select(F.lit("none"))).distinct()
    return ingest.reconcile(docs, ingest.authority(p, "doc", "rank", "lang", "pid"), "doc", "gone").select("doc", "action")


@query("b12_orphans", "SELECT count(*) AS n FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang <> 'de')")
def _(t):
    return t.labels.join(t.documents.filter("lang <> 'de'"), "doc_id", "left_anti").agg(n_rows().alias("n"))


@query("b13_rebuild_diff", "WITH o AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), n AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1) SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL THEN 'insert' WHEN n.k IS NULL THEN 'delete' ELSE 'update' END AS action FROM o FULL JOIN n ON o.k = n.k WHERE o.n IS DISTINCT FROM n.n")
def _(t):
    of = lambda w: t.lineitem.filter(w).groupBy(F.col("l_partkey").alias("k")).agg(n_rows().alias("n"))
    return ingest.rebuild_diff(of("l_linestatus = 'F'"), of("l_returnflag <> 'N'"), "k", "n")


@query("b14_snapshot_purge", "SELECT o_orderkey FROM orders QUALIFY o_orderdate = max(o_orderdate) OVER (PARTITION BY o_custkey)")
def _(t):
    keep = t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("o_orderdate"))
    return t.orders.join(keep, ["o_custkey", "o_orderdate"], "left_semi").select("o_orderkey")


@query("b15_view_counter", "SELECT user_id, count(*) AS views, min(ts) AS first_at, max(ts) AS last_at, bool_or(event_type = 'click') AS web FROM events WHERE event_type IN ('view', 'click') GROUP BY 1")
def _(t):
    e = t.events.filter(F.col("event_type").isin("view", "click"))
    return e.groupBy("user_id").agg(n_rows().alias("views"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.max(F.col("event_type") == "click").alias("web"))


@query("b16_history_page", "SELECT event_id, count(*) OVER (PARTITION BY user_id) AS total FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 10")
def _(t):
    e = t.events.join(t.customer.filter("c_acctbal > 0"), F.col("user_id") == F.col("c_custkey"), "left_semi")
    e = e.withColumn("total", F.count("*").over(Window.partitionBy("user_id")))
    return R.top_per_group(e, ["user_id"], [F.desc("ts"), F.asc("event_id")], 10).select("event_id", "total")


@query("b17_bookmarks", "SELECT DISTINCT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS doc_id FROM events WHERE event_type = 'signup'")
def _(t):
    return t.events.filter("event_type = 'signup'").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("doc_id")).distinct()


_URLS = "SELECT '/c/' || c_custkey AS loc, CAST(max(o_orderdate) AS DATE) AS lastmod FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1 UNION ALL SELECT '/p/' || p_partkey, DATE '2000-01-01' FROM part"


def _urls(t):
    c = t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").cast("date").alias("lastmod")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    p = t.part.select(F.concat(F.lit("/p/"), F.col("p_partkey").cast("string")).alias("loc"), F.lit("2000-01-01").cast("date").alias("lastmod"))
    return c.select(F.concat(F.lit("/c/"), F.col("c_custkey").cast("string")).alias("loc"), "lastmod").unionByName(p)


@query("b18_sitemap_rows", _URLS)
def _(t):
    return _urls(t)


@query("b19_sitemap_files", f"SELECT CAST((row_number() OVER (ORDER BY loc) - 1) // 500 AS BIGINT) AS file, loc FROM ({_URLS})")
def _(t):
    from corpuslens.sources.sitemap import numbered_files

    return numbered_files(_urls(t), 500).select("file", "loc")


@query("l4_pending_retry", f"SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def _(t):
    return t.orders.filter("o_orderstatus = 'P'").join(t.customer.filter("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("o_orderkey")


@query("l5_tombstones", "SELECT DISTINCT doc_id AS uid FROM labels WHERE toxic = 1 OR quality = 0")
def _(t):
    return t.labels.filter("toxic = 1").union(t.labels.filter("quality = 0")).select(F.col("doc_id").alias("uid")).distinct()


@query("l6_candidate_purge", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest([c_name, replace(c_name, '#', ''), split_part(c_name, '#', 2)]) AS u FROM customer) WHERE u = lpad(CAST(p_partkey * 2 AS VARCHAR), 9, '0'))")
def _(t):
    cand = t.customer.select(F.explode(F.array(F.col("c_name"), F.replace("c_name", F.lit("#"), F.lit("")), F.split_part("c_name", F.lit("#"), F.lit(2)))).alias("u"))
    return t.part.join(cand, F.lpad((F.col("p_partkey") * 2).cast("string"), 9, "0") == F.col("u"), "left_anti").select("p_partkey")


@query("l7_versioned_worklist", "SELECT doc_id FROM documents WHERE n_chars < 2000 AND lang <> 'de'")
def _(t):
    rows = t.documents.select("doc_id", F.col("n_chars").alias("version"), (F.col("lang") == "de").alias("certified"))
    return rows.filter((F.col("version") < 2000) & ~F.col("certified")).select("doc_id")


@query("l9_updated_since", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-25 00:00:00'")
def _(t):
    return t.events.filter("ts >= TIMESTAMP_NTZ '2024-01-25 00:00:00'").select("event_id")


@query("l10_freshness", "SELECT event_type, CAST(max(ts) AS DATE) AS asof FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(F.max("ts").cast("date").alias("asof"))


@query("l11_embedding_gaps", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def _(t):
    return t.documents.join(t.embeddings.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti").select("doc_id")


@query("l12_drift_counter", "SELECT count(*) AS drift FROM documents WHERE n_chars <> length(text)")
def _(t):
    return t.documents.filter(F.col("n_chars") != F.length("text")).agg(n_rows().alias("drift"))


@query("l14_tumbling", "SELECT time_bucket(INTERVAL '1 hour', ts) AS w, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2")
def _(t):
    return t.events.groupBy(F.window("ts", "1 hour").alias("x"), "event_type").agg(n_rows().alias("n"), F.round(F.sum("value"), 4).alias("v")).select(F.col("x.start").cast("timestamp_ntz").alias("w"), "event_type", "n", "v")


@query("l14_sliding", "SELECT time_bucket(INTERVAL '1 hour', ts) - i * INTERVAL '1 hour' AS w, count(*) AS n FROM events, generate_series(0, 1) g(i) GROUP BY 1")
def _(t):
    return t.events.groupBy(F.window("ts", "2 hours", "1 hour").alias("x")).agg(n_rows().alias("n")).select(F.col("x.start").cast("timestamp_ntz").alias("w"), "n")


@query("l14_sessions", "WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, sid")
def _(t):
    return t.events.groupBy("user_id", F.session_window("ts", "12 hours").alias("x")).agg(F.min("ts").alias("started"), n_rows().alias("n")).select("user_id", "started", "n")


@query("l14_stream_dedup", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def _(t):
    return R.distinct_on(t.events, ["user_id", "event_type"], [F.asc("event_id")]).select("user_id", "event_type", "event_id")


# K: text dataflow


@query("k1_chunker")
def _(t):
    return chunking.chunk_documents(t.documents, chunk_tokens=512, overlap_min=20, overlap_max=60).drop("body")


@query("k4_embedding_text", "SELECT doc_id, length('[' || lang || '] ' || source || chr(10) || chr(10) || text) AS n FROM documents")
def _(t):
    body = F.concat(F.lit("["), "lang", F.lit("] "), "source", F.lit("\n\n"), "text")
    return t.documents.select("doc_id", F.length(body).cast("long").alias("n"))


_REF = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"


@query("k29_identity", "SELECT a.doc_id, u.target FROM documents a LEFT JOIN (SELECT md5(text) AS h, min(doc_id) AS target FROM documents WHERE source <> 'src0' GROUP BY 1 HAVING count(*) = 1) u ON u.h = md5(a.text) WHERE a.source = 'src0'")
def _(t):
    d = t.documents.withColumn("h", F.md5("text"))
    return R.unique_match(d.filter("source = 'src0'").select("doc_id", "h"), d.filter("source <> 'src0'").select("h", F.col("doc_id").alias("target")), "h", "target").select("doc_id", "target")


@query("k30_cross_source_merge", "WITH g AS (SELECT md5(text) AS h, min(doc_id) AS keeper FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id) > 1 AND count(DISTINCT source) = count(DISTINCT (doc_id, source))) SELECT doc_id, keeper FROM documents JOIN g ON md5(text) = h WHERE doc_id <> keeper")
def _(t):
    d = t.documents.select("doc_id", "source", F.md5("text").alias("h"))
    return d.join(R.cross_source_groups(d, "h", "doc_id", "source"), "h").filter("doc_id <> keeper").select("doc_id", "keeper")


@query("k33_split_plan", "SELECT o_custkey, CASE WHEN count(DISTINCT k) > 1 AND count(*) FILTER (k IS NULL) = 0 THEN 'false_merge' WHEN count(*) FILTER (k IS NULL) > 0 THEN 'ambiguous' ELSE 'legit' END AS plan FROM (SELECT o_custkey, nullif(o_orderstatus, 'P') AS k FROM orders) GROUP BY 1")
def _(t):
    return ingest.split_plan(t.orders.select("o_custkey", F.nullif("o_orderstatus", F.lit("P")).alias("k")), "o_custkey", "k").select("o_custkey", "plan")


@query("k38_rekey", "SELECT l_orderkey, l_linenumber, coalesce(m.new, l_partkey) AS key FROM lineitem LEFT JOIN (SELECT p_partkey AS old, p_partkey + 100000 AS new FROM part WHERE p_size = 1) m ON old = l_partkey")
def _(t):
    m = t.part.filter("p_size = 1").select(F.col("p_partkey").alias("old"), (F.col("p_partkey") + 100_000).alias("new"))
    return t.lineitem.join(m, F.col("l_partkey") == F.col("old"), "left").select("l_orderkey", "l_linenumber", F.coalesce("new", "l_partkey").alias("key"))


@query("i13b_slug_assignment", "WITH b AS (SELECT p_partkey, replace(p_name, ' ', '-') AS base, DATE '2020-01-01' + CAST(p_partkey % 40 AS INTEGER) AS d FROM part), s AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY base) = 1 THEN base ELSE base || '-' || CAST(d AS VARCHAR) END AS s FROM b), n AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY p_partkey) AS i FROM s) SELECT p_partkey, CASE WHEN i = 1 THEN s ELSE s || '-' || i END AS slug FROM n")
def _(t):
    base = t.part.select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("-")).alias("base"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("p_partkey") % 40).cast("int")).alias("d"))
    return texts.assign_slugs(base, "p_partkey", "base", "d").select("p_partkey", "slug")


@query("i16_text_diff")
def _(t):
    pairs = t.documents.select("doc_id", F.col("text").alias("old"), F.regexp_replace("text", "tion", "sion").alias("new"))
    return texts.diff_frame(pairs, "doc_id", "old", "new")


# N: entity and hub pages


@query("n3_parties", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE 2 END, l_linestatus, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord FROM lineitem")
def _(t):
    w = Window.partitionBy("l_orderkey").orderBy(F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "R", 1).otherwise(2), "l_linestatus", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.row_number().over(w).cast("long").alias("ord"))


@query("n5_document_detail", "SELECT o_orderkey, count(*) AS n_lines, array_to_string(list(l_partkey || ':' || l_linenumber ORDER BY l_linenumber, l_partkey), ' ') AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def _(t):
    li = t.lineitem.select("l_orderkey", F.struct("l_linenumber", "l_partkey", F.concat_ws(":", "l_partkey", "l_linenumber").alias("s")).alias("x"))
    j = t.orders.join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy("o_orderkey").agg(n_rows().alias("n_lines"), F.concat_ws(" ", F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"])).alias("lines"))


@query("n7_article_page", "SELECT p_partkey, count(DISTINCT l_orderkey) AS citing, min(l_shipdate) AS first_at, max(l_shipdate) AS last_at FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
def _(t):
    li = t.lineitem.groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("citing"), F.min("l_shipdate").alias("first_at"), F.max("l_shipdate").alias("last_at"))
    return t.part.join(li, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.coalesce("citing", F.lit(0)).cast("long").alias("citing"), "first_at", "last_at")


@query("n12_corpus_stats", "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM lineitem) AS citations, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS cited, (SELECT count(*) FROM customer) AS entities")
def _(t):
    one = lambda df, c, name: df.agg(c.alias(name))
    j = one(t.documents, n_rows(), "documents").join(one(t.lineitem, n_rows(), "citations")).join(one(t.lineitem, F.countDistinct("l_partkey"), "cited"))
    return j.join(one(t.customer, n_rows(), "entities"))
