"""Filters, joins, aggregates, windows, set operations and trees."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuslens.functions import text as X
from corpuslens.functions import vectors as V
from corpuslens.operators import relational as R
from corpuslens.operators import search as S
from corpuslens.operators import trees
from corpuslens.plans.registry import n_rows, query
from corpuslens.plans.scalars import tok



def _join(names: list[str]):
    return F.array(*map(F.lit, names))


# C: projections, filters, predicates


@query("c1_facet_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate >= DATE '1996-01-01' AND o_orderdate <= DATE '1998-12-31'")
def _(t):
    wanted = {"o_orderstatus": ["F", "O"], "o_orderpriority": ["1-URGENT", "2-HIGH"], "o_custkey": []}
    rows = t.orders.filter("o_orderdate >= DATE '1996-01-01' AND o_orderdate <= DATE '1998-12-31'")
    for column, values in wanted.items():
        rows = rows.filter(F.col(column).isin(values)) if values else rows
    return rows.select("o_orderkey")


@query("c2_semi_filter", "SELECT l_orderkey, l_linenumber FROM lineitem l WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderpriority = '1-URGENT' AND o.o_orderdate >= DATE '2000-01-01')")
def _(t):
    urgent = t.orders.filter("o_orderpriority = '1-URGENT' AND o_orderdate >= DATE '2000-01-01'")
    return t.lineitem.join(urgent, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("l_orderkey", "l_linenumber")


_FLAGS = "SELECT l_orderkey, list_sort(list_distinct(list(l_returnflag || l_linestatus))) AS flags FROM lineitem GROUP BY l_orderkey"


@query("c3_array_overlap", f"SELECT l_orderkey FROM ({_FLAGS}) WHERE list_has_any(flags, ['RO', 'NF'])")
def _(t):
    flags = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus"))).alias("flags"))
    return flags.filter(F.arrays_overlap("flags", _join(["RO", "NF"]))).select("l_orderkey")


@query("c4_term_set", "SELECT doc_id FROM documents WHERE list_has_any(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ['thou', 'tion', 'nicht'])")
def _(t):
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return t.documents.filter(F.arrays_overlap(words, _join(["thou", "tion", "nicht"]))).select("doc_id")


@query("c5_strongest_rank", f"SELECT l_orderkey, CASE WHEN list_has_any(flags, ['RF']) THEN 3 WHEN list_has_any(flags, ['AF']) THEN 2 WHEN list_has_any(flags, ['NO']) THEN 1 ELSE 0 END AS rank FROM ({_FLAGS}) WHERE CASE WHEN list_has_any(flags, ['RF']) THEN 3 WHEN list_has_any(flags, ['AF']) THEN 2 WHEN list_has_any(flags, ['NO']) THEN 1 ELSE 0 END IN (1, 2)")
def _(t):
    flags = t.lineitem.groupBy("l_orderkey").agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("flags"))
    has = lambda f: F.arrays_overlap("flags", _join([f]))
    rank = F.when(has("RF"), 3).when(has("AF"), 2).when(has("NO"), 1).otherwise(0)
    return flags.select("l_orderkey", rank.alias("rank")).filter("rank IN (1, 2)")


@query("c6_hierarchy_expansion", "SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey IN (1, 3) OR regexp_matches(upper(c_mktsegment), '^BUILD(_|$|I)')")
def _(t):
    c = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.filter(F.col("r_regionkey").isin(1, 3) | F.upper("c_mktsegment").rlike("^BUILD(_|$|I)")).select("c_custkey")


@query("c7_scope_complement", "SELECT c_custkey, c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AS outside FROM customer")
def _(t):
    return t.customer.select("c_custkey", (~F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).alias("outside"))


@query("c8_visibility", "SELECT p_partkey, p_brand IS NOT NULL AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 48) AS searchable FROM part")
def _(t):
    hidden = t.lineitem.filter("l_returnflag = 'R' AND l_quantity > 48").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("hidden", F.lit(True))
    return t.part.join(hidden, "p_partkey", "left").select("p_partkey", (F.col("p_brand").isNotNull() & F.col("hidden").isNull()).alias("searchable"))


@query("c10_first_valid_date", "SELECT l_orderkey, l_linenumber, min(coalesce(CASE WHEN year(l_shipdate) BETWEEN 1500 AND 1999 THEN CAST(l_shipdate AS DATE) END, DATE '1999-12-31')) AS d FROM lineitem GROUP BY ALL")
def _(t):
    first = F.coalesce(F.when(F.year("l_shipdate").between(1500, 1999), F.col("l_shipdate").cast("date")), F.lit("1999-12-31").cast("date"))
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min(first).alias("d"))


@query("c11_role_classifier", "SELECT p_partkey, CASE WHEN regexp_matches(p_name, '^(red|blue)') THEN 'modifier' WHEN NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey) THEN 'shell' ELSE 'content' END AS role FROM part")
def _(t):
    cited = t.lineitem.select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("cited", F.lit(True))
    role = F.when(F.col("p_name").rlike("^(red|blue)"), "modifier").when(F.col("cited").isNull(), "shell").otherwise("content")
    return t.part.join(cited, "p_partkey", "left").select("p_partkey", role.alias("role"))


@query("c12_denylist_pairs", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag, l_linestatus) NOT IN (('R', 'F'), ('N', 'O'))")
def _(t):
    deny = t.spark.sql("SELECT * FROM VALUES ('R', 'F'), ('N', 'O') AS d(l_returnflag, l_linestatus)")
    return t.lineitem.join(F.broadcast(deny), ["l_returnflag", "l_linestatus"], "left_anti").select("l_orderkey", "l_linenumber")


@query("c13_null_safe_change", "SELECT a.doc_id, NULLIF(a.quality, 0) IS DISTINCT FROM NULLIF(1 - a.toxic, 0) AS changed FROM labels a")
def _(t):
    return t.labels.select("doc_id", (~F.nullif("quality", F.lit(0)).eqNullSafe(F.nullif(1 - F.col("toxic"), F.lit(0)))).alias("changed"))


@query("c14_keyed_status", "SELECT p_partkey, CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50) AND p_type = 'ECONOMY' THEN 'flagged' ELSE p_type END AS status FROM part")
def _(t):
    keys = t.lineitem.filter("l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("hit", F.lit(True))
    return t.part.join(keys, "p_partkey", "left").select("p_partkey", F.when(F.col("hit") & (F.col("p_type") == "ECONOMY"), "flagged").otherwise(F.col("p_type")).alias("status"))


@query("c15_value_remap", "SELECT event_type, CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'open' ELSE event_type END AS verb, count(*) AS n FROM events GROUP BY ALL")
def _(t):
    verbs = t.spark.sql("SELECT * FROM VALUES ('view', 'read'), ('click', 'open') AS v(event_type, verb)")
    return t.events.join(F.broadcast(verbs), "event_type", "left").groupBy("event_type", F.coalesce("verb", "event_type").alias("verb")).agg(n_rows().alias("n"))


@query("c16_relabel_by_url", "SELECT page_id, CASE WHEN url LIKE 'https://blog.%' THEN 'blog' WHEN url LIKE '%example.net%' THEN 'net' ELSE 'site' END AS label FROM pages")
def _(t):
    u = F.col("url")
    return t.pages.select("page_id", F.when(u.startswith("https://blog."), "blog").when(u.contains("example.net"), "net").otherwise("site").alias("label"))


# D: joins


@query("d1_join_dimension", "SELECT l_orderkey, l_linenumber, o_orderdate, n_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def _(t):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("l_orderkey", "l_linenumber", "o_orderdate", "n_name")


@query("d2_lateral_top1", "SELECT c_custkey, o.o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 1) o")
def _(t):
    return R.distinct_on(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")]).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")


_KNN = "SELECT s.vec_id AS src, v.vec_id AS vec, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(s.embedding AS DOUBLE[])), 5) AS score, row_number() OVER (PARTITION BY s.vec_id ORDER BY list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(s.embedding AS DOUBLE[])) DESC, v.vec_id) AS rk FROM embeddings s JOIN embeddings v ON s.label <> v.label WHERE s.vec_id % 20 = 0"


@query("d3_lateral_knn", f"SELECT src, vec, score, rk FROM ({_KNN}) WHERE rk <= 5")
def _(t):
    return S.knn(t.embeddings, t.embeddings.filter("vec_id % 20 = 0"), 5).select("src", "vec", F.round("score", 5).alias("score"), F.col("rk").cast("long").alias("rk"))


@query("d4_asof_join", "SELECT o.o_orderkey, p.o_orderkey AS prev_key FROM (SELECT * FROM orders WHERE o_orderstatus = 'F') o LEFT JOIN LATERAL (SELECT o_orderkey FROM orders p WHERE p.o_orderstatus = 'O' AND p.o_custkey = o.o_custkey AND p.o_orderdate <= o.o_orderdate ORDER BY p.o_orderdate DESC, p.o_orderkey LIMIT 1) p ON true")
def _(t):
    left = t.orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_orderdate")
    right = t.orders.filter("o_orderstatus = 'O'").select("o_custkey", F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("prev_key"))
    return R.asof_join(left, right, "o_custkey", "o_orderdate", "at", ["prev_key"]).select("o_orderkey", "prev_key")


_VERS = "SELECT o_custkey AS k, o_orderkey, o_orderdate AS d0, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS d1 FROM orders"


def _versions(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select(F.col("o_custkey").alias("k"), "o_orderkey", F.col("o_orderdate").alias("d0"), F.lead("o_orderdate").over(w).alias("d1"))


@query("d4b_asof_in_force", f"SELECT k, arg_max(o_orderkey, struct_pack(a := d0, b := o_orderkey)) AS served FROM ({_VERS}) WHERE d0 <= TIMESTAMP '1998-07-01' AND (d1 IS NULL OR d1 >= TIMESTAMP '1998-07-01') GROUP BY k")
def _(t):
    live = R.valid_at(_versions(t), "d0", "d1", F.lit("1998-07-01").cast("timestamp_ntz"), inclusive_end=True)
    return R.distinct_on(live, ["k"], [F.desc("d0"), F.desc("o_orderkey")]).select("k", F.col("o_orderkey").alias("served"))


@query("d5_interval_join", f"SELECT v.o_orderkey, count(*) AS n FROM ({_VERS}) v JOIN lineitem l ON l.l_orderkey = v.o_orderkey AND l.l_shipdate >= v.d0 AND (v.d1 IS NULL OR l.l_shipdate < v.d1) GROUP BY 1")
def _(t):
    v, ship = _versions(t), F.col("l_shipdate")
    j = v.join(t.lineitem, (F.col("l_orderkey") == F.col("o_orderkey")) & (ship >= F.col("d0")) & (F.col("d1").isNull() | (ship < F.col("d1"))))
    return j.groupBy("o_orderkey").agg(n_rows().alias("n"))


@query("d6_semi_join", "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def _(t):
    return t.supplier.join(t.lineitem.filter("l_quantity > 49"), F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey")


@query("d7_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def _(t):
    return t.customer.join(t.orders.filter("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("d8_collapse_duplicates", "SELECT p_partkey FROM part p WHERE p_size < 10 AND EXISTS (SELECT 1 FROM part q WHERE q.p_name = p.p_name AND q.p_brand = p.p_brand AND q.p_size >= 10) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p.p_partkey AND l_quantity > 45)")
def _(t):
    full = t.part.filter("p_size >= 10").select("p_name", "p_brand")
    shell = t.part.filter("p_size < 10").join(full, ["p_name", "p_brand"], "left_semi")
    return shell.join(t.lineitem.filter("l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query("d9_unique_match", "SELECT o_orderkey, m.c AS resolved FROM orders LEFT JOIN (SELECT c_nationkey, c_mktsegment, min(c_custkey) AS c FROM customer GROUP BY 1, 2 HAVING count(*) = 1) m ON o_custkey % 25 = c_nationkey AND ['BUILDING', 'MACHINERY', 'HOUSEHOLD', 'AUTOMOBILE', 'FURNITURE'][1 + o_orderkey % 5] = c_mktsegment")
def _(t):
    segs = _join(["BUILDING", "MACHINERY", "HOUSEHOLD", "AUTOMOBILE", "FURNITURE"])
    pending = t.orders.select("o_orderkey", F.concat_ws("|", F.col("o_custkey") % 25, F.get(segs, (F.col("o_orderkey") % 5).cast("int"))).alias("key"))
    cand = t.customer.select(F.concat_ws("|", "c_nationkey", "c_mktsegment").alias("key"), F.col("c_custkey").alias("resolved"))
    return R.unique_match(pending, cand, "key", "resolved").select("o_orderkey", "resolved")


@query("d11_bridge_join", "SELECT l_orderkey, l_linenumber, coalesce(o.o_custkey, -1) AS target FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') o ON l_orderkey = o_orderkey")
def _(t):
    links = t.orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    return t.lineitem.join(links, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("l_orderkey", "l_linenumber", F.coalesce("o_custkey", F.lit(-1).cast("long")).alias("target"))


@query("d12_array_membership", "SELECT p.p_partkey, count(DISTINCT o.l_orderkey) AS n FROM part p JOIN (SELECT l_orderkey, list(l_partkey) AS parts FROM lineitem GROUP BY 1) o ON list_contains(o.parts, p.p_partkey) GROUP BY 1")
def _(t):
    arrays = t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("parts"))
    member = arrays.select("l_orderkey", F.explode(F.array_distinct("parts")).alias("p_partkey"))
    return member.join(t.part, "p_partkey").groupBy("p_partkey").agg(n_rows().alias("n"))


@query("d13_name_variants", "WITH v AS (SELECT p_partkey, p_name AS name FROM part UNION SELECT p_partkey, split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) FROM part), k AS (SELECT DISTINCT p_name AS name FROM part) SELECT v.p_partkey, count(*) AS n FROM v JOIN k USING (name) GROUP BY 1")
def _(t):
    rotated = F.concat_ws(" ", F.split_part("p_name", F.lit(" "), F.lit(2)), F.split_part("p_name", F.lit(" "), F.lit(1)))
    variants = t.part.select("p_partkey", F.explode(F.array_distinct(F.array("p_name", rotated))).alias("name"))
    keys = t.part.select(F.col("p_name").alias("name")).distinct()
    return variants.join(keys, "name").groupBy("p_partkey").agg(n_rows().alias("n"))


@query("d14_token_subset", "WITH k AS (SELECT DISTINCT p_name AS key, string_split(p_name, ' ') AS toks FROM part), n AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS name FROM part) SELECT key AS key_id, name AS name_id FROM k, n WHERE list_has_all(string_split(name, ' '), toks)")
def _(t):
    keys = t.part.select(F.col("p_name").alias("key_id")).distinct().withColumn("toks", F.array_distinct(F.split("key_id", " ")))
    names = t.part.select(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("name_id")).distinct().withColumn("toks", F.array_distinct(F.split("name_id", " ")))
    return R.token_subset(keys, names)


@query("d15_co_occurrence", "WITH e AS (SELECT DISTINCT l_orderkey AS d, l_partkey AS a FROM lineitem) SELECT x.a AS anchor, y.a, count(*) AS n FROM e x JOIN e y USING (d) WHERE x.a % 20 = 0 AND y.a <> x.a GROUP BY 1, 2")
def _(t):
    e = t.lineitem.select(F.col("l_orderkey").alias("d"), F.col("l_partkey").alias("a")).distinct()
    anchors = e.filter("a % 20 = 0").select("d", F.col("a").alias("anchor"))  # the query set
    return e.join(anchors, "d").filter("a <> anchor").groupBy("anchor", "a").agg(n_rows().alias("n"))


@query("d16_bilateral_anchor", "SELECT o_custkey, l_suppkey, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2")
def _(t):
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_suppkey").agg(F.countDistinct("l_orderkey").alias("n"))


@query("d17_polymorphic", "SELECT e.event_id, coalesce(c.c_name, s.s_name) AS target, CASE WHEN c.c_custkey IS NOT NULL THEN 'customer' WHEN s.s_suppkey IS NOT NULL THEN 'supplier' END AS kind FROM events e LEFT JOIN customer c ON e.event_type = 'purchase' AND c.c_custkey = e.user_id LEFT JOIN supplier s ON e.event_type = 'click' AND s.s_suppkey = e.user_id")
def _(t):
    j = t.events.join(t.customer, (F.col("event_type") == "purchase") & (F.col("c_custkey") == F.col("user_id")), "left").join(t.supplier, (F.col("event_type") == "click") & (F.col("s_suppkey") == F.col("user_id")), "left")
    return j.select("event_id", F.coalesce("c_name", "s_name").alias("target"), F.when(F.col("c_custkey").isNotNull(), "customer").when(F.col("s_suppkey").isNotNull(), "supplier").alias("kind"))


_EDGES = "SELECT 'world' AS parent, 'r' || r_regionkey AS child, r_regionkey AS seq FROM region UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, n_nationkey FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, c_custkey FROM customer"


def _edges(t):
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    r = t.region.select(F.lit("world").alias("parent"), tag("r", "r_regionkey").alias("child"), F.col("r_regionkey").cast("long").alias("seq"))
    n = t.nation.select(tag("r", "n_regionkey").alias("parent"), tag("n", "n_nationkey").alias("child"), F.col("n_nationkey").cast("long").alias("seq"))
    c = t.customer.select(tag("n", "c_nationkey").alias("parent"), tag("c", "c_custkey").alias("child"), F.col("c_custkey").alias("seq"))
    return r.unionByName(n).unionByName(c)


@query("d19_breadcrumb", f"WITH RECURSIVE e AS ({_EDGES}), up AS (SELECT child AS leaf, parent AS node, 1 AS level FROM e WHERE starts_with(child, 'c') UNION ALL SELECT u.leaf, e.parent, u.level + 1 FROM up u JOIN e ON e.child = u.node WHERE u.level < 12) SELECT * FROM up")
def _(t):
    return trees.ascend(t.spark, _edges(t), _edges(t).filter("child LIKE 'c%'").select(F.col("child").alias("leaf")).distinct())


@query("d20_range_join", "WITH p AS (SELECT doc_id, i, 200 * i AS a, 200 * i + 200 AS b FROM documents, generate_series(0, n_chars // 200) g(i)), s AS (SELECT doc_id, 37 * j AS c, 37 * j + 11 AS e FROM documents, generate_series(0, n_chars // 37) h(j) WHERE 37 * j + 11 <= n_chars) SELECT p.doc_id, CAST(p.i AS INTEGER) AS para, count(*) AS n FROM p JOIN s ON s.doc_id = p.doc_id AND s.c >= p.a AND s.e <= p.b GROUP BY 1, 2")
def _(t):
    d = t.documents.select("doc_id", "n_chars")
    p = d.select("doc_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("n_chars") / 200).cast("int"))).alias("para")).selectExpr("doc_id", "para", "200 * para AS a", "200 * para + 200 AS b")
    s = d.select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0), F.floor(F.col("n_chars") / 37).cast("int"))).alias("j")).filter("37 * j + 11 <= n_chars").selectExpr("doc_id", "37 * j AS c", "37 * j + 11 AS e")
    j = p.join(s, (p.doc_id == s.doc_id) & (s.c >= p.a) & (s.e <= p.b)).select(p.doc_id, "para")
    return j.groupBy("doc_id", "para").agg(n_rows().alias("n"))


@query("d21_catalogue", "SELECT c_custkey, count(o_orderkey) FILTER (o_orderstatus = 'O') AS n_open, count(DISTINCT o_orderpriority) AS n_prio FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(t):
    pre = t.orders.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "O").alias("n_open"), F.countDistinct("o_orderpriority").alias("n_prio"))
    j = t.customer.join(pre, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.select("c_custkey", F.coalesce("n_open", F.lit(0)).cast("long").alias("n_open"), F.coalesce("n_prio", F.lit(0)).cast("long").alias("n_prio"))


@query("d22_two_key_join", "SELECT DISTINCT l_orderkey, e.event_id FROM lineitem JOIN events e ON l_partkey = e.user_id AND day(l_shipdate) = day(e.ts)")
def _(t):
    return t.lineitem.join(t.events, (F.col("l_partkey") == F.col("user_id")) & (F.dayofmonth("l_shipdate") == F.dayofmonth("ts"))).select("l_orderkey", "event_id").distinct()


@query("d23_commentary", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(t):
    return t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")


@query("d24_stale_authority", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey AND o_orderpriority = '5-LOW') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey AND o_orderpriority = '1-URGENT')")
def _(t):
    key = F.col("c_custkey") == F.col("o_custkey")
    return t.customer.join(t.orders.filter("o_orderpriority = '5-LOW'"), key, "left_semi").join(t.orders.filter("o_orderpriority = '1-URGENT'"), key, "left_anti").select("c_custkey")


# E: aggregates


@query("e1_group_count", "SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2")
def _(t):
    return t.documents.groupBy("lang", "source").agg(n_rows().alias("n"))


@query("e2_count_distinct", "SELECT l_partkey, count(DISTINCT l_orderkey) AS n_docs, count(DISTINCT year(l_shipdate)) AS n_years FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("n_docs"), F.countDistinct(F.year("l_shipdate")).alias("n_years"))


@query("e3_filtered_aggregates", "SELECT o_custkey, count(DISTINCT o_orderkey) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS open_value FROM orders GROUP BY 1")
def _(t):
    s = F.col("o_orderstatus")
    return t.orders.groupBy("o_custkey").agg(F.countDistinct(F.when(s == "F", F.col("o_orderkey"))).alias("done"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.round(F.sum(F.when(s == "O", F.col("o_totalprice"))), 2).alias("open_value"))


_SETS = "SELECT {g} AS g, lang, source, long_text, count(*) AS n FROM (SELECT lang, source, n_chars > 2000 AS long_text FROM documents) GROUP BY GROUPING SETS ((lang), (source), (long_text), (lang, long_text), ())"


@query("e4_grouping_sets", _SETS.format(g="CAST(grouping_id(lang, source, long_text) AS BIGINT)"))
def _(t):
    t.documents.createOrReplaceTempView("documents")
    return t.spark.sql(_SETS.format(g="grouping_id(lang, source, long_text)"))


@query(
    "e5_facets",
    "WITH f AS (SELECT o_orderkey, unnest([{'axis': 'status', 'value': o_orderstatus}, {'axis': 'priority', 'value': o_orderpriority}, {'axis': 'year', 'value': CAST(year(o_orderdate) AS VARCHAR)}, {'axis': 'customer', 'value': CAST(o_custkey AS VARCHAR)}]) AS p FROM orders), c AS (SELECT p.axis AS axis, p.value AS value, count(DISTINCT o_orderkey) AS n FROM f GROUP BY 1, 2) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY axis ORDER BY n DESC, value) <= 30",
)
def _(t):
    axes = {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority"), "year": F.year("o_orderdate"), "customer": F.col("o_custkey")}
    return S.facets(t.orders, axes, "o_orderkey").select("axis", "value", "n")


_ROLL = "SELECT r_name, n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)"


@query("e6_tree_rollup", _ROLL)
def _(t):
    j = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.rollup("r_name", "n_name").agg(n_rows().alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("e7_most_common", "SELECT l_partkey AS value, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, value LIMIT 25")
def _(t):
    return t.lineitem.groupBy(F.col("l_partkey").alias("value")).agg(n_rows().alias("n")).orderBy(F.desc("n"), "value").limit(25)


@query("e8_having", "SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 3")
def _(t):
    return t.lineitem.groupBy("l_suppkey", "l_partkey").agg(n_rows().alias("n")).filter("n >= 3")


@query("e9_array_agg", "SELECT l_orderkey, array_to_string(list(DISTINCT l_returnflag ORDER BY l_returnflag) FILTER (l_quantity > 5), ',') AS flags FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_quantity > 5) > 0")
def _(t):
    big = t.lineitem.filter("l_quantity > 5")
    return big.groupBy("l_orderkey").agg(F.concat_ws(",", F.array_sort(F.collect_set("l_returnflag"))).alias("flags"))


@query("e10_max_pool", "SELECT l_orderkey, max(l_extendedprice) AS best, arg_max(l_linenumber, struct_pack(a := l_extendedprice, b := -l_linenumber)) AS line FROM lineitem GROUP BY 1")
def _(t):
    best = F.max_by(F.struct("l_extendedprice", "l_linenumber"), F.struct(F.col("l_extendedprice"), -F.col("l_linenumber")))
    return t.lineitem.groupBy("l_orderkey").agg(best.alias("b")).select("l_orderkey", F.col("b.l_extendedprice").alias("best"), F.col("b.l_linenumber").alias("line"))


@query("e11_centroid", "SELECT label, CAST(k AS INTEGER) AS k, round(avg(CAST(x AS DOUBLE)), 5) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings) GROUP BY 1, 2")
def _(t):
    return V.centroid(t.embeddings, "embedding", ["label"]).select("label", F.posexplode("centroid").alias("k", "x")).select("label", "k", F.round("x", 5).alias("m"))


@query("e12_pair_mean", "SELECT a.label, round(1 - avg(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 5) AS mu FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1")
def _(t):
    # mean over pairs from the sum of unit vectors: no pair is formed
    unit = t.embeddings.select("label", V.normalise(F.col("embedding")).alias("u"))
    sums = unit.select("label", F.posexplode("u").alias("k", "x")).groupBy("label", "k").agg(F.sum("x").alias("s"), n_rows().alias("n"))
    total = sums.groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.first("n").alias("n"))
    return total.select("label", F.round(1 - (F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1)), 5).alias("mu"))


_GRAMS = f"SELECT item_id, {tok('text')} AS w FROM benchmark"


_TERMS = f"SELECT l_partkey, l_orderkey, unnest(string_split(o_orderpriority || ' ' || o_orderstatus, ' ')) AS term FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


@query("e15_corpus_counters", "SELECT count(*) AS docs, count(DISTINCT source) AS sources, count(DISTINCT md5(text)) AS texts, sum(n_chars) AS chars FROM documents")
def _(t):
    return t.documents.agg(n_rows().alias("docs"), F.countDistinct("source").alias("sources"), F.countDistinct(F.md5("text")).alias("texts"), F.sum("n_chars").alias("chars"))


@query("e16_rank_percentile", "WITH o AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT lang, max(n_chars) FILTER (i = round_even((n - 1) * 0.5, 0)) AS p50, max(n_chars) FILTER (i = round_even((n - 1) * 0.9, 0)) AS p90, max(n_chars) FILTER (i = round_even((n - 1) * 0.99, 0)) AS p99 FROM o GROUP BY 1")
def _(t):
    return R.rank_percentile(t.documents, ["lang"], "n_chars", [0.5, 0.9, 0.99])


@query("e17_profile", "SELECT lang, count(*) AS n, round(avg(n_chars), 3) AS mean, min(n_chars) AS least, max(n_chars) AS most, count(*) FILTER (regexp_matches(text, '@')) AS with_at FROM documents GROUP BY 1")
def _(t):
    return t.documents.groupBy("lang").agg(n_rows().alias("n"), F.round(F.avg("n_chars"), 3).alias("mean"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.count_if(F.col("text").contains("@")).alias("with_at"))


@query("e18_ordered_counter", "SELECT event_type, count(*) AS n, min(event_id) AS first_at FROM events GROUP BY 1 ORDER BY n DESC, first_at LIMIT 3")
def _(t):
    return t.events.groupBy("event_type").agg(n_rows().alias("n"), F.min("event_id").alias("first_at")).orderBy(F.desc("n"), "first_at").limit(3)


@query("e19_disjoint_clusters", "SELECT h AS key, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS keeper FROM (SELECT md5(text) AS h, doc_id, source FROM documents) GROUP BY 1 HAVING count(DISTINCT doc_id) > 1 AND count(DISTINCT source) = count(DISTINCT (doc_id, source))")
def _(t):
    return R.cross_source_groups(t.documents.select(F.md5("text").alias("key"), "doc_id", "source"), "key", "doc_id", "source")


@query("e20_scalar_subquery_count", "SELECT s_suppkey, (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_suppkey = s_suppkey AND l_linestatus = 'O') AS n FROM supplier")
def _(t):
    pre = t.lineitem.filter("l_linestatus = 'O'").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("n"))
    return t.supplier.join(pre, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("s_suppkey", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("e21_weighted_vote", "SELECT o, p_type FROM (SELECT l_orderkey AS o, p_type, sum(CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.5 END) AS w FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY o ORDER BY w DESC, p_type) = 1")
def _(t):
    w = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("o"), "p_type").agg(F.sum(F.when(F.col("l_quantity") > 25, 1.0).otherwise(0.5)).alias("w"))
    return R.distinct_on(w, ["o"], [F.desc("w"), F.asc("p_type")]).select("o", "p_type")


@query("e22_rank_average", "SELECT user_id, round(avg(value), 4) AS score, min(event_id) AS first_at FROM events GROUP BY 1 ORDER BY score DESC, first_at LIMIT 50")
def _(t):
    return t.events.groupBy("user_id").agg(F.round(F.avg("value"), 4).alias("score"), F.min("event_id").alias("first_at")).orderBy(F.desc("score"), "first_at").limit(50)


_CUBE = "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"


@query("e23_cube", _CUBE)
def _(t):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(n_rows().alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


# F: windows, versions, order


@query("f1_leg_rank", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS rk FROM orders QUALIFY rk <= 20")
def _(t):
    return R.top_per_group(t.orders, ["o_orderstatus"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 20).select("o_orderkey", F.col("rk").cast("long").alias("rk"))


@query("f2_first_last", "SELECT conv_id, min(turn) AS first_turn, max(turn) AS last_turn, arg_max(role, turn) AS last_role FROM conversations GROUP BY 1")
def _(t):
    return t.conversations.groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role"))


@query("f3_distinct_on", "SELECT DISTINCT ON (source) source, doc_id, n_chars FROM documents ORDER BY source, n_chars DESC, doc_id")
def _(t):
    return R.distinct_on(t.documents, ["source"], [F.desc("n_chars"), F.asc("doc_id")]).select("source", "doc_id", "n_chars")


@query("f4_keep_longest", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(lower(text)), lang ORDER BY n_chars DESC, doc_id DESC) AS rn FROM documents) WHERE rn > 1")
def _(t):
    kept = R.distinct_on(t.documents.withColumn("k", F.md5(F.lower("text"))), ["k", "lang"], [F.desc("n_chars"), F.desc("doc_id")]).select("doc_id")
    return t.documents.select("doc_id").join(kept, "doc_id", "left_anti")


@query("f5_same_source_losers", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source, md5(text) ORDER BY CASE lang WHEN 'fr' THEN 0 ELSE 1 END, doc_id) AS rn FROM documents) WHERE rn > 1")
def _(t):
    w = Window.partitionBy("source", F.md5("text")).orderBy(F.when(F.col("lang") == "fr", 0).otherwise(1), "doc_id")
    return t.documents.withColumn("rn", F.row_number().over(w)).filter("rn > 1").select("doc_id")


@query("f7_hash_sample", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) AS rn FROM events) WHERE rn <= 5")
def _(t):
    return R.top_per_group(t.events, ["user_id"], [F.md5(F.col("event_id").cast("string")), F.col("event_id")], 5).select("event_id")


@query("f8_version_timeline", f"SELECT k, o_orderkey, d0, d1 FROM ({_VERS})")
def _(t):
    return _versions(t)


@query("f9_context_window", "WITH o AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i, count(*) OVER (PARTITION BY source) AS n FROM documents), a AS (SELECT source, i AS at, n FROM o WHERE i = 20) SELECT o.doc_id FROM o JOIN a USING (source) WHERE CASE WHEN a.n <= 40 THEN true ELSE abs(o.i - a.at) <= 6 END")
def _(t):
    o = t.documents.select("doc_id", "source", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("i"), F.count(F.lit(1)).over(Window.partitionBy("source")).alias("n"))
    near = F.max((F.col("i") == 20).cast("int")).over(Window.partitionBy("source").orderBy("i").rowsBetween(-6, 6))
    small = F.max((F.col("i") == 20).cast("int")).over(Window.partitionBy("source"))
    return o.withColumn("near", F.when(F.col("n") <= 40, small).otherwise(near)).filter("near = 1").select("doc_id")


@query("f10_reading_order", "SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN p_size > 40 THEN NULL ELSE p_size END NULLS LAST, p_name, p_partkey) AS pos FROM part")
def _(t):
    order = Window.orderBy(F.when(F.col("p_size") <= 40, F.col("p_size")).asc_nulls_last(), "p_name", "p_partkey")
    return t.part.select("p_partkey", F.row_number().over(order).cast("long").alias("pos"))


@query("f11_natural_sort", "SELECT k, row_number() OVER (ORDER BY r, nums, k) AS pos FROM (SELECT k, CASE left(k, 1) WHEN 'l' THEN 1 WHEN 'r' THEN 3 WHEN 'd' THEN 4 ELSE 0 END AS r, list_transform(regexp_extract_all(k, '[0-9]+'), lambda x: CAST(x AS BIGINT)) AS nums FROM (SELECT ['l', 'r', 'd', ''][1 + p_partkey % 4] || p_size || '-' || p_partkey AS k FROM part))")
def _(t):
    key = F.concat(F.get(_join(["l", "r", "d", ""]), (F.col("p_partkey") % 4).cast("int")), F.col("p_size").cast("string"), F.lit("-"), F.col("p_partkey").cast("string"))
    k = t.part.select(key.alias("k")).withColumn("nk", X.natural_key(F.col("k")))
    return R.numbered(k, [F.col("nk")]).select("k", "pos")


@query("f12_median_order", "SELECT p_brand, quantile_disc(p_partkey, 0.5) AS med FROM part GROUP BY 1")
def _(t):
    return t.part.groupBy("p_brand").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY p_partkey)").cast("long").alias("med"))


@query("f13_date_resort", "SELECT o_orderkey, row_number() OVER (ORDER BY coalesce(CAST(CAST(d AS DATE) AS VARCHAR), ''), o_orderkey) AS pos FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END AS d FROM orders)")
def _(t):
    o = t.orders.withColumn("d", F.when(F.col("o_orderkey") % 7 == 0, F.lit(None)).otherwise(F.col("o_orderdate").cast("date").cast("string")))
    return R.numbered(o.select("o_orderkey", "d"), [F.coalesce("d", F.lit("")).alias("d"), F.col("o_orderkey")]).select("o_orderkey", "pos")


@query("f14_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def _(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20)


@query("f15_topk_total", "SELECT c_custkey, (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') AS total FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def _(t):
    rows = t.customer.filter("c_mktsegment = 'BUILDING'")
    page = rows.orderBy(F.desc("c_acctbal"), "c_custkey").limit(10).select("c_custkey")
    return page.join(F.broadcast(rows.agg(n_rows().alias("total"))))


@query("f16_two_legs", "(SELECT s_suppkey, 1 AS leg FROM supplier WHERE s_name LIKE 'Supplier%' AND s_acctbal > 5000 ORDER BY s_acctbal DESC, s_suppkey LIMIT 10) UNION ALL (SELECT s_suppkey, 2 AS leg FROM supplier WHERE s_acctbal <= 5000 ORDER BY s_name LIMIT 10)")
def _(t):
    s = t.supplier.filter(F.col("s_name").startswith("Supplier"))
    one = s.filter("s_acctbal > 5000").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(10).select("s_suppkey", F.lit(1).alias("leg"))
    return one.unionByName(s.filter("s_acctbal <= 5000").orderBy("s_name").limit(10).select("s_suppkey", F.lit(2).alias("leg")))


@query("f17_adaptive_topk", "WITH l AS (SELECT *, count(*) OVER (PARTITION BY l_partkey) AS n FROM lineitem) SELECT l_partkey, l_orderkey, l_linenumber FROM l QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY CASE WHEN n > 100000 THEN 0 ELSE CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END END, l_shipdate DESC, l_orderkey, l_linenumber, l_extendedprice) <= 10")
def _(t):
    sized = t.lineitem.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("l_partkey")))
    rank = F.when(F.col("n") > 100_000, 0).when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    order = [rank, F.desc("l_shipdate"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_extendedprice")]
    return R.top_per_group(sized, ["l_partkey"], order, 10).select("l_partkey", "l_orderkey", "l_linenumber")


@query("f18_hub_page", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) = 1997 ORDER BY o_orderdate DESC, o_orderkey LIMIT 15 OFFSET 15")
def _(t):
    return t.orders.filter("o_orderstatus = 'F' AND o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1998-01-01'").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(15).limit(15).select("o_orderkey")


@query("f19_wraparound", "SELECT o_orderkey FROM orders ORDER BY o_orderkey <= 14990, o_orderkey LIMIT 30")
def _(t):
    return t.orders.orderBy(F.col("o_orderkey") <= 14990, "o_orderkey").limit(30).select("o_orderkey")


@query("f20_total_over_page", "SELECT event_id, count(*) OVER (PARTITION BY user_id) AS total FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 3")
def _(t):
    e = t.events.withColumn("total", F.count("*").over(Window.partitionBy("user_id")))
    return R.top_per_group(e, ["user_id"], [F.desc("ts"), F.asc("event_id")], 3).select("event_id", "total")


_WIN = "SELECT event_id, rank() OVER w AS r, dense_rank() OVER w AS dr, ntile(4) OVER w AS q, lag(event_id) OVER w AS prev, lead(event_id) OVER w AS nxt, first_value(event_id) OVER w AS f, round(sum(value) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS s3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


@query("f21_window_functions", _WIN)
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    long = lambda c: c.cast("long")
    return t.events.select("event_id", long(F.rank().over(w)).alias("r"), long(F.dense_rank().over(w)).alias("dr"), long(F.ntile(4).over(w)).alias("q"), F.lag("event_id").over(w).alias("prev"), F.lead("event_id").over(w).alias("nxt"), F.first("event_id").over(w).alias("f"), F.round(F.sum("value").over(w.rowsBetween(-2, 0)), 4).alias("s3"))


# G: set operations


@query("g1_union_all", "SELECT 'c' AS leg, c_custkey AS id FROM customer UNION ALL SELECT 's', s_suppkey FROM supplier")
def _(t):
    return t.customer.select(F.lit("c").alias("leg"), F.col("c_custkey").alias("id")).unionByName(t.supplier.select(F.lit("s").alias("leg"), F.col("s_suppkey").alias("id")))


@query("g2_union", "SELECT c_nationkey AS n FROM customer UNION SELECT s_nationkey FROM supplier")
def _(t):
    return t.customer.select(F.col("c_nationkey").alias("n")).union(t.supplier.select("s_nationkey")).distinct()


@query("g3_array_union", "SELECT l_orderkey, array_to_string(list_sort(list_distinct(list_concat(list(l_returnflag), list(l_linestatus)))), '') AS merged FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.array_union(F.collect_set("l_returnflag"), F.collect_set("l_linestatus"))), "").alias("merged"))


@query("g5_set_difference", "(SELECT o_custkey AS k FROM orders WHERE year(o_orderdate) = 1996 EXCEPT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1997)")
def _(t):
    of = lambda y: t.orders.filter(F.year("o_orderdate") == y).select(F.col("o_custkey").alias("k"))
    return of(1996).subtract(of(1997))


@query("g6_intersect", "SELECT o_custkey AS k FROM orders WHERE year(o_orderdate) = 1996 INTERSECT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1997")
def _(t):
    of = lambda y: t.orders.filter(F.year("o_orderdate") == y).select(F.col("o_custkey").alias("k"))
    return of(1996).intersect(of(1997))


@query("g7_last_wins", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def _(t):
    from corpuslens.operators.ingest import last_wins

    return last_wins(t.events, "user_id", "event_id").select("user_id", "event_id")


@query("j18_span_merge", "WITH s AS (SELECT l_partkey AS k, l_orderkey % 500 AS a, l_orderkey % 500 + CAST(l_quantity AS BIGINT) AS b FROM lineitem), f AS (SELECT *, CASE WHEN a < max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM s), i AS (SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM f) SELECT k, min(a) AS a, max(b) AS b, count(*) AS n_spans FROM i GROUP BY k, g")
def _(t):
    s = t.lineitem.selectExpr("l_partkey AS k", "l_orderkey % 500 AS a", "l_orderkey % 500 + CAST(l_quantity AS BIGINT) AS b")
    return R.islands(s, ["k"], "a", "b")


@query(
    "h29_co_citation",
    "WITH e AS (SELECT DISTINCT l_orderkey AS d, l_partkey AS a FROM lineitem), c AS (SELECT a AS anchor, d FROM e WHERE a % 20 = 0 QUALIFY row_number() OVER (PARTITION BY a ORDER BY d) <= 500), n AS (SELECT anchor, a, count(*) AS n FROM e JOIN c USING (d) WHERE a <> anchor GROUP BY 1, 2), f AS (SELECT a, count(*) AS df FROM e GROUP BY 1), s AS (SELECT anchor, a, n, df, round(n / (n + 20) * ln((SELECT count(DISTINCT d) FROM e) / greatest(df, 1)), 9) AS score FROM n JOIN f USING (a)) SELECT anchor, a, n, df, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, a) <= 8",
)
def _(t):
    anchors = t.part.filter("p_partkey % 20 = 0").select(F.col("p_partkey").alias("anchor"))  # the query set
    return R.co_citation(t.lineitem, "l_orderkey", "l_partkey", anchors, least=1).withColumn("score", F.round("score", 6))
