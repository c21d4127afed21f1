"""Scalar functions: texts, keys, dates, vectors, JSON, arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions import text as X
from corpuslens.operators import relational as R
from corpuslens.operators import search as S
from corpuslens.plans.registry import query



def folded(x: str) -> str:
    """SQL of a folded text."""
    return f"translate(lower({x}), '{X.ACCENTED}', '{X.PLAIN}')"


def tok(x: str) -> str:
    """SQL of a text's tokens, folded."""
    return f"list_transform(regexp_extract_all({x}, '{X.TOKEN}'), lambda x: {folded('x')})"


STOP = "(" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + ")"


@query("i1_tokenise", f"SELECT doc_id, len({tok('text')}) AS n_tokens, md5(array_to_string({tok('text')}, ' ')) AS joined FROM documents")
def _(t):
    toks = X.tokens(F.col("text"))
    return t.documents.select("doc_id", F.size(toks).cast("long").alias("n_tokens"), F.md5(F.concat_ws(" ", toks)).alias("joined"))


@query("i2_fold", f"SELECT doc_id, md5({folded('text')}) AS folded FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(X.fold(F.col("text"))).alias("folded"))


@query("i3_fold_spaces", f"SELECT doc_id, md5(trim(regexp_replace(translate(lower(text), '{X.ACCENTED}’', '{X.PLAIN}'''), '\\s+', ' ', 'g'))) AS folded FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(X.fold_nfd(F.col("text"))).alias("folded"))


@query("i4_fold_stable", f"SELECT doc_id, length(text) = length(translate(lower(text), '{X.ACCENTED}œæ', '{X.PLAIN}oa')) AS same_length FROM documents")
def _(t):
    return t.documents.select("doc_id", (F.length("text") == F.length(X.fold_stable(F.col("text")))).alias("same_length"))


@query("i5_stopwords", f"SELECT doc_id, len(list_filter({tok('text')}, lambda x: x IN {STOP})) AS n_stop FROM documents")
def _(t):
    return t.documents.select("doc_id", F.size(F.filter(X.tokens(F.col("text")), X.is_stopword)).cast("long").alias("n_stop"))


@query(
    "i6_content_runs",
    f"SELECT item_id, count(*) AS n_runs, max(len(r)) AS longest FROM (SELECT item_id, unnest(list_filter(list_transform(string_split(array_to_string(list_transform({tok('text')}, lambda x: CASE WHEN x IN {STOP} THEN '#' ELSE x END), ' '), '#'), lambda s: list_filter(string_split(s, ' '), lambda w: w <> '')), lambda r: len(r) >= 2)) AS r FROM benchmark) GROUP BY item_id",
)
def _(t):
    runs = t.benchmark.select("item_id", F.explode(X.content_runs(X.tokens(F.col("text")), 2)).alias("r"))
    return runs.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_runs"), F.max(F.size("r")).cast("long").alias("longest"))


CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)<br\s*/?>', chr(10), 'g'), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@query("i7_clean_text", f"SELECT doc_id, md5({CLEAN}) AS cleaned, length({CLEAN}) AS n FROM documents")
def _(t):
    c = X.clean_text(F.col("text"))
    return t.documents.select("doc_id", F.md5(c).alias("cleaned"), F.length(c).cast("long").alias("n"))


@query("i8_initcap_spaces", "SELECT c_custkey, array_to_string(list_transform(string_split(lower(regexp_replace(c_mktsegment || ' of  ' || c_name, '\\s+', ' ', 'g')), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS label FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.initcap(F.regexp_replace(F.concat("c_mktsegment", F.lit(" of  "), "c_name"), r"\s+", " ")).alias("label"))


@query("i9_overlapping_matches", "SELECT doc_id, CAST((SELECT count(*) FROM generate_series(1, length(text) - 2) AS g(i) WHERE substr(text, i, 3) = 'ana' OR substr(text, i, 3) = 'ere') AS BIGINT) AS n FROM documents")
def _(t):
    return t.documents.select("doc_id", F.size(F.regexp_extract_all(F.col("text"), F.lit("(?=(ana|ere))"), F.lit(1))).cast("long").alias("n"))


@query("i10_caps_lock", "SELECT doc_id, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) >= 200 AND length(regexp_replace(text, '[^\\p{Lu}]', '', 'g')) >= 0.85 * length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS caps FROM documents")
def _(t):
    return t.documents.select("doc_id", X.caps_lock(F.col("text")).alias("caps"))


_NAME = "p_name || ' ' || p_type || ' / ' || p_brand"


@query("i13_slug", f"SELECT p_partkey, regexp_replace(regexp_replace(replace(replace({folded(_NAME)}, 'œ', 'oe'), 'æ', 'ae'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def _(t):
    return t.part.select("p_partkey", X.slug(F.expr(_NAME)).alias("slug"))


_NUMBERS = "CASE p_size % 5 WHEN 0 THEN 'L. ' || p_partkey || '-' || p_size WHEN 1 THEN 'R' || p_partkey || '-1' WHEN 2 THEN p_partkey || ' Bis' WHEN 3 THEN 'Annexe ' || p_size ELSE p_partkey || '/' || p_size END"


@query(
    "i14_article_key",
    f"SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({_NUMBERS}), '[^a-z0-9*()]+', '-', 'g'), '^-+', ''), '-+$', ''), '^(\\**)(lo|lp|l|r|d|a)-([0-9])', '\\1\\2\\3') AS key FROM part",
)
def _(t):
    return t.part.select("p_partkey", X.article_key(F.expr(_NUMBERS)).alias("key"))


@query("i17_summary_input", "SELECT doc_id, md5(CASE WHEN length(text) > 80000 THEN left(text, 56000) || chr(10) || '[...]' || chr(10) || right(text, 24000) ELSE text END) AS checksum FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(X.summary_input(F.col("text"))).alias("checksum"))


_MONTHS = "[" + ", ".join(f"'{m}'" for m in X.MONTHS) + "]"
_FRENCH = f"(CASE WHEN day(o_orderdate) = 1 THEN '1er' ELSE CAST(day(o_orderdate) AS VARCHAR) END || ' ' || {_MONTHS}[month(o_orderdate)] || ' ' || CAST(year(o_orderdate) AS VARCHAR))"


@query("i19_title", f"SELECT o_orderkey, 'Client ' || o_custkey || ', ' || {_FRENCH} || ', n° ' || o_orderkey AS title FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.concat(F.lit("Client "), F.concat_ws(", ", F.col("o_custkey").cast("string"), X.french_date(F.col("o_orderdate")), F.concat(F.lit("n° "), F.col("o_orderkey").cast("string")))).alias("title"))


@query("i21_url_host", "SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\\.', '') AS host FROM pages")
def _(t):
    return t.pages.select("page_id", X.host(F.col("url")).alias("host"))


@query("i22_snippet_head", "SELECT doc_id, CASE WHEN length(text) > 280 THEN left(text, 280) || '…' ELSE text END AS head FROM documents")
def _(t):
    return t.documents.select("doc_id", X.snippet_head(F.col("text")).alias("head"))


@query("i25_placeholder_names", "SELECT c_custkey, regexp_matches(c_name, '^[A-Z][a-z]+#0*[0-9]{1,3}$') AS masked FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.col("c_name").rlike("^[A-Z][a-z]+#0*[0-9]{1,3}$").alias("masked"))


@query("j1_parse_french_date", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS parsed FROM orders")
def _(t):
    return t.orders.select("o_orderkey", X.parse_french_date(X.french_date(F.col("o_orderdate"))).alias("parsed"))


@query("j2_format_french_date", f"SELECT o_orderkey, {_FRENCH} AS shown FROM orders")
def _(t):
    return t.orders.select("o_orderkey", X.french_date(F.col("o_orderdate")).alias("shown"))


@query("j3_year_range", "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n, min(o_orderkey) AS first_key FROM orders WHERE o_orderdate >= make_date(1996, 1, 1) AND o_orderdate < make_date(1999, 1, 1) GROUP BY 1")
def _(t):
    o = t.orders.filter("o_orderdate >= make_date(1996, 1, 1) AND o_orderdate < make_date(1999, 1, 1)")
    return o.groupBy(F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"))


@query("j4_date_window", "SELECT o_orderkey FROM orders WHERE (o_orderdate IS NULL OR o_orderdate <= DATE '1997-06-30') AND (o_orderdate + INTERVAL 90 DAY > DATE '1997-06-30')")
def _(t):
    at = F.lit("1997-06-30").cast("timestamp_ntz")
    return t.orders.filter((F.col("o_orderdate").isNull() | (F.col("o_orderdate") <= at)) & (F.col("o_orderdate") + F.expr("INTERVAL 90 DAY") > at)).select("o_orderkey")


@query("j5_lastmod_clamp", "SELECT o_custkey, CAST(least(coalesce(max(o_orderdate), TIMESTAMP '1970-01-01'), TIMESTAMP '2000-01-01') AS DATE) AS lastmod FROM orders GROUP BY o_custkey")
def _(t):
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    return t.orders.groupBy("o_custkey").agg(F.least(F.coalesce(F.max("o_orderdate"), day("1970-01-01")), day("2000-01-01")).cast("date").alias("lastmod"))


@query("j6_log_ceil", "SELECT p_partkey, CAST(least(ceil(2 * log2(p_size + 1)), 24) AS BIGINT) AS tf, round(ln(greatest(p_retailprice, 1)), 4) AS idf FROM part")
def _(t):
    return t.part.select("p_partkey", F.least(F.ceil(2 * F.log2(F.col("p_size") + 1)), F.lit(24)).cast("long").alias("tf"), F.round(F.log(F.greatest("p_retailprice", F.lit(1.0))), 4).alias("idf"))


@query("j7_cosine", "SELECT a.vec_id, b.vec_id AS query_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS cosine, round(sqrt(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))), 5) AS norm FROM embeddings a, embeddings b WHERE b.vec_id % 20 = 0")
def _(t):
    return S.cosines(R.spread(t.embeddings), t.embeddings.filter("vec_id % 20 = 0"))  # the query set


@query("j8_vector_literal", "SELECT vec_id, len(embedding) AS dim, md5('[' || array_to_string(list_transform(embedding, lambda x: printf('%.3f', x)), ',') || ']') AS lit FROM embeddings")
def _(t):
    lit = F.concat(F.lit("["), F.concat_ws(",", F.transform("embedding", lambda x: F.format_string("%.3f", x.cast("double")))), F.lit("]"))
    return t.embeddings.select("vec_id", F.size("embedding").cast("long").alias("dim"), F.md5(lit).alias("lit"))


@query("j10_query_prefix", "SELECT item_id, 'Instruct: retrieve passages' || chr(10) || 'Query: ' || text AS prompt FROM benchmark")
def _(t):
    return t.benchmark.select("item_id", F.concat(F.lit("Instruct: retrieve passages\nQuery: "), "text").alias("prompt"))


@query("j11_span_terms", "SELECT l_orderkey, unnest(list_distinct(flatten(list(['p' || l_partkey, 'p' || l_partkey || '|' || l_linenumber])))) AS term FROM lineitem GROUP BY l_orderkey")
def _(t):
    p = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    spans = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.array(p, F.concat_ws("|", p, F.col("l_linenumber").cast("string")))).alias("s"))
    return spans.select("l_orderkey", F.explode(F.array_distinct(F.flatten("s"))).alias("term"))


@query("j12_span_substring", "SELECT doc_id, substr(text, 11, 15) AS part FROM documents WHERE length(text) >= 25")
def _(t):
    return t.documents.filter(F.length("text") >= 25).select("doc_id", F.substring("text", 10 + 1, 25 - 10).alias("part"))


@query("j13_json_project", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("j14_rekey_element", "SELECT l_orderkey, sum(CASE WHEN l_partkey % 7 = 0 THEN l_partkey + 1000000 ELSE l_partkey END) AS total FROM lineitem GROUP BY l_orderkey")
def _(t):
    spans = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_partkey", "l_linenumber")).alias("s"))
    rekeyed = F.transform("s", lambda x: F.when(x["l_partkey"] % 7 == 0, x.withField("l_partkey", x["l_partkey"] + 1_000_000)).otherwise(x))
    return spans.select("l_orderkey", F.aggregate(rekeyed, F.lit(0).cast("long"), lambda a, x: a + x["l_partkey"]).alias("total"))


@query("j15_array_ops", "SELECT doc_id, len(w) AS n, list_position(w, w[len(w)]) AS last_at, len(list_filter(w, lambda x: x <> w[1])) AS others FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)")
def _(t):
    d = t.documents.select("doc_id", F.split("text", " ").alias("w"))
    return d.select("doc_id", F.size("w").cast("long").alias("n"), F.array_position("w", F.element_at("w", -1)).cast("int").alias("last_at"), F.size(F.array_remove("w", F.element_at("w", 1))).cast("long").alias("others"))


@query("j16_sibling_family", "SELECT p_brand, p_partkey AS anchor, len(fam) AS n FROM (SELECT p_brand, p_partkey, list_filter(list(p_partkey) OVER (PARTITION BY p_brand), lambda x: x >= p_partkey AND x < p_partkey + 100) AS fam FROM part) WHERE len(fam) BETWEEN 2 AND 20")
def _(t):
    from pyspark.sql import Window

    sib = t.part.select("p_brand", F.col("p_partkey").alias("anchor"), F.count(F.lit(1)).over(Window.partitionBy("p_brand").orderBy("p_partkey").rangeBetween(0, 99)).alias("n"))
    return sib.filter("n BETWEEN 2 AND 20")


@query("j19_checksums", "SELECT doc_id, md5(text) AS m, sha256(text) AS s FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5("text").alias("m"), F.sha2("text", 256).alias("s"))


@query("j20_significance", "SELECT o_orderkey, CASE WHEN list_has_any(codes, ['1-URGENT']) THEN 'major' WHEN list_has_any(codes, ['2-HIGH', '3-MEDIUM']) THEN 'notable' ELSE 'limited' END AS grade FROM (SELECT o_orderkey, [o_orderpriority, o_orderstatus] AS codes FROM orders)")
def _(t):
    codes = F.array("o_orderpriority", "o_orderstatus")
    has = lambda *c: F.arrays_overlap(codes, F.array(*map(F.lit, c)))
    return t.orders.select("o_orderkey", F.when(has("1-URGENT"), "major").when(has("2-HIGH", "3-MEDIUM"), "notable").otherwise("limited").alias("grade"))


def _tri(x: str) -> str:
    return f"list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: substr('  ' || w || ' ', CAST(i AS BIGINT), 3)))))"


@query(
    "h34_trigram_suggest",
    f"WITH p AS (SELECT DISTINCT p_name FROM part), s AS (SELECT p_name, {_tri('p_name')} AS a, {_tri(chr(39) + 'smal rings' + chr(39))} AS b FROM p) SELECT p_name, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS sim FROM s WHERE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) > 0.4",
)
def _(t):
    names = t.part.select("p_name").distinct()
    sim = X.trigram_similarity(F.col("p_name"), F.lit("smal rings"))
    return names.select("p_name", F.round(sim, 6).alias("sim")).filter(sim > 0.4)


STRIP = r"regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', '', 'g')"
STRIP = rf"regexp_replace(regexp_replace({STRIP}, '(?i)</?(?:p|br|div|li|tr|h[1-6]|article|section|ul|ol|table|nav|footer)[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g')"
for _n, _c in (("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&copy;", "'©'"), ("&middot;", "'·'"), ("&amp;", "'&'")):
    STRIP = f"replace({STRIP}, '{_n}', {_c})"
STRIP = rf"regexp_replace(regexp_replace(regexp_replace({STRIP}, '[ \t]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"


@query("a21_strip_html", f"SELECT page_id, md5({STRIP}) AS plain, length({STRIP}) AS n FROM pages")
def _(t):
    s = X.strip_html(F.col("html"))
    return t.pages.select("page_id", F.md5(s).alias("plain"), F.length(s).cast("long").alias("n"))
