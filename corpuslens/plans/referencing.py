"""Texts, references, linking, entities and state: operators on whole tables, each against its SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions import text as X
from corpuslens.operators import chunking, texts
from corpuslens.operators import decisions as D
from corpuslens.operators import relational as R
from corpuslens.operators import trees
from corpuslens.plans.extracting import decisions
from corpuslens.plans.registry import n_rows, query


def _each(rows: DataFrame, key: str, column: str, function, kind: str = "string") -> DataFrame:
    """key and ``out``: a Python function of one column, in Arrow batches."""

    @F.pandas_udf(kind)
    def apply(values: pd.Series) -> pd.Series:
        return values.map(function)

    return rows.select(key, apply(column).alias("out"))


# texts

_NATURES = ["CODE", "CODE_RURAL", "CONSTITUTION", "DIRECTIVE", "TRAITE", "LOI", "DECRET", "ARRETE", "ACCORD", "CIRCULAIRE", "BOFIP", "AVIS"]
_NATURE = "list_element([" + ", ".join(f"'{n}'" for n in _NATURES) + "], CAST(p_partkey % 12 + 1 AS INTEGER))"


@query("c9_classifier", f"SELECT p_partkey, CASE WHEN n LIKE 'CODE%' OR n = 'CONSTITUTION' THEN 'codes' WHEN j = 'UE' OR n = 'DIRECTIVE' THEN 'textes-ue' WHEN j = 'INTL' OR n = 'TRAITE' THEN 'traites' WHEN n = 'LOI' THEN 'lois' WHEN n = 'DECRET' THEN 'decrets' WHEN n = 'ARRETE' THEN 'arretes' WHEN n = 'ACCORD' THEN 'conventions-collectives' WHEN n = 'CIRCULAIRE' THEN 'circulaires' WHEN n = 'BOFIP' THEN 'bofip' ELSE 'autres' END AS collection FROM (SELECT p_partkey, {_NATURE} AS n, CASE p_size % 10 WHEN 0 THEN 'UE' WHEN 1 THEN 'INTL' WHEN 2 THEN 'FR' END AS j FROM part)")
def _(t):
    nature = F.element_at(F.array(*map(F.lit, _NATURES)), (F.col("p_partkey") % 12 + 1).cast("int"))
    place = F.when(F.col("p_size") % 10 == 0, "UE").when(F.col("p_size") % 10 == 1, "INTL").when(F.col("p_size") % 10 == 2, "FR")
    return t.part.select("p_partkey", X.collection(nature, place).alias("collection"))


@query("i11_truecase", "SELECT p_partkey, repeat(upper(left(p_name, 1)) || substr(p_name, 2) || '. ', 40) AS out FROM part")
def _(t):
    loud = t.part.select("p_partkey", F.repeat(F.concat(F.upper("p_name"), F.lit(". ")), F.lit(40)).alias("x"))
    return _each(loud, "p_partkey", "x", texts.truecase)


@query("i12_collocations", "SELECT p_partkey, '0-' || n || ' ' || n + 1 || '-' || 2 * n + 1 AS out FROM (SELECT p_partkey, len(string_split(p_name, ' ')) AS n FROM part)")
def _(t):
    lexicon = {tuple(r.p_name.split()) for r in t.part.select("p_name").distinct().collect()}  # a curated lexicon is a parameter; names are few
    found = lambda x: " ".join(f"{a}-{b}" for a, b in texts.collocations(x.split(), lexicon))
    return _each(t.part.select("p_partkey", F.concat_ws(" x ", "p_name", "p_name").alias("x")), "p_partkey", "x", found)


@query("i15_normalised_article", "SELECT l_orderkey, l_linenumber, 'L. ' || l_partkey || '-' || l_suppkey || '.' || l_linenumber AS article FROM lineitem")
def _(t):
    raw = F.concat(F.lit(" L.  "), F.col("l_partkey"), F.lit(" – "), F.col("l_suppkey"), F.lit(" . "), F.col("l_linenumber"), F.lit(" ;)"))
    return t.lineitem.select("l_orderkey", "l_linenumber", X.normalise_article(raw).alias("article"))


@query("i18_summary_clean", "SELECT p_partkey, 'La société vend ' || p_name || ' à M. W Y.' AS cleaned FROM part")
def _(t):
    raw = F.concat(F.lit("[Décision] cour, 2020-01-02, n° "), F.col("p_partkey").cast("string"), F.lit("\nà [Localité 6], la société [7] vend "), "p_name", F.lit(" à M. [W] [Y]  ."))
    return t.part.select("p_partkey", X.clean_summary(raw).alias("cleaned"))


@query("i20_labels", "SELECT o_orderstatus AS code, CASE o_orderstatus WHEN 'O' THEN 'Cour de cassation' WHEN 'F' THEN 'Cour d''appel de Paris' ELSE 'Tribunal administratif d''Amiens' END AS label, count(*) AS n FROM orders GROUP BY ALL")
def _(t):
    code = F.when(F.col("o_orderstatus") == "O", "cc").when(F.col("o_orderstatus") == "F", "ca:paris").otherwise("ta:amiens")
    return t.orders.groupBy(F.col("o_orderstatus").alias("code"), D.court_label(code).alias("label")).agg(n_rows().alias("n"))


@query("i23_adjacent_repeats", "SELECT p_partkey, p_name AS name FROM part")
def _(t):
    doubled = F.array_join(F.transform(F.split("p_name", " "), lambda w: F.concat_ws(" ", w, w, w)), " ")
    return t.part.select("p_partkey", X.collapse_repeats(doubled).alias("name"))


@query("i24_prefix_variants", "SELECT p_partkey, p_name || ' bis|other' AS out FROM part")
def _(t):
    values = F.concat_ws("|", F.upper("p_name"), "p_name", F.concat("p_name", F.lit(" bis")), F.lit("other"))
    return _each(t.part.select("p_partkey", values.alias("x")), "p_partkey", "x", lambda x: "|".join(texts.without_prefix_variants(x.split("|"))))


@query("j9_deterministic_embedding", "SELECT p_partkey, 64 AS dim, 1.0 AS norm FROM part")
def _(t):
    from corpuslens.functions.udfs import embed

    rows = t.part.select("p_partkey", embed("p_name").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return rows.select("p_partkey", F.size("v").cast("long").alias("dim"), F.round(norm, 4).alias("norm"))


@query("j17_range_expansion", "SELECT o_orderkey, 'L. ' || o_custkey || '-' || unnest(generate_series(o_orderkey % 20 + 1, o_orderkey % 20 + o_orderkey % 5)) AS key FROM orders")
def _(t):
    stem, low = F.concat(F.lit("L. "), F.col("o_custkey"), F.lit("-")), F.col("o_orderkey") % 20
    keys = X.range_keys(F.concat(stem, low), F.concat(stem, low + F.col("o_orderkey") % 5 + 1))
    return t.orders.select("o_orderkey", F.explode(keys).alias("key"))


@query("j21_tokens_of_chars", "SELECT doc_id, CAST(ceil(n_chars / 3.2) AS BIGINT) AS safe, CAST(ceil(n_chars / 3.41) AS BIGINT) AS median FROM documents")
def _(t):
    of = lambda rate: F.ceil(F.col("n_chars") / F.lit(rate)).cast("long")
    return t.documents.select("doc_id", of(chunking.SAFE_CHARS).alias("safe"), of(chunking.MEDIAN_CHARS).alias("median"))


@query("k2_chunker_tokens")
def _(t):
    import public_tokenizers

    return chunking.chunk_documents(t.documents, chunk_tokens=512, overlap_min=20, overlap_max=60, tokenizer_file=str(public_tokenizers.path("byte_bpe_50k.json"))).drop("body")


_CUT = "left(text, greatest(length(text) - 1, 0))"
_OFF = "length({0}) - length(replace({0}, '{1}', ''))"


@query("k3_separator_candidates", f"SELECT doc_id, {_OFF.format('x', chr(10))} - len(regexp_extract_all(x, '\\n+')) AS p0, len(regexp_extract_all(x, '\\n+')) AS p1, (length(x) - length(replace(x, '. ', ''))) // 2 AS p3, {_OFF.format('x', '.')} AS p5, {_OFF.format('x', ';')} AS p7, {_OFF.format('x', ',')} AS p9 FROM (SELECT doc_id, {_CUT} AS x FROM documents)")
def _(t):
    return t.documents.select("doc_id", X.separator_counts(F.col("text")).alias("c")).select("doc_id", "c.*")


@query("k6_sections", "SELECT o_orderkey AS id, unnest(['visa', 'dispositif']) AS kind, unnest([length('Vu l''article L. 1231-1 du code du travail ;') + 1, length('PAR CES MOTIFS :') + 1 + length(CASE o_orderpriority WHEN '1-URGENT' THEN 'CASSE ET ANNULE l''arrêt ; ordonne une expertise' WHEN '2-HIGH' THEN 'REJETTE le pourvoi' WHEN '3-MEDIUM' THEN 'DONNE ACTE DU DÉSISTEMENT' WHEN '4-NOT SPECIFIED' THEN 'CONFIRME le jugement ; ordonne la radiation' ELSE 'Dit qu''il n''y a pas lieu de statuer' END)]) AS n FROM orders")
def _(t):
    rows = decisions(t).select("id", F.explode(D.sections(D.folded(F.col("text")))).alias("s"))
    return rows.filter("s.kind IN ('visa', 'dispositif')").select("id", "s.kind", (F.col("s.char_end") - F.col("s.char_start")).cast("long").alias("n"))


@query("k7_visa_trim", "SELECT doc_id, length(CASE WHEN length(x) <= 1705 THEN x WHEN regexp_extract(left(x, 1705), '(?s)^(.+)\\n\\n', 1) <> '' THEN regexp_extract(left(x, 1705), '(?s)^(.+)\\n\\n', 1) ELSE left(x, 1705) END) AS n FROM (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS x FROM documents)")
def _(t):
    spaced = t.documents.select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("x"))
    return spaced.select("doc_id", F.length(X.visa_trim(F.col("x"))).cast("long").alias("n"))


@query("k8_reference_tokens", "SELECT o_orderkey, unnest(['L_' || o_custkey + 10 || '_1', 'CSP_L_' || o_custkey + 10 || '_1', 'R_' || o_orderkey + 10]) AS ref FROM orders")
def _(t):
    text = F.concat(F.lit("Vu l'article L. "), F.col("o_custkey") + 10, F.lit("-1 du code de la santé publique ; vu R."), F.col("o_orderkey") + 10, F.lit(" et encore l. "), F.col("o_custkey") + 10, F.lit("‑1 du code de la santé publique."))
    return t.orders.select("o_orderkey", F.explode(X.reference_tokens(text)).alias("ref"))


@query("k22_domain_cascade", "SELECT doc_id, coalesce(CASE WHEN contains(text, '***') THEN 'symbols' END, CASE WHEN regexp_matches(text, '\\b(?:the|of)\\b') THEN 'english' END, CASE lang WHEN 'fr' THEN 'french' END, 'other') AS domain FROM documents")
def _(t):
    x = F.col("text")
    d = F.coalesce(F.when(x.contains("***"), "symbols"), F.when(x.rlike(r"\b(?:the|of)\b"), "english"), F.when(F.col("lang") == "fr", "french"), F.lit("other"))
    return t.documents.select("doc_id", d.alias("domain"))


@query("k35_link_verbs", "SELECT l_returnflag AS flag, CASE l_linenumber % 4 WHEN 0 THEN 'modifie' WHEN 1 THEN 'abroge' WHEN 2 THEN 'transpose' ELSE 'autre_lien' END AS verb, count(*) AS n FROM lineitem GROUP BY ALL")
def _(t):
    kind = F.element_at(F.array(*map(F.lit, ("MODIFICATION", "ABROGE", "TRANSPOSITION", "AUTRE_LIEN"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return t.lineitem.groupBy(F.col("l_returnflag").alias("flag"), X.link_verb(kind).alias("verb")).agg(n_rows().alias("n"))


_ALIASES = {"thou": "you", "nicht": "not", "les": "the", "que": "that", "of": "from", "und": "and"}
_HELD = ", ".join(f"CASE WHEN regexp_matches(q, '(^|[^\\p{{L}}\\p{{N}}]){a}($|[^\\p{{L}}\\p{{N}}])') THEN '{x}' END" for a, x in _ALIASES.items())


@query("h26_query_expansion", f"SELECT item_id, array_to_string(list_slice(list_filter([{_HELD}], lambda x: x IS NOT NULL), 1, 4), '|') AS expansions, trim(regexp_replace(t, '[^\\p{{L}}\\p{{N}}-]+', ' ', 'g')) AS title FROM (SELECT item_id, text AS t, lower(text) AS q FROM benchmark)")
def _(t):
    query_text = F.concat(F.lit("Article "), "text")
    return t.benchmark.select("item_id", F.array_join(X.expansions(F.col("text"), _ALIASES), "|").alias("expansions"), X.title_query(query_text).alias("title"))


@query("h14_empty_query", "SELECT p_partkey, p_size % 3 = 0 AS lacks FROM part")
def _(t):
    q = F.when(F.col("p_size") % 3 == 0, "de la, et des").when(F.col("p_size") % 3 == 1, F.col("p_name")).otherwise(F.concat(F.lit("le "), "p_name"))
    return t.part.select("p_partkey", (F.size(X.content_tokens(q)) == 0).alias("lacks"))


@query("h19_snippets")
def _(t):
    """Best fragment of each document for a query, over pages of twenty documents."""

    def run(page: pa.Table) -> pa.Table:
        ids = page.column("doc_id").combine_chunks()
        found = texts.highlight([(n, text or "") for n, text in enumerate(page.column("text").to_pylist())], "thou tion onre")  # by row: ids may repeat
        return pa.table({"doc_id": ids.take(pa.array(list(found), pa.int64())), "snippet": pa.array(list(found.values()), pa.string())})

    paged = t.documents.select("doc_id", "text", F.floor(F.col("doc_id") / 20).alias("page"))
    return paged.groupBy("page").applyInArrow(lambda f: run(f), "doc_id long, snippet string")


@query("h20_cache_key", "SELECT item_id, md5('{\"q\":\"' || trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) || '\",\"limit\":20,\"offset\":0}') AS key FROM benchmark")
def _(t):
    from corpuslens.plans.services import cache_key

    return t.benchmark.select("item_id", cache_key(F.col("text")).alias("key"))


@query("c17_request_validation", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'not a date' WHEN o_orderkey % 5 = 1 THEN 'date out of range' ELSE 'ok' END AS verdict FROM orders")
def _(t):
    from corpuslens.plans.services import date_verdict

    day = F.when(F.col("o_orderkey") % 5 == 0, "2020-13-45").when(F.col("o_orderkey") % 5 == 1, "1600-01-01").when(F.col("o_orderkey") % 5 == 2, F.lit(None)).otherwise(F.col("o_orderdate").cast("date").cast("string"))
    return t.orders.select("o_orderkey", date_verdict(day).alias("verdict"))


# relations

@query("f6_unordered_number", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) AS ord FROM events")
def _(t):
    order = Window.partitionBy("user_id").orderBy(F.md5(F.col("event_id").cast("string")), "event_id")
    return t.events.select("event_id", F.row_number().over(order).cast("long").alias("ord"))


@query("g4_facet_members", "SELECT kind, nation, count(*) AS n FROM (SELECT 'c' AS kind, c_nationkey AS nation FROM customer UNION ALL SELECT 's', s_nationkey FROM supplier UNION ALL SELECT 'n', n_nationkey FROM nation) GROUP BY GROUPING SETS ((kind), (nation), ())")
def _(t):
    leg = lambda rows, kind, column: rows.select(F.lit(kind).alias("kind"), F.col(column).alias("nation"))
    every = leg(t.customer, "c", "c_nationkey").unionAll(leg(t.supplier, "s", "s_nationkey")).unionAll(leg(t.nation, "n", "n_nationkey"))
    return every.groupingSets([("kind",), ("nation",), ()], "kind", "nation").agg(n_rows().alias("n"))


@query("d25_join_strategies", "SELECT n_name, count(*) AS n, sum(CASE WHEN o_orderkey IS NULL THEN 1 ELSE 0 END) AS without FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(t):
    """The dimension of fixed size is broadcast; the two large sides are merged on their key, where a skewed key can be split."""
    named = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    both = named.hint("merge").join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left")
    return both.groupBy("n_name").agg(n_rows().alias("n"), F.sum(F.when(F.col("o_orderkey").isNull(), 1).otherwise(0)).alias("without"))


_FAMILIES = [("o_orderkey % 10 = 0", "concat('CE:', o_custkey % 900)"), ("o_orderkey % 10 = 1", "concat('CAA:', o_custkey % 50, '|', o_orderkey % 90)"), ("o_orderkey % 10 = 2", "concat('CC:', o_orderkey % 5000)"), ("o_orderkey % 10 IN (3, 4)", "concat('CA:', o_orderstatus, '|', o_custkey)"), ("o_orderkey % 10 = 5", "concat('TA:', replace(o_orderpriority, '-', ''), '|', o_custkey)"), ("o_orderkey % 10 IN (6, 7)", "concat('ECLI:', o_custkey % 3000)"), ("o_orderkey % 10 > 7", "concat('CJUE:', substr(o_orderpriority, 1, 1), o_custkey)")]


@query("d10_composite_keys", "WITH k AS (" + " UNION ALL ".join(f"SELECT {key} AS key, o_orderkey AS d FROM orders WHERE {where}" for where, key in _FAMILIES) + ") SELECT key, min(d) AS target FROM k GROUP BY key HAVING count(DISTINCT d) = 1")
def _(t):
    legs = [t.orders.filter(where).selectExpr(f"{key} AS key", "o_orderkey AS d") for where, key in _FAMILIES]
    every = legs[0]
    for leg in legs[1:]:
        every = every.unionAll(leg)
    return every.groupBy("key").agg(F.countDistinct("d").alias("n"), F.min("d").alias("target")).filter("n = 1").drop("n")


_RULES = [["p_name"], ["p_name", "p_brand"], ["p_name", "p_type"], ["p_name", "p_size"], ["p_brand", "p_type", "p_size"], ["p_name", "p_brand", "p_type"], ["p_name", "p_brand", "p_size"], ["p_name", "p_type", "p_size"], ["p_name", "p_brand", "p_type", "p_size"]]


def _cascade_sql() -> str:
    ctes = ", ".join(f"r{k} AS (SELECT {', '.join(keys)}, min(p_partkey) AS t FROM part GROUP BY {', '.join(keys)} HAVING count(*) = 1)" for k, keys in enumerate(_RULES))
    joins = " ".join(f"LEFT JOIN r{k} ON " + " AND ".join(f"r{k}.{c} = p.{c}" for c in keys) for k, keys in enumerate(_RULES))
    rule = " ".join(f"WHEN r{k}.t IS NOT NULL THEN {k + 1}" for k in range(len(_RULES)))
    return f"WITH {ctes} SELECT p.p_partkey AS id, coalesce({', '.join(f'r{k}.t' for k in range(len(_RULES)))}) AS target, CASE {rule} END AS rule FROM part p {joins}"


@query("k10_linking_cascade", _cascade_sql())
def _(t):
    cited = t.part.select(F.col("p_partkey").alias("id"), "p_name", "p_brand", "p_type", "p_size")
    return R.cascade(cited, t.part.withColumnRenamed("p_partkey", "target"), _RULES, "target").select("id", "target", "rule")


_NUM = "CASE p_partkey % 5 WHEN 0 THEN 'l' WHEN 1 THEN 'r' WHEN 2 THEN '*r' WHEN 3 THEN '*' ELSE '' END || p_size || '-' || p_partkey % 7"
_CITED = "CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'l' ELSE 'r' END || p_size || '-' || p_partkey % 7"


@query("k11_existence_variants", f"""
    WITH c AS (SELECT DISTINCT p_brand AS uid, {_NUM} AS k FROM part), q AS (SELECT p_partkey AS id, p_brand AS uid, {_CITED} AS num FROM part)
    SELECT q.id, coalesce(
        (SELECT min(k) FROM c WHERE c.uid = q.uid AND k = num), (SELECT min(k) FROM c WHERE c.uid = q.uid AND k = '*' || num),
        (SELECT CASE WHEN count(*) = 1 THEN min(k) END FROM c WHERE c.uid = q.uid AND k IN ('l' || num, 'r' || num, 'd' || num, 'a' || num) AND regexp_matches(num, '^[0-9].*-')),
        (SELECT CASE WHEN count(*) = 1 THEN min(k) END FROM c WHERE c.uid = q.uid AND regexp_extract(k, '[0-9].*$') = regexp_extract(num, '[0-9].*$'))) AS num_key FROM q""")
def _(t):
    choice = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("p_partkey") % n + 1).cast("int"))
    tail = F.concat(F.col("p_size").cast("string"), F.lit("-"), (F.col("p_partkey") % 7).cast("string"))
    catalogue = t.part.select(F.col("p_brand").alias("uid"), F.concat(choice(["l", "r", "*r", "*", ""], 5), tail).alias("num_key"))
    cited = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("uid"), F.concat(choice(["", "l", "r"], 3), tail).alias("num"))
    return R.existing_article(cited, catalogue).select("id", "num_key")


# A register with unique and ambiguous names, and mentions of its entities in six spellings.
_ENTITY = "CASE c_custkey % 5 WHEN 0 THEN 'Alpha ' || c_custkey WHEN 1 THEN 'SA Beta ' || c_custkey WHEN 2 THEN 'Gamma ' || c_custkey % 200 WHEN 3 THEN c_mktsegment || ' Delta' || c_custkey % 300 ELSE 'Omega Un Deux ' || c_custkey END"
_FIRM = "trim(regexp_replace(regexp_replace(lower({0}), '\\b(sa|sarl)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("k27_entity_resolution", f"""
    WITH r AS (SELECT c_custkey AS uid, {_ENTITY} AS name, c_nationkey AS place FROM customer),
    e AS (SELECT *, {_FIRM.format('name')} AS firm, list_extract(string_split({_FIRM.format('name')}, ' '), -1) AS last FROM r),
    q AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 1 THEN 'SARL ' || substr({_ENTITY}, 4) WHEN c_custkey % 5 = 3 THEN 'Maison Delta' || c_custkey % 300 WHEN c_custkey % 5 = 4 THEN 'Deux Omega ' || c_custkey || ' Un' ELSE {_ENTITY} END AS name, c_nationkey AS place FROM customer),
    p AS (SELECT *, {_FIRM.format('name')} AS firm, list_extract(string_split({_FIRM.format('name')}, ' '), -1) AS last FROM q),
    s1 AS (SELECT name, min(uid) AS u FROM e GROUP BY 1 HAVING count(*) = 1), s2 AS (SELECT firm, min(uid) AS u FROM e GROUP BY 1 HAVING count(*) = 1),
    s3 AS (SELECT firm, place, min(uid) AS u FROM e GROUP BY 1, 2 HAVING count(*) = 1), s4 AS (SELECT last, min(uid) AS u FROM e GROUP BY 1 HAVING count(*) = 1),
    s5 AS (SELECT last, place, min(uid) AS u FROM e GROUP BY 1, 2 HAVING count(*) = 1),
    five AS (SELECT p.id, p.firm, coalesce(s1.u, s2.u, s3.u, s4.u, s5.u) AS uid, CASE WHEN s1.u IS NOT NULL THEN 1 WHEN s2.u IS NOT NULL THEN 2 WHEN s3.u IS NOT NULL THEN 3 WHEN s4.u IS NOT NULL THEN 4 WHEN s5.u IS NOT NULL THEN 5 END AS stage
        FROM p LEFT JOIN s1 USING (name) LEFT JOIN s2 USING (firm) LEFT JOIN s3 ON s3.firm = p.firm AND s3.place = p.place LEFT JOIN s4 ON s4.last = p.last LEFT JOIN s5 ON s5.last = p.last AND s5.place = p.place),
    w AS (SELECT id, unnest(list_distinct(string_split(firm, ' '))) AS tok FROM five WHERE uid IS NULL), n AS (SELECT id, count(*) AS n FROM w GROUP BY 1), v AS (SELECT uid, unnest(list_distinct(string_split(firm, ' '))) AS tok FROM e),
    fits AS (SELECT w.id, v.uid FROM w JOIN v USING (tok) JOIN n ON n.id = w.id GROUP BY w.id, v.uid, n.n HAVING count(*) = n.n), s6 AS (SELECT id, min(uid) AS u FROM fits GROUP BY 1 HAVING count(*) = 1)
    SELECT five.id, coalesce(five.uid, s6.u) AS uid, coalesce(stage, CASE WHEN s6.u IS NOT NULL THEN 6 END) AS stage FROM five LEFT JOIN s6 ON s6.id = five.id""")
def _(t):
    register = t.customer.selectExpr("c_custkey AS uid", f"{_ENTITY} AS name", "c_nationkey AS place")
    spelled = f"CASE WHEN c_custkey % 5 = 1 THEN 'SARL ' || substr({_ENTITY}, 4) WHEN c_custkey % 5 = 3 THEN 'Maison Delta' || c_custkey % 300 WHEN c_custkey % 5 = 4 THEN 'Deux Omega ' || c_custkey || ' Un' ELSE {_ENTITY} END AS name"
    return R.resolve_entities(t.customer.selectExpr("c_custkey AS id", spelled, "c_nationkey AS place"), register, D.party_key)


@query("k28_registry_load", "SELECT 'c' AS namespace, c_custkey AS uid, c_name AS name, 'customer-' || right(c_name, 9) AS slug, lower(c_name) AS key FROM customer UNION ALL SELECT 's', s_suppkey, s_name, 'supplier-' || right(s_name, 9), lower(s_name) FROM supplier")
def _(t):
    load = lambda rows, kind, uid, name: rows.select(F.lit(kind).alias("namespace"), F.col(uid).alias("uid"), F.col(name).alias("name"), X.slug(F.col(name)).alias("slug"), D.party_key(F.col(name)).alias("key"))
    return load(t.customer, "c", "c_custkey", "c_name").unionAll(load(t.supplier, "s", "s_suppkey", "s_name"))


# identity and state

@query("k31_split_execution", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' AND l_orderkey % 3 <> 0 THEN 1000000000 + l_orderkey ELSE l_orderkey END AS canonical FROM lineitem")
def _(t):
    """Provenances of a group move to a new canonical row, unless they have moved before (every third one has)."""
    new = F.lit(1_000_000_000) + F.col("l_orderkey")
    moved = (F.col("l_returnflag") == "R") & (F.col("l_orderkey") % 3 != 0)
    return t.lineitem.select("l_orderkey", "l_linenumber", F.when(moved, new).otherwise(F.col("l_orderkey")).alias("canonical"))


@query("k32_canonical_rebuild", "SELECT 'JURI' || o_orderkey AS source_uid, CAST(o_orderdate AS DATE) AS read_on, o_orderpriority AS title, length('Texte ' || o_orderkey) AS n FROM orders")
def _(t):
    """Decisions from what is stored: text, fields as JSON, uid."""
    fields = F.to_json(F.struct(F.struct(F.col("o_orderdate").cast("date").cast("string").alias("Date_Lecture"), F.col("o_orderpriority").alias("Titre")).alias("Dossier")))
    stored = t.orders.select(F.concat(F.lit("JURI"), "o_orderkey").alias("source_uid"), fields.alias("source_fields"), F.concat(F.lit("Texte "), "o_orderkey").alias("full_text"))
    return D.from_storage(stored).select("source_uid", "read_on", "title", F.length("full_text").cast("long").alias("n"))


@query("k34_unmerge_same_source", "SELECT l_orderkey AS canonical, l_suppkey AS source, l_linenumber AS uid, CASE WHEN row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber) = 1 THEN 'stays' ELSE 'alone' END AS fate FROM lineitem WHERE (l_orderkey, l_suppkey) IN (SELECT (l_orderkey, l_suppkey) FROM lineitem GROUP BY l_orderkey, l_suppkey HAVING count(*) > 1)")
def _(t):
    w = Window.partitionBy("canonical", "source")
    rows = t.lineitem.select(F.col("l_orderkey").alias("canonical"), F.col("l_suppkey").alias("source"), F.col("l_linenumber").alias("uid"))
    numbered = rows.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("rn", F.row_number().over(w.orderBy("uid")))
    return numbered.filter("n > 1").select("canonical", "source", "uid", F.when(F.col("rn") == 1, "stays").otherwise("alone").alias("fate"))


@query("l3_state_lookup", "SELECT e.event_id, o.o_orderstatus AS status, o.o_orderkey IS NOT NULL AS known FROM events e LEFT JOIN orders o ON o.o_orderkey = e.event_id * 4")
def _(t):
    state = t.orders.select(F.col("o_orderkey").alias("uid"), F.col("o_orderstatus").alias("status"), F.lit(True).alias("known"))
    return t.events.select("event_id", (F.col("event_id") * 4).alias("uid")).join(state, "uid", "left").select("event_id", "status", F.coalesce("known", F.lit(False)).alias("known"))


@query("l8_parallel_reextract", "SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'cassation' WHEN '2-HIGH' THEN 'rejet' WHEN '3-MEDIUM' THEN 'desistement' WHEN '4-NOT SPECIFIED' THEN 'confirmation' WHEN '5-LOW' THEN 'non_lieu' END AS outcome, 2 AS version FROM orders WHERE o_orderstatus = 'P'")
def _(t):
    """Documents of an older version are read anew; others aren't touched."""
    version = t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", 1).otherwise(2).alias("version"))
    stale = decisions(t).join(version.filter("version < 2"), "id", "left_semi")
    return D.fields(stale, "id", "text").select("id", "outcome", F.lit(2).alias("version"))


@query("m1_citation_terms", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'T' || o_custkey || ',T' || o_custkey || '|l' || o_orderkey ELSE 'T' || o_custkey END AS terms FROM orders")
def _(t):
    from corpuslens.functions.udfs import register

    register(t.spark)
    terms = F.call_function("citation_terms", F.concat(F.lit("T"), "o_custkey"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("l"), "o_orderkey")))
    return t.orders.select("o_orderkey", F.array_join(terms, ",").alias("terms"))


@query("m3_following_keys", "SELECT n_nationkey, unnest(['l' || n_nationkey || '-2', 'l' || n_nationkey || '-3']) AS key FROM nation")
def _(t):
    from corpuslens.functions.udfs import register

    register(t.spark)
    t.nation.createOrReplaceTempView("nation")
    keys = "transform(sequence(1, 3), i -> 'l' || n_nationkey || '-' || i)"
    return t.spark.sql(f"SELECT n_nationkey, f.key FROM nation, LATERAL following_keys({keys}, 'l' || n_nationkey || '-2') AS f")


@query("m4_sync_arrays", "SELECT o_orderkey, list_sort(list(DISTINCT l_suppkey)) AS suppliers FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' GROUP BY 1")
def _(t):
    ids = t.orders.filter("o_orderstatus = 'P'").select("o_orderkey")
    lines = t.lineitem.join(ids, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.groupBy("o_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("suppliers"))


@query("m5_denormalised_columns", "SELECT l_orderkey, l_linenumber, o_orderstatus AS status, o_custkey AS owner FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def _(t):
    """What a change of a document writes to its chunks: only rows whose copies differ are written again."""
    copies = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, F.col("o_orderstatus")).alias("status"), F.col("o_custkey").alias("owner"))
    now = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("s"), F.col("o_custkey").alias("o"))
    differs = ~(F.col("status").eqNullSafe(F.col("s")) & F.col("owner").eqNullSafe(F.col("o")))
    return copies.join(now, "l_orderkey").select("l_orderkey", "l_linenumber", F.when(differs, F.col("s")).otherwise(F.col("status")).alias("status"), F.when(differs, F.col("o")).otherwise(F.col("owner")).alias("owner"))


@query("m6_table_functions", "SELECT event_id, pos, CAST(k AS BIGINT) AS k FROM (SELECT event_id, unnest([1, 2]) AS pos, CAST(json_extract_string(props, '$.k') AS BIGINT) * unnest([1, 2]) AS k FROM events)")
def _(t):
    k = F.from_json("props", "k long")["k"]
    return t.events.select("event_id", F.posexplode(F.array(k, k * 2)).alias("pos", "k")).select("event_id", (F.col("pos") + 1).cast("long").alias("pos"), "k")


@query("m7_embedder", "SELECT item_id, 64 AS dim FROM benchmark")
def _(t):
    from corpuslens.functions.udfs import embed

    return t.benchmark.select("item_id", F.size(embed("text")).cast("long").alias("dim"))


@query("e13_document_frequency", "WITH w AS (SELECT item_id, string_split(trim(regexp_replace(text, '[^\\p{L}]+', ' ', 'g')), ' ') AS w FROM benchmark), g AS (SELECT item_id, array_to_string(list_slice(w, i, i + n - 1), ' ') AS display FROM w, (SELECT unnest(generate_series(1, 400)) AS i), (SELECT unnest([1, 2, 3]) AS n) WHERE i + n - 1 <= len(w)), c AS (SELECT lower(display) AS gram, display, count(*) AS n, row_number() OVER (PARTITION BY lower(display) ORDER BY count(*) DESC, display) AS rk FROM g GROUP BY 1, 2) SELECT d.gram, d.df, c.display FROM (SELECT lower(display) AS gram, count(DISTINCT item_id) AS df FROM g GROUP BY 1) d JOIN c ON c.gram = d.gram AND rk = 1")
def _(t):
    words = t.benchmark.select("item_id", F.split(F.trim(F.regexp_replace("text", r"[^\p{L}]+", " ")), " ").alias("w"))
    spans = F.flatten(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))).otherwise(F.array().cast("array<string>"))))
    grams = words.select("item_id", F.explode(spans).alias("display")).withColumn("gram", F.lower("display"))
    return R.frequencies(grams, "item_id", "gram", "display")


_EDGES = "SELECT 'world' AS parent, 'r' || r_regionkey AS child, r_regionkey AS seq, NULL::DATE AS d0, NULL::DATE AS d1 FROM region UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, n_nationkey, DATE '2000-01-01', CASE WHEN n_nationkey % 4 = 0 THEN DATE '2010-01-01' END FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, c_custkey, CASE WHEN c_custkey % 5 = 0 THEN DATE '2020-01-01' ELSE DATE '2000-01-01' END, NULL FROM customer"


def _toc_edges(t) -> DataFrame:
    none, day = F.lit(None).cast("date"), lambda x: F.lit(x).cast("date")
    tag = lambda letter, column: F.concat(F.lit(letter), F.col(column).cast("string"))
    regions = t.region.select(F.lit("world").alias("parent"), tag("r", "r_regionkey").alias("child"), F.col("r_regionkey").cast("long").alias("seq"), none.alias("d0"), none.alias("d1"))
    nations = t.nation.select(tag("r", "n_regionkey"), tag("n", "n_nationkey"), F.col("n_nationkey").cast("long"), day("2000-01-01"), F.when(F.col("n_nationkey") % 4 == 0, day("2010-01-01")))
    leaves = t.customer.select(tag("n", "c_nationkey"), tag("c", "c_custkey"), F.col("c_custkey").cast("long"), F.when(F.col("c_custkey") % 5 == 0, day("2020-01-01")).otherwise(day("2000-01-01")), none)
    return regions.unionAll(nations).unionAll(leaves)


@query("d18_tree_down", f"WITH RECURSIVE e AS (SELECT * FROM ({_EDGES}) WHERE (d0 IS NULL OR d0 <= DATE '2015-06-01') AND (d1 IS NULL OR d1 > DATE '2015-06-01')), tree AS (SELECT e.parent AS root, child AS node, 1 AS depth, CAST(seq AS VARCHAR) AS path FROM e WHERE e.parent = 'world' OR starts_with(e.parent, 'r') UNION ALL SELECT t.root, e.child, t.depth + 1, t.path || '/' || e.seq FROM tree t JOIN e ON e.parent = t.node WHERE t.depth < 32) SELECT * FROM tree")
def _(t):
    edges = trees.in_force(_toc_edges(t), "d0", "d1", F.lit("2015-06-01").cast("date"))
    roots = edges.filter("parent = 'world' OR parent LIKE 'r%'").select(F.col("parent").alias("root")).distinct()
    return trees.descend_all(t.spark, edges.select("parent", "child", "seq"), roots).select("root", "node", F.col("depth").cast("long").alias("depth"), F.array_join("path", "/").alias("path"))


_PATHS = "SELECT r_name AS text_uid, c_custkey AS idx, 'a' || c_custkey AS uid, CASE WHEN c_custkey % 10 > 0 THEN n_name END AS l1, CASE WHEN c_custkey % 10 > 3 THEN c_mktsegment END AS l2 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_TOC = f"WITH a AS ({_PATHS}), d AS (SELECT text_uid, '' AS owner, 'division' AS kind, l1 AS label, min(idx) AS pl FROM a WHERE l1 IS NOT NULL GROUP BY ALL UNION ALL SELECT text_uid, l1, 'division', l2, min(idx) FROM a WHERE l2 IS NOT NULL GROUP BY ALL UNION ALL SELECT text_uid, coalesce(l1 || coalesce(' > ' || l2, ''), ''), 'article', uid, idx FROM a) SELECT text_uid, owner, kind, label, row_number() OVER (PARTITION BY text_uid, owner ORDER BY pl, kind DESC) AS seq FROM d"


def _toc(t) -> DataFrame:
    # dimensions of fixed size
    j = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    path = F.when(F.col("c_custkey") % 10 > 3, F.concat_ws(" > ", "n_name", "c_mktsegment")).when(F.col("c_custkey") % 10 > 0, F.col("n_name"))
    return trees.corpus_toc(j.select(F.col("r_name").alias("text_uid"), F.col("c_custkey").alias("idx"), F.concat(F.lit("a"), F.col("c_custkey").cast("string")).alias("uid"), path.alias("title_path")))


@query("k36_corpus_toc", _TOC)
def _(t):
    return _toc(t).withColumn("seq", F.col("seq").cast("long"))


@query("n8_code_toc", f"WITH toc AS ({_TOC}) SELECT text_uid, label AS article, row_number() OVER (PARTITION BY text_uid ORDER BY k1, k2, k3) AS pos FROM (SELECT a.text_uid, a.label, CASE WHEN a.owner = '' THEN a.seq ELSE d1.seq END AS k1, CASE WHEN a.owner = '' THEN 0 WHEN d2.seq IS NULL THEN a.seq ELSE d2.seq END AS k2, CASE WHEN d2.seq IS NULL THEN 0 ELSE a.seq END AS k3 FROM toc a LEFT JOIN toc d1 ON d1.kind = 'division' AND d1.owner = '' AND d1.text_uid = a.text_uid AND d1.label = split_part(a.owner, ' > ', 1) LEFT JOIN toc d2 ON d2.kind = 'division' AND d2.owner <> '' AND d2.text_uid = a.text_uid AND d2.owner || ' > ' || d2.label = a.owner WHERE a.kind = 'article')")
def _(t):
    """Articles of each text in reading order, by the tree of its table of contents."""
    toc = _toc(t)
    node = F.concat_ws("|", "text_uid", F.when(F.col("kind") == "article", F.concat(F.lit("#"), "label")).otherwise(F.concat_ws(" > ", F.nullif("owner", F.lit("")), "label")))
    edges = toc.select(F.concat_ws("|", "text_uid", "owner").alias("parent"), node.alias("child"), F.col("seq").cast("long").alias("seq"))
    roots = toc.select(F.concat(F.col("text_uid"), F.lit("|")).alias("root")).distinct()
    tree = trees.descend_all(t.spark, edges, roots).filter("contains(node, '|#')")
    order = Window.partitionBy("root").orderBy("path")
    return tree.select(F.expr("rtrim('|', root)").alias("text_uid"), F.split_part("node", F.lit("|#"), F.lit(2)).alias("article"), F.row_number().over(order).cast("long").alias("pos"))


@query("e14_term_bag", "WITH c AS (SELECT source AS uid, doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(left(text, 400)), '[^a-zà-ÿ -]', ' ', 'g'), '\\s+'), lambda w: w <> '') AS w FROM documents), g AS (SELECT DISTINCT uid, doc_id, g FROM (SELECT uid, doc_id, unnest(list_concat(list_filter(w, lambda x: length(x) > 1), list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || '_' || w[i + 1]))) AS g FROM c)), d AS (SELECT uid, g, count(*) AS df FROM g GROUP BY ALL), n AS (SELECT uid, count(*) AS n FROM c GROUP BY 1) SELECT uid, string_agg(trim(repeat(g || ' ', CAST(least(ceil(round(2 * log2(df + 1), 9)), 24) AS INTEGER))), ' ' ORDER BY g) AS bag FROM d JOIN n USING (uid) WHERE df >= greatest(2, ceil(n * 0.03)) GROUP BY 1")
def _(t):
    return R.usage_bags(t.documents.select("source", "doc_id", F.left("text", F.lit(400)).alias("context")), "source", "doc_id", "context")


def _top(value: str, name: str) -> str:
    return f"(SELECT entity, string_agg(v || ':' || n, ',' ORDER BY n DESC, v) AS {name} FROM (SELECT o_custkey AS entity, {value} AS v, count(*) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, {value}) AS rk FROM orders GROUP BY 1, 2) WHERE rk <= 3 GROUP BY 1)"


def _all(value: str, name: str) -> str:
    return f"(SELECT entity, string_agg(v || ':' || n, ',' ORDER BY v) AS {name} FROM (SELECT o_custkey AS entity, CAST({value} AS VARCHAR) AS v, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1)"


@query("n1_entity_page", f"SELECT e.entity, c_name AS name, total, first_day, last_day, years, roles, courts, counsel FROM (SELECT o_custkey AS entity, count(*) AS total, CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day FROM orders GROUP BY 1) e JOIN customer ON c_custkey = e.entity JOIN {_all('year(o_orderdate)', 'years')} y USING (entity) JOIN {_all('o_orderstatus', 'roles')} r USING (entity) JOIN {_top('o_orderpriority', 'courts')} p USING (entity) JOIN {_top('CAST(o_orderkey % 7 AS VARCHAR)', 'counsel')} k USING (entity)")
def _(t):
    rows = t.orders.select("o_custkey", F.col("o_orderdate").cast("date").alias("day"), "o_orderstatus", "o_orderpriority", (F.col("o_orderkey") % 7).cast("string").alias("counsel"))
    pages = R.entity_pages(rows, "o_custkey", "day", "o_orderstatus", "o_orderpriority", "counsel")
    return pages.join(t.customer.select(F.col("c_custkey").alias("entity"), F.col("c_name").alias("name")), "entity")


@query("n2_entity_documents", "SELECT l_suppkey AS entity, l_orderkey AS doc, arg_min(l_returnflag, struct_pack(a := l_linenumber, b := l_returnflag)) AS role, count(*) OVER (PARTITION BY l_suppkey) AS total FROM lineitem GROUP BY l_suppkey, l_orderkey")
def _(t):
    """Each document of an entity once, with the role of its first mention, and the entity's total."""
    docs = t.lineitem.groupBy(F.col("l_suppkey").alias("entity"), F.col("l_orderkey").alias("doc")).agg(F.min_by("l_returnflag", F.struct("l_linenumber", "l_returnflag")).alias("role"))
    return docs.join(docs.groupBy("entity").agg(n_rows().alias("total")), "entity")


@query("n4_directory", "SELECT c_mktsegment AS category, upper(left(c_name, 1)) AS initial, c_nationkey AS place, count(*) AS total, count(*) FILTER (n > 0) AS active, max(n) AS busiest FROM (SELECT c_custkey, c_mktsegment, c_name, c_nationkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL) GROUP BY GROUPING SETS ((c_mktsegment), (c_mktsegment, upper(left(c_name, 1)), c_nationkey), ())")
def _(t):
    """Totals of the directory: all, by category, by category with initial and place; and those with cases."""
    n = t.orders.groupBy("o_custkey").agg(n_rows().alias("n"))
    rows = t.customer.join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_mktsegment").alias("category"), F.upper(F.left("c_name", F.lit(1))).alias("initial"), F.col("c_nationkey").alias("place"), F.coalesce("n", F.lit(0)).alias("n"))
    return rows.groupingSets([("category",), ("category", "initial", "place"), ()], "category", "initial", "place").agg(n_rows().alias("total"), F.count_if(F.col("n") > 0).alias("active"), F.max("n").alias("busiest"))


@query("n6_preview", "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'Cour de cassation' WHEN 'F' THEN 'Cour d''appel de Paris' ELSE 'Tribunal administratif de Lyon' END AS court, CAST(o_orderdate AS DATE) AS read_on, CASE o_orderpriority WHEN '1-URGENT' THEN 'cassation' WHEN '2-HIGH' THEN 'rejet' WHEN '3-MEDIUM' THEN 'desistement' WHEN '4-NOT SPECIFIED' THEN 'confirmation' ELSE 'non_lieu' END AS outcome, 281 AS n FROM orders")
def _(t):
    """What a decision's preview shows: court, day, outcome, head of the text."""
    docs = decisions(t)
    read = D.fields(docs, "id", "text").select("id", D.court_label(F.col("court.code")).alias("court"), "read_on", "outcome")
    return read.join(docs.select("id", F.length(X.snippet_head(F.col("text"))).cast("long").alias("n")), "id")


@query("n11_hub", "SELECT o_orderstatus AS hub, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS n, max(CAST(o_orderdate AS DATE)) AS latest FROM orders GROUP BY ROLLUP (o_orderstatus, year(o_orderdate), month(o_orderdate))")
def _(t):
    """Catalogue, hubs, their years and months in one pass."""
    rows = t.orders.select(F.col("o_orderstatus").alias("hub"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), F.col("o_orderdate").cast("date").alias("day"))
    return rows.rollup("hub", "year", "month").agg(n_rows().alias("n"), F.max("day").alias("latest"))


@query("j22_backoff", "SELECT event_id, least(60.0, power(2.0, event_id % 9)) * (0.5 + 0.5 * (event_id % 11) / 10.0) AS seconds FROM events")
def _(t):
    from corpuslens.sources.incremental import backoff

    return t.events.select("event_id", backoff(F.col("event_id") % 9, (F.col("event_id") % 11) / 10.0).alias("seconds"))


@query("k9_citation_extraction", "SELECT o_orderkey AS id, unnest(['L. 1231-1', 'L. ' || o_custkey || '-1', 'L. ' || o_custkey || '-2', 'L. ' || o_custkey || '-3', 'R. ' || o_orderkey, '12']) AS article, unnest(['code du travail', 'code civil', 'code civil', 'code civil', 'code civil', 'code civil']) AS instrument FROM orders")
def _(t):
    """Citations of each decision with their instrument: single ones, ranges, enumerations and "the same code"."""
    from corpuslens.operators.extraction import extract_frame

    cited = F.concat(F.lit("\nVu les articles L. "), F.col("o_custkey").cast("string"), F.lit("-1 à L. "), F.col("o_custkey").cast("string"), F.lit("-3 et R. "), F.col("id").cast("string"), F.lit(" du code civil, ensemble l'article 12 du même code ;"))
    rows = decisions(t).join(t.orders.select(F.col("o_orderkey").alias("id"), "o_custkey"), "id").select("id", F.concat("text", cited).alias("text"))
    return extract_frame(R.spread(rows), "id", "text").select("id", F.explode("citations").alias("c")).select("id", "c.article", "c.instrument")
