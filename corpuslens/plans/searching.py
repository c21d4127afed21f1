"""Search: legs, fusion, cuts, phrases, facets, suggestions, similar documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions import text as X
from corpuslens.functions import vectors as V
from corpuslens.operators import relational as R
from corpuslens.operators import search as S
from corpuslens.operators.lexicon import LexicalIndex
from corpuslens.plans.registry import n_rows, query
from corpuslens.plans.scalars import STOP, tok



def post(id: str, text: str, table: str) -> str:
    """SQL of postings: id, pos, term without stop words."""
    return f"SELECT id, pos, term FROM (SELECT {id} AS id, unnest({tok(text)}) AS term, generate_subscripts({tok(text)}, 1) - 1 AS pos FROM {table}) WHERE term NOT IN {STOP}"


POST_DOCS = post(id="doc_id", text="text", table="documents")
POST_TITLES = post(id="doc_id", text="split_part(text, chr(10), 1)", table="documents")


def bm25_sql(post: str, terms: list[str], limit: int = S.LEG_LIMIT) -> str:
    words = ", ".join(f"'{t}'" for t in terms)
    return f"""
        WITH post AS ({post}), dl AS (SELECT id, count(*) AS dl FROM post GROUP BY id), st AS (SELECT count(*) AS n, avg(dl) AS av FROM dl),
        tf AS (SELECT id, term, count(*) AS tf FROM post WHERE term IN ({words}) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
        SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {S.K1 + 1} / (tf + {S.K1} * (1 - {S.B} + {S.B} * dl / av))) AS score
        FROM tf JOIN df USING (term) JOIN dl USING (id), st GROUP BY id ORDER BY round(score, 9) DESC, id LIMIT {limit}"""


def stable(scored: DataFrame) -> DataFrame:
    """Scores without the last bits, in which two engines may differ."""
    return scored.withColumn("score", F.round("score", 9))


TERMS = ["thou", "ation", "onre", "tion"]


def bodies(t) -> LexicalIndex:
    """The stored index of the documents' texts."""
    return LexicalIndex.stored(t.documents, "doc_id", F.col("text"), "text")


def titles(t) -> LexicalIndex:
    """The stored index of first lines."""
    return LexicalIndex.stored(t.documents, "doc_id", F.split_part("text", F.lit("\n"), F.lit(1)), "line 1")


def body_leg(t) -> DataFrame:
    return S.leg(stable(bodies(t).bm25(TERMS)))


def title_leg(t) -> DataFrame:
    return S.leg(stable(titles(t).bm25(TERMS)))


@query("h1_bm25_body", f"SELECT id, round(round(score, 9), 5) AS score FROM ({bm25_sql(POST_DOCS, TERMS)})")
def _(t):
    return body_leg(t).select("id", F.round("score", 5).alias("score"))


@query("h2_bm25_title", f"SELECT id, round(round(score, 9), 5) AS score FROM ({bm25_sql(POST_TITLES, TERMS)})")
def _(t):
    return title_leg(t).select("id", F.round("score", 5).alias("score"))


_COS = "round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9)"
_ANN = f"SELECT e.vec_id AS chunk, e.vec_id // 5 AS id, {_COS} - 1 AS score FROM embeddings e, embeddings q WHERE q.vec_id = 3 ORDER BY {_COS} DESC, e.vec_id LIMIT 221"


def ann_hits(t) -> DataFrame:
    q = t.embeddings.filter("vec_id = 3").select("embedding").first()[0]
    v = t.embeddings.withColumn("owner", F.floor(F.col("vec_id") / 5))
    return stable(S.ann(v, list(q), S.LEG_LIMIT, owner_col="owner")).select("chunk", "id", "score")


@query("h3_ann_leg", f"SELECT chunk, id, round(score, 5) AS score FROM ({_ANN})")
def _(t):
    return ann_hits(t).withColumn("score", F.round("score", 5))


_POOL = f"SELECT id, max(score) AS score, min(chunk) FILTER (score = best) AS chunk FROM (SELECT *, max(score) OVER (PARTITION BY id) AS best FROM ({_ANN})) GROUP BY id ORDER BY score DESC, id LIMIT 200"


@query("h4_max_pool", f"SELECT id, round(score, 5) AS score, chunk FROM ({_POOL})")
def _(t):
    return S.pool_max(ann_hits(t)).withColumn("score", F.round("score", 5))


def _rrf_sql(legs: list[tuple[str, float]]) -> str:
    votes = " UNION ALL ".join(f"SELECT id, {w} / (60 + row_number() OVER (ORDER BY round(score, 9) DESC, id)) AS v FROM ({sql})" for sql, w in legs)
    return f"SELECT id, sum(v) AS score FROM ({votes}) GROUP BY id"


_FUSED = _rrf_sql([(bm25_sql(POST_DOCS, TERMS), 1.0), (_POOL, 1.0), (bm25_sql(POST_TITLES, TERMS), 1.0)])


def fused(t) -> DataFrame:
    return S.rrf([(body_leg(t), 1.0), (S.pool_max(ann_hits(t)), 1.0), (title_leg(t), 1.0)])


@query("h5_rrf", f"SELECT id, round(score, 8) AS score FROM ({_FUSED})")
def _(t):
    return fused(t).select("id", F.round("score", 8).alias("score"))


_CUT = f"SELECT id, score FROM (SELECT id, round(score, 12) AS score, max(round(score, 12)) OVER () AS top FROM ({_FUSED})) WHERE score >= 0.3 * top ORDER BY score DESC, id LIMIT 100"


def hits(t) -> DataFrame:
    return S.relative_cut(fused(t).withColumn("score", F.round("score", 12)))


@query("h6_relative_cut", f"SELECT id, round(score, 8) AS score FROM ({_CUT})")
def _(t):
    return hits(t).withColumn("score", F.round("score", 8))


_ASKED = ["article L. 761-1", "congés payés", "pourvoi 18-23.954", "arrêt du 12 mars 2020"]


@query("h7_adaptive_weights", """
    WITH e AS (SELECT vec_id // 10 AS g, vec_id % 10 < 5 AS near, vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS norm FROM embeddings),
    u AS (SELECT g, near, norm, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM e),
    m AS (SELECT g, i, avg(x) FILTER (near) AS a, avg(x) FILTER (NOT near) AS b, sum(x / norm) FILTER (near) AS s FROM u GROUP BY ALL),
    d AS (SELECT g, 1 - sum(a * b) / sqrt(sum(a * a) * sum(b * b)) AS apart, sum(s * s) AS uu FROM m GROUP BY g),
    n AS (SELECT g, count(*) FILTER (near) AS n FROM e GROUP BY g),
    w AS (SELECT g, g % 4 AS q, g % 4 <> 0 AND apart > 0.06 AND n > 1 AND 1 - (uu - n) / (n * (n - 1)) < 0.18 AS far FROM d JOIN n USING (g))
    SELECT g, CASE q WHEN 0 THEN 0.2 WHEN 2 THEN 6 WHEN 3 THEN 1.5 ELSE 1 END AS title, CASE WHEN q = 0 THEN 1.5 WHEN far THEN 0.4 ELSE 1 END AS bm25, CASE WHEN far THEN 2.5 ELSE 1 END AS ann FROM w""")
def _(t):
    """Every ten vectors are a query's two legs; the queries' texts take turns."""
    legs = t.embeddings.select(F.floor(F.col("vec_id") / 10).alias("g"), F.when(F.col("vec_id") % 10 < 5, "ann").otherwise("bm25").alias("leg"), "embedding")
    asked = F.element_at(F.array(*map(F.lit, _ASKED)), (F.col("g") % 4 + 1).cast("int"))
    return S.weights_of_legs(legs, "g", asked, "leg", "embedding")


_ART = r"(?i)\barticles?\s+\d+|\b[LRDA]\.?\s?\d+-\d+"
_NUM = r"\b\d{2}[-/.]\d{2}[.\s]?\d{3}\b|\b\d{6,7}\b"


@query("h8_signals", f"SELECT doc_id, regexp_matches(text, '{_ART}') AS article, regexp_matches(text, '{_NUM}') AS docket, regexp_matches(text, '\\b\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}\\b') AS dated FROM documents")
def _(t):
    x = F.col("text")
    return t.documents.select("doc_id", x.rlike(_ART).alias("article"), x.rlike(_NUM).alias("docket"), x.rlike(r"\b\d{1,2}/\d{1,2}/\d{4}\b").alias("dated"))


@query("h9_query_mode", "SELECT item_id, regexp_matches(text, '\\b(?:ET|OU|SAUF|AND|OR|NOT)\\b|\"|\\*') AS lexical FROM benchmark")
def _(t):
    return t.benchmark.select("item_id", F.col("text").rlike(r"\b(?:ET|OU|SAUF|AND|OR|NOT)\b|\"|\*").alias("lexical"))


@query("h10_boolean", f"WITH p AS ({POST_DOCS}) SELECT DISTINCT id FROM p WHERE term = 'thou' AND id IN (SELECT id FROM p WHERE term = 'tion') AND id NOT IN (SELECT id FROM p WHERE term = 'onre')")
def _(t):
    return S.compile_boolean(bodies(t).postings(), S.translate_boolean("thou ET tion SAUF onre"))


@query("h11_phrase_combo", f"WITH p AS ({POST_DOCS}), ph AS (SELECT DISTINCT a.id FROM p a JOIN p b ON a.id = b.id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the'), b AS (SELECT id, count(DISTINCT term) AS n FROM p WHERE term IN ('of', 'the') GROUP BY 1) SELECT b.id, n + CASE WHEN ph.id IS NULL THEN 0 ELSE 2 END AS score FROM b LEFT JOIN ph ON ph.id = b.id")
def _(t):
    p = bodies(t).postings()
    bag = p.filter(F.col("term").isin("of", "the")).groupBy("id").agg(F.countDistinct("term").alias("n"))
    ph = S.phrase(p, ["of", "the"]).withColumn("hit", F.lit(2))
    return bag.join(ph, "id", "left").select("id", (F.col("n") + F.coalesce("hit", F.lit(0))).cast("long").alias("score"))


@query("h12_phrase_proximity", f"WITH p AS ({POST_DOCS}) SELECT DISTINCT a.id FROM p a JOIN p b ON a.id = b.id AND a.pos <> b.pos AND abs(b.pos - a.pos) <= 4 WHERE a.term = 'thou' AND b.term = 'tion'")
def _(t):
    return S.phrase(bodies(t).postings(), ["thou", "tion"], slop=3)


@query("h13_prefix", f"WITH p AS ({POST_DOCS}) SELECT id, count(DISTINCT term) AS n FROM p WHERE starts_with(term, 'anti') GROUP BY 1")
def _(t):
    return bodies(t).table().filter(F.col("term").startswith("anti")).groupBy("id").agg(F.countDistinct("term").alias("n"))


@query("h15_lexical_path", f"SELECT id, round(score, 8) AS score FROM ({_rrf_sql([(bm25_sql(POST_DOCS, TERMS), 1.0), (bm25_sql(POST_TITLES, TERMS), 1.0)])})")
def _(t):
    return S.rrf([(body_leg(t), 1.0), (title_leg(t), 1.0)]).withColumn("score", F.round("score", 8))


@query("h16_hybrid_search", f"SELECT c.id, round(c.score, 8) AS score, d.lang, d.source FROM ({_CUT}) c JOIN documents d ON d.doc_id = c.id")
def hybrid(t):
    meta = t.documents.select(F.col("doc_id").alias("id"), "lang", "source")
    return meta.join(F.broadcast(hits(t)), "id").select("id", F.round("score", 8).alias("score"), "lang", "source")


@query("h17_hydrate", f"SELECT d.doc_id, d.n_chars, d.lang FROM documents d JOIN ({_CUT}) c ON c.id = d.doc_id")
def _(t):
    return t.documents.join(F.broadcast(hits(t).select(F.col("id").alias("doc_id"))), "doc_id").select("doc_id", "n_chars", "lang")


@query("h18_page")
def _(t):
    from corpuslens.operators.texts import highlight

    page = t.documents.join(F.broadcast(hits(t).limit(20).select(F.col("id").alias("doc_id"))), "doc_id").select("doc_id", "text").collect()  # one page
    found = highlight([(r.doc_id, r.text) for r in sorted(page)], " ".join(TERMS))
    return t.spark.createDataFrame([(r.doc_id, found.get(r.doc_id) or r.text[:280] + "…") for r in page] or [(None, None)], "doc_id long, snippet string")


@query("h22_rerank_merge", "WITH base AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents QUALIFY r <= 50), new AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS nr FROM base JOIN documents USING (doc_id) WHERE lang = 'fr') SELECT doc_id, row_number() OVER (ORDER BY CASE WHEN nr IS NULL THEN 1 ELSE 0 END, nr, r) AS pos FROM base LEFT JOIN new USING (doc_id)")
def _(t):
    base = t.documents.orderBy(F.desc("n_chars"), "doc_id").limit(50).select("doc_id", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")).alias("r"))
    new = base.join(t.documents.filter("lang = 'fr'"), "doc_id", "left_semi").select("doc_id", F.row_number().over(Window.orderBy("doc_id")).alias("nr"))
    return base.join(new, "doc_id", "left").select("doc_id", F.row_number().over(Window.orderBy(F.col("nr").isNull(), "nr", "r")).cast("long").alias("pos"))


POST_USAGE = post(id="doc_id", text="split_part(text, chr(10), 2)", table="documents")
POST_ITEMS = post(id="item_id", text="text", table="benchmark")
POST_HEADS = post(id="id", text="title", table="(SELECT min(doc_id) AS id, min_by(split_part(text, chr(10), 1), doc_id) AS title FROM documents GROUP BY source)")
_EVERY = 1_000_000_000


def _legs_sql() -> str:
    title, scored = bm25_sql(POST_TITLES, TERMS, _EVERY), {"u": bm25_sql(POST_USAGE, TERMS, _EVERY), "i": bm25_sql(POST_ITEMS, TERMS, _EVERY), "h": bm25_sql(POST_HEADS, TERMS[:2], _EVERY)}
    whole = f"SELECT id FROM ({POST_TITLES}) WHERE term IN ('{TERMS[0]}', '{TERMS[1]}') GROUP BY id HAVING count(DISTINCT term) = 2"
    heads = f"SELECT id FROM ({POST_HEADS}) WHERE term IN ('{TERMS[0]}', '{TERMS[1]}') GROUP BY id HAVING count(DISTINCT term) = 2"
    articles = f"SELECT b.id, b.score + 0.25 * coalesce(t.score, 0) + CASE WHEN w.id IS NULL THEN 0 ELSE 4 * coalesce(t.score, 0) END AS score FROM ({bm25_sql(POST_DOCS, TERMS, _EVERY)}) b LEFT JOIN ({title}) t ON t.id = b.id LEFT JOIN ({whole}) w ON w.id = b.id"
    legs = [
        ("'a:' || id", f"SELECT a.* FROM ({articles}) a JOIN documents ON doc_id = id WHERE lang IN ('fr', 'en')", 1.0),
        ("'a:' || id", f"SELECT a.* FROM ({articles}) a JOIN documents ON doc_id = id WHERE lang NOT IN ('fr', 'en', 'de')", 0.25),
        ("'a:' || id", f"SELECT a.* FROM ({articles}) a JOIN documents ON doc_id = id WHERE lang = 'de'", 1.0),
        ("'t:' || id", scored["i"], 1.0),
        ("'c:' || id", f"SELECT * FROM ({scored['h']}) WHERE id IN ({heads})", 1.0),
        ("'a:' || id", scored["u"], 0.8),
    ]
    votes = [f"SELECT {key} AS id, {n} AS leg, {w} / (60 + row_number() OVER (ORDER BY round(score, 9) DESC, id)) AS v FROM (SELECT * FROM ({sql}) ORDER BY round(score, 9) DESC, id LIMIT {S.LEG_LIMIT})" for n, (key, sql, w) in enumerate(legs)]
    return f"SELECT id, sum(v) AS s, min(leg) AS leg FROM ({' UNION ALL '.join(votes)}) GROUP BY id ORDER BY round(s, 12) DESC, leg, id LIMIT 60"


def article_legs(t) -> list[tuple[DataFrame, float]]:
    """Articles of home, of abroad, of the country that the query names; texts with a body; containers by their title; articles by the words of their usage."""
    title = titles(t)
    whole = title.bm25(TERMS[:2], least=2).select("id", F.lit(1).alias("whole"))
    extra = title.bm25(TERMS).withColumnRenamed("score", "title").join(whole, "id", "left")
    body = bodies(t).bm25(TERMS).join(extra, "id", "left")
    articles = body.select("id", (F.col("score") + F.coalesce("title", F.lit(0.0)) * F.when(F.col("whole").isNull(), 0.25).otherwise(4.25)).alias("score"))
    place = t.documents.select(F.col("doc_id").alias("id"), "lang")
    of = lambda where: articles.join(place.filter(where).select("id"), "id", "left_semi")
    usage = LexicalIndex.stored(t.documents, "doc_id", F.split_part("text", F.lit("\n"), F.lit(2)), "line 2").bm25(TERMS)
    items = LexicalIndex.stored(t.benchmark, "item_id", F.col("text"), "text").bm25(TERMS)
    heads = t.documents.groupBy("source").agg(F.min("doc_id").alias("id"), F.min_by(F.split_part("text", F.lit("\n"), F.lit(1)), "doc_id").alias("title"))
    boxes = S.postings(heads, "id", "title")  # a row for each container
    both = boxes.filter(F.col("term").isin(TERMS[:2])).groupBy("id").agg(F.countDistinct("term").alias("n")).filter("n = 2")
    containers = S.bm25(boxes, TERMS[:2]).join(both.select("id"), "id", "left_semi")
    named = lambda rows, kind: S.ranked(S.leg(stable(rows))).select(F.concat(F.lit(f"{kind}:"), F.col("id").cast("string")).alias("id"), "rank")
    return [(named(of("lang IN ('fr', 'en')"), "a"), 1.0), (named(of("lang NOT IN ('fr', 'en', 'de')"), "a"), 0.25), (named(of("lang = 'de'"), "a"), 1.0), (named(items, "t"), 1.0), (named(containers, "c"), 1.0), (named(usage, "a"), 0.8)]


@query("h23_article_search", f"SELECT id, round(s, 8) AS score, leg FROM ({_legs_sql()})")
def _(t):
    votes = [leg.select("id", F.lit(n).alias("leg"), (F.lit(w) / (F.col("rank") + S.RRF_K)).alias("v")) for n, (leg, w) in enumerate(article_legs(t))]
    every = votes[0]
    for v in votes[1:]:
        every = every.unionByName(v)
    joined = every.groupBy("id").agg(F.round(F.sum("v"), 12).alias("s"), F.min("leg").alias("leg"))
    return joined.orderBy(F.desc("s"), "leg", "id").limit(60).select("id", F.round("s", 8).alias("score"), "leg")


_ARMS = {"or": (0.25, 0.0), "conj": (0.0, 4.0), "or_conj": (0.25, 4.0)}


def _arm_sql(mode: str, fuse: str) -> str:
    loose, strict = _ARMS[mode]
    title = bm25_sql(POST_TITLES, TERMS[:2], _EVERY)
    whole = f"SELECT * FROM ({title}) WHERE id IN (SELECT id FROM ({POST_TITLES}) WHERE term IN ('{TERMS[0]}', '{TERMS[1]}') GROUP BY id HAVING count(DISTINCT term) = 2)"
    legs = [(bm25_sql(POST_DOCS, TERMS[:2], _EVERY), 1.0), *([(title, loose)] if loose else []), *([(whole, strict)] if strict else [])]
    if fuse == "raw":
        every = " UNION ALL ".join(f"SELECT id, {w} * round(score, 9) AS x FROM ({sql})" for sql, w in legs)
        return f"SELECT '{mode}' AS mode, '{fuse}' AS fuse, id, sum(x) AS s FROM ({every}) GROUP BY id ORDER BY round(s, 8) DESC, id LIMIT 50"
    every = " UNION ALL ".join(f"SELECT id, {w} / (60 + row_number() OVER (ORDER BY round(score, 9) DESC, id)) AS v FROM (SELECT * FROM ({sql}) ORDER BY round(score, 9) DESC, id LIMIT 200)" for sql, w in legs)
    return f"SELECT '{mode}' AS mode, '{fuse}' AS fuse, id, sum(v) AS s FROM ({every}) GROUP BY id ORDER BY round(s, 12) DESC, id LIMIT 50"


@query("h25_rank_arms", " UNION ALL ".join(f"SELECT mode, fuse, id, round(s, 6) AS score FROM ({_arm_sql(m, f)})" for m in _ARMS for f in ("rrf", "raw")))
def _(t):
    out, two = None, TERMS[:2]
    for mode, (loose, strict) in _ARMS.items():
        legs = [(bodies(t).bm25(two), 1.0), *([(titles(t).bm25(two), loose)] if loose else []), *([(titles(t).bm25(two, least=2), strict)] if strict else [])]
        for fuse in ("rrf", "raw"):
            if fuse == "rrf":
                joined = S.rrf([(S.leg(stable(x)), w) for x, w in legs]).withColumn("score", F.round("score", 12))
            else:
                every = legs[0][0].select("id", F.round("score", 9).alias("score"))
                for x, w in legs[1:]:
                    every = every.unionByName(x.select("id", (F.round("score", 9) * w).alias("score")))
                joined = every.groupBy("id").agg(F.round(F.sum("score"), 8).alias("score"))
            best = S.leg(joined, 50).select(F.lit(mode).alias("mode"), F.lit(fuse).alias("fuse"), "id", F.round("score", 6).alias("score"))
            out = best if out is None else out.unionByName(best)
    return out


_BOTH = f"WITH b AS ({bm25_sql(POST_DOCS, TERMS, 100000)}), t AS ({bm25_sql(POST_TITLES, TERMS, 100000)}) SELECT coalesce(b.id, t.id) AS id, coalesce(b.score, 0) + 0.25 * coalesce(t.score, 0) AS score FROM b FULL JOIN t ON b.id = t.id"


@query("h24_weighted_predicate", f"SELECT id, round(round(score, 7), 5) AS score FROM ({_BOTH}) ORDER BY round(score, 7) DESC, id LIMIT 50")
def _(t):
    body, title = bodies(t).bm25(TERMS), titles(t).bm25(TERMS, boost=0.25)
    both = body.unionByName(title).groupBy("id").agg(F.round(F.sum("score"), 7).alias("score"))
    return S.leg(both, 50).withColumn("score", F.round("score", 5))


@query("h27_country_strip", "SELECT n_nationkey, trim(regexp_replace(q, '(?i)\\b' || n_name || '\\b', '', 'g')) AS stripped, regexp_matches(q, '(?i)\\b' || n_name || '\\b') AS named FROM (SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 2 = 0 THEN 'contrat ' || n_name ELSE 'franco contrat' END AS q FROM nation)")
def _(t):
    q = t.nation.withColumn("q", F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("contrat "), "n_name")).otherwise("franco contrat"))
    pattern = F.concat(F.lit(r"(?i)\b"), "n_name", F.lit(r"\b"))
    return q.select("n_nationkey", F.trim(F.regexp_replace("q", pattern, F.lit(""))).alias("stripped"), F.regexp("q", pattern).alias("named"))


_WORDS = "list_filter(string_split(regexp_replace(lower(text), '[^\\p{L}-]', ' ', 'g'), ' '), lambda w: w <> '')"


@query("h28_usage_grams", f"SELECT item_id, len(w) AS n_words, array_to_string(list_concat(list_filter(w, lambda x: length(x) > 1), list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || '_' || w[i + 1])), ' ') AS grams FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)")
def _(t):
    words = F.filter(F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}-]", " "), r"\s+"), lambda w: w != "")
    return t.benchmark.select("item_id", F.size(words).cast("long").alias("n_words"), F.concat_ws(" ", X.usage_grams(F.col("text"))).alias("grams"))


@query("h30_similar_documents", f"WITH c AS (SELECT vec_id, vec_id // 5 AS doc, embedding FROM embeddings), q AS (SELECT doc, embedding FROM c WHERE doc = 4 AND (vec_id = 20 OR vec_id = 24)), s AS (SELECT c.doc, max(round(list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9)) AS score FROM c, q WHERE c.doc <> 4 GROUP BY 1) SELECT doc, round(score, 5) AS score FROM s ORDER BY s.score DESC, doc LIMIT 8")
def _(t):
    c = t.embeddings.withColumn("doc", F.floor(F.col("vec_id") / 5))
    mine = c.filter("doc = 4")
    ends = mine.join(F.broadcast(mine.agg(F.min("vec_id").alias("a"), F.max("vec_id").alias("b"))), F.col("vec_id").isin(F.col("a"), F.col("b"))).select(F.col("embedding").alias("q"))
    best = c.filter("doc <> 4").join(F.broadcast(ends)).groupBy("doc").agg(F.max(F.round(V.cosine(F.col("embedding"), F.col("q")), 9)).alias("score"))
    return best.orderBy(F.desc("score"), "doc").limit(8).select("doc", F.round("score", 5).alias("score"))


#: Least number of documents of a gram, as the reference asks of decisions.
LEAST_DOCUMENTS = 5


def _grams_sql() -> str:
    clause = "(" + ", ".join(f"'{w}'" for w in X.CLAUSE_BREAKERS) + ")"
    border = "(" + ", ".join(f"'{w}'" for w in [*X.STOPWORDS, *X.BORDER_WORDS, *X.CLAUSE_BREAKERS]) + ")"
    digit = lambda k: f"coalesce(regexp_matches(t{k}, '[0-9]'), false)"
    words = f"SELECT doc_id, unnest({tok('text')}) AS term, generate_subscripts({tok('text')}, 1) AS pos FROM documents"
    near = f"SELECT doc_id, lag(term) OVER w AS t0, term AS t1, {', '.join(f'lead(term, {k}) OVER w AS t{k + 1}' for k in range(1, 6))} FROM ({words}) WINDOW w AS (PARTITION BY doc_id ORDER BY pos)"
    legs = [f"SELECT doc_id, concat_ws(' ', {', '.join(f't{i}' for i in range(1, k + 1))}) AS gram FROM near WHERE t1 NOT IN {border} AND t{k} NOT IN {border} AND {' AND '.join(f't{i} NOT IN {clause}' for i in range(1, k + 1))} AND NOT ({digit(0)} AND {digit(1)}) AND NOT ({digit(k)} AND {digit(k + 1)})" for k in range(1, 6)]
    return f"WITH near AS ({near}) {' UNION ALL '.join(legs)}"


@query("h31_suggest_harvest", f"SELECT doc_id, gram, count(*) AS n FROM ({_grams_sql()}) GROUP BY ALL")
def _(t):
    return S.gram_counts(R.spread(t.documents), "doc_id", "text")


@query("h32_suggest_probe")
def _(t):
    return S.probe(S.vocabulary(t.documents, "doc_id", "text", LEAST_DOCUMENTS), "the", 8)


@query("h33_suggest_vocabulary", f"SELECT gram, count(DISTINCT doc_id) AS df FROM ({_grams_sql()}) GROUP BY 1 HAVING count(DISTINCT doc_id) >= {LEAST_DOCUMENTS}")
def _(t):
    return S.vocabulary(R.spread(t.documents), "doc_id", "text", LEAST_DOCUMENTS)


@query("h35_ndcg", f"WITH r AS (SELECT quality, rank FROM (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM ({bm25_sql(POST_DOCS, TERMS)})) JOIN labels ON doc_id = id) SELECT round(sum(quality / log2(rank + 1)) FILTER (rank <= 10), 9) AS dcg, (SELECT sum(quality) FROM (SELECT quality FROM r ORDER BY quality DESC LIMIT 10)) AS relevant FROM r")
def _(t):
    judged = t.labels.select(F.col("doc_id").alias("id"), "quality")
    ranked = S.ranked(body_leg(t)).join(judged, "id")  # a leg is bounded: Spark broadcasts it, not the labels
    gain = ranked.agg(F.round(F.sum(F.when(F.col("rank") <= 10, F.col("quality") / F.log2(F.col("rank") + 1))), 9).alias("dcg"))
    ideal = ranked.select("quality").orderBy(F.desc("quality")).limit(10).agg(F.sum("quality").alias("relevant"))
    return gain.join(F.broadcast(ideal))
