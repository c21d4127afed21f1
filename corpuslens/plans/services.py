"""Request-shaped functions: what the services answer, as DataFrames or small dictionaries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.operators import search as S
from corpuslens.operators.lexicon import LexicalIndex
from corpuslens.plans.registry import n_rows, query
from corpuslens.plans.searching import POST_DOCS, bm25_sql

FIRST_DAY, LAST_DAY = dt.date(1678, 1, 1), dt.date(2262, 1, 1)


class BadRequest(ValueError):
    """A request that is refused, with the reason."""


def parse_date(text: str | None) -> dt.date | None:
    if not text:
        return None
    try:
        day = dt.date.fromisoformat(text)
    except ValueError as e:
        raise BadRequest(f"not a date: {text}") from e
    if not FIRST_DAY <= day <= LAST_DAY:
        raise BadRequest(f"date out of range: {text}")
    return day


def date_verdict(x):
    """What ``parse_date`` says of a column: ok, not a date, or date out of range."""
    day = F.when(x.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(x))
    return F.when(x.isNull() | (x == ""), "ok").when(day.isNull(), "not a date").when(day.between(F.lit(FIRST_DAY), F.lit(LAST_DAY)), "ok").otherwise("date out of range")


def cache_key(text, limit: int = 20, offset: int = 0):
    """Key under which a request's result may be kept: digest of the normalised request."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    return F.md5(F.concat(F.lit('{"q":"'), plain, F.lit(f'","limit":{limit},"offset":{offset}}}')))


def search_documents(docs: DataFrame, text: str, id_col: str = "doc_id", text_col: str = "text", filters: dict[str, list[str]] | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """Ranked documents of a query: id, score, rank. Boolean queries go by their clauses, others by BM25.

    A table read from files uses the stored index of its texts (statistics are the whole table's); any other is
    tokenised.
    """
    if not 0 < limit <= S.MAX_RESULTS or offset < 0:
        raise BadRequest("limit or offset out of range")
    index = LexicalIndex.stored(docs, id_col, F.col(text_col), text_col) if docs.inputFiles() else None
    for column, values in (filters or {}).items():
        docs = docs.filter(F.col(column).isin(values)) if values else docs
    terms = [t for t in dict.fromkeys(S.query_tokens(text)) if t not in S.X.STOPWORDS]
    if not terms:
        return docs.limit(0).select(F.col(id_col).alias("id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    wanted = [t for t in terms if t not in ("et", "ou", "sauf")] or terms
    post = index.postings() if index else S.postings(docs, id_col, text_col)
    scored = index.bm25(wanted) if index else S.bm25(post, wanted)
    if index and filters:
        scored = scored.join(docs.select(F.col(id_col).alias("id")), "id", "left_semi")
    if S.query_mode(text) == "lexical":
        found = S.compile_boolean(post, S.translate_boolean(text))
        scored = scored.join(found, "id", "left_semi") if found is not None else scored
    scored = scored.withColumn("score", F.round("score", 9))
    return S.ranked(S.relative_cut(scored)).filter((F.col("rank") > offset) & (F.col("rank") <= offset + limit))


def more_like(vectors: DataFrame, owner: int, k: int = 8) -> DataFrame:
    """Owners nearest to one owner's vectors."""
    hits = S.knn(vectors, vectors.filter(F.col("label") == owner), 24 * k)
    return hits.groupBy("doc").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "doc").limit(k)


_FOUND = f"SELECT b.id, round(b.score, 9) AS score FROM ({bm25_sql(POST_DOCS, ['thou', 'tion', 'onre'], 1_000_000_000)}) b JOIN documents ON doc_id = b.id WHERE lang = 'en' AND b.id IN (SELECT id FROM ({POST_DOCS}) WHERE term = 'thou') AND b.id IN (SELECT id FROM ({POST_DOCS}) WHERE term = 'tion') AND b.id NOT IN (SELECT id FROM ({POST_DOCS}) WHERE term = 'onre')"


@query("n10_text_search", f"SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT * FROM (SELECT *, max(score) OVER () AS top FROM ({_FOUND})) WHERE score >= 0.3 * top) QUALIFY rank <= 20")
def _(t):
    return search_documents(t.documents, "thou ET tion SAUF onre", filters={"lang": ["en"]}).select("id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("n9_catalogue", "SELECT lang, count(*) AS n, min(n_chars) AS shortest, max(n_chars) AS longest, count(DISTINCT source) AS sources FROM documents GROUP BY 1")
def _(t):
    return t.documents.groupBy("lang").agg(n_rows().alias("n"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"), F.countDistinct("source").alias("sources"))


@query("k5_embed_batch")
def _(t):
    from corpuslens.functions.udfs import embed

    return t.benchmark.select("item_id", embed("text").alias("vector"))


@query("m2_sql_functions", "SELECT p_partkey, translate(lower(p_name), 'éè', 'ee') AS folded, list_sort(list_filter(['p' || p_partkey, CASE WHEN p_size > 25 THEN 'p' || p_partkey || '|' || p_size END], lambda x: x IS NOT NULL)) AS terms FROM part")
def _(t):
    from corpuslens.functions.udfs import register

    register(t.spark)
    t.part.createOrReplaceTempView("part")
    return t.spark.sql("SELECT p_partkey, fold_stable(p_name) AS folded, array_sort(citation_terms('p' || p_partkey, CASE WHEN p_size > 25 THEN CAST(p_size AS STRING) END)) AS terms FROM part")


@query("h21_rerank")
def _(t):
    from corpuslens.operators.rerank import rerank

    rows = t.documents.orderBy(F.desc("n_chars"), "doc_id").limit(50).select("doc_id", "text").collect()  # the depth of a reranking
    return t.spark.createDataFrame(list(enumerate(rerank([(r.doc_id, r.text) for r in rows], "the tion de la"), 1)), "rank int, doc_id long")
