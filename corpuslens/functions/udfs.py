"""SQL functions and table functions that users can call after ``register``."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.functions import text as X

_MASK = (1 << 64) - 1


def fnv1a(text: str) -> int:
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 & _MASK
    return h


def _splitmix(state: int) -> tuple[int, int]:
    state = state + 0x9E3779B97F4A7C15 & _MASK
    z = state
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & _MASK
    z = (z ^ z >> 27) * 0x94D049BB133111EB & _MASK
    return state, z ^ z >> 31


def deterministic_embedding(text: str, dim: int = 64) -> list[float]:
    """Unit vector that depends on the text alone: seeded Gaussians, for tests of vector paths."""
    state, out = fnv1a(text), []
    while len(out) < dim:
        state, a = _splitmix(state)
        state, b = _splitmix(state)
        u, v = (a >> 11) / (1 << 53) or 1e-300, (b >> 11) / (1 << 53)
        r = math.sqrt(-2 * math.log(u))
        out += [r * math.cos(2 * math.pi * v), r * math.sin(2 * math.pi * v)]
    n = math.sqrt(sum(x * x for x in out[:dim])) or 1.0
    return [x / n for x in out[:dim]]


@F.pandas_udf(T.ArrayType(T.FloatType()))
def embed(texts: pd.Series) -> pd.Series:
    """Batch embedder; a service-backed one has the same shape."""
    return texts.map(lambda t: deterministic_embedding(t or ""))


class FollowingKeys:
    """Table function: the keys of an article and of its siblings that follow it."""

    def eval(self, keys: list, anchor: str):
        ordered = list(keys or [])
        if anchor in ordered:
            rest = ordered[ordered.index(anchor) :]
            if 2 <= len(rest) <= 20:
                for k in rest:
                    yield (k,)


def register(spark: SparkSession) -> None:
    """Temporary SQL functions fold_stable, article_number_key and citation_terms, and following_keys()."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION fold_stable(x STRING) RETURNS STRING RETURN translate(lower(x), '{X.ACCENTED}œæ', '{X.PLAIN}oa')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION article_number_key(x STRING) RETURNS STRING RETURN regexp_replace(regexp_replace(lower(x), '[^a-z0-9*()]+', '-'), '^(lo|lp|l|r|d|a)-([0-9])', '$1$2')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION citation_terms(uid STRING, num STRING) RETURNS ARRAY<STRING> RETURN array_distinct(array_compact(array(uid, CASE WHEN num IS NOT NULL THEN concat(uid, '|', num) END)))")
    spark.udf.register("embed_text", embed)
    spark.udtf.register("following_keys", F.udtf(FollowingKeys, returnType="key string"))
