"""The stored index against postings taken anew."""

from pyspark.sql import functions as F

from corpuslens.operators import search as S
from corpuslens.operators.lexicon import LexicalIndex


def test_index_gives_what_postings_give(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    index = LexicalIndex.stored(docs, "doc_id", F.col("text"), "text")
    post = S.postings(docs, "doc_id", "text")
    assert index.postings().exceptAll(post.select("id", "pos", "term")).count() == 0 and post.select("id", "pos", "term").exceptAll(index.postings()).count() == 0
    for terms in (["tion"], ["thou", "tion", "nowhere"], ["tion", "tion"]):
        want = {r.id: r.score for r in S.bm25(post, list(dict.fromkeys(terms))).collect()}
        got = {r.id: r.score for r in index.bm25(terms).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    both = {r.id for r in post.filter(F.col("term").isin("thou", "tion")).groupBy("id").agg(F.countDistinct("term").alias("n")).filter("n = 2").collect()}
    assert {r.id for r in index.bm25(["thou", "tion"], least=2).collect()} == both


def test_index_is_kept_for_the_same_files_only(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.createDataFrame([(1, "un mot"), (2, None), (3, "le la")], "i long, x string").write.parquet(path)
    first = LexicalIndex.stored(spark.read.parquet(path), "i", F.col("x"), "x")
    assert {r.id for r in first.bm25(["mot"]).collect()} == {1} and first.bm25(["absent"]).count() == 0
    assert LexicalIndex.stored(spark.read.parquet(path), "i", F.col("x"), "x").path == first.path
    assert LexicalIndex.stored(spark.read.parquet(path), "i", F.upper("x"), "other").path != first.path
    spark.createDataFrame([(4, "mot mot")], "i long, x string").write.mode("append").parquet(path)
    again = LexicalIndex.stored(spark.read.parquet(path), "i", F.col("x"), "x")
    assert again.path != first.path and {r.id for r in again.bm25(["mot"]).collect()} == {1, 4}
    spark.createDataFrame([], "i long, x string").write.parquet(f"file://{tmp_path}/none")
    assert LexicalIndex.stored(spark.read.parquet(f"file://{tmp_path}/none"), "i", F.col("x"), "x").bm25(["mot"]).count() == 0
