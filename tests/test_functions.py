from pyspark.sql import functions as F

from corpuslens.functions import text as X
from corpuslens.functions import vectors as V


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_tokens_and_folds(spark):
    assert one(spark, "Référé-suspension", X.tokens) == ["refere-suspension"]
    assert one(spark, "l'instruction", X.tokens) == ["l", "instruction"]
    assert one(spark, "Œuvre", X.fold) == "œuvre" and one(spark, "Œuvre", X.fold_stable) == "oeuvre".replace("oe", "o")
    assert one(spark, "  L’Été  à\n Paris ", X.fold_nfd) == "l'ete a paris"


def test_article_keys(spark):
    for form in ("L. 761-1", "L761-1", "L 761-1", "l. 761-1"):
        assert one(spark, form, X.article_key) == "l761-1"
    assert one(spark, "R*212-4", X.article_key) == "r*212-4"
    assert one(spark, "106 Bis", X.article_key) == "106-bis"
    assert one(spark, "1er", X.identity_key) == "1" and one(spark, "Premier", X.identity_key) == "1"
    assert one(spark, "l761-1", X.display_key) == "L. 761-1"


def test_clean_text(spark):
    assert one(spark, "  ligne 1  \n\n\n\n  ligne 2  ", X.clean_text) == "ligne 1\n\nligne 2"
    assert one(spark, "a<br/>b", X.clean_text) == "a\nb"
    assert one(spark, "le le chat chat", X.collapse_repeats) == "le chat"


def test_usage_grams(spark):
    assert one(spark, "l'article 700", X.usage_grams) == ["article", "l_article"]


def test_content_runs(spark):
    runs = one(spark, "tribunal de commerce paris", lambda x: X.content_runs(X.tokens(x), 1))
    assert runs == [["tribunal"], ["commerce", "paris"]]


def test_dates(spark):
    assert one(spark, "2024-02-13", lambda x: X.french_date(x.cast("date"))) == "13 février 2024"
    assert str(one(spark, "1er août 2020", X.parse_french_date)) == "2020-08-01"
    assert one(spark, "31 février 2020", X.parse_french_date) is None


def test_natural_order(spark):
    keys = ["r1", "l10-1", "l2-1", "3", "annexe-1", "lo1", "l2"]
    df = spark.createDataFrame([(k,) for k in keys], "k string").orderBy(X.natural_key(F.col("k")))
    assert [r.k for r in df.collect()] == ["3", "l2", "l2-1", "l10-1", "lo1", "r1", "annexe-1"]


def test_trigram_similarity(spark):
    row = spark.createDataFrame([("word", "two words")], "a string, b string").select(X.trigram_similarity(F.col("a"), F.col("b")).alias("s")).first()
    assert abs(row.s - 0.363636) < 1e-5


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0])], "a array<float>, b array<float>").select(V.norm(F.col("a")).alias("n"), V.cosine(F.col("a"), F.col("b")).alias("c"), V.literal(V.normalise(F.col("a"))).alias("l")).first()
    assert row.n == 5.0 and abs(row.c - 0.96) < 1e-9 and row.l == "[0.600000,0.800000]"


def test_cited_numbers(spark):
    assert one(spark, " L. 225 – 1 .", X.normalise_article) == "L. 225-1" and one(spark, "12 . 3);", X.normalise_article) == "12.3"


def test_summary_input_keeps_texts_whole_up_to_its_limit(spark):
    from functools import partial

    whole, long = "é" * 80_000, "a" * 56_000 + "b" * 101 + "c" * 24_000
    assert one(spark, whole, X.summary_input) == whole
    assert one(spark, long, X.summary_input) == "a" * 56_000 + "\n[...]\n" + "c" * 24_000
    assert one(spark, "abcdefgh", partial(X.summary_input, limit=7, head=3, tail=2)) == "abc\n[...]\ngh"
