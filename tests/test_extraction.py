import pytest

from corpuslens.functions import udfs
from corpuslens.operators import extraction as E
from corpuslens.operators import rerank
from corpuslens.plans import services


def test_citations_and_their_antecedents():
    text = "Vu les articles L. 225-1 à L. 225-3 et 700 du code de commerce ; l'article 5 du même code."
    got = [(i, n) for _, _, i, n in E.read(text).citations]
    assert got == [("code de commerce", n) for n in ("L. 225-1", "L. 225-2", "L. 225-3", "700", "5")]


def test_sections_and_outcome():
    r = E.read("En-tête\nVu le code\nAttendu que rien\nPAR CES MOTIFS\nla cour CASSE ET ANNULE l'arrêt")
    assert [k for k, _, _ in r.sections] == ["preamble", "visa", "motivations", "dispositif"] and r.outcome == "cassation"


def test_gazetteer_abstains_on_ties():
    names = ["Convention collective nationale des transports routiers", "Convention collective nationale des transports routiers urbains", "Accord métallurgie région parisienne"]
    assert E.gazetteer("convention des transports routiers", names) == names[0]
    assert E.gazetteer("convention transports", names) is None


def test_names_and_votes():
    assert E.resolve_key("La Société Dupont-Durand SARL") == "dupont-durand"
    assert E.domain_vote([("b", 1.0), ("a", 0.5), ("a", 0.5)]) == "a" and E.domain_vote([]) is None


def test_rerank():
    items = [(1, "rien"), (2, "bail commercial"), (3, "bail")]
    assert rerank.rerank(items, "bail commercial") == [2, 3, 1]
    assert rerank.rerank(items, "x", lambda q, t: None) == [1, 2, 3]
    assert rerank.merge([1, 2, 3, 4], [3, 1, 9]) == [3, 1, 2, 4]
    assert rerank.parse_scores("scores: [1, 200]", 2) == [1.0, 100.0] and rerank.parse_scores("[1]", 2) is None


def test_embeddings_depend_on_the_text_alone():
    a = udfs.deterministic_embedding("x")
    assert a == udfs.deterministic_embedding("x") != udfs.deterministic_embedding("y") and abs(sum(v * v for v in a) - 1) < 1e-9


def test_sql_functions(spark):
    udfs.register(spark)
    r = spark.sql("SELECT fold_stable('Œuvre') AS f, article_number_key('L. 761-1') AS k, citation_terms('u', NULL) AS t").first()
    assert (r.f, r.k, r.t) == ("ouvre", "l761-1", ["u"])
    assert [x.key for x in spark.sql("SELECT * FROM following_keys(array('a', 'b', 'c'), 'b')").collect()] == ["b", "c"]


def test_requests():
    assert services.parse_date("") is None
    for bad in ("2020-13-01", "1500-01-01"):
        with pytest.raises(services.BadRequest):
            services.parse_date(bad)


def test_search_service(spark):
    docs = spark.createDataFrame([(1, "bail commercial", "fr"), (2, "bail habitation", "fr"), (3, "lease", "en")], "doc_id long, text string, lang string")
    assert [r.id for r in services.search_documents(docs, "bail SAUF habitation").collect()] == [1]
    assert services.search_documents(docs, "le la").count() == 0
