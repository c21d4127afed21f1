"""Fields of decisions, by example."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpuslens.functions import text as X
from corpuslens.operators import decisions as D
from corpuslens.operators import extraction

CASSATION = """COUR DE CASSATION
Chambre sociale, formation restreinte
Pourvoi n° 18-23.954
Audience publique du 13 février 2024
Entre : Société Alpha Bêta, représentée par Me Jean Durand, de la SCP Durand et Fils
et :
M. Paul Martin, et Mme X
Formé contre l'arrêt n° 17/01234 rendu le 3 mars 2020 par la cour d'appel de Paris, dans le litige
Vu l'article L. 1 du code du travail ;
Considérant le jugement rendu le 1er août 2019 par le tribunal judiciaire de Lyon ; que la cour rejette
PAR CES MOTIFS :
CASSE ET ANNULE l'arrêt ; ordonne une expertise."""


@pytest.fixture(scope="module")
def read(spark):
    rows = [(1, CASSATION, "A-1; B-2"), (2, None, None), (3, "", None), (4, "x" * 200_000, None)]
    return {r.id: r for r in D.fields(spark.createDataFrame(rows, "i long, t string, l string"), "i", "t", "l").collect()}


def test_a_judgment_in_cassation(read):
    r = read[1]
    assert (r.court.code, r.chamber, r.formation, r.outcome) == ("cc", "sociale", "formation_restreinte", "cassation")
    assert r.read_on == dt.date(2024, 2, 13) and r.steps == ["expertise"] and r.signals == []
    assert r.dockets == ["A-1", "B-2", "18-23.954"]
    assert [(a.value, a.nature, a.side) for a in r.actors] == [("Alpha Bêta", "company", "demandeur"), ("Paul Martin", "person", "defendeur"), ("Jean Durand", "counsel", "demandeur"), ("SCP Durand et Fils", "firm", "demandeur")]
    assert all(CASSATION[a.char_start : a.char_end] == a.value for a in r.actors)
    assert [(p.link, p.key) for p in r.prior] == [("attacked", "ca:paris|2020-03-03|17/01234"), ("cited", "tj:lyon|2019-08-01")]


def test_texts_without_fields(read):
    for i in (2, 3, 4):
        r = read[i]
        assert r.court.code is None and r.outcome is None and r.dockets == [] and r.actors == [] and r.prior == [] and r.read_on is None


@pytest.mark.parametrize(
    ("operative", "want"),
    [
        ("Rejette la requête.", "rejet"),
        ("La requête est rejetée.", "rejet"),
        ("Donne acte du désistement et rejette le surplus.", "desistement"),
        ("Déclare irrecevable l'appel.", "irrecevabilite"),
        ("INFIRME le jugement en ce qu'il a condamné", "infirmation_partielle"),
        ("INFIRME le jugement.", "infirmation"),
        ("Le pourvoi n'est pas admis.", "non_admission"),
        ("L'arrêté est annulé.", "annulation"),
        ("Condamne aux dépens.", None),
    ],
)
def test_outcomes(spark, operative, want):
    text = f"TRIBUNAL ADMINISTRATIF DE LYON\nVu la loi qui rejette et annule\nPAR CES MOTIFS :\n{operative}"
    assert D.fields(spark.createDataFrame([(1, text)], "i long, t string"), "i", "t").first().outcome == want


@pytest.mark.parametrize(("banner", "want"), [("Cour administrative d'appel de Nantes", "caa:nantes"), ("Tribunal de grande instance d'Aix-en-Provence", "tj:aix-en-provence"), ("CONSEIL D'ÉTAT", "ce"), ("Conseil de prud’hommes de Metz", "cph:metz"), ("Mairie de Lyon", None)])
def test_courts(spark, banner, want):
    assert D.fields(spark.createDataFrame([(1, banner)], "i long, t string"), "i", "t").first().court.code == want


def test_keys(spark):
    rows = spark.createDataFrame([("LOI", "1965-07-10", "n° 65‑557"), ("Décret", "2008-01-02", "65 – 557"), ("LOI", None, "1"), ("LOI", "1965-07-10", "sans"), ("", "1965-07-10", "1")], "n string, d string, x string")
    assert [r.k for r in rows.select(X.instrument_key(F.col("n"), F.col("d"), F.col("x")).alias("k")).collect()] == ["loi|1965-07-10|65-557", "decret|2008-01-02|65-557", None, None, None]


def test_snapping_is_the_gazetteer_of_each_row(spark):
    names = ["Bureaux études techniques", "Bureaux études", "Transports routiers marchandises", "Routiers transports", "Hôtels cafés restaurants parisiens"]
    cited = ["convention collective des bureaux études", "transports routiers", "hôtels cafés", "études", "rien du tout", "cafés hôtels restaurants"]
    got = {r.i: r.found for r in extraction.snapped(spark.createDataFrame(list(enumerate(cited)), "i long, c string"), "i", "c", spark.createDataFrame([(n,) for n in names], "n string"), "n").collect()}
    assert got == {k: found for k, c in enumerate(cited) if (found := extraction.gazetteer(c, names))}
