"""Published formats, by example."""

import datetime as dt
import json

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as contract
from corpuslens.sources import parsers


def test_titles(spark):
    titles = ["CE, 5 février 2026, n°499141", "Cass. 1re civ., 1er mars 2025, n° 24-15449 et 24-15.450", "CAA Paris, 2 août 2024, n°24pa04236; 24PA04237", "Colloque, 5 février 2026, 12", "CE, sans date, 12", "CE, 5 février 2026", None]
    got = [r.c for r in spark.createDataFrame([(t,) for t in titles], "t string").select(parsers.title_citation(F.col("t")).alias("c")).collect()]
    assert [(c.court, c.date, c.dockets) for c in got[:3]] == [("CE", dt.date(2026, 2, 5), ["499141"]), ("CC", dt.date(2025, 3, 1), ["24-15.449", "24-15.450"]), ("CAA", dt.date(2024, 8, 2), ["24PA04236", "24PA04237"])]
    assert got[3:] == [None] * 4


def test_case_numbers(spark):
    rows = spark.createDataFrame([("62020CJ0560",), ("62019TO0007",), ("other",)], "x string")
    assert [r.c for r in rows.select(parsers.case_number(F.col("x")).alias("c")).collect()] == ["C-560/20", "T-7/19", "other"]


def test_numbered_paragraphs():
    html = '<p>Avant</p><h1>I. A</h1><p class="numero-de-paragraphe-western">1</p><p>un</p><h2>B</h2><p class=""numero-de-paragraphe-western"">10</p><p>dix</p><p class="numero-de-paragraphe-western">note</p><h1>II. C</h1><p class="numero-de-paragraphe-western">20</p>vingt'
    assert parsers.numbered_paragraphs(html) == ("Avant", [("1", "un", ["I. A"]), ("10", "dix note", ["I. A", "B"]), ("20", "vingt", ["II. C"])])
    assert parsers.numbered_paragraphs(None) == (None, []) and parsers.numbered_paragraphs("<p>plan</p>") == ("plan", [])


def test_reflow():
    assert parsers.reflow("COUR\nn° 12\nVu la re-\nquête de\f3\nM. X ;\nConsidérant que\n\nla suite.\nD É C I D E :\nArticle 1er : rejet") == "COUR\nVu la requête de M. X ;\nConsidérant que la suite.\nDECIDE :\nArticle 1er : rejet"
    assert parsers.reflow(None) == "" and parsers.reflow("\f\n 3 \n") == ""


def test_analysis_pages():
    page = "<p>Conseil d'Etat<br>N° 438885</p><p>Mentionné aux tables</p><hr><p>54-06-05 : Procédure -<br>Dépens</p><p>Titre</p><hr/><p>Le sommaire.</p><p>(1) Cf. CE, 1.</p><hr><p>26 : Droits</p><p>Autre</p><hr><p>Le sommaire.</p><p>(1) Cf. CE, 1.</p>"
    got = parsers.analysis(page)
    assert (got["docket"], got["level"], got["summaries"], got["notes"]) == ("438885", "Mentionné aux tables", ["Le sommaire."], ["(1) Cf. CE, 1."])
    assert [(h["code"], h["label"], h["title"], h["summary"]) for h in got["headings"]] == [("54-06-05", "Procédure - Dépens", "Titre", 0), ("26", "Droits", "Autre", 0)]
    assert parsers.analysis(None) == parsers.analysis("<p></p>") == {"docket": None, "level": None, "headings": [], "summaries": [], "notes": []}


def test_members_that_are_no_documents(spark):
    raws = [b"<ARTICLE><META><META_COMMUN><ID>A1</ID></META_COMMUN></META><CONTEXTE><TEXTE cid='T1'/></CONTEXTE><NUM/></ARTICLE>", b"<ARTICLE><META_COMMUN><ID>A2</ID></META_COMMUN></ARTICLE>", b"not xml", b""]
    members = spark.createDataFrame([(f"{k}.xml", bytearray(r)) for k, r in enumerate(raws)], "member string, raw binary")
    assert [(r.uid, r.text_uid, r.valid_until) for r in parsers.journal_articles(members).collect()] == [("A1", "T1", None)]
    assert parsers.agreement_articles(members).count() == 0 and parsers.circulars(members).count() == 0


def test_european_rows(spark):
    rows = [("cedh", "001-1", json.dumps({"appno": "1/01; 2/02", "judgementdate": "14/11/1960 00:00:00", "ecli": "ECLI:X"}), "<p>Vu la loi</p>"), ("cjue", "62020CJ0560", "{}", "<p>x</p>"), ("cedh", "", "{}", "<p>x</p>"), ("cedh", "2", "{}", " "), ("cedh", "3", None, "<p>y</p>")]
    got = {r.source_uid: r for r in parsers.european(spark.createDataFrame(rows, "kind string, uid string, columns string, html string")).collect()}
    assert set(got) == {"cedh/001-1", "cjue/62020CJ0560", "cedh/3"}
    assert got["cedh/001-1"].dockets == ["1/01", "2/02"] and got["cedh/001-1"].read_on == dt.date(1960, 11, 14) and got["cedh/001-1"].sections[0].kind == "visa"
    assert got["cjue/62020CJ0560"].dockets == ["C-560/20"] and got["cjue/62020CJ0560"].ecli is None


def test_european_numbers_of_seven_digits_against_sql(spark, tmp_path):
    rows = [(k, 7, "O", 1.0, dt.datetime(1998, 2, 6), "5-LOW") for k in (2, 3, 999_999, 1_000_001, 1_000_003, 12_345_678, 12_345_679)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    got = sorted(map(tuple, contract.queries()["a10_european_decisions"](spark, str(tmp_path)).collect()))
    assert got == sorted(db.execute(contract.oracle_sql()["a10_european_decisions"]).fetchall()) and len({r[0] for r in got}) == 7
