"""Fields of decisions: each order is written out as a decision, and its fields are read back from the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import text as X
from corpuslens.operators import decisions as D
from corpuslens.operators import extraction
from corpuslens.plans.registry import n_rows, query

_COURTS = {"O": "COUR DE CASSATION\nChambre sociale, formation restreinte", "F": "COUR D'APPEL DE PARIS\nChambre commerciale, juge unique", "P": "TRIBUNAL ADMINISTRATIF DE LYON\nLe juge des référés"}
_ENDS = {"1-URGENT": "CASSE ET ANNULE l'arrêt ; ordonne une expertise", "2-HIGH": "REJETTE le pourvoi", "3-MEDIUM": "DONNE ACTE DU DÉSISTEMENT", "4-NOT SPECIFIED": "CONFIRME le jugement ; ordonne la radiation", "5-LOW": "Dit qu'il n'y a pas lieu de statuer"}


def _choice(column: str, values: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for key, value in values.items():
        out = F.when(F.col(column) == key, F.lit(value)).otherwise(out)
    return out


def decisions(t) -> DataFrame:
    """id, listed (numbers of the metadata), text."""
    o = t.orders.join(t.customer.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"), "left")
    day, key = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    number = lambda k: F.format_string("%02d-%02d.%03d", (k % 100).cast("int"), ((k / 100).cast("long") % 100).cast("int"), (k % 1000).cast("int"))
    lines = [
        _choice("o_orderstatus", _COURTS),
        F.concat(F.lit("Pourvoi n° "), number(key)),
        F.concat(F.lit("Audience publique du "), X.french_date(day)),
        F.concat(F.lit("Entre : Société "), F.coalesce("c_name", F.lit("Inconnue")), F.lit(", représentée par Me Clerc"), (key % 7).cast("string"), F.lit(", de la SCP Clerc et Fils")),
        F.lit("et :"),
        F.concat(F.lit("Mme Dupont"), (key % 11).cast("string"), F.lit(", et M. X")),
        F.concat(F.lit("Pourvoi contre l'arrêt n° 17/"), F.lpad((key % 100000).cast("string"), 5, "0"), F.lit(" rendu le "), X.french_date(F.date_sub(day, 400)), F.lit(" par la cour d'appel de Lyon, dans le litige")),
        F.lit("Vu l'article L. 1231-1 du code du travail ;"),
        F.concat(F.lit("Considérant que le jugement rendu le "), X.french_date(F.date_sub(day, 900)), F.lit(" par le tribunal judiciaire de Nice ; que la cour annule la saisie")),
        F.lit("PAR CES MOTIFS :"),
        _choice("o_orderpriority", _ENDS),
    ]
    return o.select(key.alias("id"), F.concat(F.lit("N-"), (key % 9).cast("string"), F.lit(" , "), number(key)).alias("listed"), F.concat_ws("\n", *lines).alias("text"))


def _fields(t) -> DataFrame:
    return D.fields(decisions(t), "id", "text", "listed")


_N = "printf('%02d-%02d.%03d', o_orderkey % 100, (o_orderkey // 100) % 100, o_orderkey % 1000)"
_DAY = "CAST(o_orderdate AS DATE)"


@query("k15_marker_scan", "SELECT o_orderkey AS id, strpos(text, chr(10) || 'Vu ') AS motives_at, strpos(text, 'PAR CES MOTIFS') AS operative_at FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'COUR DE CASSATION' || chr(10) || 'Chambre sociale, formation restreinte' WHEN 'F' THEN 'COUR D''APPEL DE PARIS' || chr(10) || 'Chambre commerciale, juge unique' ELSE 'TRIBUNAL ADMINISTRATIF DE LYON' || chr(10) || 'Le juge des référés' END || chr(10) || 'Pourvoi n° ' || " + _N + " || chr(10) || 'Vu ' || chr(10) || 'PAR CES MOTIFS :' AS text FROM orders)")
def _(t):
    kept = F.regexp_extract("text", r"(?s)^(.*?Pourvoi n° [0-9.-]+\n)", 1)
    text = F.concat(kept, F.lit("Vu \nPAR CES MOTIFS :"))
    p = D.parts(D.folded(text))
    return decisions(t).select("id", F.length(p["banner"]).cast("long").alias("motives_at"), (F.length(p["banner"]) + F.length(p["motives"]) - F.length(p["operative"]) + 1).cast("long").alias("operative_at"))


@query("k16_outcome", "SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'cassation' WHEN '2-HIGH' THEN 'rejet' WHEN '3-MEDIUM' THEN 'desistement' WHEN '4-NOT SPECIFIED' THEN 'confirmation' WHEN '5-LOW' THEN 'non_lieu' END AS outcome FROM orders")
def _(t):
    return _fields(t).select("id", "outcome")


@query("k17_procedure", "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'P' THEN 'refere' ELSE '' END AS signals, CASE o_orderpriority WHEN '1-URGENT' THEN 'expertise' WHEN '4-NOT SPECIFIED' THEN 'radiation' ELSE '' END AS steps FROM orders")
def _(t):
    return _fields(t).select("id", F.array_join("signals", ",").alias("signals"), F.array_join("steps", ",").alias("steps"))


@query("k18_formation", "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'sociale' WHEN 'F' THEN 'commerciale' END AS chamber, CASE o_orderstatus WHEN 'O' THEN 'formation_restreinte' WHEN 'F' THEN 'juge_unique' END AS formation, CASE o_orderstatus WHEN 'P' THEN 'refere' END AS office FROM orders")
def _(t):
    return _fields(t).select("id", "chamber", "formation", "office")


@query("k19_jurisdiction", "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'cc' WHEN 'F' THEN 'ca:paris' ELSE 'ta:lyon' END AS court FROM orders")
def _(t):
    return _fields(t).select("id", F.col("court.code").alias("court"))


@query("k20_dockets", f"SELECT o_orderkey AS id, 'N-' || o_orderkey % 9 || '|' || {_N} AS dockets FROM orders")
def _(t):
    return _fields(t).select("id", F.array_join("dockets", "|").alias("dockets"))


@query("k21_dates", f"SELECT o_orderkey AS id, {_DAY} AS read_on FROM orders")
def _(t):
    return _fields(t).select("id", "read_on")


@query("k23_parties", "SELECT o_orderkey AS id, c_name AS companies, 'Dupont' || o_orderkey % 11 AS people, 'Clerc' || o_orderkey % 7 AS counsel, 'SCP Clerc et Fils' AS firms FROM orders JOIN customer ON c_custkey = o_custkey")
def _(t):
    named = lambda n: F.array_join(F.transform(F.filter("actors", lambda a: a["nature"] == n), lambda a: a["value"]), "|")
    return _fields(t).select("id", named("company").alias("companies"), named("person").alias("people"), named("counsel").alias("counsel"), named("firm").alias("firms"))


@query("k24_actor_rows", "SELECT o_orderkey AS id, unnest([c_name, 'Dupont' || o_orderkey % 11, 'Clerc' || o_orderkey % 7, 'SCP Clerc et Fils']) AS value, unnest(['demandeur', 'defendeur', 'demandeur', 'demandeur']) AS side, unnest([lower(c_name), 'dupont' || o_orderkey % 11, 'clerc' || o_orderkey % 7, 'clerc et fils']) AS key, unnest([length(c_name), length('Dupont' || o_orderkey % 11), length('Clerc' || o_orderkey % 7), 17]) AS n FROM orders JOIN customer ON c_custkey = o_custkey")
def _(t):
    rows = _fields(t).select("id", F.explode("actors").alias("a")).select("id", "a.value", "a.side", "a.key", (F.col("a.char_end") - F.col("a.char_start")).cast("long").alias("n"))
    return rows


@query("k25_prior_decisions", f"SELECT o_orderkey AS id, unnest(['attacked', 'cited']) AS link, unnest(['ca:lyon|' || ({_DAY} - 400) || '|17/' || printf('%05d', o_orderkey % 100000), 'tj:nice|' || ({_DAY} - 900)]) AS key FROM orders")
def _(t):
    return _fields(t).select("id", F.explode("prior").alias("p")).select("id", "p.link", "p.key")


@query("k26_field_assembly", f"SELECT o_orderstatus AS status, count(*) AS n, count(DISTINCT {_N}) AS numbers, min({_DAY}) AS first_day, max({_DAY}) AS last_day, count(*) FILTER (o_orderpriority = '2-HIGH') AS refused, 4 * count(*) AS actors, 2 * count(*) AS prior FROM orders GROUP BY 1")
def _(t):
    f = _fields(t)
    status = F.when(F.col("court.code") == "cc", "O").when(F.col("court.code") == "ca:paris", "F").otherwise("P")
    return f.groupBy(status.alias("status")).agg(n_rows().alias("n"), F.countDistinct(F.element_at("dockets", -1)).alias("numbers"), F.min("read_on").alias("first_day"), F.max("read_on").alias("last_day"), F.count_if(F.col("outcome") == "rejet").alias("refused"), F.sum(F.size("actors")).cast("long").alias("actors"), F.sum(F.size("prior")).cast("long").alias("prior"))


@query("k12_key_signals", f"SELECT o_orderkey AS id, 'case' AS nature, {_DAY} - 400 AS date, '17/' || printf('%05d', o_orderkey % 100000) AS number, 'ca:lyon' AS court FROM orders")
def _(t):
    p = _fields(t).select("id", D.signals_of_key(F.col("prior")[0]["key"]).alias("s"))
    return p.select("id", "s.nature", "s.date", "s.number", "s.court")


@query("k14_instrument_key", f"SELECT o_orderkey, lower(substr(o_orderpriority, 3)) || '|' || {_DAY} || '|' || o_custkey || '-' || o_orderkey AS key FROM orders")
def _(t):
    day = F.col("o_orderdate").cast("date").cast("string")
    number = F.concat(F.lit("n° "), F.col("o_custkey").cast("string"), F.lit(" – "), F.col("o_orderkey").cast("string"))
    return t.orders.select("o_orderkey", X.instrument_key(F.substring("o_orderpriority", 3, 99), day, number).alias("key"))


@query("k13_gazetteer_snap", "SELECT p_partkey, p_name AS found FROM part WHERE p_partkey IN (SELECT min(p_partkey) FROM part GROUP BY p_name)")
def _(t):
    """Each name, cited as an agreement, finds itself in the list of names."""
    names = t.part.groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey"))
    cited = names.select("p_partkey", F.concat(F.lit("Convention collective nationale des "), "p_name").alias("cited"))
    return extraction.snapped(cited, "p_partkey", "cited", names.select(F.col("p_name").alias("name")), "name").select("p_partkey", "found")


@query("k37_text_case_refs", f"SELECT key, count(*) AS n FROM (SELECT 'ca:lyon|' || ({_DAY} - 400) || '|17/' || printf('%05d', o_orderkey % 100000) AS key FROM orders) GROUP BY 1")
def _(t):
    refs = decisions(t).select("id", F.explode(D.prior_decisions(D.folded(F.col("text")))).alias("p")).filter("p.link = 'attacked'")
    return refs.groupBy(F.col("p.key").alias("key")).agg(n_rows().alias("n"))
