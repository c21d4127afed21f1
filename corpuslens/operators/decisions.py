"""Fields of court decisions read from their text, as column expressions.

Rules are data: vocabularies by field, in order of precedence. A text is divided into banner (up to the first motive
or visa), motives and operative part; each field names the part that it reads, so a word that tells an earlier step
of the case isn't taken for this decision's. Everything stays in the JVM; a document is read once, by ``fields``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import text as X
from corpuslens.operators.relational import spread

# Wording, folded, by field. The first entry that is found wins.
MOTIVES = r"(?m)^\s*(?:vu\b|considerant\b|attendu\b|sur quoi\b|faits et procedure\b)"
OPERATIVE = r"(?m)^\s*(?:par ces motifs\b|decide\s*:|ordonne\s*:|d e c i d e\b)"
COURTS = (
    ("cc", r"cour de cassation"),
    ("ce", r"conseil d'etat"),
    ("cons", r"conseil constitutionnel"),
    ("tc", r"tribunal des conflits"),
    ("caa", r"cour administrative d'appel"),
    ("ta", r"tribunal administratif"),
    ("ca", r"cour d'appel"),
    ("tcom", r"tribunal de commerce"),
    ("cph", r"conseil de prud'hommes"),
    ("tj", r"tribunal (?:judiciaire|de grande instance)"),
    ("cedh", r"cour europeenne des droits de l'homme"),
    ("cjue", r"cour de justice de l'union europeenne"),
    ("cnda", r"cour nationale du droit d'asile"),
)
CHAMBERS = (
    ("sociale", r"chambre sociale|\bsoc\."),
    ("commerciale", r"chambre commerciale|\bcom\."),
    ("criminelle", r"chambre criminelle|\bcrim\."),
    ("civile_1", r"(?:premiere|1re|1ere) chambre civile"),
    ("civile_2", r"(?:deuxieme|2e|2eme) chambre civile"),
    ("civile_3", r"(?:troisieme|3e|3eme) chambre civile"),
    ("correctionnelle", r"chambre des appels correctionnels|tribunal correctionnel"),
)
FORMATIONS = (
    ("assemblee_pleniere", r"assemblee pleniere"),
    ("chambre_mixte", r"chambre mixte"),
    ("assemblee", r"assemblee du contentieux|\bassemblee\b"),
    ("section", r"section du contentieux"),
    ("chambres_reunies", r"chambres reunies"),
    ("formation_restreinte", r"formation restreinte"),
    ("juge_unique", r"juge unique|magistrat designe"),
)
OFFICES = (("refere", r"juge des referes|ordonnance de refere"), ("mise_en_etat", r"mise en etat"), ("premier_president", r"premier president"), ("president", r"\bpresident du tribunal\b"))
OUTCOMES = (
    ("desistement", r"donne acte (?:du|de son|de leur) desistement|constate le desistement"),
    ("non_admission", r"pourvoi n'est pas admis|non[- ]admission du pourvoi|declare non admis"),
    ("cassation_partielle", r"casse et annule,? (?:mais )?(?:seulement|partiellement)"),
    ("cassation", r"casse et annule"),
    ("non_lieu", r"n'y a pas lieu (?:de|a) statuer|non[- ]lieu a statuer"),
    ("irrecevabilite", r"declare irrecevable"),
    ("infirmation_partielle", r"infirme partiellement|infirme[^.;]{0,80}\ben ce qu"),
    ("infirmation", r"\binfirme\b"),
    ("confirmation", r"\bconfirme\b"),
    ("annulation", r"\bannule\b|\b(?:est|sont) annulee?s?\b"),
    ("rejet", r"\brejette\b|\b(?:est|sont) rejetee?s?\b"),
)
PROCEDURES = (
    ("qpc", r"question prioritaire de constitutionnalite"),
    ("renvoi_prejudiciel", r"question prejudicielle|renvoi prejudiciel"),
    ("refere", r"juge des referes|ordonnance de refere|\ben refere\b"),
    ("non_admission", r"non[- ]admission"),
    ("filtrage", r"manifestement irrecevable|irrecevabilite manifeste"),
    ("jonction", r"jonction (?:des|de ces) (?:requetes|pourvois|instances|procedures)|joint les (?:requetes|pourvois)"),
    ("expertise", r"ordonne une expertise|expertise judiciaire"),
    ("sursis", r"sursis a statuer|surseoir a statuer"),
    ("radiation", r"ordonne la radiation"),
)
_MONTH = "janvier|fevrier|mars|avril|mai|juin|juillet|aout|septembre|octobre|novembre|decembre"
DATE = rf"([0-9]{{1,2}})(?:er)? ({_MONTH}) ([0-9]{{4}})"
DOCKETS = r"\b(?:[0-9]{2}-[0-9]{2}\.[0-9]{3}|[0-9]{2}/[0-9]{4,6}|[0-9]{2}[A-Z]{2}[0-9]{4,6}|[CT]-[0-9]{1,3}/[0-9]{2})\b"
_NAME = r"[A-ZÀÂÇÉÈÊËÎÏÔÛ][\p{L}'’&#0-9-]*(?: (?:et|de|du|des|la|le|[A-ZÀÂÇÉÈÊËÎÏÔÛ0-9&#][\p{L}'’&#0-9-]*))*"
COMPANY = rf"\b(?:[Ss]ociété|SARL|SAS|SA|SCI|SNC) ({_NAME})"
PERSON = rf"\b(?:MM?\.|Mmes?|Mme|M\.) ({_NAME})"
COUNSEL = rf"\b(?:Me|Maître) ({_NAME})"
FIRM = rf"\b((?:SCP|SELARL|SELAS|AARPI) {_NAME})"
INTERVENOR = rf"(?i:interven\w+ volontaire\w*)[^.;\n]{{0,20}}?(?:[Ss]ociété|M\.|Mme) ({_NAME})"
PRIOR = rf"(arret|jugement|ordonnance|decision) (?:n° ?([0-9/.-]+) )?rendue? le {DATE} par (?:la |le |l')?([^,;.\n(]+)"


def _first(x: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """Name of the first rule that is found."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        out = F.when(x.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def _all(x: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    return F.array_compact(F.array(*[F.when(x.rlike(p), F.lit(n)) for n, p in rules]))


def folded(x: Column) -> Column:
    """Length-preserving fold that keeps line breaks, with plain apostrophes."""
    return F.translate(F.lower(x), X.ACCENTED + "œæ\t\u00a0\u202f’", X.PLAIN + "oa   '")


def parts(x: Column) -> Column:
    """banner, motives and operative part of a folded text; without a marker the text is banner, the tail operative."""
    motive = F.regexp_instr(x, F.lit(MOTIVES))
    last = F.regexp_instr(x, F.lit(OPERATIVE))
    first = F.when(motive > 0, motive).when(last > 0, last).otherwise(F.length(x) + 1)
    tail = F.when(last > 0, F.substr(x, last)).otherwise(F.right(x, F.lit(3000)))
    return F.struct(F.substr(x, F.lit(1), first - 1).alias("banner"), F.substr(x, first).alias("motives"), tail.alias("operative"))


def day(found: Column) -> Column:
    """Date of a folded "13 fevrier 2024"."""
    month = F.array_position(F.array(*map(F.lit, _MONTH.split("|"))), F.regexp_extract(found, DATE, 2))
    return F.when(found.rlike(DATE), F.try_to_date(F.concat_ws("-", F.regexp_extract(found, DATE, 3), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(found, DATE, 1), 2, "0"))))


def date_after(x: Column, cue: str) -> Column:
    return day(F.regexp_extract(x, rf"(?:{cue})[^\n]{{0,40}}?({DATE})", 1))


def court(x: Column) -> Column:
    """type, place and code (type:place) of the first court that a folded text names."""
    names = "|".join(p for _, p in COURTS)
    found = F.regexp_extract(x, rf"({names})(?: (?:de |d')([a-z][a-z' -]*[a-z]))?", 0)
    kind = _first(found, COURTS)
    place = F.nullif(F.trim(F.regexp_extract(found, rf"^(?:{names}) (?:de |d')([a-z][a-z' -]*[a-z])$", 1)), F.lit(""))
    local = kind.isin("caa", "ta", "ca", "tcom", "cph", "tj")
    code = F.when(local & place.isNotNull(), F.concat(kind, F.lit(":"), X.slug(place))).otherwise(kind)
    return F.struct(kind.alias("type"), F.when(local, place).alias("place"), code.alias("code"))


def dockets(listed: Column, banner: Column) -> Column:
    """Numbers of the metadata list (split at commas and semicolons), then those of the banner, each once."""
    given = F.filter(F.transform(F.split(F.coalesce(listed, F.lit("")), "[,;]"), lambda n: F.trim(n)), lambda n: n != "")
    own = F.upper(F.regexp_replace(banner, PRIOR, " "))  # not those of earlier decisions
    return F.array_distinct(F.concat(given, F.regexp_extract_all(own, F.lit(DOCKETS), F.lit(0))))


def _names(x: Column, pattern: str, group: int = 1) -> Column:
    """Names found, each once; anonymised ones ("M. X", "Mme A...") are none."""
    found = F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(group)), lambda n: F.regexp_replace(F.trim(n), r"(?: (?:et|de|du|des|la|le))+$", ""))
    return F.array_distinct(F.filter(found, lambda n: (F.length(n) > 1) & ~n.rlike(r"^[A-Z](?:\.\.\.)?$")))


def party_key(name: Column) -> Column:
    """Folded name without punctuation, article, legal form and "société"."""
    plain = F.regexp_replace(X.fold_nfd(name), r"[^\p{L}\p{N}\s#-]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\b(?:la|le|les|l|societes?|sa|sas|sarl|eurl|sci|scp|selarl|selas|aarpi|sasu|snc|gie)\b", " "), r"\s+", " "))


def actors(original: Column, low: Column) -> Column:
    """Rows of the actors: value, key, nature, side and the place of their first mention (code points, end exclusive)."""
    opponent = F.regexp_instr(low, F.lit(r"(?m)^\s*(?:et|contre)\s*:"))

    def rows(values: Column, nature: str, sided: bool) -> Column:
        def row(v: Column) -> Column:
            at = F.instr(original, v) if isinstance(v, str) else F.position(v, original)
            side = F.when(opponent == 0, F.lit(None)).when(at < opponent, "demandeur").otherwise("defendeur") if sided else F.lit(None)
            return F.struct(v.alias("value"), party_key(v).alias("key"), F.lit(nature).alias("nature"), side.cast("string").alias("side"), (at - 1).cast("int").alias("char_start"), (at - 1 + F.length(v)).cast("int").alias("char_end"))

        return F.transform(values, row)

    people = _names(original, PERSON)
    return F.concat(rows(_names(original, COMPANY), "company", True), rows(people, "person", True), rows(_names(original, COUNSEL), "counsel", True), rows(_names(original, FIRM), "firm", True), rows(_names(original, INTERVENOR), "intervenor", False))


def prior_decisions(low: Column) -> Column:
    """Earlier decisions that the text names: kind, link (attacked in the banner or operative part, else cited), court code, date, number, key."""
    found = F.regexp_extract_all(low, F.lit(PRIOR), F.lit(0))

    def row(m: Column) -> Column:
        where, on, number = court(F.regexp_extract(m, PRIOR, 6))["code"], day(m), F.nullif(F.regexp_extract(m, PRIOR, 2), F.lit(""))
        link = F.when(low.contains(F.concat(F.lit("contre l'"), m)) | low.contains(F.concat(F.lit("contre le "), m)) | low.contains(F.concat(F.lit("annule l'"), m)) | low.contains(F.concat(F.lit("annule le "), m)), "attacked").otherwise("cited")
        return F.struct(F.regexp_extract(m, PRIOR, 1).alias("kind"), link.alias("link"), where.alias("court"), on.alias("date"), number.alias("number"), F.concat_ws("|", where, on.cast("string"), number).alias("key"))

    return F.array_distinct(F.transform(found, row))


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """A projection that the optimiser doesn't merge into later ones, so each column is computed once."""
    return rows.select(F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def fields(docs: DataFrame, id_col: str, text_col: str, listed_col: str | None = None) -> DataFrame:
    """All fields of each document, from one reading: id, court, chamber, formation, office, outcome, procedures, dockets, read_on, heard_on, actors, prior."""
    listed = F.col(listed_col) if listed_col else F.lit(None).cast("string")
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = _once(spread(docs), id=F.col(id_col), original=text, listed=listed, low=folded(text))
    read = _once(read, id=F.col("id"), original=F.col("original"), listed=F.col("listed"), low=F.col("low"), p=parts(F.col("low")))
    banner, low = F.col("p.banner"), F.col("low")
    return read.select(
        F.col("id").alias("id"),
        court(banner).alias("court"),
        _first(banner, CHAMBERS).alias("chamber"),
        _first(banner, FORMATIONS).alias("formation"),
        _first(banner, OFFICES).alias("office"),
        _first(F.col("p.operative"), OUTCOMES).alias("outcome"),
        _all(banner, PROCEDURES[:5]).alias("signals"),
        _all(low, PROCEDURES[5:]).alias("steps"),
        dockets(F.col("listed"), banner).alias("dockets"),
        F.coalesce(date_after(banner, r"lu en audience publique le|audience publique du|arret du|jugement du|ordonnance du|decision du"), date_after(low, r"lu en audience publique le")).alias("read_on"),
        date_after(banner, r"audience du|debats? a l'audience|seance du").alias("heard_on"),
        actors(F.col("original"), low).alias("actors"),
        prior_decisions(low).alias("prior"),
    )


def signals_of_key(key: Column) -> Column:
    """nature, date, number and jurisdiction that the key of a text or case tells."""
    parts_ = F.split(key, r"\|")
    case = key.rlike(r"^[a-z]+(?::[a-z-]+)?\|[0-9]{4}-")
    return F.struct(
        F.when(case, "case").otherwise(F.nullif(F.get(parts_, 0), F.lit(""))).alias("nature"),
        F.try_to_date(F.get(parts_, 1)).alias("date"),
        F.get(parts_, 2).alias("number"),
        F.when(case & F.get(parts_, 0).rlike(r"^(?:cc|ce|cons|tc|caa|ta|ca|tcom|cph|tj|cedh|cjue|cnda)\b"), F.get(parts_, 0)).alias("court"),
    )


SECTIONS = (("visa", r"(?m)^\s*vu\b"), ("procedure", r"(?m)^\s*faits et procedure\b"), ("motivations", r"(?m)^\s*(?:considerant|attendu|sur quoi)\b"), ("dispositif", OPERATIVE))
# Names of the courts' types.
COURT_LABELS = {"cc": "Cour de cassation", "ce": "Conseil d'État", "cons": "Conseil constitutionnel", "tc": "Tribunal des conflits", "caa": "Cour administrative d'appel", "ta": "Tribunal administratif", "ca": "Cour d'appel", "tcom": "Tribunal de commerce", "cph": "Conseil de prud'hommes", "tj": "Tribunal judiciaire", "cedh": "Cour européenne des droits de l'homme", "cjue": "Cour de justice de l'Union européenne", "cnda": "Cour nationale du droit d'asile"}


def sections(low: Column) -> Column:
    """kind, char_start, char_end of a folded text's sections: from each kind's first marker to the next one, before it the preamble."""
    pinned = lambda x, body: F.element_at(F.transform(F.array(x), body), 1)  # noqa: E731 - computed once, not for each use

    def cut(t: Column) -> Column:
        marks = F.array_sort(F.filter(F.array(*[F.struct((F.regexp_instr(t, F.lit(p)) - 1).alias("char_start"), F.lit(k).alias("kind")) for k, p in SECTIONS]), lambda m: m["char_start"] >= 0))
        opening = F.array(F.struct(F.lit(0).alias("char_start"), F.lit("preamble").alias("kind")))
        whole = lambda m: F.when((F.size(m) > 0) & (F.get(m, 0)["char_start"] > 0), F.concat(opening, m)).otherwise(m)
        ends = lambda w: F.transform(w, lambda m, i: F.struct(m["kind"].alias("kind"), m["char_start"].alias("char_start"), F.coalesce(F.get(w, i + 1)["char_start"], F.length(t)).alias("char_end")))
        return pinned(marks, lambda m: pinned(whole(m), ends))

    return pinned(low, cut)


def court_label(code: Column) -> Column:
    """Name of a court's code; places capitalised."""
    kind, place = F.split_part(code, F.lit(":"), F.lit(1)), F.split_part(code, F.lit(":"), F.lit(2))
    label = F.try_element_at(F.create_map(*[F.lit(x) for kv in COURT_LABELS.items() for x in kv]), kind)
    link = F.when(place.rlike("^[aeiouy]"), F.lit(" d'")).otherwise(F.lit(" de "))
    return F.when(place == "", label).otherwise(F.concat(label, link, F.regexp_replace(F.initcap(F.regexp_replace(place, "-", " ")), " ", "-")))


def from_storage(stored: DataFrame) -> DataFrame:
    """Decisions rebuilt from (source_uid, source_fields as JSON, full_text): the one path for chunks, fields and display."""
    fields_ = F.from_json("source_fields", "Dossier struct<Date_Lecture:string, Titre:string, Nom_Juridiction:string, Numero:string>")["Dossier"]
    return stored.select("source_uid", F.try_to_date(fields_["Date_Lecture"]).alias("read_on"), fields_["Titre"].alias("title"), fields_["Nom_Juridiction"].alias("court"), fields_["Numero"].alias("listed"), "full_text")
