"""Parsers of published formats: official journal, agreements, circulars, tax doctrine, European and asylum decisions, analyses, titles."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import text as X
from corpuslens.operators import decisions as D
from corpuslens.sources.archives import parse_xml

# Element paths of the published formats; "@name" is an attribute, a path is looked for at any depth.
JOURNAL_ARTICLE = {"uid": "META_COMMUN/ID", "text_uid": "CONTEXTE/TEXTE@cid", "num": "META_ARTICLE/NUM", "state": "META_ARTICLE/ETAT", "valid_from": "META_ARTICLE/DATE_DEBUT", "valid_until": "META_ARTICLE/DATE_FIN", "body": "BLOC_TEXTUEL/CONTENU", "note": "NOTA/CONTENU"}
JOURNAL_TEXT = {"uid": "META_COMMUN/ID", "nature": "META_COMMUN/NATURE", "nor": "META_COMMUN/NOR", "eli": "META_COMMUN/ID_ELI", "num": "META_TEXTE_CHRONICLE/NUM", "signed_on": "META_TEXTE_CHRONICLE/DATE_TEXTE", "published_on": "META_TEXTE_CHRONICLE/DATE_PUBLI", "title": "META_TEXTE_VERSION/TITRE", "full_title": "META_TEXTE_VERSION/TITREFULL"}
AGREEMENT_ARTICLE = {"uid": "META_COMMUN/ID", "container_uid": "CONTEXTE/CONTENEUR@cid", "text_uid": "CONTEXTE/TEXTE@cid", "num": "META_ARTICLE/NUM", "state": "META_ARTICLE/ETAT", "valid_from": "META_ARTICLE/DATE_DEBUT", "valid_until": "META_ARTICLE/DATE_FIN", "body": "BLOC_TEXTUEL/CONTENU"}
AGREEMENT = {"uid": "META_COMMUN/ID", "nature": "META_COMMUN/NATURE", "title": "META_CONTENEUR/TITRE", "state": "META_CONTENEUR/ETAT", "published_on": "META_CONTENEUR/DATE_PUBLI", "brochure": "NUMS_BROCH/NUM_BROCH"}
CIRCULAR = {"number": "ID_CIRCULAIRE", "state": "ETAT", "title": "TITRE", "nor": "NUMERO_NOR", "signed_on": "DATE_SIGNATURE", "exported_on": "DATE_EXPORT", "filed_on": "DATE_DEPOT", "author": "AUTEUR", "signatory": "SIGNATAIRE", "summary": "RESUME", "pdf": "NOM_FICHIER_PDF"}
#: Years from which a date means "without end" or is a slip.
NO_END = 2222


def _value(tree, path: str) -> str | None:
    path, _, attribute = path.partition("@")
    found = tree if tree.tag == path else tree.find(f".//{path}")
    if found is None:
        return None
    raw = found.get(attribute) if attribute else " ".join("".join(found.itertext()).split())
    return raw or None


def read_fields(members: DataFrame, paths: dict[str, str], lists: dict[str, str] | None = None) -> DataFrame:
    """member and the first value at each path (and all values at each of ``lists``); unreadable members are left out."""
    lists = lists or {}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for member, raw in zip(frame["member"], frame["raw"], strict=True):
                tree = parse_xml(bytes(raw))
                if tree is not None:
                    many = [[x for e in tree.findall(f".//{p}") if (x := " ".join("".join(e.itertext()).split()))] for p in lists.values()]
                    rows.append((member, *(_value(tree, p) for p in paths.values()), *many))
            yield pd.DataFrame(rows, columns=["member", *paths, *lists])

    schema = ", ".join(["member string", *(f"{k} string" for k in paths), *(f"{k} array<string>" for k in lists)])
    return members.select("member", "raw").mapInPandas(run, schema)


def day(x: Column) -> Column:
    """A date, null where it stands for no date."""
    d = F.try_to_date(F.left(x, F.lit(10)))
    return F.when(F.year(d) < NO_END, d)


def _versions(r: DataFrame, *owners: str) -> DataFrame:
    state = F.when(F.col("state").startswith("VIGUEUR"), "VIGUEUR").otherwise(F.col("state"))
    return r.select("uid", *owners, "num", X.identity_key(F.col("num")).alias("num_key"), state.alias("state"), day(F.col("valid_from")).alias("valid_from"), day(F.col("valid_until")).alias("valid_until"), "body")


def journal_articles(members: DataFrame) -> DataFrame:
    """Articles of the official journal; those without id or text are refused."""
    return _versions(read_fields(members, JOURNAL_ARTICLE).filter("uid IS NOT NULL AND text_uid IS NOT NULL"), "text_uid")


def journal_texts(members: DataFrame) -> DataFrame:
    """Texts of the official journal with the key of their act, and whether they publish a treaty."""
    r = read_fields(members, JOURNAL_TEXT).filter("uid IS NOT NULL AND title IS NOT NULL")
    treaty = F.lower("title").rlike(r"portant publication (?:de |du |des |d')") & F.lower("title").rlike(r"\b(?:accord|convention|traite|traité|protocole)\b")
    return r.select("uid", "nature", "nor", "eli", "title", day(F.col("signed_on")).alias("signed_on"), day(F.col("published_on")).alias("published_on"), X.instrument_key(F.col("nature"), F.col("signed_on"), F.col("num")).alias("key"), treaty.alias("treaty"))


def agreement_articles(members: DataFrame) -> DataFrame:
    """Articles of collective agreements, anchored to their container; states in force are one."""
    r = read_fields(members, AGREEMENT_ARTICLE).filter("uid IS NOT NULL AND container_uid IS NOT NULL AND valid_from IS NOT NULL")
    return _versions(r, "container_uid", "text_uid")


def agreements(members: DataFrame) -> DataFrame:
    r = read_fields(members, AGREEMENT).filter("uid IS NOT NULL AND title IS NOT NULL")
    return r.withColumn("state", F.when(F.col("state").startswith("VIGUEUR"), "VIGUEUR").otherwise(F.col("state"))).drop("member")


def circulars(members: DataFrame) -> DataFrame:
    """Circulars by id (cir_<number>), with the texts that they name."""
    r = read_fields(members, CIRCULAR, {"cited": "TEXTES_DE_REFERENCE/TEXTE_REF"}).filter("number IS NOT NULL AND title IS NOT NULL")
    return r.select(F.concat(F.lit("cir_"), "number").alias("uid"), F.coalesce("state", F.lit("V")).alias("state"), "title", "nor", day(F.col("signed_on")).alias("signed_on"), day(F.coalesce("exported_on", "filed_on")).alias("published_on"), "author", "signatory", "summary", "pdf", "cited")


def abrogated(lines: DataFrame, column: str) -> DataFrame:
    """uid of the circulars that a list of withdrawn files names."""
    return lines.select(F.regexp_extract(column, r"cir_([0-9]+)", 1).alias("n")).filter("n <> ''").select(F.concat(F.lit("cir_"), "n").alias("uid")).distinct()


_NUMBERED = re.compile(r"(?is)<p\b[^>]*numero-de-paragraphe-western[^>]*>(.*?)</p>|<h([1-6])\b[^>]*>(.*?)</h\2\s*>")
_TAG = re.compile(r"<[^>]+>")


def _plain(html: str) -> str:
    return " ".join(unescape(_TAG.sub(" ", html)).split())


def numbered_paragraphs(html: str | None) -> tuple[str | None, list[tuple[str, str, list[str]]]]:
    """Preamble, and number, text and headings above it of each numbered paragraph."""
    html = (html or "").replace('""', '"')
    out: list[tuple[str, str, list[str]]] = []
    preamble, headings, number, at = [], [], None, 0
    held: list[str] = []

    def close(upto: int) -> None:
        text = _plain(html[at:upto])
        if text:
            (preamble if number is None else held).append(text)

    above: list[str] = []
    for m in _NUMBERED.finditer(html):
        title = _plain(m[1] if m[2] is None else m[3])
        if (m[2] is None and not title.isdigit()) or not title:
            continue
        close(m.start())
        at = m.end()
        if m[2] is None:
            if number is not None:
                out.append((number, " ".join(held), above))
            number, held, above = title, [], [h for _, h in headings]
        else:
            headings = [(level, h) for level, h in headings if level < int(m[2])] + [(int(m[2]), title)]
    close(len(html))
    if number is not None:
        out.append((number, " ".join(held), above))
    return " ".join(preamble) or None, out


def doctrine(lines: DataFrame) -> DataFrame:
    """Tax doctrine from JSON lines: documents in force with their numbered paragraphs; news are left out."""
    r = lines.select(F.from_json("line", "type string, titre string, debut_de_validite string, serie string, division string, identifiant_juridique string, permalien string, contenu_html string").alias("r")).select("r.*")
    kept = r.filter("type = 'Contenu' AND identifiant_juridique IS NOT NULL AND titre IS NOT NULL AND debut_de_validite IS NOT NULL AND serie IS NOT NULL")

    @F.pandas_udf("struct<preamble:string, paragraphs:array<struct<num:string, text:string, path:array<string>>>>")
    def cut(html: pd.Series) -> pd.DataFrame:
        found = [numbered_paragraphs(x) for x in html]
        return pd.DataFrame({"preamble": [p for p, _ in found], "paragraphs": [[{"num": n, "text": t, "path": h} for n, t, h in rows] for _, rows in found]})

    return kept.select(F.col("identifiant_juridique").alias("uid"), F.col("titre").alias("title"), "serie", "division", day(F.col("debut_de_validite")).alias("valid_from"), F.col("permalien").alias("url"), cut("contenu_html").alias("c")).select("uid", "title", "serie", "division", "valid_from", "url", "c.*")


def case_number(celex: Column) -> Column:
    """62020CJ0560 as C-560/20; other forms as they are."""
    form = r"^6([0-9]{4})([A-Z])[A-Z]*0*([0-9]+)$"
    shown = F.concat(F.regexp_extract(celex, form, 2), F.lit("-"), F.regexp_extract(celex, form, 3), F.lit("/"), F.right(F.regexp_extract(celex, form, 1), F.lit(2)))
    return F.when(celex.rlike(form), shown).otherwise(celex)


def european(rows: DataFrame) -> DataFrame:
    """Decisions of the European courts from (kind, uid, columns as JSON, html): court, ECLI as given, dockets, date, text, sections."""
    c = F.from_json("columns", "ecli string, appno string, kpdate string, judgementdate string, `case-law_ecli` string, work_date_document string")
    r = rows.withColumn("c", c).withColumn("full_text", X.strip_html(F.col("html"))).filter("uid <> '' AND full_text <> ''")
    human = F.col("kind") == "cedh"
    listed = F.filter(F.transform(F.split("c.appno", ";"), lambda x: F.trim(x)), lambda x: x != "")
    on = F.when(human, F.coalesce(F.try_to_date(F.left("c.kpdate", F.lit(10))), F.try_to_timestamp(F.left("c.judgementdate", F.lit(10)), F.lit("dd/MM/yyyy")).cast("date"))).otherwise(F.try_to_date("c.work_date_document"))
    return r.select(
        F.concat_ws("/", "kind", "uid").alias("source_uid"),
        F.upper("kind").alias("court"),
        F.nullif(F.when(human, F.col("c.ecli")).otherwise(F.col("c.case-law_ecli")), F.lit("")).alias("ecli"),
        F.when(human, listed).otherwise(F.array(case_number(F.col("uid")))).alias("dockets"),
        on.alias("read_on"),
        "full_text",
        D.sections(D.folded(F.col("full_text"))).alias("sections"),
    )


_START = re.compile(r"(?i)^(?:vu\b|considérant|sur\b|article\s+\d|décide|en ce qui concerne|\d+\.\s|[-–•])")
_PAGE = re.compile(r"(?i)^(?:n°\s*\d+\s*$|page\s+\d+|-?\s*\d+\s*-?$)")
_DECIDE = re.compile(r"(?i)^\s*d\s*[ée]\s*c\s*i\s*d\s*e\s*:?\s*$")


def reflow(raw: str | None) -> str:
    """Text of a paged document as paragraphs: page furniture goes, lines and words that pages and margins broke are joined."""
    lines = [x.strip() for x in (raw or "").replace("\f", "\n").split("\n")]
    often = Counter(x for x in lines if x)
    out: list[str] = []
    open_ = False
    for line in lines:
        if not line or _PAGE.match(line) or (often[line] >= 3 and len(line) < 80):
            continue
        if _DECIDE.match(line):
            out.append("DECIDE :")
            open_ = False
        elif open_ and not _START.match(line) and out[-1][-1] not in ".;:":
            out[-1] = out[-1][:-1] + line if out[-1].endswith("-") and line[0].islower() else f"{out[-1]} {line}"
        else:
            out.append(line)
            open_ = True
    return "\n".join(out)


def asylum(rows: DataFrame) -> DataFrame:
    """Asylum decisions from (number, published, raw text of the pages): made-up ECLI, date, text in paragraphs, sections, outcome."""

    @F.pandas_udf("string")
    def flowed(raw: pd.Series) -> pd.Series:
        return raw.map(reflow)

    r = rows.withColumn("full_text", flowed("raw")).filter("full_text <> ''")
    low = D.folded(F.col("full_text"))
    on = F.coalesce(D.date_after(low, r"lecture du|audience du|decision du"), F.col("published").cast("date"))
    return r.select("number", F.concat(F.lit("ECLI:FR:CNDA:"), F.year(on).cast("string"), F.lit(":"), "number").alias("ecli"), on.alias("read_on"), "full_text", D.sections(low).alias("sections"), D._first(D.parts(low)["operative"], D.OUTCOMES).alias("outcome"))


_CODE = re.compile(r"^\s*(\d{2,3}(?:-\d{2,3})*)\s*:\s*(.*)$")


def analysis(html: str | None) -> dict:
    """An analysis page: docket, level, headings of its plan (code, label, title, place of its summary), summaries and notes, each once."""
    out: dict = {"docket": None, "level": None, "headings": [], "summaries": [], "notes": []}
    blocks = []
    for part in re.split(r"(?i)<hr\s*/?>", html or ""):
        paragraphs = [[unescape(_TAG.sub("", line)).strip() for line in re.split(r"(?i)<br\s*/?>", p)] for p in re.split(r"(?i)</?p\b[^>]*>", part)]
        paragraphs = [[x for x in p if x] for p in paragraphs]
        blocks.append([p for p in paragraphs if p])
    for k, block in enumerate(b for b in blocks if b):
        flat = " ".join(x for p in block for x in p)
        if k == 0:
            number = re.search(r"N°\s*([0-9][0-9,\s]*)", flat)
            out["docket"] = re.sub(r"\D", "", number[1]) or None if number else None
            out["level"] = next((x for p in block for x in p if re.match(r"(?i)(?:publié|mentionné|inédit)", x)), None)
        elif m := _CODE.match(block[0][0]):
            label = " - ".join(x.rstrip("-").strip() for x in [m[2], *block[0][1:]] if x.strip("- "))
            out["headings"].append({"code": m[1], "label": label, "title": " ".join(" ".join(p) for p in block[1:]), "summary": None})
        else:
            notes = [x for p in block if re.match(r"\(\d+\)\s", p[0]) for x in p]
            out["notes"] += [x for x in dict.fromkeys(notes) if x not in out["notes"]]
            body = "\n".join("\n".join(p) for p in block if not re.match(r"\(\d+\)\s", p[0]))
            if body:
                if body not in out["summaries"]:
                    out["summaries"].append(body)
                open_ = [h for h in out["headings"] if h["summary"] is None]
                if open_:
                    open_[-1]["summary"] = out["summaries"].index(body)
    return out


def analyses(rows: DataFrame, html: str) -> DataFrame:
    """``rows`` with the struct ``analysis`` of their page."""

    @F.pandas_udf("struct<docket:string, level:string, headings:array<struct<code:string, label:string, title:string, summary:int>>, summaries:array<string>, notes:array<string>>")
    def read(pages: pd.Series) -> pd.DataFrame:
        found = [analysis(x) for x in pages]
        return pd.DataFrame({k: [f[k] for f in found] for k in ("docket", "level", "headings", "summaries", "notes")})

    return rows.withColumn("analysis", read(html))


# How titles name courts; longer names first.
TITLE_COURTS = (("CAA", "CAA"), ("CEDH", "CEDH"), ("CE", "CE"), ("TA", "TA"), ("CASS", "CC"), ("CNDA", "CNDA"), ("CJUE", "CJUE"))


def title_citation(title: Column) -> Column:
    """court, date and dockets that a post's title cites; null where any is missing."""
    first = F.upper(F.trim(F.split_part(title, F.lit(","), F.lit(1))))
    court = F.lit(None).cast("string")
    for start, code in reversed(TITLE_COURTS):
        court = F.when(first.startswith(start), code).otherwise(court)
    low = D.folded(title)
    on = D.day(F.regexp_extract(low, rf"({D.DATE})", 1))
    rest = F.regexp_extract(title, r"(?i)[0-9]{1,2}(?:er)? \p{L}+ [0-9]{4}(.*)$", 1)
    raw = F.transform(F.split(rest, r"[,;]| et "), lambda x: F.upper(F.regexp_replace(F.regexp_replace(x, r"\s+", ""), r"^[nN°.]+", "")))
    numbers = F.transform(F.filter(raw, lambda x: x.rlike("[0-9]")), lambda x: F.when(court == "CC", F.regexp_replace(x, r"^([0-9]{2}-[0-9]{2})\.?([0-9]{3})$", "$1.$2")).otherwise(x))
    return F.when(court.isNotNull() & on.isNotNull() & (F.size(numbers) > 0), F.struct(court.alias("court"), on.alias("date"), numbers.alias("dockets")))
