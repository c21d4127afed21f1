"""Scans of archives and compressed files as DataFrames.

Archives are read by Spark's ``binaryFile`` source, so any store Spark can reach works; members are then
unpacked in the tasks, one archive in memory at a time, and yielded in small batches.
"""

from __future__ import annotations

import csv
import io
import re
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from html import escape, unescape
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.schemas import MEMBER

BATCH_BYTES = 32 << 20


def files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """path, content of the files under ``path`` whose name matches, at any depth."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")


def _unpack(found: DataFrame, members: Callable[[bytes], Iterator[tuple[str, bytes]]]) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                rows, held = [], 0
                for name, raw in members(bytes(content)):
                    rows.append((path.rsplit("/", 1)[-1], name, raw))
                    held += len(raw)
                    if held > BATCH_BYTES:
                        yield pd.DataFrame(rows, columns=["archive", "member", "raw"])
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=["archive", "member", "raw"])

    return found.mapInPandas(run, MEMBER)


def unzipped(found: DataFrame, suffix: str = ".xml") -> DataFrame:
    """archive, member, raw of the members with ``suffix`` of zip archives (path, content)."""

    def members(content: bytes) -> Iterator[tuple[str, bytes]]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for info in z.infolist():
                if info.filename.lower().endswith(suffix):
                    yield info.filename, z.read(info)

    return _unpack(found, members)


def zip_members(spark: SparkSession, path: str, suffix: str = ".xml", glob: str = "*.zip") -> DataFrame:
    return unzipped(files(spark, path, glob), suffix)


def untarred(found: DataFrame, suffix: str = "") -> DataFrame:
    """archive, member, raw of the regular files of compressed tar archives (path, content), read as a stream."""

    def members(content: bytes) -> Iterator[tuple[str, bytes]]:
        with tarfile.open(fileobj=io.BytesIO(content), mode="r|gz") as t:
            for info in t:
                if info.isfile() and info.name.endswith(suffix):
                    yield info.name, t.extractfile(info).read()

    return _unpack(found, members)


def tar_members(spark: SparkSession, path: str, suffix: str = "", glob: str = "*.tar.gz") -> DataFrame:
    return untarred(files(spark, path, glob), suffix)


def member_names(members: DataFrame) -> DataFrame:
    return members.select("archive", "member").distinct()


def jsonl(spark: SparkSession, path: str, schema: str | None = None, glob: str = "*.jsonl.gz") -> DataFrame:
    """Lines of compressed JSON files at any depth: parsed with a schema, else as trimmed text."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path).select(F.trim("value").alias("line"))
    return lines.select(F.from_json("line", schema).alias("r")).select("r.*") if schema else lines


def csv_records(spark: SparkSession, path: str, delimiter: str = ";", encoding: str = "latin-1", suffix: str = ".csv", glob: str = "*.zip") -> DataFrame:
    return csv_from(zip_members(spark, path, suffix, glob), delimiter, encoding)


def csv_from(members: DataFrame, delimiter: str = ";", encoding: str = "latin-1") -> DataFrame:
    """archive, member, line, record (column to value) of CSV members, by their header."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for archive, member, raw in zip(frame["archive"], frame["member"], frame["raw"], strict=True):
                try:
                    text = bytes(raw).decode("utf-8-sig")
                except UnicodeDecodeError:
                    text = bytes(raw).decode(encoding, "replace")
                rows = []
                for n, record in enumerate(csv.DictReader(io.StringIO(text), delimiter=delimiter)):
                    rows.append((archive, member, n, {k: v for k, v in record.items() if k is not None and not isinstance(v, list)}))
                    if len(rows) == 20_000:
                        yield pd.DataFrame(rows, columns=["archive", "member", "line", "record"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["archive", "member", "line", "record"])

    return members.mapInPandas(run, "archive string, member string, line long, record map<string,string>")


def parse_xml(raw: bytes) -> ElementTree.Element | None:
    """Tree of a document; a stray ampersand or control character is repaired, anything worse gives None."""
    for attempt in (raw, re.sub(rb"&(?!#?\w+;)", b"&amp;", re.sub(rb"[\x00-\x08\x0b\x0c\x0e-\x1f]", b"", raw))):
        try:
            return ElementTree.fromstring(attempt)
        except ElementTree.ParseError:
            continue
    return None


def xml_fields(members: DataFrame, fields: dict[str, str]) -> DataFrame:
    """archive, member, ok and, for each field, the joined text of the elements at its path."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for archive, member, raw in zip(frame["archive"], frame["member"], frame["raw"], strict=True):
                tree = parse_xml(bytes(raw))
                values = [" ".join(" ".join("".join(e.itertext()) for e in tree.findall(path)).split()) or None if tree is not None else None for path in fields.values()]
                rows.append((archive, member, tree is not None, *values))
            yield pd.DataFrame(rows, columns=["archive", "member", "ok", *fields])

    return members.mapInPandas(run, "archive string, member string, ok boolean, " + ", ".join(f"`{f}` string" for f in fields))


def docx_text(raw: bytes) -> str:
    """Paragraphs of a DOCX file; other bytes give the empty string."""
    if raw[:2] != b"PK":
        return ""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = z.read("word/document.xml").decode("utf-8")
    paragraphs = re.findall(r"<w:p[ >].*?</w:p>", body, re.S)
    return "\n".join(unescape("".join(re.findall(r"<w:t[^>]*>([^<]*)</w:t>", p))) for p in paragraphs)


def docx_bytes(text: str) -> bytes:
    """A DOCX file of the text's lines, as paragraphs."""
    paragraphs = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in text.split("\n"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{paragraphs}</w:body></w:document>')
    return out.getvalue()


_DOUBLE = re.compile(r"[Â-ô][\u0080-¿]+")


def repair_encoding(text: str) -> str:
    """Undo UTF-8 that was decoded as Latin-1, where the bytes form valid UTF-8."""

    def fix(m: re.Match[str]) -> str:
        try:
            return m.group().encode("latin-1").decode("utf-8")
        except UnicodeDecodeError:
            return m.group()

    return _DOUBLE.sub(fix, text).replace("&amp;nbsp;", " ")


def repaired(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with a column's encoding repaired."""

    @F.pandas_udf("string")
    def mended(texts: pd.Series) -> pd.Series:
        return texts.map(repair_encoding, na_action="ignore")

    return rows.withColumn(column, mended(column))


def decisions_from_json(lines: DataFrame) -> DataFrame:
    """Court decisions from API lines: identity, court, date, dockets, text and its zones as sections."""
    schema = "id string, jurisdiction string, chamber string, decision_date string, number string, numbers array<string>, ecli string, text string, zones map<string,array<struct<start:int,`end`:int>>>"
    r = lines.select(F.from_json("line", schema).alias("r")).select("r.*").filter("id IS NOT NULL")
    sections = F.transform(F.flatten(F.transform(F.map_entries(F.coalesce("zones", F.expr("map()"))), lambda z: F.transform(z["value"], lambda s: F.struct(z["key"].alias("kind"), s["start"].alias("start_char"), s["end"].alias("end_char"))))), lambda s: s)
    return r.select(F.col("id").alias("source_uid"), "jurisdiction", "chamber", F.try_to_date("decision_date").alias("date_lecture"), F.coalesce("numbers", F.array("number")).alias("docket_numbers"), "ecli", F.col("text").alias("full_text"), F.array_sort(sections).alias("sections"))


def sparql_rows(responses: DataFrame, column: str, names: list[str]) -> DataFrame:
    """One row for each binding of SPARQL JSON responses."""
    schema = f"results struct<bindings:array<struct<{', '.join(f'{n}:struct<value:string>' for n in names)}>>>"
    parsed = F.from_json(column, schema)
    return responses.select(F.explode(parsed["results"]["bindings"]).alias("b")).select(*[F.col(f"b.{n}.value").alias(n) for n in names])


# Element paths of the published XML of law articles and of decisions.
ARTICLE_PATHS = {
    "uid": "META/META_COMMUN/ID",
    "num": "META/META_SPEC/META_ARTICLE/NUM",
    "etat": "META/META_SPEC/META_ARTICLE/ETAT",
    "date_debut": "META/META_SPEC/META_ARTICLE/DATE_DEBUT",
    "date_fin": "META/META_SPEC/META_ARTICLE/DATE_FIN",
    "text_uid": "CONTEXTE/TEXTE",
    "body": "BLOC_TEXTUEL/CONTENU",
}
DECISION_PATHS = {
    "source_uid": "META/META_COMMUN/ID",
    "title": "META/META_SPEC/META_JURI/TITRE",
    "date_lecture": "META/META_SPEC/META_JURI/DATE_DEC",
    "jurisdiction": "META/META_SPEC/META_JURI/JURIDICTION",
    "number": "META/META_SPEC/META_JURI/NUMERO",
    "full_text": "TEXTE/BLOC_TEXTUEL/CONTENU",
}


def law_articles(members: DataFrame) -> DataFrame:
    """Article versions with their keys; the far-future end of a version in force is null."""
    from corpuslens.functions.text import identity_key

    r = xml_fields(members, ARTICLE_PATHS).filter("ok AND uid IS NOT NULL")
    end = F.try_to_date("date_fin")
    return r.select("uid", "num", identity_key(F.col("num")).alias("num_key"), "etat", F.try_to_date("date_debut").alias("date_debut"), F.when(F.year(end) < 2999, end).alias("date_fin"), "body")


def decisions_from_xml(members: DataFrame) -> DataFrame:
    r = xml_fields(members, DECISION_PATHS).filter("ok AND source_uid IS NOT NULL")
    return r.select("source_uid", "title", "jurisdiction", F.try_to_date("date_lecture").alias("date_lecture"), F.filter(F.transform(F.split("number", ","), lambda n: F.trim(n)), lambda n: n != "").alias("docket_numbers"), "full_text")
