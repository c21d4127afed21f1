"""Sources and file sinks: tables are packed into the published formats and scanned again."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions import text as X
from corpuslens.plans.registry import n_rows, query
from corpuslens.sources import archives, incremental, parsers, sitemap
from corpuslens.sources.shared import scratch

MEMBERS = 200


def _zip(members: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, raw in members:
            z.writestr(name, raw)
    return out.getvalue()


def _tar(members: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, raw in members:
            info = tarfile.TarInfo(name)
            info.size = len(raw)
            t.addfile(info, io.BytesIO(raw))
    return out.getvalue()


def packed(rows: DataFrame, pack: Callable[[list[tuple[str, bytes]]], bytes] = _zip, decoy: bool = True) -> DataFrame:
    """path, content: rows (member, raw) as archives of ``MEMBERS`` members, with a member of another kind in each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), MEMBERS):
                part = frame.iloc[at : at + MEMBERS]
                members = [(m, bytes(r)) for m, r in zip(part["member"], part["raw"], strict=True)]
                yield pd.DataFrame({"path": [f"archive-{members[0][0]}"], "content": [pack(members + [("read.me", b"nothing")] * decoy)]})

    return rows.selectExpr("member", "CAST(raw AS binary) AS raw").mapInPandas(run, "path string, content binary")


def escaped(c) -> F.Column:
    """Text as XML content; ampersands stay as they are, so the tolerant parser has to mend them."""
    return F.replace(F.replace(c, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def element(name: str, *content) -> F.Column:
    """An XML element; a path a/b makes elements in each other."""
    tags = name.split("/")
    return F.concat(F.lit("".join(f"<{t}>" for t in tags)), *content, F.lit("".join(f"</{t}>" for t in reversed(tags))))


def flat(c) -> F.Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


_FLAT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


def _xml_docs(t) -> DataFrame:
    body = element("doc", element("id", F.col("doc_id").cast("string")), element("lang", "lang"), element("text", escaped(F.col("text"))))
    return t.documents.select(F.concat(F.lit("d/"), "doc_id", F.lit(".xml")).alias("member"), body.alias("raw"))


_XML = "'<doc><id>' || doc_id || '</id><lang>' || lang || '</lang><text>' || replace(replace(text, '<', '&lt;'), '>', '&gt;') || '</text></doc>'"


@query("a1_zip_xml_scan", f"SELECT 'd/' || doc_id || '.xml' AS member, md5({_XML}) AS checksum FROM documents")
def _(t):
    return archives.unzipped(packed(_xml_docs(t))).select("member", F.md5("raw").alias("checksum"))


@query("a2_tar_gz_scan", f"SELECT 'd/' || doc_id || '.xml' AS member, md5({_XML}) AS checksum FROM documents")
def _(t):
    return archives.untarred(packed(_xml_docs(t), _tar), ".xml").select("member", F.md5("raw").alias("checksum"))


@query("a3_jsonl_gz_scan", "SELECT doc_id, lang, md5(text) AS checksum FROM documents")
def _(t):
    path = scratch(t.spark, "jsonl")
    lines = t.documents.select(F.concat(F.lit("  "), F.to_json(F.struct("doc_id", "lang", "text")), F.lit(" ")).alias("value"), "source")
    lines.write.partitionBy("source").option("compression", "gzip").text(path)
    return archives.jsonl(t.spark, path, "doc_id long, lang string, text string", glob="*.txt.gz").select("doc_id", "lang", F.md5("text").alias("checksum"))


@query("a4_file_glob", "SELECT source, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    path = scratch(t.spark, "tree")
    t.documents.select("source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit("\n")).alias("value")).write.partitionBy("source", "lang").text(path)
    found = archives.files(t.spark, path, "*.txt").select(F.regexp_extract("path", "source=([^/]*)/lang=", 1).alias("source"), F.explode(F.split(F.col("content").cast("string"), "\n")).alias("line"))
    return found.filter("line <> ''").groupBy("source").agg(n_rows().alias("n"))


@query("a5_csv_record_scan", "SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal FROM customer")
def _(t):
    line = F.concat_ws(";", F.col("c_custkey").cast("string"), F.concat(F.lit('"'), "c_name", F.lit('"')), F.col("c_acctbal").cast("decimal(20,2)").cast("string"))
    files = t.customer.groupBy((F.col("c_custkey") % 50).alias("f")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    text = F.encode(F.concat(F.lit("clé;nom;solde\n"), F.array_join("lines", "\n")), "ISO-8859-1")
    records = archives.csv_from(archives.unzipped(packed(files.select(F.concat("f", F.lit(".csv")).alias("member"), text.alias("raw"))), ".csv"))
    r = F.col("record")
    return records.select(r["clé"].cast("long").alias("c_custkey"), r["nom"].alias("c_name"), F.round(r["solde"].cast("double"), 2).alias("c_acctbal"))


@query("a6_xml_tree", f"SELECT doc_id, lang, length({_FLAT}) AS n FROM documents")
def _(t):
    found = archives.xml_fields(archives.unzipped(packed(_xml_docs(t))), {"id": "id", "lang": "lang", "text": "text"})
    return found.filter("ok").select(F.col("id").cast("long").alias("doc_id"), "lang", F.length("text").cast("long").alias("n"))


_DECISION = "SELECT 'JURI' || o_orderkey AS source_uid, 'Décision ' || o_orderpriority AS title, CASE o_orderstatus WHEN 'O' THEN 'Cour de cassation' ELSE 'Cour d''appel' END AS jurisdiction, CAST(o_orderdate AS DATE) AS date_lecture, o_orderkey || '|' || o_custkey AS dockets, 'Sur ' || o_clerk || ' & suites' AS full_text FROM orders".replace("o_clerk", "o_orderpriority")


def _decisions(t) -> DataFrame:
    key, court = F.col("o_orderkey").cast("string"), F.when(F.col("o_orderstatus") == "O", "Cour de cassation").otherwise("Cour d'appel")
    return t.orders.select(key.alias("key"), F.concat(F.lit("Décision "), "o_orderpriority").alias("title"), court.alias("court"), F.col("o_orderdate").cast("date").cast("string").alias("day"), F.col("o_custkey").cast("string").alias("other"), F.concat(F.lit("Sur "), "o_orderpriority", F.lit(" & suites")).alias("text"))


@query("a7_decision_xml", _DECISION)
def _(t):
    d = _decisions(t)
    paths = archives.DECISION_PATHS
    values = {"source_uid": F.concat(F.lit("JURI"), "key"), "title": F.col("title"), "date_lecture": F.col("day"), "jurisdiction": F.col("court"), "number": F.concat("key", F.lit(", "), "other"), "full_text": escaped(F.col("text"))}
    body = element("DECISION", *[element(paths[k], v) for k, v in values.items()])
    files = packed(d.select(F.concat("key", F.lit(".xml")).alias("member"), body.alias("raw")))
    return archives.decisions_from_xml(archives.unzipped(files)).select("source_uid", "title", "jurisdiction", "date_lecture", F.array_join("docket_numbers", "|").alias("dockets"), "full_text")


@query("a8_decision_json", "SELECT 'JURI' || o_orderkey AS source_uid, CASE o_orderstatus WHEN 'O' THEN 'Cour de cassation' ELSE 'Cour d''appel' END AS jurisdiction, CAST(o_orderdate AS DATE) AS date_lecture, o_orderkey || '|' || o_custkey AS dockets, 'Sur ' || o_orderpriority || ' & suites' AS full_text, length('Sur ' || o_orderpriority) AS section_end FROM orders")
def _(t):
    d = _decisions(t)
    end = F.length("text") - F.length(F.lit(" & suites"))
    zones = F.create_map(F.lit("motivations"), F.array(F.struct(F.lit(0).alias("start"), end.alias("end"))))
    line = F.to_json(F.struct(F.concat(F.lit("JURI"), "key").alias("id"), F.col("court").alias("jurisdiction"), F.col("day").alias("decision_date"), F.array("key", "other").alias("numbers"), "text", zones.alias("zones")))
    return archives.decisions_from_json(d.select(line.alias("line"))).select("source_uid", "jurisdiction", "date_lecture", F.array_join("docket_numbers", "|").alias("dockets"), "full_text", F.col("sections")[0]["end_char"].cast("long").alias("section_end"))


@query("a14_law_article_xml", "SELECT 'ART' || p_partkey AS uid, 'L. ' || p_size || '-' || p_partkey AS num, CASE WHEN p_size > 25 THEN DATE '2020-01-01' + CAST(p_size AS INTEGER) END AS date_fin, p_name AS body FROM part")
def _(t):
    key, paths = F.col("p_partkey").cast("string"), archives.ARTICLE_PATHS
    end = F.when(F.col("p_size") > 25, F.date_add(F.lit("2020-01-01").cast("date"), F.col("p_size").cast("int")).cast("string")).otherwise("2999-01-01")
    values = {"uid": F.concat(F.lit("ART"), key), "num": F.concat(F.lit("L. "), F.col("p_size").cast("string"), F.lit("-"), key), "etat": F.lit("VIGUEUR"), "date_debut": F.lit("2001-02-03"), "date_fin": end, "body": F.col("p_name")}
    files = packed(t.part.select(F.concat(key, F.lit(".xml")).alias("member"), element("ARTICLE", *[element(paths[k], v) for k, v in values.items()]).alias("raw")))
    return archives.law_articles(archives.unzipped(files)).select("uid", "num", "date_fin", "body")


@query("a19_sparql_bindings", "SELECT n_name AS name, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey")
def _(t):
    value = lambda c: F.struct(F.lit("literal").alias("type"), F.col(c).alias("value"))
    j = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))  # the fixed table of regions
    b = j.groupBy("r_regionkey").agg(F.collect_list(F.struct(value("n_name").alias("name"), value("r_name").alias("region"))).alias("bindings"))
    response = F.to_json(F.struct(F.struct(F.col("bindings")).alias("results")))
    return archives.sparql_rows(b.select(response.alias("response")), "response", ["name", "region"])


@query("a20_docx_text", "SELECT doc_id, md5(text) AS checksum FROM documents")
def _(t):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "text": [archives.docx_text(archives.docx_bytes(x or "")) for x in frame["text"]]})

    return t.documents.select("doc_id", "text").mapInPandas(run, "doc_id long, text string").select("doc_id", F.md5("text").alias("checksum"))


@query("a22_paged_source", "SELECT doc_id FROM documents WHERE source > 'src0'")
def _(t):
    path = scratch(t.spark, "pages")
    t.documents.select("source", F.col("doc_id").cast("string").alias("value")).repartition(1, "source").write.partitionBy("source").text(path)
    names = archives.files(t.spark, path, "*.txt").select("path", F.regexp_extract("path", "source=([^/]*)/", 1).alias("source"))
    t.spark.dataSource.register(incremental.PagedFolder)
    folders = [r.source for r in names.filter("source > 'src0'").select("source").distinct().collect()]  # one row for each folder
    legs = [t.spark.read.format("paged_folder").option("path", f"{path}/source={s}").load() for s in sorted(folders)]
    out = legs[0]
    for leg in legs[1:]:
        out = out.unionByName(leg)
    return out.filter("line RLIKE '^[0-9]+$'").select(F.col("line").cast("long").alias("doc_id"))


@query("a24_keyset_pages", "SELECT page, min(doc_id) AS first_id, max(doc_id) AS last_id, count(*) AS n FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 500 AS page FROM documents) GROUP BY 1")
def _(t):
    rows = sitemap.numbered_files(t.documents.select(F.col("doc_id").alias("loc")), 500)
    return rows.groupBy(F.col("file").alias("page")).agg(F.min("loc").alias("first_id"), F.max("loc").alias("last_id"), n_rows().alias("n"))


@query("a25_sampled_scan", "SELECT doc_id, length(text) AS n FROM documents WHERE doc_id % 10 = 0")
def _(t):
    return incremental.every_nth(t.documents, "doc_id", 10).select("doc_id", F.length("text").cast("long").alias("n"))


@query("a26_reservoir_sample", "SELECT doc_id FROM documents ORDER BY md5('7|' || doc_id), doc_id LIMIT 100")
def _(t):
    return incremental.reservoir(t.documents.select("doc_id"), "doc_id", 100, seed=7)


_FILES = "SELECT strftime(CAST(o_orderdate AS DATE), '%Y/%m') AS path, count(*) AS size FROM orders GROUP BY 1"
_KNOWN = f"SELECT path, CASE WHEN path LIKE '%/06' THEN size + 1 ELSE size END AS size FROM ({_FILES}) WHERE path < '1996'"


def _files(t) -> tuple[DataFrame, DataFrame]:
    files = t.orders.groupBy(F.date_format(F.col("o_orderdate").cast("date"), "yyyy/MM").alias("path")).agg(n_rows().alias("size"))
    known = files.filter("path < '1996'").select("path", F.when(F.col("path").like("%/06"), F.col("size") + 1).otherwise(F.col("size")).alias("size"))
    return files, known


@query("a27_incremental_state", f"SELECT f.path, f.size FROM ({_FILES}) f LEFT JOIN ({_KNOWN}) k ON k.path = f.path AND k.size = f.size WHERE k.path IS NULL")
def _(t):
    return incremental.unseen(*_files(t))


@query("b22_manifest", f"SELECT path, size FROM ({_FILES})")
def _(t):
    files, known = _files(t)
    return incremental.advance(known, incremental.unseen(files, known))


_LINES = "SELECT o_custkey % 64 AS file, o_orderkey, row_number() OVER (PARTITION BY o_custkey % 64 ORDER BY o_orderkey) AS line FROM orders"


@query("a28_append_resume", f"SELECT l.file, l.o_orderkey FROM ({_LINES}) l WHERE l.line > (l.file * 5) % 40")
def _(t):
    lines = t.orders.select((F.col("o_custkey") % 64).alias("file"), "o_orderkey").withColumn("line", F.row_number().over(Window.partitionBy("file").orderBy("o_orderkey")))
    state = t.spark.range(64).select(F.col("id").alias("file"), ((F.col("id") * 5) % 40).alias("done"))
    return incremental.after_done(lines, state, "file", "line").select("file", "o_orderkey")


@query("a29_month_calendar", "SELECT strftime(m, '%Y-%m') AS month, last_day(CAST(m AS DATE)) AS last_day FROM (SELECT unnest(generate_series(date_trunc('month', min(o_orderdate)), max(o_orderdate), INTERVAL 1 MONTH)) AS m FROM orders)")
def _(t):
    low, high = t.orders.agg(F.date_format(F.min("o_orderdate"), "yyyy-MM"), F.date_format(F.max("o_orderdate"), "yyyy-MM")).first()
    return incremental.months(t.spark, low, high)


@query("a30_archive_compaction", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id % 64 = 0)) WHERE rn = 1")
def _(t):
    gone = t.events.filter("event_id % 64 = 0").select("user_id")
    return incremental.compact(t.events.select("user_id", "event_id"), "user_id", "event_id", gone)


@query("a31_encoding_repair", "SELECT doc_id, md5(text) AS checksum FROM documents")
def _(t):
    twice = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return archives.repaired(t.documents.select("doc_id", twice.alias("text")), "text").select("doc_id", F.md5("text").alias("checksum"))


@query("b7_bulk_copy", "SELECT o_orderstatus, count(*) AS n, sum(o_custkey) AS keys FROM orders GROUP BY 1")
def _(t):
    path = scratch(t.spark, "copy")
    t.orders.write.partitionBy("o_orderstatus").parquet(path)
    return t.spark.read.parquet(path).groupBy("o_orderstatus").agg(n_rows().alias("n"), F.sum("o_custkey").alias("keys"))


@query("b21_push_payload", """SELECT file, '{"host":"x.org","key":"k","urlList":[' || string_agg('"https://x.org' || loc || '"', ',' ORDER BY loc) || ']}' AS payload FROM (SELECT '/p/' || p_partkey AS loc, (row_number() OVER (ORDER BY '/p/' || p_partkey) - 1) // 300 AS file FROM part) GROUP BY 1""")
def _(t):
    return sitemap.push_payloads(t.part.select(F.concat(F.lit("/p/"), F.col("p_partkey").cast("string")).alias("loc")), "k", "x.org", 300)


# published formats


def _published(t, root: str, paths: dict[str, str], values: dict[str, F.Column], more: tuple = ()) -> DataFrame:
    """Parts written out in a format, as unpacked members."""
    parts = []
    for name, value in values.items():
        path, _, attribute = paths[name].partition("@")
        if attribute:
            *above, last = path.split("/")
            parts.append(F.concat(F.lit("".join(f"<{x}>" for x in above) + f'<{last} {attribute}="'), value, F.lit('"/>' + "".join(f"</{x}>" for x in reversed(above)))))
        else:
            parts.append(element(path, value))
    body = element(root, *parts, *more)
    return archives.unzipped(packed(t.part.select(F.concat(F.col("p_partkey").cast("string"), F.lit(".xml")).alias("member"), body.alias("raw"))))


@query("a15_journal_articles", "SELECT 'JORFARTI' || p_partkey AS uid, 'JORFTEXT' || p_size AS text_uid, 'l' || p_size || '-' || p_partkey AS num_key, DATE '2001-02-03' AS valid_from, CASE WHEN p_size > 25 THEN DATE '2020-01-31' END AS valid_until, p_name AS body FROM part")
def _(t):
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    values = {"uid": F.concat(F.lit("JORFARTI"), key), "text_uid": F.concat(F.lit("JORFTEXT"), size), "num": F.concat(F.lit("L. "), size, F.lit("-"), key), "state": F.lit("VIGUEUR"), "valid_from": F.lit("2001-02-03"), "valid_until": F.when(F.col("p_size") > 25, "2020-01-31").otherwise("2999-01-01"), "body": F.col("p_name")}
    return parsers.journal_articles(_published(t, "ARTICLE", parsers.JOURNAL_ARTICLE, values)).select("uid", "text_uid", "num_key", "valid_from", "valid_until", "body")


@query("a15_journal_texts", "SELECT 'JORFTEXT' || p_partkey AS uid, 'decret|2001-02-03|' || p_size || '-' || p_partkey AS key, p_size % 2 = 0 AS treaty FROM part")
def _(t):
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    title = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("Décret portant publication de l'accord sur "), "p_name")).otherwise(F.concat(F.lit("Décret relatif à "), "p_name"))
    values = {"uid": F.concat(F.lit("JORFTEXT"), key), "nature": F.lit("DECRET"), "num": F.concat(F.lit("n° "), size, F.lit("-"), key), "signed_on": F.lit("2001-02-03"), "title": title}
    return parsers.journal_texts(_published(t, "TEXTE_VERSION", parsers.JOURNAL_TEXT, values)).select("uid", "key", "treaty")


@query("a16_agreement_articles", "SELECT 'KALIARTI' || p_partkey AS uid, 'KALICONT' || p_size AS container_uid, CASE WHEN p_size % 3 = 0 THEN 'ABROGE' ELSE 'VIGUEUR' END AS state, p_name AS body FROM part")
def _(t):
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    state = F.when(F.col("p_size") % 3 == 0, "ABROGE").when(F.col("p_size") % 3 == 1, "VIGUEUR_ETEN").otherwise("VIGUEUR_NON_ETEN")
    values = {"uid": F.concat(F.lit("KALIARTI"), key), "container_uid": F.concat(F.lit("KALICONT"), size), "num": F.lit(""), "state": state, "valid_from": F.lit("2001-02-03"), "valid_until": F.lit("2999-01-01"), "body": F.col("p_name")}
    return parsers.agreement_articles(_published(t, "ARTICLE", parsers.AGREEMENT_ARTICLE, values)).select("uid", "container_uid", "state", "body")


@query("a17_tax_doctrine", "SELECT 'BOI-' || p_partkey AS uid, unnest(['1', '10']) AS num, unnest(['Texte ' || p_name, p_name || ' suite et fin']) AS text, unnest(['I. Règles', 'I. Règles > A. Cas']) AS path FROM part WHERE p_size % 5 <> 0")
def _(t):
    html = F.concat(F.lit('<h1>I. Règles</h1><p class=""numero-de-paragraphe-western"">1</p><p>Texte <b>'), "p_name", F.lit('</b></p><h2>A. Cas</h2><p class="numero-de-paragraphe-western">10</p><p>'), "p_name", F.lit("</p><p>suite&nbsp;et fin</p>"))
    line = F.to_json(F.struct(F.when(F.col("p_size") % 5 == 0, "Actualité").otherwise("Contenu").alias("type"), F.col("p_name").alias("titre"), F.lit("2020-01-02").alias("debut_de_validite"), F.lit("TVA").alias("serie"), F.concat(F.lit("BOI-"), F.col("p_partkey").cast("string")).alias("identifiant_juridique"), html.alias("contenu_html")))
    rows = parsers.doctrine(t.part.select(line.alias("line"))).select("uid", F.explode("paragraphs").alias("p"))
    return rows.select("uid", "p.num", "p.text", F.array_join("p.path", " > ").alias("path"))


@query("a18_circulars", "SELECT 'cir_' || p_partkey AS uid, CASE WHEN p_size = 1 THEN 'A' ELSE 'V' END AS state, p_name AS title, DATE '2010-11-12' AS published_on, 'loi ' || p_size || '|code' AS cited FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#1')")
def _(t):
    key = F.col("p_partkey").cast("string")
    cited = F.concat(F.lit("<TEXTES_DE_REFERENCE><TEXTE_REF>loi "), F.col("p_size").cast("string"), F.lit("</TEXTE_REF><TEXTE_REF>code</TEXTE_REF></TEXTES_DE_REFERENCE>"))
    values = {"number": key, "state": F.when(F.col("p_size") == 1, "A").otherwise("V"), "title": F.col("p_name"), "signed_on": F.lit("2010-10-10"), "filed_on": F.lit("2010-11-12")}
    gone = parsers.abrogated(t.part.filter("p_brand = 'Brand#1'").select(F.concat(F.lit("2011/07/A_cir_"), key, F.lit(".pdf")).alias("line")), "line")
    found = parsers.circulars(_published(t, "CIRCULAIRE", parsers.CIRCULAR, values, (cited,))).join(gone, "uid", "left_anti")
    return found.select("uid", "state", "title", "published_on", F.array_join("cited", "|").alias("cited"))


@query("a10_european_decisions", "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'cedh/001-' || o_orderkey ELSE 'cjue/62020CJ' || printf('%06d', o_orderkey) END AS source_uid, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey || '/01|' || o_custkey || '/02' ELSE 'C-' || o_orderkey || '/20' END AS dockets, CAST(o_orderdate AS DATE) AS read_on, 'Arrêt' || chr(10) || o_orderpriority || ' & suites' AS full_text FROM orders")
def _(t):
    key, human, day = F.col("o_orderkey"), F.col("o_orderkey") % 2 == 0, F.col("o_orderdate").cast("date")
    columns = F.when(human, F.to_json(F.struct(F.concat(key.cast("string"), F.lit("/01; "), F.col("o_custkey").cast("string"), F.lit("/02")).alias("appno"), F.when(key % 4 == 0, F.concat(day.cast("string"), F.lit("T00:00:00"))).alias("kpdate"), F.concat(F.date_format(day, "dd/MM/yyyy"), F.lit(" 00:00:00")).alias("judgementdate")))).otherwise(F.to_json(F.struct(day.cast("string").alias("work_date_document"))))
    rows = t.orders.select(F.when(human, "cedh").otherwise("cjue").alias("kind"), F.when(human, F.concat(F.lit("001-"), key.cast("string"))).otherwise(F.concat(F.lit("62020CJ"), F.format_string("%06d", key))).alias("uid"), columns.alias("columns"), F.concat(F.lit("<html><style>p{}</style><p>Arrêt</p><p>"), "o_orderpriority", F.lit(" &amp; suites</p></html>")).alias("html"))
    return parsers.european(rows).select("source_uid", F.array_join("dockets", "|").alias("dockets"), "read_on", "full_text")


@query("a11_asylum_decisions", "SELECT CAST(o_orderkey AS VARCHAR) AS number, 'ECLI:FR:CNDA:' || year(o_orderdate) || ':' || o_orderkey AS ecli, CASE WHEN o_orderstatus = 'F' THEN 'annulation' ELSE 'rejet' END AS outcome, 'COUR' || chr(10) || 'Vu la procédure, demande de protection ;' || chr(10) || 'Considérant que ' || o_orderpriority || ' suffit.' || chr(10) || 'DECIDE :' || chr(10) || CASE WHEN o_orderstatus = 'F' THEN 'Article 1er : La décision est annulée.' ELSE 'Article 1er : Le recours est rejeté.' END AS full_text FROM orders")
def _(t):
    day = F.col("o_orderdate").cast("date")
    end = F.when(F.col("o_orderstatus") == "F", "Article 1er : La décision est\nannulée.").otherwise("Article 1er : Le recours\nest rejeté.")
    raw = F.concat(F.lit("COUR\nn° 123\n\nVu la procé-\ndure, demande de\f2\nprotection ;\nConsidérant que "), "o_orderpriority", F.lit("\n\nsuffit.\nD É C I D E\n"), end)
    return parsers.asylum(t.orders.select(F.col("o_orderkey").cast("string").alias("number"), day.alias("published"), raw.alias("raw"))).select("number", "ecli", "outcome", "full_text")


@query("a12_analyses", "SELECT p_partkey, CAST(400000 + p_partkey AS VARCHAR) AS docket, '54-06:Procédure - Jugements:Titre ' || p_name AS headings, 'Résumé de ' || p_name AS summary, '(1) Cf. CE, ' || p_size AS notes FROM part")
def _(t):
    html = F.concat(F.lit("<p>CONSEIL D'ETAT</p><p>N° "), (F.col("p_partkey") + 400_000).cast("string"), F.lit("</p><p>Mentionné aux tables</p><hr/><p>54-06 : Procédure -<br>Jugements</p><p>Titre "), "p_name", F.lit("</p><hr><p>Résumé de "), "p_name", F.lit("</p><p>(1) Cf. CE, "), F.col("p_size").cast("string"), F.lit("</p><hr><p>Résumé de "), "p_name", F.lit("</p>"))
    rows = parsers.analyses(t.part.select("p_partkey", html.alias("html")), "html").select("p_partkey", "analysis.*")
    shown = F.array_join(F.transform("headings", lambda h: F.concat_ws(":", h["code"], h["label"], h["title"])), "|")
    return rows.select("p_partkey", "docket", shown.alias("headings"), F.array_join("summaries", "|").alias("summary"), F.array_join("notes", "|").alias("notes"))


@query("a13_title_citations", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'CE' WHEN o_orderkey % 3 = 1 THEN 'CAA' ELSE 'CC' END AS court, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderkey % 3 = 2 THEN '24-15.449' ELSE '24PA' || o_orderkey || '|' || o_custkey END AS dockets FROM orders WHERE o_orderkey % 7 <> 0")
def _(t):
    key = F.col("o_orderkey")
    court = F.when(key % 7 == 0, "Blog").when(key % 3 == 0, "CE").when(key % 3 == 1, "CAA de Paris").otherwise("Cass. 1re civ.")
    numbers = F.when(key % 3 == 2, "n° 24-15449").otherwise(F.concat(F.lit("n°24pa"), key.cast("string"), F.lit(" et "), F.col("o_custkey").cast("string")))
    title = F.concat(court, F.lit(", "), X.french_date(F.col("o_orderdate").cast("date")), F.lit(", "), numbers)
    found = t.orders.select("o_orderkey", parsers.title_citation(title).alias("c")).filter("c IS NOT NULL")
    return found.select("o_orderkey", "c.court", "c.date", F.array_join("c.dockets", "|").alias("dockets"))
