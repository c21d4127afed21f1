import gzip
import io
import json
import tarfile
import zipfile

from corpuslens.sources import archives, incremental, sitemap


def test_zip_xml(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/1.xml", "<doc><title>T &amp; U</title><p>un</p><p>deux</p></doc>")
        z.writestr("2.xml", "<doc><title>A & B</title></doc>")
        z.writestr("bad.xml", "<doc>")
        z.writestr("skip.txt", "x")
    members = archives.zip_members(spark, str(tmp_path))
    assert archives.member_names(members).count() == 3
    got = {r.member: r for r in archives.xml_fields(members, {"title": "title", "body": "p"}).collect()}
    assert (got["d/1.xml"].title, got["d/1.xml"].body) == ("T & U", "un deux")
    assert got["2.xml"].title == "A & B" and not got["bad.xml"].ok


def test_tar(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        for name, raw in (("x/1.xml", b"<a/>"), ("x/2.txt", b"two")):
            info = tarfile.TarInfo(name)
            info.size = len(raw)
            t.addfile(info, io.BytesIO(raw))
    assert {r.member: bytes(r.raw) for r in archives.tar_members(spark, str(tmp_path)).collect()} == {"x/1.xml": b"<a/>", "x/2.txt": b"two"}


def test_jsonl_and_decisions(spark, tmp_path):
    (tmp_path / "d").mkdir()
    line = json.dumps({"id": "u1", "jurisdiction": "cc", "decision_date": "2020-02-03", "number": "18-23.954", "text": "abc", "zones": {"motivations": [{"start": 0, "end": 2}]}})
    (tmp_path / "d" / "a.jsonl.gz").write_bytes(gzip.compress(f"  {line} \n".encode()) + gzip.compress(b"{}\n"))
    lines = archives.jsonl(spark, str(tmp_path))
    assert lines.count() == 2
    r = archives.decisions_from_json(lines).collect()
    assert len(r) == 1 and r[0].docket_numbers == ["18-23.954"] and r[0].sections[0].kind == "motivations"


def test_csv(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("r.csv", "nom;ville\nÉlan;Paris\n".encode("latin-1"))
    assert archives.csv_records(spark, str(tmp_path)).first().record == {"nom": "Élan", "ville": "Paris"}


def test_sparql(spark):
    text = json.dumps({"results": {"bindings": [{"a": {"value": "1"}}, {"a": {"value": "2"}, "b": {"value": "x"}}]}})
    got = archives.sparql_rows(spark.createDataFrame([(text,)], "t string"), "t", ["a", "b"]).collect()
    assert [(r.a, r.b) for r in got] == [("1", None), ("2", "x")]


def test_docx_and_encoding():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", '<w:document><w:p><w:r><w:t>Un &amp; deux</w:t></w:r></w:p><w:p><w:t xml:space="preserve">trois</w:t></w:p></w:document>')
    assert archives.docx_text(raw.getvalue()) == "Un & deux\ntrois" and archives.docx_text(b"%PDF") == ""
    assert archives.repair_encoding("Ã©tÃ© déjà") == "été déjà"


def test_manifest(spark):
    manifest = spark.createDataFrame([("s/a", 1), ("s/b", 2)], "path string, size long")
    files = spark.createDataFrame([("s/a", 1), ("s/b", 3), ("s/c", 1)], "path string, size long")
    fresh = incremental.unseen(files, manifest)
    assert {r.path for r in fresh.collect()} == {"s/b", "s/c"}
    assert incremental.advance(manifest, fresh).count() == 3 and incremental.watermark(files) == "c"


def test_compaction_and_reservoir(spark):
    lines = spark.createDataFrame([(1, 0), (1, 5), (2, 1), (3, 2)], "uid long, pos long")
    out = incremental.compact(lines, "uid", "pos", spark.createDataFrame([(3,)], "uid long"))
    assert sorted((r.uid, r.pos) for r in out.collect()) == [(1, 5), (2, 1)]
    sample = lambda s: {r.id for r in incremental.reservoir(spark.range(100), "id", 10, s).collect()}
    assert sample(1) == sample(1) and len(sample(1)) == 10 and sample(1) != sample(2)
    assert [r.month for r in incremental.months(spark, "2023-11", "2024-02").collect()] == ["2023-11", "2023-12", "2024-01", "2024-02"]


def test_paged_source(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"p{k}").write_text(f"a{k}\nb{k}\n")
    spark.dataSource.register(incremental.PagedFolder)
    df = spark.read.format("paged_folder").option("path", str(tmp_path)).option("after", "p0").load()
    assert sorted(r.line for r in df.collect()) == ["a1", "a2", "b1", "b2"]


def test_sitemaps(spark):
    urls = spark.createDataFrame([(f"/p/{k:03d}", "2020-01-01") for k in range(25)], "loc string, lastmod string")
    files = sitemap.write_sitemaps(urls, "https://x.test", most=10).orderBy("file").collect()
    assert [gzip.decompress(bytes(r.body)).count(b"<loc>") for r in files] == [10, 10, 5]
    assert sitemap.sitemap_xml([("/a&b", "2020-01-01")], "h") == sitemap.sitemap_xml([("/a&b", "2020-01-01")], "h")


def test_published_xml(spark, tmp_path):
    meta = "<META><META_COMMUN><ID>A1</ID></META_COMMUN><META_SPEC><META_ARTICLE><NUM>L. 1-2</NUM><ETAT>VIGUEUR</ETAT><DATE_DEBUT>2020-01-01</DATE_DEBUT><DATE_FIN>2999-01-01</DATE_FIN></META_ARTICLE></META_SPEC></META>"
    juri = "<META><META_COMMUN><ID>J1</ID></META_COMMUN><META_SPEC><META_JURI><TITRE>T</TITRE><DATE_DEC>2021-05-06</DATE_DEC><NUMERO>1, 2</NUMERO></META_JURI></META_SPEC></META>"
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a.xml", f"<ARTICLE>{meta}<BLOC_TEXTUEL><CONTENU><p>Corps</p></CONTENU></BLOC_TEXTUEL></ARTICLE>")
        z.writestr("j.xml", f"<TEXTE_JURI>{juri}</TEXTE_JURI>")
    members = archives.zip_members(spark, str(tmp_path))
    a = archives.law_articles(members).filter("uid = 'A1'").first()
    assert (a.num_key, a.date_fin, a.body, str(a.date_debut)) == ("l1-2", None, "Corps", "2020-01-01")
    d = archives.decisions_from_xml(members).filter("source_uid = 'J1'").first()
    assert d.docket_numbers == ["1", "2"] and str(d.date_lecture) == "2021-05-06"


def test_push_payloads(spark):
    urls = spark.createDataFrame([(f"/p/{k}", "2020-01-01") for k in range(5)], "loc string, lastmod string")
    rows = sitemap.push_payloads(urls, "k", "x.test", most=2).orderBy("file").collect()
    assert [len(json.loads(r.payload)["urlList"]) for r in rows] == [2, 2, 1]
