"""Books as the reader has to take them, written whole and read again."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookspark import engine
from bookspark.operators.filters import Rule
from bookspark.session import checkpointed
from bookspark.sinks import package
from bookspark.sources import archive, assets, charset, documents, profiles, raster, vector

CONTAINER = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="x.pdf" media-type="application/pdf"/><rootfile full-path="OPS/b.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
OPF = """<package xmlns="http://www.idpf.org/2007/opf" unique-identifier="u"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:opf="http://www.idpf.org/2007/opf">
<dc:identifier id="i1">978-1</dc:identifier><meta refines="#i1" property="identifier-type">ISBN</meta><dc:identifier id="u">urn:x</dc:identifier><dc:title>Tide</dc:title><dc:creator opf:role="aut" id="c">Ann Reed</dc:creator>
<meta refines="#c" property="role">edt</meta><meta property="belongs-to-collection" id="s">Boats</meta><meta refines="#s" property="group-position">II</meta><meta name="calibre:series" content="Other"/><meta name="cover" content="p2"/></metadata>
<manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/><item id="p1" href="p1.png" media-type="image/png" properties="cover-image"/><item id="p2" href="p2.png" media-type="image/png"/><item id="s" href="s.css" media-type="text/css"/></manifest>
<spine><itemref idref="a"/><itemref idref="b"/></spine></package>"""
PAGE_A = '<?xml version="1.0" encoding="iso-8859-1"?><html><head><title>A</title><style>p{color:red}</style></head><body><h1 id="top">Caf\xe9</h1>' + "<p>Long words here.</p>" * 40 + '<h2><span id="mid">Mid</span></h2><p style="color:red;margin:0">harbour ad</p>' + "<p>More words.</p>" * 40 + '<p><a href="#top">up</a> <a href="http://ads.example/1"><i>ad</i></a></p></body></html>'
PAGE_B = '<html><body><table><tr><th>H</th><th>V</th></tr><tr><td>a</td><td>1</td></tr></table><p><img src="p1.png" width="9"/></p><p><a href="a.xhtml#mid">to mid</a><a href="a.xhtml">start</a></p></body></html>'


def pack(files, drm=False):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip", zipfile.ZIP_STORED)
        for name, data in files.items():
            z.writestr(name, data)
        if drm:
            z.writestr("META-INF/encryption.xml", '<encryption><EncryptedData><EncryptionMethod Algorithm="urn:drm"/></EncryptedData></encryption>')
    return bytearray(b.getvalue())


FILES = {"META-INF/container.xml": CONTAINER, "OPS/b.opf": OPF, "OPS/a.xhtml": PAGE_A.encode("latin-1"), "OPS/b.xhtml": PAGE_B, "OPS/p1.png": raster.encode_png(np.repeat(np.arange(200, dtype=np.uint8)[None, :], 60, 0)), "OPS/p2.png": b"\x89PNG\r\n\x1a\n2", "OPS/s.css": "@media print{p{color:red}}p{margin:0!important;color:red}"}


@pytest.fixture(scope="module")
def books(spark):
    rows = [("good", pack(FILES)), ("drm", pack(FILES, True)), ("none", pack({"x.txt": "x"})), ("bad", pack({**FILES, "OPS/b.opf": "<package"})), ("junk", bytearray(b"zip?"))]
    return engine.books_of(checkpointed(archive.entries(spark.createDataFrame(rows, "book_id string, content binary"))))


def test_what_is_refused(books):
    assert {(r.book_id, r.code) for r in books.errors.collect()} == {("drm", "drm"), ("none", "container"), ("bad", "package"), ("junk", "archive")}
    assert {r.book_id for r in books.metadata.collect()} == {"good"}


def test_metadata(books):
    m = books.metadata.first()
    assert (m.identifier, m.series.name, m.series["index"]) == ("urn:x", "Boats", "II")
    assert [(i.value, i.scheme) for i in m.identifiers] == [("978-1", "ISBN")] and m.authors[0].role == "aut"
    assert archive.covers(books.metadata, books.manifest).first().path == "OPS/p2.png"
    assert archive.covers(books.metadata, books.manifest, lint=True).first().path == "OPS/p1.png"
    page = books.entries.where("path = 'OPS/a.xhtml'").first()
    assert page.encoding == "cp1252" and "Café" in bytes(page.data).decode() and 'encoding="UTF-8"' in bytes(page.data).decode()


def test_charsets(spark):
    rows = [("a.html", "<meta charset=windows-1251>Я".encode("cp1251")), ("b.xhtml", '<?xml encoding="utf-16"?>é'.encode("utf-16")), ("c.css", b"\xef\xbb\xbfp{}"), ("d.png", b"\xff\xfe1"), ("e.html", b"caf\xe9"), ("f.html", None), ("g.html", b"")]
    got = {r.path: (None if r.data is None else bytes(r.data), r.encoding) for r in charset.normalized(spark.createDataFrame([(p, None if d is None else bytearray(d)) for p, d in rows], "path string, data binary")).collect()}
    assert got["a.html"] == ("<meta charset=UTF-8>Я".encode(), "cp1251") and got["b.xhtml"] == ('<?xml encoding="UTF-8"?>é'.encode(), "utf-16")
    assert got["c.css"] == (b"p{}", None) and got["d.png"] == (b"\xff\xfe1", None) and got["e.html"] == ("café".encode(), "cp1252") and got["f.html"] == (None, None) and got["g.html"] == (b"", None)


def test_fitted_book_comes_back(books, spark):
    """Fitted for a small device with a tiny chapter limit: rules, styles, tables, ids, parts and links, then read and checked again."""
    o = profiles.compose(["x4"], chapter_kb=1)
    docs = documents.documents(spark.createDataFrame([("good", "subjects: [Sea, Tide]\nidentifier: other\nisbn: 978-2\n")], "id string, t string"), F.col("id"), F.col("t")).withColumnRenamed("doc_id", "book_id").drop("error")
    out = engine.fit_tables(books, o, docs, rules=[Rule("replace", "harbour", "haven"), Rule("remove", "ads.example", targets=frozenset({"href"}))], stamp="pocket 1.0", at=F.lit("2026-01-02 03:04:05").cast("timestamp"))
    assert out.failures.count() == 0
    b = engine.books_of(checkpointed(archive.entries(out.archives)))
    m = b.metadata.first()
    assert m.identifier == "urn:x" and {i.value for i in m.identifiers} == {"978-1", "other", "978-2"} and m.subjects == ["Sea", "Tide"] and m.series["index"] == "II"
    spine = [r.path for r in engine.readable_spine(b).orderBy("ord").collect()]
    assert len(spine) > 2 and spine[0] == "OPS/a-1.xhtml" and spine[-1] == "OPS/b.xhtml"
    text = {r.path: bytes(r.data).decode("utf-8", "replace") for r in b.entries.collect()}
    whole = "".join(text[p] for p in spine)
    owner = next(p for p in spine if 'id="mid"' in text[p])
    assert f'href="{owner.rsplit("/", 1)[-1]}#mid"' in text["OPS/b.xhtml"] and 'href="a-1.xhtml"' in text["OPS/b.xhtml"]
    assert "haven" in whole and "ads.example" not in whole and "H: a" in whole and "<table" not in whole and "style=\"margin:0\"" in whole and "(contd.)" in whole
    assert text["OPS/s.css"] == "p{margin:0}"
    assert '<img src="p1.jpg"/>' in text["OPS/b.xhtml"] and "OPS/p1.jpg" in text and "OPS/p1.png" not in text
    codes = {(r.code, r.severity) for r in engine.check(b).collect()}
    assert not {c for c, s in codes if s == "error"}, codes
    assert package.stamps(b.facts).first().fitted == "pocket 1.0"
    again = engine.show_metadata(b).first()
    assert again.cover == "OPS/p2.png" and again.fitted == "pocket 1.0" and "publisher" in again.missing


def test_contents_tree(spark):
    toc = spark.createDataFrame([("b", k, f"t{k}", "a.xhtml", None, lv) for k, lv in enumerate((1, 2, 2, 3, 1, 3))], "book_id string, ord int, title string, path string, fragment string, level int")
    assert [r.parent for r in package.toc_parents(toc).orderBy("ord").collect()] == [None, 0, 0, 2, None, 4]
    nodes = package._tree([r.asDict() for r in toc.orderBy("ord").collect()])
    assert package.nav_list(nodes, "").count("<li>") == 6 and package._depth(nodes) == 3 and package.ncx_points(nodes, "").count('playOrder="6"') == 1
    ids = [("b", 0, "a/b.xhtml"), ("b", 1, "a-b.xhtml"), ("b", 2, "a-b-xhtml-2"), ("b", 3, "1.png"), ("c", 0, "a/b.xhtml")]
    from bookspark.operators import naming

    got = {(r.book_id, r.ord): r.id for r in naming.manifest_ids(spark.createDataFrame(ids, "book_id string, ord int, path string")).collect()}
    assert got == {("b", 0): "a-b-xhtml", ("b", 1): "a-b-xhtml-2", ("b", 2): "a-b-xhtml-2-2", ("b", 3): "id-1-png", ("c", 0): "a-b-xhtml"}


def test_batch(spark):
    inputs = spark.createDataFrame([("a", "d", "One.epub"), ("b", "d", "one.EPUB"), ("c", "d", "two.md"), ("e", "d", "old.fitted.epub"), ("f", "d", "seen.epub")], "book_id string, folder string, file_name string")
    known = spark.createDataFrame([(".fitted.epub",)], "suffix string")
    p = {r.book_id: (r.output, r.status) for r in engine.plan(inputs, "fitted", known, stamped=spark.createDataFrame([("f",)], "book_id string"), existing=spark.createDataFrame([("d", "two.epub")], "folder string, file_name string")).collect()}
    assert p["a"] == ("One.fitted.epub", "planned") and p["b"][1] == "failed" and p["c"] == ("two.epub", "skipped") and p["e"][1] == "skipped" and p["f"][1] == "skipped"
    report = engine.batch_report(spark.createDataFrame([("a", "done"), ("b", "failed")], "book_id string, status string"))
    assert '"schema":1' in report.first().report and '"failed":1' in report.first().report
    assert engine.read_report(report, "summary struct<done:bigint>").first().summary.done == 1
    with pytest.raises(Exception, match="is not known"):
        engine.read_report(spark.createDataFrame([('{"schema":2}',)], "report string"), "x int").collect()


MD = """---
title: Own
authors: [Ann]
---

# One

Some *text* with a note[^1] and ![p](img/p.png) and ![q](lost.png).

## Sub

- a
- b

# Two

| h | i |
|---|---|
| 1 | 2 |

[^1]: The note.
"""


def test_markdown_book(spark, tmp_path):
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "p.png").write_bytes(b"1")
    meta, pages, toc = assets.books(spark.createDataFrame([("m", MD), ("e", ""), ("n", None)], "d string, t string"), F.col("d"), F.col("t"))
    m = meta.where("book_id = 'm'").first()
    assert (m.title, m.authors[0].name) == ("Own", "Ann")
    assert [(r.title, r.path, r.fragment, r.level) for r in toc.orderBy("ord").collect()] == [("One", "text/chapter-001.xhtml", None, 1), ("Sub", "text/chapter-001.xhtml", "sub", 2), ("Two", "text/chapter-002.xhtml", None, 1)]
    new, files, lost = assets.resolve_images(pages, assets.local_assets(spark, str(tmp_path)))
    text = {r.chunk: r.html for r in new.collect()}
    assert 'src="images/img-p.png"' in text[1] and 'src="lost.png"' in text[1] and 'id="note-1"' in text[1] and "<table>" in text[2]
    assert [r.path for r in files.collect()] == ["images/img-p.png"] and lost.count() == 1


def test_vector():
    assert vector.wrapped('<svg xmlns:x="y"><title/><g><image x:href=" a.png "/></g></svg>') == "a.png" and vector.wrapped('<svg><image href="data:image/png;base64,MQ=="/></svg>') == b"1"
    assert vector.wrapped("<svg><rect/><image href='a'/></svg>") is None and vector.wrapped("<p") is None
    drawn = vector.draw_table([["a", "long words in a cell"], ["b"]], ["H", "I"], "Cap", 200)
    assert drawn == vector.draw_table([["a", "long words in a cell"], ["b"]], ["H", "I"], "Cap", 200) and drawn.count("<rect") == 7 and sum(vector.column_widths([3, 5, 9], 100)) == 100
