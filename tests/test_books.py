"""Archives built here, read, checked, changed and written again."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from bookspark import engine
from bookspark.operators.filters import Rule
from bookspark.sources import archive

CONTAINER = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/book.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
OPF = """<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">
<dc:title> A  Small   Boat </dc:title><dc:creator id="c1">Ann Reed</dc:creator><meta refines="#c1" property="file-as">Reed, Ann</meta><dc:subject>Sea</dc:subject><dc:subject> </dc:subject>
<meta name="calibre:series" content="Boats"/><meta name="calibre:series_index" content="2.5"/></metadata>
<manifest><item id="a" href="one.xhtml" media-type="application/xhtml+xml"/><item id="b" href="two%20b.xhtml" media-type="application/xhtml+xml"/><item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>
<item id="f" href="x.ttf" media-type="font/ttf"/><item id="gone" href="gone.css" media-type="text/css"/></manifest>
<spine><itemref idref="a"/><itemref idref="b" linear="no"/><itemref idref="zz"/></spine></package>"""
NAV = '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><ol><li><a href="one.xhtml#p1">One</a><ol><li><a href="one.xhtml#none">Deep</a></li></ol></li><li><a href="lost.xhtml">Lost</a></li></ol></nav></body></html>'


def book(opf=OPF, first="mimetype"):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr(zipfile.ZipInfo(first), "application/epub+zip", zipfile.ZIP_STORED)
        z.writestr("META-INF/container.xml", CONTAINER)
        z.writestr("OPS/book.opf", opf)
        z.writestr("OPS/nav.xhtml", NAV)
        z.writestr("OPS/one.xhtml", '<html><body><p id="p1">The harbour, slowly.</p><p id="p1">x</p></body></html>')
        z.writestr("OPS/two b.xhtml", "<html><body><p>Two</p></body></html>")
        z.writestr("OPS\\one.xhtml", "later, dropped")
        z.writestr("OPS/x.ttf", b"\0\1")
        z.writestr("OPS/stray.css", "p{color:red}")
    return b.getvalue()


@pytest.fixture(scope="module")
def books(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("books")
    (d / "good.epub").write_bytes(book())
    (d / "broken.epub").write_bytes(b"no archive")
    (d / "late.EPUB").write_bytes(book(first="other"))
    return engine.read_books(spark, str(d))


def test_tables(books):
    assert {r.book_id for r in books.errors.collect()} == {"broken"}
    m = {r.id: r.path for r in books.manifest.where("book_id = 'good'").collect()}
    assert m["b"] == "OPS/two b.xhtml" and m["a"] == "OPS/one.xhtml"
    assert [(r.title, r.path, r.fragment, r.level) for r in books.toc.where("book_id = 'good'").orderBy("ord").collect()] == [("One", "OPS/one.xhtml", "p1", 1), ("Deep", "OPS/one.xhtml", "none", 2), ("Lost", "OPS/lost.xhtml", None, 1)]
    meta = books.metadata.where("book_id = 'good'").first()
    assert (meta.title, meta.language, meta.series["index"], meta.subjects) == ("A Small Boat", "en", "2.5", ["Sea"])
    assert meta.authors[0].file_as == "Reed, Ann"
    assert [r.path for r in engine.archive_spine(books).where("book_id = 'good'").collect()] == ["OPS/one.xhtml"]


def test_collisions(spark):
    e = archive.entries(spark.createDataFrame([("g", bytearray(book()))], "book_id string, content binary"))
    c = archive.collisions(e).collect()
    assert [(r.kept_raw, r.path) for r in c] == [("OPS/one.xhtml", "OPS/one.xhtml")]


def test_findings(books):
    f = {(r.book_id, r.code, r.path) for r in engine.check(books).collect()}
    assert ("good", "manifest-sync", "OPS/gone.css") in f and ("good", "manifest-sync", "OPS/stray.css") in f
    assert ("good", "duplicate-id", "OPS/one.xhtml") in f and ("good", "fonts", "OPS/x.ttf") in f
    assert ("good", "spine-toc-sync", "OPS/lost.xhtml") in f and ("good", "spine-toc-sync", "OPS/one.xhtml") in f
    assert ("late", "mimetype-first", "other") in f and ("good", "mimetype-first", "mimetype") not in f
    assert ("good", "manifest-sync", "OPS/book.opf") not in f


def test_fit(books, spark):
    docs = spark.createDataFrame([("good", "Other", None, "House")], "book_id string, title string, language string, publisher string")
    docs = docs.select("*", *[F.lit(None).cast("string").alias(c) for c in ("date", "description", "rights")])
    out, meta = engine.fit(books, [Rule("replace", "harbour", "port"), Rule("remove", "x.ttf", targets=frozenset({"file"})), Rule("remove", "one.xhtml", targets=frozenset({"file"}))], docs)
    row = out.where("book_id = 'good'").first()
    with zipfile.ZipFile(io.BytesIO(bytes(row.content))) as z:
        names = z.namelist()
        assert names[0] == "mimetype" and z.getinfo("mimetype").compress_type == zipfile.ZIP_STORED
        assert "OPS/x.ttf" not in names and "OPS/one.xhtml" in names
        assert b"The port" in z.read("OPS/one.xhtml")
    m = meta.where("book_id = 'good'").first()
    assert (m.title, m.publisher, m.changed) == ("A Small Boat", "House", ["publisher"])
