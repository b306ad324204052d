"""EPUB-style archives as tables: entries, package document, table of contents."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bookspark.functions import paths
from bookspark.functions import text as tx

ENTRIES = "book_id string, ord int, raw_name string, path string, method string, size bigint, csize bigint, offset bigint, data binary, error string"
MANIFEST = "book_id string, ord int, id string, path string, media_type string, properties array<string>"
SPINE = "book_id string, ord int, idref string, linear boolean"
FACTS = "book_id string, ord int, name string, value string, attrs map<string,string>"
TOC = "book_id string, ord int, title string, path string, fragment string, level int"
#: Algorithms of font obfuscation; any other encryption is rights management. Fixed values.
OBFUSCATION = ("http://www.idpf.org/2008/embedding", "http://ns.adobe.com/pdf/enc#RC")


def normal_path(name: str) -> str:
    out: list[str] = []
    for part in unquote(name.replace("\\", "/")).split("/"):
        if part == "..":
            out[-1:] = []
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in ENTRIES.split(", ")]
    for pdf in batches:
        for book, content in zip(pdf["book_id"], pdf["content"], strict=True):
            rows = []
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for i, e in enumerate(x for x in z.infolist() if not x.is_dir()):
                        rows.append((book, i, e.filename, normal_path(e.filename), "stored" if e.compress_type == zipfile.ZIP_STORED else "deflated", e.file_size, e.compress_size, e.header_offset, z.read(e), None))
            except Exception as x:  # noqa: BLE001 - a broken archive is a row, never a failed task
                rows = [(book, -1, None, None, None, None, None, None, None, f"archive: {x}")]
            yield pd.DataFrame(rows, columns=columns).astype({"size": "Int64", "csize": "Int64", "offset": "Int64"})


def archives(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """(book_id, content) of every archive in a folder, by name; names that begin with a dot are skipped by the source."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[eE][pP][uU][bB]").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.select(paths.stem(F.col("path")).alias("book_id"), "content")


def entries(books: DataFrame) -> DataFrame:
    """One row per file of each archive; a broken archive gives one row with an error."""
    return books.select("book_id", "content").mapInPandas(_entries, ENTRIES)


def first_wins(e: DataFrame) -> DataFrame:
    """Entries whose folded path no earlier one has."""
    w = Window.partitionBy("book_id", "path").orderBy("ord")
    return e.where("error is null").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def collisions(e: DataFrame) -> DataFrame:
    """Entries dropped for an earlier one of the same path."""
    w = Window.partitionBy("book_id", "path").orderBy("ord")
    return e.where("error is null").select("book_id", "path", "ord", F.first("raw_name").over(w).alias("kept_raw"), F.col("raw_name").alias("dropped_raw"), F.row_number().over(w).alias("rn")).where("rn > 1").drop("rn", "ord")


def rights_managed(e: DataFrame) -> DataFrame:
    """(book_id, drm) of archives with an encryption file."""
    x = e.where("path = 'META-INF/encryption.xml'").select("book_id", F.make_valid_utf8(F.col("data").cast("string")).alias("xml"))
    used = F.expr("""regexp_extract_all(xml, 'EncryptionMethod[^>]*Algorithm="([^"]*)"', 1)""")
    n = F.regexp_count("xml", F.lit(r"<(?:\w+:)?EncryptedData\b"))
    return x.select("book_id", (F.exists(used, lambda a: ~a.isin(*OBFUSCATION)) | (F.size(used) < n)).alias("drm"))


def package_paths(e: DataFrame) -> DataFrame:
    """(book_id, opf_path) from the container file: the first root file that is a package."""
    c = e.where("path = 'META-INF/container.xml'").select("book_id", F.col("data").cast("string").alias("xml"))
    files = F.regexp_extract_all("xml", F.lit(r"<(?:\w+:)?rootfile\b[^>]*>"), F.lit(0))
    package = F.try_element_at(F.filter(files, lambda t: t.contains("application/oebps-package+xml")), F.lit(1))
    tag = F.regexp_extract(package, r"""full-path=["']([^"']*)["']""", 1)
    return c.select("book_id", paths.normalize_segments(paths.percent_decode(tag)).alias("opf_path")).where("opf_path <> ''")


def package_documents(e: DataFrame) -> DataFrame:
    """(book_id, opf_path, data) of each book's package document."""
    return e.select("book_id", "path", "data").join(package_paths(e).withColumnRenamed("opf_path", "path"), ["book_id", "path"]).withColumnRenamed("path", "opf_path")


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _parse(kind: str):
    def rows_of(book: str, opf_path: str, data: bytes) -> list[tuple]:
        try:
            root = ET.fromstring(data)
        except ET.ParseError:
            return []
        base = posixpath.dirname(opf_path)
        section = {_local(x.tag): x for x in root}
        out: list[tuple] = []
        if kind == "manifest":
            last: dict[str, tuple] = {}
            for x in section.get("manifest", ()):
                if (i := x.get("id")) and (href := x.get("href")):
                    last[i] = (normal_path(posixpath.join(base, href.split("#")[0])), x.get("media-type"), (x.get("properties") or "").split())
            out = [(book, n, i, *v) for n, (i, v) in enumerate(last.items())]
        elif kind == "spine":
            out = [(book, n, x.get("idref"), x.get("linear") != "no") for n, x in enumerate(y for y in section.get("spine", ()) if y.get("idref"))]
        else:
            out.append((book, -1, "#package", None, {_local(k): v for k, v in root.attrib.items()}))
            for n, x in enumerate(section.get("metadata", ())):
                out.append((book, n, _local(x.tag), " ".join("".join(x.itertext()).split()) or None, {_local(k): v for k, v in x.attrib.items()}))
        return out

    schema = {"manifest": MANIFEST, "spine": SPINE, "facts": FACTS}[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for b, p, d in zip(pdf["book_id"], pdf["opf_path"], pdf["data"], strict=True) for r in rows_of(b, p, d)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.replace("map<string,string>", "map").split(", ")])

    return run


def manifest(e: DataFrame) -> DataFrame:
    """Items with id and reference; of a repeated id the last value at the first place."""
    return package_documents(e).mapInPandas(_parse("manifest"), MANIFEST)


def spine(e: DataFrame) -> DataFrame:
    return package_documents(e).mapInPandas(_parse("spine"), SPINE)


def facts(e: DataFrame) -> DataFrame:
    """Every element of the metadata section with its attributes, in order, after the package itself with its own."""
    return package_documents(e).mapInPandas(_parse("facts"), FACTS)


def metadata(f: DataFrame) -> DataFrame:
    """One record per book from its facts: defaults for title and language, refinements by id, series of either version."""
    def first(name: str):
        return F.min_by("value", F.when((F.col("name") == name) & F.col("value").isNotNull(), F.col("ord")))

    value = lambda p: F.min_by("rvalue", F.when((F.col("property") == p) & F.col("rvalue").isNotNull(), F.col("rord")))
    refined = f.where("name = 'meta' and attrs['refines'] is not null").select("book_id", F.substring(F.col("attrs")["refines"], 2, 999).alias("rid"), F.col("attrs")["property"].alias("property"), F.col("value").alias("rvalue"), F.col("ord").alias("rord"))
    refinements = refined.groupBy("book_id", "rid").agg(value("file-as").alias("r_file_as"), value("role").alias("r_role"), value("identifier-type").alias("r_scheme"), value("group-position").alias("r_position"))
    named = f.withColumn("rid", F.col("attrs")["id"]).join(refinements, ["book_id", "rid"], "left")
    attr = lambda a: tx.blank_to_null(F.col("attrs")[a])
    person = F.struct("ord", F.col("value").alias("name"), F.coalesce(attr("file-as"), "r_file_as").alias("file_as"), F.coalesce(attr("role"), "r_role").alias("role"))
    other = F.struct("ord", "rid", F.col("value").alias("value"), F.coalesce(attr("scheme"), "r_scheme").alias("scheme"))

    def listed(kind: str, item=person):
        return F.array_sort(F.collect_list(F.when((F.col("name") == kind) & F.col("value").isNotNull(), item)))

    collection = (F.col("name") == "meta") & (F.col("attrs")["property"] == "belongs-to-collection")
    lists = named.groupBy("book_id").agg(
        F.transform(listed("creator"), lambda p: p.dropFields("ord")).alias("authors"), F.transform(listed("contributor"), lambda p: p.dropFields("ord")).alias("contributors"), listed("identifier", other).alias("ids"),
        F.min_by(F.struct(F.col("value").alias("name"), F.col("r_position").alias("index")), F.when(collection, F.col("ord"))).alias("collection"), F.max(F.when(F.col("name") == "#package", F.col("attrs")["unique-identifier"])).alias("uid"),
    )
    meta = lambda n: F.min_by(tx.blank_to_null(F.col("attrs")["content"]), F.when((F.col("name") == "meta") & (F.col("attrs")["name"] == n), F.col("ord")))
    one = f.groupBy("book_id").agg(
        F.coalesce(first("title"), F.lit("Untitled")).alias("title"), F.coalesce(first("language"), F.lit("en")).alias("language"),
        *[first(n).alias(n) for n in ("description", "publisher", "date", "rights")],
        F.transform(F.array_sort(F.collect_list(F.when((F.col("name") == "subject") & F.col("value").isNotNull(), F.struct("ord", "value")))), lambda x: x["value"]).alias("subjects"),
        F.when(meta("calibre:series").isNotNull(), F.struct(meta("calibre:series").alias("name"), meta("calibre:series_index").alias("index"))).alias("calibre"), meta("cover").alias("cover_id"),
    )
    # the identifier that the package names, else the first one; the others are secondary
    unique = F.coalesce(F.try_element_at(F.filter("ids", lambda i: i["rid"] == F.col("uid")), F.lit(1)), F.try_element_at("ids", F.lit(1)))
    j = one.join(lists, "book_id", "left").withColumn("unique", unique)
    rest = F.transform(F.filter("ids", lambda i: i["ord"] != F.col("unique.ord")), lambda i: i.dropFields("ord", "rid"))
    series = F.coalesce(F.when(F.col("collection.name").isNotNull(), F.col("collection")), "calibre")
    return j.select("book_id", "title", "language", F.col("unique.value").alias("identifier"), "authors", "contributors", F.coalesce(rest, F.array().cast("array<struct<value:string,scheme:string>>")).alias("identifiers"), "subjects", "description", "publisher", "date", "rights", series.alias("series"), "cover_id")


def covers(meta: DataFrame, m: DataFrame, lint: bool = False) -> DataFrame:
    """(book_id, path): the cover a reader shows, by the item that the metadata names if it is an image, else by property; a check looks the other way round."""
    named = meta.select("book_id", F.col("cover_id").alias("id")).join(m.where("media_type like 'image/%'"), ["book_id", "id"]).select("book_id", F.col("path").alias("by_name"))
    marked = m.where(F.array_contains("properties", "cover-image")).groupBy("book_id").agg(F.min_by("path", "ord").alias("by_property"))
    both = named.join(marked, "book_id", "full")
    order = ("by_property", "by_name") if lint else ("by_name", "by_property")
    return both.select("book_id", F.coalesce(*order).alias("path"))


def refused(e: DataFrame) -> DataFrame:
    """(book_id, code, message) of archives that are not read: rights management, or too large for the plain format."""
    from bookspark.operators import lint

    drm = rights_managed(e).where("drm").select("book_id", F.lit("drm").alias("code"), F.lit("the book is protected by rights management").alias("message"))
    return drm.unionByName(lint.zip64(e).select("book_id", F.lit("zip64").alias("code"), F.col("message")))


def _toc(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def nav(node: ET.Element, level: int, base: str, out: list) -> None:
        for li in node:
            if _local(li.tag) != "li":
                continue
            for x in li:
                if _local(x.tag) == "a" and x.get("href"):
                    href, _, frag = x.get("href").partition("#")
                    out.append((" ".join("".join(x.itertext()).split()), normal_path(posixpath.join(base, href)), frag or None, level))
                elif _local(x.tag) == "ol":
                    nav(x, level + 1, base, out)

    def ncx(node: ET.Element, level: int, base: str, out: list) -> None:
        for p in node:
            if _local(p.tag) == "navPoint":
                label = next((" ".join("".join(x.itertext()).split()) for x in p if _local(x.tag) == "navLabel"), "")
                src = next((x.get("src", "") for x in p if _local(x.tag) == "content"), "")
                href, _, frag = src.partition("#")
                out.append((label, normal_path(posixpath.join(base, href)), frag or None, level))
                ncx(p, level + 1, base, out)

    for pdf in batches:
        rows = []
        for book, path, data in zip(pdf["book_id"], pdf["path"], pdf["data"], strict=True):
            try:
                root = ET.fromstring(data)
            except ET.ParseError:
                continue
            out: list = []
            base = posixpath.dirname(path)
            if _local(root.tag) == "ncx":
                for x in root:
                    if _local(x.tag) == "navMap":
                        ncx(x, 1, base, out)
            else:
                navs = [x for x in root.iter() if _local(x.tag) == "nav"]
                best = next((x for x in navs if any(_local(k) == "type" and v == "toc" for k, v in x.attrib.items())), navs[0] if navs else None)
                for x in best if best is not None else ():
                    if _local(x.tag) == "ol":
                        nav(x, 1, base, out)
            rows += [(book, n, *r) for n, r in enumerate(out)]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in TOC.split(", ")])


def toc(e: DataFrame, m: DataFrame) -> DataFrame:
    """The table of contents: of the navigation document, else of the NCX."""
    files = e.select("book_id", "path", "data")
    nav = files.join(m.where(F.array_contains("properties", "nav")).select("book_id", "path"), ["book_id", "path"]).mapInPandas(_toc, TOC)
    ncx = files.join(m.where("media_type = 'application/x-dtbncx+xml'").select("book_id", "path"), ["book_id", "path"]).mapInPandas(_toc, TOC)
    return nav.unionByName(ncx.join(nav.select("book_id").distinct(), "book_id", "left_anti"))


def write_archives(resources: DataFrame) -> DataFrame:
    """(book_id, content, n_entries): one archive per book of (book_id, ord, path, data); mimetype first and stored.

    Rows stream through a task in order of book and place, so a task holds the
    packed bytes of one book at a time, not its rows.
    """
    schema = "book_id string, content binary, n_entries int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book, buffer, z, n = None, None, None, 0
        for pdf in batches:
            done = []
            for b, path, data in zip(pdf["book_id"], pdf["path"], pdf["data"], strict=True):
                if b != book:
                    if z is not None:
                        z.close()
                        done.append((book, buffer.getvalue(), n))
                    book, buffer, n = b, io.BytesIO(), 1
                    z = zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED)
                    z.writestr(zipfile.ZipInfo("mimetype", (1980, 1, 1, 0, 0, 0)), "application/epub+zip", zipfile.ZIP_STORED)
                if path != "mimetype":
                    z.writestr(zipfile.ZipInfo(path, (1980, 1, 1, 0, 0, 0)), data or b"", zipfile.ZIP_DEFLATED)
                    n += 1
            yield pd.DataFrame(done, columns=["book_id", "content", "n_entries"])
        if z is not None:
            z.close()
            yield pd.DataFrame([(book, buffer.getvalue(), n)], columns=["book_id", "content", "n_entries"])

    return resources.where("book_id is not null").select("book_id", "ord", "path", "data").repartition("book_id").sortWithinPartitions("book_id", "ord", "path").mapInPandas(run, schema)
