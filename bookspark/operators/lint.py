"""Checks over a book's tables; each gives findings (book_id, severity, code, message, path)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookspark.functions import paths
from bookspark.functions import text as tx
from bookspark.operators.pages import wellformed_error
from bookspark.sources import css, images
from bookspark.sources.profiles import Caps

SEVERITIES = ("error", "warning", "info")


def findings(df: DataFrame, severity: str, code: str, message: Column, path: Column) -> DataFrame:
    return df.select("book_id", F.lit(severity).alias("severity"), F.lit(code).alias("code"), message.alias("message"), path.alias("path"))


def manifest_sync(entries: DataFrame, manifest: DataFrame, opf: DataFrame | None = None) -> DataFrame:
    """Manifest items without an archive entry, and entries without an item; control files and the package itself are exempt."""
    lost = manifest.join(entries.select("book_id", "path"), ["book_id", "path"], "left_anti")
    stray = entries.where((F.col("path") != "mimetype") & ~F.col("path").startswith("META-INF/")).join(manifest.select("book_id", "path"), ["book_id", "path"], "left_anti")
    if opf is not None:
        stray = stray.join(opf.select("book_id", F.col("opf_path").alias("path")), ["book_id", "path"], "left_anti")
    return findings(lost, "error", "manifest-sync", F.concat(F.lit("the archive lacks "), "path"), F.col("path")).unionByName(findings(stray, "error", "manifest-sync", F.concat(F.lit("the manifest lacks "), "path"), F.col("path")))


def spine(spine_rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Spine entries whose id the manifest lacks, and books without any linear entry."""
    unknown = spine_rows.join(manifest.select("book_id", F.col("id").alias("idref")), ["book_id", "idref"], "left_anti")
    empty = spine_rows.groupBy("book_id").agg(F.bool_or("linear").alias("any")).where(~F.col("any"))
    return findings(unknown, "error", "spine-toc-sync", F.concat(F.lit("spine names unknown id "), "idref"), F.lit(None).cast("string")).unionByName(findings(empty, "error", "spine-empty", F.lit("no linear entry"), F.lit(None).cast("string")))


def readable_spine(spine_rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Resolvable entries in order; those that are not linear only where no resolvable one is."""
    known = spine_rows.join(manifest.select("book_id", F.col("id").alias("idref"), "path"), ["book_id", "idref"])
    any_linear = known.groupBy("book_id").agg(F.bool_or("linear").alias("some"))
    return known.join(any_linear, "book_id").where(F.col("linear") | ~F.col("some")).select("book_id", "ord", "idref", "path")


def toc_targets(toc: DataFrame, spine_paths: DataFrame, ids: DataFrame) -> DataFrame:
    """Entries whose document is no part of the spine, or whose fragment no element has."""
    lost = toc.join(spine_paths.select("book_id", "path"), ["book_id", "path"], "left_anti")
    held = toc.where("fragment is not null").join(spine_paths.select("book_id", "path"), ["book_id", "path"], "left_semi")
    dangling = held.join(ids.select("book_id", "path", F.col("id").alias("fragment")), ["book_id", "path", "fragment"], "left_anti")
    return findings(lost, "error", "spine-toc-sync", F.concat(F.lit("no spine document "), "path"), F.col("path")).unionByName(findings(dangling, "warning", "spine-toc-sync", F.concat(F.lit("no anchor "), "fragment"), F.col("path")))


def duplicate_ids(ids: DataFrame) -> DataFrame:
    twice = ids.groupBy("book_id", "path", "id").agg(F.count("*").alias("n")).where("n > 1")
    return findings(twice, "error", "duplicate-id", F.concat("id", F.lit(" stands on "), F.col("n").cast("string"), F.lit(" elements")), F.col("path"))


def fonts(manifest: DataFrame) -> DataFrame:
    return findings(manifest.where(paths.is_font(F.col("path"), F.coalesce(F.col("media_type"), F.lit("")))), "warning", "fonts", F.lit("embedded font"), F.col("path"))


def zip64(entries: DataFrame) -> DataFrame:
    """Archives that the plain format cannot hold."""
    big = 2**32 - 1
    agg = entries.groupBy("book_id").agg(F.count("*").alias("n"), F.max("size").alias("size"), F.max("csize").alias("csize"), F.max("offset").alias("offset"))
    return findings(agg.where((F.col("n") > 65535) | (F.col("size") >= big) | (F.col("csize") >= big) | (F.col("offset") >= big)), "error", "zip64", F.lit("needs ZIP64"), F.lit(None).cast("string"))


def mimetype_first(entries: DataFrame) -> DataFrame:
    first = entries.where("ord = 0")
    ok = (F.col("raw_name") == "mimetype") & (F.col("method") == "stored") & (F.col("data").cast("string") == "application/epub+zip")
    return findings(first.where(~F.coalesce(ok, F.lit(False))), "error", "mimetype-first", F.lit("the first entry must be a stored mimetype"), F.col("path"))


#: Declared types and extensions of text, fixed values.
TEXT_TYPES = ("application/xhtml+xml", "text/html", "text/css", "application/x-dtbncx+xml", "application/oebps-package+xml")
TEXT_EXTENSIONS = ("xhtml", "html", "htm", "css", "opf", "ncx", "xml", "svg")


def is_text(declared: Column, path: Column) -> Column:
    """Whether an entry is text: by its declared type, only without one by its extension."""
    return F.when(F.coalesce(declared, F.lit("")) != "", F.lower(declared).isin(*TEXT_TYPES)).otherwise(paths.extension(path).isin(*TEXT_EXTENSIONS))


def declared_types(entries: DataFrame, manifest: DataFrame) -> DataFrame:
    """``entries`` with ``declared``, the type of the first manifest item of that path."""
    first = manifest.groupBy("book_id", "path").agg(F.min_by("media_type", "ord").alias("declared"))
    return entries.join(first, ["book_id", "path"], "left")


def encoding(entries: DataFrame) -> DataFrame:
    """Text entries that are no valid UTF-8, and valid ones that are not composed; ``declared`` counts if it is there."""
    e = entries if "declared" in entries.columns else entries.withColumn("declared", F.lit(None).cast("string"))
    text = e.where(is_text(F.col("declared"), F.col("path"))).withColumn("text", F.col("data").cast("string"))
    broken = findings(text.where(~F.is_valid_utf8("text")), "error", "encoding", F.lit("not UTF-8"), F.col("path"))
    foreign = text.where(F.is_valid_utf8("text") & F.col("text").rlike(r"[\x{0300}-\x{036F}\x{1100}-\x{11FF}\x{1E00}-\x{FFFF}]"))
    loose = findings(foreign.where(~tx.is_composed(F.col("text"))), "warning", "encoding", F.lit("text is not in composed form"), F.col("path"))
    return broken.unionByName(loose)


def collisions(dropped: DataFrame) -> DataFrame:
    """Entries that were dropped for an earlier one of the same path (book_id, path, kept_raw, dropped_raw)."""
    return findings(dropped, "warning", "entry-collision", F.concat("dropped_raw", F.lit(" falls on "), "kept_raw"), F.col("path"))


def package_pointer(entries: DataFrame, opf: DataFrame, packages: DataFrame) -> DataFrame:
    """Books whose container is missing or names no package, and whose package is missing."""
    books = entries.select("book_id").distinct()
    container = entries.where("path = 'META-INF/container.xml'").select("book_id").distinct()
    none = books.join(container, "book_id", "left_anti")
    blind = container.join(opf, "book_id", "left_anti")
    lost = opf.join(packages.select("book_id"), "book_id", "left_anti")
    at = F.lit("META-INF/container.xml")
    return (
        findings(none, "error", "manifest-sync", F.lit("the archive has no container"), at)
        .unionByName(findings(blind, "error", "manifest-sync", F.lit("the container names no package"), at))
        .unionByName(findings(lost, "error", "manifest-sync", F.concat(F.lit("the package is missing: "), "opf_path"), F.col("opf_path")))
    )


def content_wellformed(pages: DataFrame) -> DataFrame:
    """Pages (book_id, path, data) of the spine that are no XML, or have a name that XML forbids."""
    schema = "book_id string, path string, message string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for b, p, d in pdf.itertuples(index=False):
                text = bytes(d).decode("utf-8", "replace")
                why = wellformed_error(text) or bad_name(text)
                if why:
                    rows.append((b, p, why))
            yield pd.DataFrame(rows, columns=["book_id", "path", "message"])

    bad = pages.where("data is not null").select("book_id", "path", "data").mapInPandas(run, schema)
    return findings(bad, "error", "content-wellformed", F.col("message"), F.col("path"))


def bad_name(text: str) -> str | None:
    """The first element or attribute whose name or prefix is not allowed, with its line."""
    bare = re.sub(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<!DOCTYPE[^>]*>", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    for m in re.finditer(r"</?([^\s<>/]+)((?:\s+[^\s=<>/\"']+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s<>]+))?)*)\s*/?>", bare):
        names = [m[1], *re.findall(r"([^\s=<>/\"']+)\s*=", re.sub(r"\"[^\"]*\"|'[^']*'", '""', m[2]))]
        for name in names:
            prefix, colon, local = name.rpartition(":")
            if not _NCNAME.fullmatch(local) or colon and prefix not in _PREFIXES:
                return f"name {name} is not allowed (line {text.count(chr(10), 0, m.start()) + 1})"
    return None


_NCNAME = re.compile(r"[^\W\d][\w.\-]*")
_PREFIXES = frozenset(("xml", "xmlns", "xlink", "epub"))


def image_format(entries: DataFrame, caps: Caps) -> DataFrame:
    """Pictures (book_id, path, data, declared) that the device does not show: vector, progressive, another format, too large in pixels; too large in bytes is a warning."""
    e = entries.where("data is not null").withColumn("kind", images.sniff(F.col("data"))).withColumn("svg", images.is_svg(F.col("data")))
    e = e.where(F.coalesce(F.lower("declared").startswith("image/"), F.lit(False)) | F.col("kind").isNotNull() | F.col("svg"))
    pw, ph = images.png_gif_size(F.col("data"))
    e = e.withColumn("probe", images.jpeg_probe(F.when(F.col("kind") == "jpeg", F.col("data")))).withColumn("w", F.coalesce(pw, F.col("probe.width"))).withColumn("h", F.coalesce(ph, F.col("probe.height"))).withColumn("n", F.octet_length("data"))
    tests = [
        ("error", F.col("svg") & ~F.lit(caps.svg), F.lit("vector picture")),
        ("error", F.coalesce(F.col("probe.progressive"), F.lit(False)) & ~F.lit(caps.progressive), F.lit("progressive JPEG")),
        ("error", F.col("kind").isNotNull() & ~F.col("kind").isin(*caps.formats), F.concat(F.lit("format "), "kind")),
    ]
    if caps.max_width:
        tests.append(("error", (F.col("w") > caps.max_width) | (F.col("h") > caps.max_height), F.concat("w", F.lit(" x "), "h", F.lit(" pixels"))))
    if caps.image_bytes:
        tests.append(("warning", F.col("n") > caps.image_bytes, F.concat("n", F.lit(" bytes"))))
    out = None
    for severity, test, message in tests:
        one = findings(e.where(test), severity, "image-format", message, F.col("path"))
        out = one if out is None else out.unionByName(one)
    return out


def css_caps(sheets: DataFrame, caps: Caps) -> DataFrame:
    """Sheets (book_id, path, data) above the limit of bytes, and books above that of rules."""
    out = findings(sheets.where(F.octet_length("data") > (caps.css_bytes or 2**62)), "error", "css-caps", F.concat(F.octet_length("data"), F.lit(" bytes")), F.col("path"))
    total = css.rule_total(sheets, F.col("data").cast("string"), caps.css_rules or 2**62)
    return out.unionByName(findings(total.where("over_cap"), "warning", "css-caps", F.concat("n_rules", F.lit(" rules")), F.lit(None).cast("string")))


def report(f: DataFrame) -> DataFrame:
    """Findings with the errors first, then warnings, then information, in order of book and path."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return f.orderBy("book_id", rank, "code", "path", "message")


def exit_codes(f: DataFrame, books: DataFrame, errors: DataFrame) -> DataFrame:
    """(book_id, exit_code): 2 for what can't be read, else 1 with any error, else 0."""
    bad = f.where("severity = 'error'").select("book_id").distinct().withColumn("bad", F.lit(1))
    dead = errors.select("book_id").distinct().withColumn("dead", F.lit(2))
    return books.select("book_id").unionByName(errors.select("book_id")).distinct().join(dead, "book_id", "left").join(bad, "book_id", "left").select("book_id", F.coalesce("dead", "bad", F.lit(0)).alias("exit_code"))


def summary(f: DataFrame) -> DataFrame:
    """Findings per book and severity, and over all books."""
    return f.rollup("book_id", "severity").agg(F.count("*").alias("n")).where("severity is not null or book_id is null")
