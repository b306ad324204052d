"""Whole books from their tables: package document, navigation, NCX, then the archive.

Each of these documents is one small text per book, made from arrays that are
collected for the book; pages and pictures never pass through them.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from urllib.parse import quote
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookspark.functions import paths
from bookspark.functions import text as tx
from bookspark.operators import naming
from bookspark.sources import archive

# fixed values: offset and prime of the 64-bit hash of synthetic identifiers
_OFFSET, _PRIME = 0xCBF29CE484222325, 0x100000001B3
#: Prefix of identifiers that this engine makes up, and of its provenance marks.
URN, STAMP = "urn:bookspark:", "bookspark"
OPF, NCX, XHTML = "application/oebps-package+xml", "application/x-dtbncx+xml", "application/xhtml+xml"
FILES = "book_id string, path string, data string"


def fnv64(text: str) -> str:
    h = _OFFSET
    for b in text.encode():
        h = (h ^ b) * _PRIME & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


def synthetic_identifier(title: Column, authors: Column) -> Column:
    """The same for the same title and names, for books that have none."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: URN + fnv64(x))

    return F.pandas_udf(run, "string")(F.concat_ws("\0", F.coalesce(title, F.lit("")), F.transform(F.coalesce(authors, F.array().cast("array<struct<name:string,file_as:string,role:string>>")), lambda a: F.coalesce(a["name"], F.lit("")))))


def modified(at: Column | None = None) -> Column:
    """The time of the change in UTC, to the second."""
    return F.date_format(F.to_utc_timestamp(at if at is not None else F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _attr(text: str) -> str:
    return escape(text, {'"': "&quot;"})


def _way(folder: str, target: str) -> str:
    path, mark, fragment = target.partition("#")
    return quote(posixpath.relpath("/" + path, "/" + folder), safe="/-._~") + (mark + quote(fragment, safe="-._~:") if mark else "")


def toc_parents(toc: DataFrame) -> DataFrame:
    """``toc`` with ``parent``, the place of the nearest entry before with a smaller level; null at the top.

    The entries before are one array per book, folded on the JVM: a stack of
    (ord, level) that drops all that are not smaller.
    """
    one = toc.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("level").cast("int").alias("level")))).alias("all"))
    step = F.expr(
        "aggregate(all, struct(cast(array() as array<struct<ord:int,level:int>>) as stack, cast(array() as array<struct<ord:int,parent:int>>) as out), "
        "(acc, x) -> struct(concat(filter(acc.stack, s -> s.level < x.level), array(struct(cast(x.ord as int) as ord, x.level as level))) as stack, "
        "concat(acc.out, array(struct(cast(x.ord as int) as ord, try_element_at(filter(acc.stack, s -> s.level < x.level), -1).ord as parent))) as out), acc -> acc.out)"
    )
    parents = one.select("book_id", F.inline(step))
    return toc.join(parents, ["book_id", "ord"])


def _tree(entries: list) -> list[dict]:
    """Entries as a tree: what follows with a greater level lies below."""
    root: dict = {"level": -1, "below": []}
    stack = [root]
    for e in entries:
        while stack[-1]["level"] >= e["level"]:
            stack.pop()
        node = {"title": (e["title"] or "").strip() or "Untitled", "href": e["path"] + (f"#{e['fragment']}" if e["fragment"] else ""), "level": e["level"], "below": []}
        stack[-1]["below"].append(node)
        stack.append(node)
    return root["below"]


def nav_list(nodes: list[dict], folder: str) -> str:
    """The nested list of a navigation document, references relative to its folder."""
    items = "".join(f'<li><a href="{_attr(_way(folder, n["href"]))}">{escape(n["title"])}</a>' + (("\n" + nav_list(n["below"], folder)) if n["below"] else "") + "</li>\n" for n in nodes)
    return f"<ol>\n{items}</ol>" if nodes else ""


def ncx_points(nodes: list[dict], folder: str, counter: list[int] | None = None) -> str:
    """The points of an NCX, numbered as they are read."""
    counter = counter if counter is not None else [0]
    out = []
    for n in nodes:
        counter[0] += 1
        k = counter[0]
        out.append(f'<navPoint id="p{k}" playOrder="{k}"><navLabel><text>{escape(n["title"])}</text></navLabel><content src="{_attr(_way(folder, n["href"]))}"/>\n{ncx_points(n["below"], folder, counter)}</navPoint>\n')
    return "".join(out)


def _depth(nodes: list[dict]) -> int:
    return max((1 + _depth(n["below"]) for n in nodes), default=0)


def _package(r: dict, items: list[dict], spine: list[str], stamp: str | None, profile: str | None) -> str:
    x = lambda tag, v, attrs="": f"    <dc:{tag}{attrs}>{escape(v)}</dc:{tag}>\n" if v else ""
    refine = lambda i, p, v, more="": f'    <meta refines="#{i}" property="{p}"{more}>{escape(v)}</meta>\n' if v else ""
    folder = posixpath.dirname(r["opf_path"])
    prefix = f' prefix="{STAMP}: {URN}terms#"' if stamp else ""
    out = [f'<?xml version="1.0" encoding="UTF-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="uid"{prefix}>\n  <metadata xmlns:dc="http://purl.org/dc/elements/1.1/">\n', x("identifier", r["identifier"], ' id="uid"')]
    for k, i in enumerate(r["identifiers"] or (), 1):
        out += [x("identifier", i["value"], f' id="more{k}"'), refine(f"more{k}", "identifier-type", i["scheme"])]
    out += [x("title", r["title"] or "Untitled"), x("language", (r["language"] or "").strip() or "en")]
    for tag, people in (("creator", r["authors"]), ("contributor", r["contributors"])):
        for k, c in enumerate(people or (), 1):
            i = f"{tag}{k}"
            out += [x(tag, c["name"], f' id="{i}"'), refine(i, "file-as", c["file_as"]), refine(i, "role", c["role"], ' scheme="marc:relators"')]
    out += [x(t, r[t]) for t in ("publisher", "description", "date", "rights")] + [x("subject", s) for s in (r["subjects"] or ())]
    if r["series"] is not None and r["series"]["name"]:
        out += [f'    <meta property="belongs-to-collection" id="series">{escape(r["series"]["name"])}</meta>\n', refine("series", "collection-type", "series"), refine("series", "group-position", r["series"]["index"])]
    out.append(f'    <meta property="dcterms:modified">{r["modified"]}</meta>\n')
    out += [f'    <meta property="{STAMP}:{k}">{escape(v)}</meta>\n' for k, v in (("fitted", stamp), ("profile", profile if stamp else None)) if v]
    cover = next((i["id"] for i in items if "cover-image" in i["properties"]), None)
    if cover:
        out.append(f'    <meta name="cover" content="{cover}"/>\n')
    ids = {i["path"]: i["id"] for i in items}
    ncx = next((i["id"] for i in items if i["media_type"] == NCX), "")
    out.append("  </metadata>\n  <manifest>\n")
    for i in items:
        props = f' properties="{" ".join(i["properties"])}"' if i["properties"] else ""
        out.append(f'    <item id="{i["id"]}" href="{_attr(_way(folder, i["path"]))}" media-type="{_attr(i["media_type"])}"{props}/>\n')
    out.append(f'  </manifest>\n  <spine toc="{ncx}">\n' + "".join(f'    <itemref idref="{ids[p]}"/>\n' for p in spine if p in ids) + "  </spine>\n</package>\n")
    return "".join(out)


def _documents(stamp: str | None, profile: str | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in ({k: list(v) if isinstance(v, np.ndarray) else v for k, v in x.items()} for x in pdf.to_dict("records")):
                folder = posixpath.dirname(r["opf_path"])
                nav = r["nav_path"] or posixpath.join(folder, "nav.xhtml")
                ncx = r["ncx_path"] or posixpath.join(folder, "toc.ncx")
                spine = r["spine"] or []
                given = [dict(i) for i in (r["items"] or ()) if i["path"] not in (r["opf_path"], "mimetype") and not i["path"].startswith("META-INF/")]
                given += [{"path": p, "media_type": None} for p in (nav, ncx) if p not in {i["path"] for i in given}]
                taken: set[str] = set()
                items = []
                for i in given:
                    base = "".join(c if c.isascii() and c.isalnum() else "-" for c in i["path"])
                    base = base if base[:1].isascii() and base[:1].isalpha() else "id-" + base
                    kind = XHTML if i["path"] == nav else NCX if i["path"] == ncx else i["media_type"] or "application/octet-stream"
                    items.append({"path": i["path"], "id": naming.first_free(base, taken), "media_type": kind, "properties": ["nav"] * (i["path"] == nav) + ["cover-image"] * (i["path"] == r["cover"])})
                entries = [dict(e) for e in (r["toc"] or ())]
                if not entries:
                    entries = [{"title": r["title"], "path": (spine or [i["path"] for i in items])[0], "fragment": None, "level": 1}]
                tree = _tree(entries)
                title, lang = escape(r["title"] or "Untitled"), _attr((r["language"] or "").strip() or "en")
                nav_text = f'<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" lang="{lang}" xml:lang="{lang}">\n<head><title>{title}</title></head>\n<body><nav epub:type="toc" id="toc"><h1>{title}</h1>\n{nav_list(tree, posixpath.dirname(nav))}\n</nav></body>\n</html>\n'
                ncx_text = f'<?xml version="1.0" encoding="UTF-8"?>\n<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1">\n<head><meta name="dtb:uid" content="{_attr(r["identifier"])}"/><meta name="dtb:depth" content="{_depth(tree)}"/></head>\n<docTitle><text>{title}</text></docTitle>\n<navMap>\n{ncx_points(tree, posixpath.dirname(ncx))}</navMap>\n</ncx>\n'
                container = f'<?xml version="1.0" encoding="UTF-8"?>\n<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="{_attr(quote(r["opf_path"], safe="/-._~"))}" media-type="{OPF}"/></rootfiles></container>\n'
                rows += [(r["book_id"], p, t) for p, t in (("META-INF/container.xml", container), (r["opf_path"], _package(r, items, spine, stamp, profile)), (nav, nav_text), (ncx, ncx_text))]
            yield pd.DataFrame(rows, columns=["book_id", "path", "data"])

    return run


def documents(metadata: DataFrame, resources: DataFrame, spine: DataFrame, toc: DataFrame, shell: DataFrame, stamp: str | None = None, profile: str | None = None, at: Column | None = None) -> DataFrame:
    """(book_id, path, data) of container, package, navigation and NCX of every book.

    ``resources`` (book_id, ord, path, media_type), ``spine`` (book_id, ord,
    path), ``toc`` (book_id, ord, title, path, fragment, level), ``shell``
    (book_id, opf_path, nav_path, ncx_path, cover). A book without contents gets
    one entry, one without identifier a synthetic one.
    """
    order = lambda c, *cols: F.transform(F.array_sort(F.collect_list(F.struct("ord", *cols))), lambda x: x[c] if c else x.dropFields("ord"))
    items = resources.groupBy("book_id").agg(order(None, "path", "media_type").alias("items"))
    sp = spine.groupBy("book_id").agg(order("path", "path").alias("spine"))
    contents = toc.groupBy("book_id").agg(order(None, "title", "path", "fragment", F.col("level").cast("int").alias("level")).alias("toc"))
    m = metadata.withColumn("identifier", F.coalesce(tx.blank_to_null(F.col("identifier")), synthetic_identifier(F.col("title"), F.col("authors")))).withColumn("modified", modified(at))
    one = m.join(shell, "book_id").join(items, "book_id", "left").join(sp, "book_id", "left").join(contents, "book_id", "left")
    cols = ("book_id", "title", "language", "identifier", "authors", "contributors", "identifiers", "subjects", "description", "publisher", "date", "rights", "series", "modified", "opf_path", "nav_path", "ncx_path", "cover", "items", "spine", "toc")
    return one.select(*cols).mapInPandas(_documents(stamp, profile), FILES)


def write_books(entries: DataFrame, made: DataFrame) -> DataFrame:
    """(book_id, content, n_entries): archives of the entries (book_id, ord, path, data) with the documents of ``made`` in the place of their namesakes, container first."""
    new = made.select("book_id", "path", F.encode("data", "utf-8").alias("new"))
    j = entries.where("path <> 'mimetype'").select("book_id", "ord", "path", "data").join(new, ["book_id", "path"], "full")
    place = F.when(F.col("path") == "META-INF/container.xml", F.lit(-1)).otherwise(F.coalesce("ord", F.lit(2**30)))
    return archive.write_archives(j.select("book_id", place.alias("ord"), "path", F.coalesce("new", "data").alias("data")))


def stamps(facts: DataFrame) -> DataFrame:
    """(book_id, fitted, appendix, version, profile) of books that carry a mark of an earlier run."""
    p = F.col("attrs")["property"]
    g = facts.where("name = 'meta'").groupBy("book_id").agg(F.min_by("value", F.when(p == f"{STAMP}:fitted", F.col("ord"))).alias("fitted"), F.min_by("value", F.when(p == f"{STAMP}:profile", F.col("ord"))).alias("profile"))
    return g.where("fitted is not null").select("book_id", "fitted", F.substring_index("fitted", " ", 1).alias("appendix"), F.nullif(F.regexp_extract("fitted", "^[^ ]* (.*)$", 1), F.lit("")).alias("version"), "profile")


def shells(e: DataFrame, m: DataFrame, meta: DataFrame) -> DataFrame:
    """(book_id, opf_path, nav_path, ncx_path, cover) of books as they were read."""
    nav = m.where(F.array_contains("properties", "nav")).groupBy("book_id").agg(F.min_by("path", "ord").alias("nav_path"))
    ncx = m.where(F.col("media_type") == NCX).groupBy("book_id").agg(F.min_by("path", "ord").alias("ncx_path"))
    return archive.package_paths(e).join(nav, "book_id", "left").join(ncx, "book_id", "left").join(archive.covers(meta, m).withColumnRenamed("path", "cover"), "book_id", "left")


def resources_of(e: DataFrame, m: DataFrame) -> DataFrame:
    """(book_id, ord, path, media_type) of all entries, the declared type first."""
    declared = m.groupBy("book_id", "path").agg(F.min_by("media_type", "ord").alias("declared"))
    return e.select("book_id", "ord", "path").join(declared, ["book_id", "path"], "left").select("book_id", "ord", "path", paths.media_type(F.col("path"), F.col("declared")).alias("media_type"))


def set_cover(resources: DataFrame, shell: DataFrame, covers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resources, shell) with new covers (book_id, data, media_type) beside the package, under a name that is free."""
    ext = F.when(F.col("media_type") == "image/png", "png").when(F.col("media_type") == "image/gif", "gif").when(F.col("media_type") == "image/svg+xml", "svg").otherwise("jpg")
    c = covers.join(shell.select("book_id", "opf_path"), "book_id").withColumn("folder", paths.parent_dir(F.col("opf_path"))).withColumn("base", F.concat(F.when(F.col("folder") == "", F.lit("")).otherwise(F.concat("folder", F.lit("/"))), F.lit("cover"))).withColumn("ext", ext)
    taken = resources.join(c.select("book_id", "base", "ext"), "book_id").where(F.expr("startswith(path, base)")).groupBy("book_id").agg(F.collect_set("path").alias("taken"))
    tries = F.expr("transform(sequence(1, size(coalesce(taken, array())) + 1), k -> concat(base, if(k = 1, '', concat('-', k)), '.', ext))")
    named = c.join(taken, "book_id", "left").withColumn("path", F.element_at(F.filter(tries, lambda p: ~F.array_contains(F.coalesce("taken", F.array().cast("array<string>")), p)), 1))
    rows = named.select("book_id", F.lit(2**29).alias("ord"), "path", "media_type", "data")
    return resources.unionByName(rows, allowMissingColumns=True), shell.drop("cover").join(named.select("book_id", F.col("path").alias("new")), "book_id", "left").join(shell.select("book_id", "cover"), "book_id").withColumn("cover", F.coalesce("new", "cover")).drop("new")
