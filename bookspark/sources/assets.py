"""Markdown as books: pictures from a folder, pages from blocks, and the tables of a book."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookspark.functions import paths
from bookspark.operators import naming
from bookspark.sources import documents, markdown

#: What the renderer knows, fixed on.
OPTIONS = ("tables", "strikethrough", "autolinks", "footnotes", "task lists", "front matter", "raw html")
_INLINE = (
    (re.compile(r"!\[([^\]]*)\]\(([^()\s]+)(?:\s+\"([^\"]*)\")?\)"), lambda m: f'<img src="{html.escape(m[2])}" alt="{html.escape(m[1])}"/>'),
    (re.compile(r"\[\^([^\]\s]+)\]"), lambda m: f'<sup><a id="ref-{m[1]}" href="#note-{m[1]}">{m[1]}</a></sup>'),
    (re.compile(r"\[([^\]]+)\]\(([^()\s]+)(?:\s+\"([^\"]*)\")?\)"), lambda m: f'<a href="{html.escape(m[2])}">{m[1]}</a>'),
    (re.compile(r"<((?:https?|mailto):[^\s<>]+)>"), lambda m: f'<a href="{m[1]}">{m[1]}</a>'),
    (re.compile(r"(?<![\"'>=\w])(https?://[^\s<>\"')\]]+)"), lambda m: f'<a href="{m[1]}">{m[1]}</a>'),
    (re.compile(r"\*\*(?=\S)(.+?)(?<=\S)\*\*|__(?=\S)(.+?)(?<=\S)__"), lambda m: f"<strong>{m[1] or m[2]}</strong>"),
    (re.compile(r"(?<![\w*])\*(?=\S)(.+?)(?<=\S)\*(?![\w*])|(?<!\w)_(?=\S)(.+?)(?<=\S)_(?!\w)"), lambda m: f"<em>{m[1] or m[2]}</em>"),
    (re.compile(r"~~(?=\S)(.+?)(?<=\S)~~"), lambda m: f"<del>{m[1]}</del>"),
)


def inline(text: str) -> str:
    """Emphasis, links, pictures, notes and code of one block; what stands in code is left alone. Ampersands that begin no reference are written out."""
    kept: list[str] = []

    def code(m: re.Match) -> str:
        kept.append(f"<code>{html.escape(m[2].strip(), quote=False)}</code>")
        return f"\0{len(kept) - 1}\0"

    out = re.sub(r"(`+)(.+?)\1(?!`)", code, text)
    out = re.sub(r"&(?!#?\w+;)", "&amp;", out)
    out = re.sub(r"<(?![a-zA-Z/!])", "&lt;", out)
    for rx, one in _INLINE:
        out = rx.sub(one, out)
    out = re.sub(r"(?: {2,}|\\)\n", "<br/>\n", out)
    return re.sub("\0(\\d+)\0", lambda m: kept[int(m[1])], out)


def _list(text: str) -> str:
    """Items by their indent; a task has a box."""
    items = [(len(m[1]), m[2], m[3]) for m in re.finditer(r"^([ \t]*)([-+*]|\d+[.)])[ \t]+(.*(?:\n(?![ \t]*(?:[-+*]|\d+[.)])[ \t]).*)*)", text, re.M)]

    def build(k: int, indent: int) -> tuple[str, int]:
        ordered = items[k][1][0].isdigit()
        start = f' start="{int(items[k][1][:-1])}"' if ordered and items[k][1][:-1] != "1" else ""
        out = ["<ol" + start + ">" if ordered else "<ul>"]
        while k < len(items) and items[k][0] >= indent:
            body = re.sub(r"^\[([ xX])\][ \t]+", lambda m: "☑ " if m[1] != " " else "☐ ", items[k][2].strip())
            below = ""
            k += 1
            if k < len(items) and items[k][0] > indent:
                below, k = build(k, items[k][0])
            out.append(f"<li>{inline(body)}{below}</li>")
        return "".join(out) + ("</ol>" if ordered else "</ul>"), k

    return build(0, items[0][0])[0] if items else f"<p>{inline(text)}</p>"


def _table(text: str) -> str | None:
    lines = text.split("\n")
    if len(lines) < 2 or not re.fullmatch(r"\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*", lines[1]) or "|" not in lines[0]:
        return None
    cells = lambda x: [c.strip() for c in re.split(r"(?<!\\)\|", x.strip().strip("|"))]
    head = "".join(f"<th>{inline(c)}</th>" for c in cells(lines[0]))
    return f"<table><thead><tr>{head}</tr></thead><tbody>" + "".join("<tr>" + "".join(f"<td>{inline(c)}</td>" for c in cells(x)) + "</tr>" for x in lines[2:]) + "</tbody></table>"


def render_block(kind: str, level: int, text: str, anchor: str | None = None) -> str:
    """One block as XHTML; raw HTML passes through and is sanitised later."""
    at = f' id="{anchor}"' if anchor else ""
    if kind == "heading":
        return f"<h{level}{at}>{inline(text)}</h{level}>"
    if kind == "code":
        return f"<pre><code>{html.escape(text, quote=False)}</code></pre>"
    if kind == "list":
        return _list(text)
    if kind == "quote":
        return "<blockquote><p>" + inline(re.sub(r"^ {0,3}> ?", "", text, flags=re.M)) + "</p></blockquote>"
    if kind == "note":
        name, _, body = text.partition("\t")
        return f'<p id="note-{name}"><a href="#ref-{name}">{name}</a> {inline(body)}</p>'
    if re.fullmatch(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})", text):
        return "<hr/>"
    if text.lstrip().startswith("<") and re.match(r"\s*</?[a-zA-Z][^>]*>", text):
        return text
    return _table(text) or f"<p>{inline(text)}</p>"


PAGES = "doc string, chunk int, html string"


def pages(blocks: DataFrame, split_level: int = 1) -> DataFrame:
    """(doc, chunk, html): the body of every chapter; footnotes stand at the end of the chapter they belong to."""
    c = markdown.chunks(blocks, split_level)
    anchors = markdown.heading_anchors(c)
    homes = markdown.note_homes(blocks, c).select("doc", "note", "chunk")
    notes = blocks.where("kind = 'note'").withColumn("note", F.substring_index("text", "\t", 1)).join(homes, ["doc", "note"]).select("doc", "chunk", (F.col("ord") + F.lit(2**20)).alias("ord"), "kind", "level", "text", F.lit(None).cast("string").alias("anchor"))
    every = c.join(anchors, ["doc", "chunk", "ord"], "left").select("doc", "chunk", "ord", "kind", "level", "text", "anchor").unionByName(notes)
    grouped = every.groupBy("doc", "chunk").agg(F.array_sort(F.collect_list(F.struct("ord", "kind", "level", "text", "anchor"))).alias("blocks"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, k, "\n".join(render_block(b["kind"], b["level"], b["text"], b["anchor"]) for b in bs)) for d, k, bs in pdf.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["doc", "chunk", "html"])

    return grouped.select("doc", F.col("chunk").cast("int").alias("chunk"), "blocks").mapInPandas(run, PAGES)


def local_assets(spark: SparkSession, folder: str) -> DataFrame:
    """(href, data) of pictures in a folder and below it, by the way from the folder: nothing outside it can be named."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = folder.rstrip("/") + "/"
    return files.select(F.regexp_extract("path", "^(?:file:)?/*" + re.escape(root.lstrip("/")) + "(.*)$", 1).alias("href"), F.col("content").alias("data")).where("href <> ''")


def asset_media_type(path: Column) -> Column:
    """By extension; what is unknown is bytes."""
    return paths.media_type(path)


def cover_media_type(path: Column) -> Column:
    """By extension; what is unknown is taken for a JPEG."""
    known = paths.media_type(path)
    return F.when(known.startswith("image/"), known).otherwise("image/jpeg")


def resolve_images(rendered: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, resources, warnings): pictures of pages (doc, chunk, html) found among assets (href, data) are stored once each beside the pages, under flat names that are free; others stay as written and are warned about."""
    refs = rendered.select("doc", F.explode(F.regexp_extract_all("html", F.lit(r'<img [^>]*src="([^"]+)"'), F.lit(1))).alias("href")).distinct()
    local = refs.where(~paths.has_scheme(F.col("href")) & ~F.col("href").startswith("//") & ~F.col("href").startswith("/"))
    found = local.withColumn("clean", paths.normalize_segments(paths.percent_decode(F.col("href")))).where(~F.col("href").rlike(r"(^|/)\.\.(/|$)")).join(assets.withColumnRenamed("href", "clean"), "clean")
    named = naming.reserve(found.select("doc", "href", "clean", F.concat(F.lit("images/"), F.replace("clean", F.lit("/"), F.lit("-"))).alias("flat"), "data"), "doc", "flat", "clean", "path")
    lost = refs.join(named.select("doc", "href"), ["doc", "href"], "left_anti").select("doc", F.concat(F.lit("no such picture: "), "href").alias("message"))
    maps = named.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("href", "path"))).alias("m"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            new = [re.sub(r'(<img [^>]*src=")([^"]+)(")', lambda m: m[1] + table.get(m[2], m[2]) + m[3], text) for text, table in ((t, dict(m) if m is not None else {}) for t, m in zip(pdf["html"], pdf["m"], strict=True))]  # noqa: B023
            yield pdf[["doc", "chunk"]].assign(html=new)[["doc", "chunk", "html"]]

    return rendered.join(maps, "doc", "left").select("doc", "chunk", "html", "m").mapInPandas(run, PAGES), named.select("doc", "path", "data"), lost


def books(texts: DataFrame, doc: Column, text: Column, split_level: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(metadata, pages, toc) of Markdown documents: front matter as a document, a page per chapter, headings of two levels as contents."""
    b = markdown.blocks(texts, doc, text)
    front = b.where("kind = 'front'").select("doc", "text")
    meta = documents.documents(front, F.col("doc"), F.col("text")).withColumnRenamed("doc_id", "book_id")
    title = markdown.titles(b).withColumnRenamed("doc", "book_id").withColumnRenamed("title", "found")
    meta = title.join(meta, "book_id", "left").withColumn("title", F.coalesce("title", "found")).drop("found")
    c = markdown.chunks(b, split_level)
    heads = c.where((F.col("kind") == "heading") & (F.col("level") <= split_level + 1)).join(markdown.heading_anchors(c), ["doc", "chunk", "ord"], "left")
    page = F.format_string("text/chapter-%03d.xhtml", F.col("chunk"))
    toc = heads.select(F.col("doc").alias("book_id"), "ord", F.col("text").alias("title"), page.alias("path"), F.when(F.col("level") > split_level, F.col("anchor")).alias("fragment"), F.when(F.col("level") > split_level, 2).otherwise(1).alias("level"))
    return meta, pages(b, split_level), toc
