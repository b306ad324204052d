"""Markdown documents as block and chunk tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookspark.functions import text as tx
from bookspark.operators import naming

BLOCKS = "doc string, ord int, kind string, level int, text string"
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
_HEADING = re.compile(r"^ {0,3}(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$")
_NOTE = re.compile(r"^\[\^([^\]]+)\]:[ \t]*(.*)$")


def blocks_of(text: str) -> list[tuple[str, int, str]]:
    """(kind, level, text) of each block: front matter, heading, code, note, list, quote or paragraph."""
    out: list[tuple[str, int, str]] = []
    lines = text.replace("\r\n", "\n").split("\n")
    i = 0
    if lines and lines[0].strip() == "---" and "---" in (x.strip() for x in lines[1:]):
        end = next(k for k in range(1, len(lines)) if lines[k].strip() == "---")
        out.append(("front", 0, "\n".join(lines[1:end])))
        i = end + 1
    para: list[str] = []

    def flush() -> None:
        if para:
            first = para[0].lstrip()
            kind = "list" if re.match(r"[-+*][ \t]|\d+[.)][ \t]", first) else "quote" if first.startswith(">") else "paragraph"
            out.append((kind, 0, "\n".join(para)))
            para.clear()

    while i < len(lines):
        line = lines[i]
        if m := _FENCE.match(line):
            flush()
            end = next((k for k in range(i + 1, len(lines)) if lines[k].strip().startswith(m[1])), len(lines))
            out.append(("code", 0, "\n".join(lines[i + 1:end])))
            i = end
        elif m := _HEADING.match(line):
            flush()
            out.append(("heading", len(m[1]), m[2]))
        elif para and re.match(r"^(=+|-+)\s*$", line) and len(para) == 1:
            out.append(("heading", 1 if line[0] == "=" else 2, para.pop()))
        elif m := _NOTE.match(line):
            flush()
            out.append(("note", 0, f"{m[1]}\t{m[2]}"))
        elif not line.strip():
            flush()
        else:
            para.append(line)
        i += 1
    flush()
    return out


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(doc, i, *b) for doc, text in zip(pdf["doc"], pdf["md"], strict=True) if text for i, b in enumerate(blocks_of(text))]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in BLOCKS.split(", ")])


def blocks(df: DataFrame, doc: Column, text: Column) -> DataFrame:
    return df.select(doc.cast("string").alias("doc"), text.alias("md")).mapInPandas(_blocks, BLOCKS)


def chunks(b: DataFrame, split_level: int = 1) -> DataFrame:
    """Blocks with the number of their chapter: a new one at each heading of at most the level; what stands before is 0."""
    cut = ((F.col("kind") == "heading") & (F.col("level") <= split_level)).cast("int")
    return b.where("kind not in ('front', 'note')").withColumn("chunk", F.sum(cut).over(Window.partitionBy("doc").orderBy("ord")))


def titles(b: DataFrame) -> DataFrame:
    """(doc, title): that of the front matter, else the first heading of level 1, else the default."""
    front = F.nullif(F.trim(F.regexp_extract("text", r"(?m)^title:[ \t]*[\"']?(.*?)[\"']?[ \t]*$", 1)), F.lit(""))
    g = b.groupBy("doc").agg(F.max(F.when(F.col("kind") == "front", front)).alias("front"), F.min_by("text", F.when((F.col("kind") == "heading") & (F.col("level") == 1), F.col("ord"))).alias("h1"))
    return g.select("doc", F.coalesce("front", F.nullif("h1", F.lit("")), F.lit("Untitled")).alias("title"))


def heading_anchors(c: DataFrame) -> DataFrame:
    """(doc, chunk, ord, anchor): slugs of headings, numbered within a chapter where they repeat."""
    h = c.where("kind = 'heading'").withColumn("slug", tx.slugify(F.col("text")))
    n = F.row_number().over(Window.partitionBy("doc", "chunk", "slug").orderBy("ord"))
    return h.withColumn("n", n).select("doc", "chunk", "ord", naming.suffixed(F.col("slug"), F.col("n")).alias("anchor"))


def note_homes(b: DataFrame, c: DataFrame) -> DataFrame:
    """(doc, note, chunk, shared): each footnote goes to the first chapter that refers to it, else to the last one."""
    notes = b.where("kind = 'note'").select("doc", F.substring_index("text", "\t", 1).alias("note"))
    refs = c.select("doc", "chunk", F.explode(F.regexp_extract_all("text", F.lit(r"\[\^([^\]]+)\]"), F.lit(1))).alias("note"))
    first = refs.groupBy("doc", "note").agg(F.min("chunk").alias("chunk"), (F.count_distinct("chunk") > 1).alias("shared"))
    last = c.groupBy("doc").agg(F.max("chunk").alias("last"))
    return notes.join(first, ["doc", "note"], "left").join(last, "doc", "left").select("doc", "note", F.coalesce("chunk", "last").alias("chunk"), F.coalesce("shared", F.lit(False)).alias("shared"))
