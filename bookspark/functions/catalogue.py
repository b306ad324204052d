"""Catalogue records: match score, description, references and names of output files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUALITY = {"low": 70, "std": 82, "high": 90}


def match_score(title: Column, authors: Column, want_title: Column, want_author: Column) -> Column:
    """Mean of what was asked for: title 1 if equal, 0.6 if one holds the other; author 1 if one holds the other; 0.5 if nothing was asked."""
    wt, wa, t = F.lower(F.coalesce(want_title, F.lit(""))), F.lower(F.coalesce(want_author, F.lit(""))), F.lower(title)
    by_title = F.when(t == wt, 1.0).when(t.contains(wt) | wt.contains(t), 0.6).otherwise(0.0)
    holds = F.exists(F.coalesce(authors, F.array().cast("array<string>")), lambda a: F.coalesce(F.lower(a).contains(wa) | wa.contains(F.lower(a)), F.lit(False)))
    asked = (wt != "").cast("int") + (wa != "").cast("int")
    points = F.when(wt != "", F.coalesce(by_title, F.lit(0.0))).otherwise(0.0) + F.when((wa != "") & holds, 1.0).otherwise(0.0)
    return F.when(asked == 0, F.lit(0.5)).otherwise(points / asked)


def clean_description(text: Column) -> Column:
    """The text before a source note, links flattened to their labels, emphasis signs and spaces at line ends removed. A target without an end takes the rest with it; behind a bracket without an end nothing is changed."""
    cut = F.substring_index(F.substring_index(F.substring_index(text, "\n----------", 1), "\r\n\r\n([source]", 1), "\n([source]", 1)
    out = F.replace(cut, F.lit("\r\n"), F.lit("\n"))
    out = F.regexp_replace(out, r"(?s)\[[*_]*([^\]]*?)[*_]*\](?:\([^)]*(?:\)|$)|\[[^\]]*(?:\]|$))?", "$1")
    whole = r"(?s)^(.*?)(\[[^\]]*)?$"
    out = F.concat(F.regexp_replace(F.regexp_extract(out, whole, 1), r"[*_]", ""), F.regexp_extract(out, whole, 2))
    return F.regexp_replace(F.regexp_replace(out, r"[ \t\r\f]+(?=\n|$)", ""), r"^\s+|\s+$", "")


def parse_ref(ref: Column) -> tuple[Column, Column]:
    """(source, identifier) of a prefixed reference."""
    return F.substring_index(ref, ":", 1), F.regexp_extract(ref, r"^[^:]*:(.*)$", 1)


def quality(text: Column) -> Column:
    """A named quality or a number of 1 to 100, else null."""
    n = text.try_cast("int")
    named = F.when(text == "low", QUALITY["low"]).when(text == "std", QUALITY["std"]).when(text == "high", QUALITY["high"])
    return F.coalesce(named, F.when((n >= 1) & (n <= 100), n))


def file_name(template: str, values: dict[str, Column], original: Column) -> Column:
    """A template filled in and made safe as a file name; unknown tokens stay, an empty result is the original."""
    out = F.lit(template)
    for token, value in values.items():
        out = F.replace(out, F.lit("{" + token + "}"), F.coalesce(value, F.lit("")))
    out = F.regexp_replace(out, r"-*[/\\:*?\"<>|\x00-\x1f][-/\\:*?\"<>|\x00-\x1f]*", "-")
    out = F.regexp_replace(F.substring(F.regexp_replace(F.trim(out), r"[. ]+$", ""), 1, 120), r"[. ]+$", "")
    return F.when(out == "", original).otherwise(out)


def copy_name(name: Column) -> tuple[Column, Column, Column]:
    """(stem, appendix, number) of ``stem.appendix (n).epub``; empty and null where it is no copy."""
    rx = r"(?i)^(.+)\.([A-Za-z0-9-]+)(?: \((\d+)\))?\.epub$"
    return F.regexp_extract(name, rx, 1), F.lower(F.regexp_extract(name, rx, 2)), F.nullif(F.regexp_extract(name, rx, 3), F.lit("")).cast("int")


def split_stamp(stamp: Column) -> tuple[Column, Column]:
    """(appendix, version) at the first space."""
    return F.substring_index(stamp, " ", 1), F.when(stamp.contains(" "), F.regexp_extract(stamp, r"^[^ ]* (.*)$", 1))


def size_text(n: Column) -> Column:
    """Bytes for reading: kilobytes with a decimal below ten, megabytes from a thousand kilobytes on."""
    kb = n / 1024
    small = F.concat(F.format_string("%.1f", kb), F.lit(" KB"))
    return F.when(n.isNull() | (n <= 0), "0 B").when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B"))).when(kb < 10, small).when(kb < 1000, F.concat(F.floor(kb + 0.5).cast("string"), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.1f", kb / 1024), F.lit(" MB")))


def initials(name: Column) -> Column:
    """Up to two initials of the words of a name."""
    words = F.slice(F.filter(F.split(name, r"[\s_·—–-]+"), lambda w: w != ""), 1, 2)
    return F.array_join(F.transform(words, lambda w: F.upper(F.substring(w, 1, 1))), "")


def year(date: Column) -> Column:
    """The first four digits of a date, else empty."""
    return F.coalesce(F.regexp_extract(date, r"\d{4}", 0), F.lit(""))


def input_kind(name: Column) -> Column:
    """What an input file is by its extension; null for others."""
    low = F.lower(name)
    return F.when(low.endswith(".epub"), "epub").when(low.endswith(".md") | low.endswith(".markdown"), "md")


def fnv32(text: Column) -> Column:
    """A 32-bit hash of the bytes of a text, by folding; for keys of caches."""
    codes = F.transform(F.sequence(F.lit(0), F.octet_length(text) - 1), lambda k: F.conv(F.substring(F.hex(F.encode(text, "utf-8")), k * 2 + 1, F.lit(2)), 16, 10).cast("long"))
    start, prime, wide = F.lit(2166136261).cast("long"), F.lit(16777619), F.lit(4294967295).cast("long")
    return F.when(F.octet_length(text) > 0, F.aggregate(codes, start, lambda h, b: (h.bitwiseXOR(b) * prime).bitwiseAND(wide))).otherwise(F.when(text.isNotNull(), start))


def isbn_of(isbn: Column, identifiers: Column) -> Column:
    """The ISBN of a document, in its field or among its identifiers."""
    return F.coalesce(isbn, F.try_element_at(F.filter(identifiers, lambda i: F.lower(i["scheme"]) == "isbn"), F.lit(1))["value"])


def card(df: DataFrame) -> DataFrame:
    """Metadata records as a card shows them: names instead of people, the ISBN wherever it stands, the series in two columns."""
    return df.select("book_id", "title", F.transform("authors", lambda a: a["name"]).alias("authors"), F.col("series.name").alias("series"), F.col("series.index").alias("series_index"), "publisher", "description", "language", "date", isbn_of(F.lit(None).cast("string"), F.col("identifiers")).alias("isbn"), "subjects")
