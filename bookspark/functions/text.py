"""Text functions as Column expressions; only Unicode normalisation needs Python."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))


def blank_to_null(text: Column) -> Column:
    c = collapse_whitespace(text)
    return F.when(c != "", c)


def strip_controls(text: Column) -> Column:
    """Without the control characters that XML forbids and without byte order marks."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FEFF}]", "")


def _nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def clean_string(text: Column) -> Column:
    """Composed and fit for XML; plain ASCII never reaches Python."""
    nfc = F.pandas_udf(_nfc, "string")
    plain = strip_controls(text)
    return F.when(plain.rlike(r"[^\x00-\x7F]"), nfc(F.when(plain.rlike(r"[^\x00-\x7F]"), plain))).otherwise(plain)


def _composed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda t: t is None or unicodedata.is_normalized("NFC", t)).astype(bool)


def is_composed(text: Column) -> Column:
    """Whether a text is in composed form."""
    return F.pandas_udf(_composed, "boolean")(text)


def xml_escape(text: Column, quote: bool = False) -> Column:
    out = strip_controls(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"),) if quote else ())):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def slugify(text: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", "")
    return F.when(s == "", F.lit("section")).otherwise(s)


def count_of(text: Column, needle: str) -> Column:
    """Occurrences of a literal, not overlapping."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def long_words(text: Column, limit: int) -> Column:
    """Words of more than ``limit`` bytes."""
    return F.filter(F.split(text, r"\s+"), lambda w: F.octet_length(w) > limit)


def wrap(text: Column, width: int) -> Column:
    """Lines of at most ``width`` characters, filled word by word; a longer word is broken hard; at least one line."""
    pieces = F.flatten(F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.regexp_extract_all(w, F.lit(rf"(?s).{{1,{width}}}"), F.lit(0))))
    lines = F.aggregate(
        pieces,
        F.array().cast("array<string>"),
        lambda acc, w: F.when((F.size(acc) > 0) & (F.length(F.element_at(acc, -1)) + 1 + F.length(w) <= width), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.lit(" "), w)))).otherwise(F.concat(acc, F.array(w))),
    )
    return F.when(F.size(lines) == 0, F.array(F.lit(""))).otherwise(lines)


def alpha(n: Column) -> Column:
    """Bijective base 26 in small letters; below 1 the number itself."""
    digits = F.aggregate(
        F.sequence(F.lit(1), F.lit(7)),
        F.struct(n.cast("long").alias("n"), F.lit("").alias("s")),
        lambda acc, _: F.struct(F.when(acc.n > 0, F.floor((acc.n - 1) / 26)).otherwise(acc.n).cast("long").alias("n"), F.when(acc.n > 0, F.concat(F.char(F.lit(97) + (acc.n - 1) % 26), acc.s)).otherwise(acc.s).alias("s")),
        lambda acc: acc.s,
    )
    return F.when(n < 1, n.cast("string")).otherwise(digits)


# fixed values: Roman digits by place
_ROMAN = (("", "m", "mm", "mmm"), ("", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"), ("", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"), ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"))


def roman(n: Column) -> Column:
    """1 to 3999 in small Roman digits, any other number as it is."""
    place = [F.element_at(F.array(*[F.lit(x) for x in row]), (F.floor(n / 10 ** (3 - i)) % 10 + 1).cast("int")) for i, row in enumerate(_ROMAN)]
    return F.when((n >= 1) & (n <= 3999), F.concat(*place)).otherwise(n.cast("string"))


def list_token(n: Column, kind: Column) -> Column:
    """The label of an ordered list item by its type."""
    return F.when(kind == "a", alpha(n)).when(kind == "A", F.upper(alpha(n))).when(kind == "i", roman(n)).when(kind == "I", F.upper(roman(n))).otherwise(n.cast("string"))


def kibibytes(n: Column) -> Column:
    return F.floor((n + 512) / 1024).cast("long")


def leading_zero(value: Column) -> Column:
    return F.regexp_replace(value, r"(?<![0-9])\.(?=[0-9])", "0.")


def first_anchor(value: Column) -> Column:
    """The first ``#id`` in any text, or null."""
    return F.nullif(F.regexp_extract(value, r"#[A-Za-z0-9_.:-]+", 0), F.lit(""))


def is_ncname(name: Column) -> Column:
    return name.rlike(r"^[\p{L}_][\p{L}\p{N}\-._]*$")
