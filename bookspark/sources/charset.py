"""Text entries as UTF-8: valid ones never leave the JVM, the rest are decoded by their mark, their declaration, or as Windows text."""

import codecs
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookspark.functions import paths

#: Bytes of a file in which a declaration is looked for, a fixed value.
HEAD = 2048
#: Text by extension.
TEXT = ("xhtml", "html", "htm", "css", "opf", "ncx", "xml", "svg")
_DECLARED = r"""(?s)%s=(?:"([^"]*)"|'([^']*)'|([^"'; >]*))"""


def declared(data: Column) -> Column:
    """The encoding that the head of a file names, in its XML declaration or else as a character set; null without one."""
    head = F.decode(F.substring(data, 1, HEAD), "iso-8859-1")
    named = [F.concat(*[F.regexp_extract(head, _DECLARED % key, k) for k in (1, 2, 3)]) for key in ("encoding", "charset")]
    return F.coalesce(*[F.nullif(F.trim(n), F.lit("")) for n in named])


def redeclared(text: str) -> str:
    """A decoded text that now calls itself UTF-8."""
    return re.sub(r"""((?:encoding|charset)=)(?:(["'])[^"']*\2|[^"'; >]*)""", lambda m: f"{m[1]}{m[2] or ''}UTF-8{m[2] or ''}", text)


def decoded(data: bytes, label: str | None) -> tuple[str, str]:
    """(text, name of the encoding) of bytes that are no UTF-8."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace"), "utf-16"
    try:
        name = codecs.lookup(label).name if label else "cp1252"
    except LookupError:
        name = "cp1252"
    if name in ("iso8859-1", "ascii", "utf-8"):
        name = "cp1252"  # as browsers read these labels where the bytes do not fit them
    try:
        return data.decode(name), name
    except UnicodeDecodeError:
        return data.decode(name, "replace"), name


def _two(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for data, label in batches:
        rows = [(None, None) if d is None else decoded(bytes(d), e) for d, e in zip(data, label, strict=True)]
        yield pd.DataFrame([(redeclared(t) if t is not None else None, n) for t, n in rows], columns=["text", "encoding"])


def normalized(entries: DataFrame) -> DataFrame:
    """Entries with text as UTF-8 and ``encoding``, the name of what it was transcoded from (null where nothing was to do).

    UTF-16 is known by its mark; a mark of UTF-8 goes; what is valid UTF-8 stays
    as it is; else the declared encoding counts, else Windows-1252. Only what
    has to be transcoded meets Python, and only that is declared anew.
    """
    text = paths.extension(F.col("path")).isin(*TEXT)
    marked = F.hex(F.substring("data", 1, 2)).isin("FFFE", "FEFF")
    bare = F.when(F.hex(F.substring("data", 1, 3)) == "EFBBBF", F.substring("data", 4, 2**31 - 1)).otherwise(F.col("data"))
    valid = ~marked & F.is_valid_utf8(bare.cast("string"))
    e = entries.withColumn("_bare", bare).withColumn("_odd", text & F.col("data").isNotNull() & ~valid)
    udf = F.pandas_udf(_two, "text string, encoding string")
    e = e.withColumn("_t", F.when(F.col("_odd"), udf(F.when(F.col("_odd"), F.col("data")), F.when(F.col("_odd"), declared(F.col("data"))))))
    new = F.when(F.col("_odd"), F.encode("_t.text", "utf-8")).when(text, F.col("_bare")).otherwise(F.col("data"))
    return e.withColumn("data", new).withColumn("encoding", F.col("_t.encoding")).drop("_bare", "_odd", "_t")
