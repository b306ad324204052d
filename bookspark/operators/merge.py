"""Layered metadata and profiles: fill, replace, clear, compose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookspark.functions import text as tx

FIELDS = ("title", "language", "publisher", "date", "description", "rights")
UNTITLED = "Untitled"


def absent(name: str, value: Column) -> Column:
    """Blank counts as absent, and for a title the default does too."""
    blank = value.isNull() | (F.trim(value) == "")
    return blank | (value == UNTITLED) if name == "title" else blank


def merged(name: str, book: Column, doc: Column, mode: str) -> Column:
    """``fill`` gives only what the book lacks, ``replace`` whatever the document says; a null of the document says nothing."""
    says = F.when(F.trim(doc) != "", doc)
    return F.coalesce(says, book) if mode == "replace" else F.when(absent(name, book), F.coalesce(says, book)).otherwise(book)


def merge(books: DataFrame, docs: DataFrame, mode: str, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Books with the documents of the same key laid over; ``changed`` lists the fields that differ now."""
    d = docs.select("book_id", *[F.col(f).alias(f"doc_{f}") for f in fields])
    joined = books.join(d, "book_id", "left")
    new = {f: merged(f, F.col(f), F.col(f"doc_{f}"), mode) for f in fields}
    changed = F.array_compact(F.array(*[F.when(~new[f].eqNullSafe(F.col(f)), F.lit(f)) for f in fields]))
    return joined.withColumn("changed", changed).withColumns(new).drop(*[f"doc_{f}" for f in fields])


def clear(df: DataFrame, cleared: Column, fields: tuple[str, ...]) -> DataFrame:
    """Fields named in the array become null; after a merge."""
    return df.withColumns({f: F.when(F.array_contains(cleared, f), F.lit(None).cast("string")).otherwise(F.col(f)) for f in fields})


def missing_fields() -> Column:
    """The ordered list of what a metadata record lacks."""
    none = lambda c: F.col(c).isNull() | (F.col(c) == "")
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    tests = (("title", none("title") | (F.col("title") == UNTITLED)), ("authors", empty("authors")), ("description", F.col("description").isNull()), ("publisher", F.col("publisher").isNull()), ("subjects", empty("subjects")), ("date", F.col("date").isNull()), ("series", F.col("series").isNull()), ("isbn", empty("identifiers")))
    return F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests]))


def compose_layers(layers: DataFrame, key: str, order: str, leaves: tuple[str, ...]) -> DataFrame:
    """One row per key: of each leaf the last value that is not null, by ``order``."""
    return layers.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in leaves])


#: Fields that can be cleared after a merge.
CLEARABLE = ("description", "publisher", "date", "rights", "series", "subjects", "contributors")
_LISTS = ("authors", "contributors", "subjects")


def push_identifiers(identifier: Column, have: Column, more: Column) -> Column:
    """The secondary identifiers with those of ``more`` whose value is neither the unique one nor among them; first seen stays first."""
    fresh = lambda acc, x: ~F.exists(acc, lambda i: i["value"] == F.trim(x["value"])) & ~F.trim(x["value"]).eqNullSafe(identifier) & (F.trim(x["value"]) != "")
    none = F.array().cast("array<struct<value:string,scheme:string>>")
    out = F.aggregate(F.coalesce(more, none), F.coalesce(have, none), lambda acc, x: F.when(fresh(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return F.when(have.isNull() & (F.size(F.coalesce(more, none)) == 0), F.lit(None)).otherwise(out)


def apply_documents(books: DataFrame, docs: DataFrame, mode: str = "fill", cleared: Column | None = None) -> DataFrame:
    """Whole metadata records with the documents of the same book laid over.

    Scalars and lists are filled where the book is silent, or replaced; the
    series takes a name with its index, or an index alone for the series that
    is there; the unique identifier is filled, never replaced: another value
    becomes a secondary one and ``warning`` says so; identifiers and ISBNs are
    added beside. A document's null says nothing. ``changed`` lists the fields.
    """
    replace = mode == "replace"
    cols = [f.name for f in docs.schema if f.name not in ("book_id", "doc_id", "error")]
    j = books.join(docs.select("book_id", *[F.col(c).alias(f"doc_{c}") for c in cols]), "book_id", "left")
    d = lambda c: F.col(f"doc_{c}") if c in cols else F.lit(None).cast("string")
    new: dict[str, Column] = {f: merged(f, F.col(f), d(f), mode) for f in ("title", "language")}
    for f in ("description", "publisher", "date", "rights"):
        new[f] = F.coalesce(d(f), F.col(f)) if replace else F.coalesce(F.col(f), d(f))
    for f in _LISTS:
        if f in cols:
            empty = F.coalesce(F.size(f), F.lit(0)) <= 0
            new[f] = F.coalesce(d(f), F.col(f)) if replace else F.when(empty, F.coalesce(d(f), F.col(f))).otherwise(F.col(f))
    name, index = tx.blank_to_null(d("series")), d("series_index")
    takes = name.isNotNull() & (F.lit(replace) | F.col("series").isNull())
    alone = ~takes & index.isNotNull() & F.col("series").isNotNull() & (F.lit(replace) | F.col("series.index").isNull())
    new["series"] = F.when(takes, F.struct(name.alias("name"), index.alias("index"))).when(alone, F.struct(F.col("series.name").alias("name"), index.alias("index"))).otherwise(F.col("series"))
    wanted = F.nullif(F.trim(d("identifier")), F.lit(""))
    refused = wanted.isNotNull() & F.col("identifier").isNotNull() & (wanted != F.col("identifier"))
    new["identifier"] = F.coalesce("identifier", wanted)
    as_id = lambda v, scheme: F.when(v.isNotNull(), F.array(F.struct(v.alias("value"), F.lit(scheme).cast("string").alias("scheme"))))
    none = F.array().cast("array<struct<value:string,scheme:string>>")
    isbn = F.nullif(F.trim(d("isbn")), F.lit(""))
    more = F.concat(F.coalesce(as_id(F.when(refused, wanted), None), none), F.coalesce(d("identifiers"), none) if "identifiers" in cols else none, F.coalesce(as_id(isbn, "ISBN"), none))
    new["identifiers"] = push_identifiers(F.coalesce("identifier", wanted), F.col("identifiers"), more)
    if cleared is not None:
        new |= {f: F.when(F.array_contains(cleared, f), F.lit(None)).otherwise(new.get(f, F.col(f))) for f in CLEARABLE}
    changed = F.array_compact(F.array(*[F.when(~c.eqNullSafe(F.col(f)), F.lit(f)) for f, c in new.items()]))
    warning = F.when(refused, F.concat(F.lit("the unique identifier stays; kept as a secondary one: "), wanted))
    return j.withColumn("changed", changed).withColumn("warning", warning).withColumns(new).drop(*[f"doc_{c}" for c in cols])


def conflicts(cleared: Column, given: Column) -> Column:
    """Fields that are both to be cleared and to be set."""
    return F.array_intersect(cleared, given)


def staged(edits: DataFrame, doc: DataFrame, ticked: Column) -> DataFrame:
    """Staged edits (book_id and fields) with the ticked fields of a document that say something; the others stay as staged."""
    fields = [c for c in edits.columns if c != "book_id"]
    j = edits.join(doc.select("book_id", *[F.col(c).alias(f"doc_{c}") for c in fields if c in doc.columns]), "book_id", "left")
    said = {c: F.when(F.array_contains(ticked, c) & (F.trim(F.col(f"doc_{c}")) != ""), F.col(f"doc_{c}")).otherwise(F.col(c)) for c in fields if c in doc.columns}
    return j.withColumns(said).select("book_id", *fields)


def search_seed(title: Column | None, author: Column | None, book_title: Column, book_authors: Column) -> tuple[Column, Column]:
    """What to look a book up by: what was asked for, else its title unless it is the default, and its first author."""
    t, a = F.nullif(book_title, F.lit(UNTITLED)), F.try_element_at(book_authors, F.lit(1))["name"]
    return (t if title is None else F.coalesce(title, t)), (a if author is None else F.coalesce(author, a))
