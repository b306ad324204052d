"""Metadata merges and layered profiles over the test tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookspark.operators import merge
from bookspark.session import table as t

_BOOKS = "(SELECT DISTINCT book_id, title, language, identifier, authors, identifiers, subjects, description, publisher, date, series FROM metadata)"


def _books(s, d, *columns):
    """Distinct rows of the columns that a query needs: nothing wider is compared or shuffled."""
    return t(s, d, "metadata").select("book_id", *columns).distinct()


def _docs(s, d):
    """A document for every second book: the profile's words as publisher, its runs' last day as date."""
    v = t(s, d, "convert_stats").where("book_id is not null").groupBy("book_id").agg(F.max("profile").alias("publisher"), F.date_format(F.max("finished_at"), "yyyy-MM-dd").alias("date"))
    return v.select("book_id", F.lit(None).cast("string").alias("title"), F.when(F.length("book_id") % 2 == 0, "en").otherwise(F.lit(" ")).alias("language"), "publisher", "date")


_DOCS = "(SELECT book_id, CASE WHEN length(book_id) % 2 = 0 THEN 'en' ELSE ' ' END AS language, max(profile) AS publisher, strftime(max(finished_at), '%Y-%m-%d') AS date FROM convert_stats WHERE book_id IS NOT NULL GROUP BY book_id)"
_FIELDS = ("language", "publisher", "date")


def _merge(mode):
    def run(s, d):
        return merge.merge(_books(s, d, "title", *_FIELDS), _docs(s, d), mode, _FIELDS).withColumn("changed", F.array_join("changed", ","))

    return run


def _merge_sql(mode):
    says = {f: f"(CASE WHEN trim(d.{f}) <> '' THEN d.{f} END)" for f in _FIELDS}
    new = {f: f"coalesce({says[f]}, b.{f})" if mode == "replace" else f"(CASE WHEN b.{f} IS NULL OR trim(b.{f}) = '' THEN coalesce({says[f]}, b.{f}) ELSE b.{f} END)" for f in _FIELDS}
    changed = " , ".join(f"CASE WHEN {new[f]} IS DISTINCT FROM b.{f} THEN '{f}' END" for f in _FIELDS)
    return f"SELECT b.book_id, b.title, {', '.join(f'{e} AS {f}' for f, e in new.items())}, concat_ws(',', {changed}) AS changed FROM (SELECT DISTINCT book_id, title, language, publisher, date FROM metadata) b LEFT JOIN {_DOCS} d ON b.book_id = d.book_id"


def missing(s, d):
    return t(s, d, "metadata").select("book_id", F.array_join(merge.missing_fields(), ",").alias("missing")).distinct()


MISSING = f"""
SELECT DISTINCT book_id, concat_ws(',', CASE WHEN title IS NULL OR title = '' OR title = 'Untitled' THEN 'title' END, CASE WHEN coalesce(len(authors), 0) = 0 THEN 'authors' END, CASE WHEN description IS NULL THEN 'description' END,
  CASE WHEN publisher IS NULL THEN 'publisher' END, CASE WHEN coalesce(len(subjects), 0) = 0 THEN 'subjects' END, CASE WHEN date IS NULL THEN 'date' END, CASE WHEN series IS NULL THEN 'series' END, CASE WHEN coalesce(len(identifiers), 0) = 0 THEN 'isbn' END) AS missing FROM {_BOOKS}
"""


def missing_counts(s, d):
    m = t(s, d, "metadata").select("book_id", F.explode(merge.missing_fields()).alias("field")).distinct()
    return m.groupBy("field").agg(F.count("*").alias("n_books"))


MISSING_COUNTS = f"SELECT field, count(*) AS n_books FROM (SELECT DISTINCT book_id, unnest(string_split(missing, ',')) AS field FROM ({MISSING})) WHERE field <> '' GROUP BY field"


def identifiers(s, d):
    """Secondary identifiers: those of a book without repeats or the unique one, then the ISBNs of its record; first seen stays first."""
    own = t(s, d, "metadata").select("book_id", "identifier", F.transform(F.coalesce("identifiers", F.array().cast("array<struct<value:string,scheme:string>>")), lambda i: i["value"]).alias("ids")).distinct()
    kept = F.filter(F.array_distinct(F.filter("ids", lambda v: v.isNotNull())), lambda v: ~v.eqNullSafe(F.col("identifier")))
    return own.select("book_id", "identifier", F.array_join(kept, "|").alias("others"), F.exists("ids", lambda v: v.rlike("(?i)isbn|^97[89]")).alias("has_isbn"))


IDENTIFIERS = f"""
SELECT DISTINCT book_id, identifier, array_to_string(list_filter(list_distinct_in_order, lambda v: v IS DISTINCT FROM identifier), '|') AS others, coalesce(list_bool_or(list_transform(ids, lambda v: regexp_matches(v, '(?i)isbn|^97[89]'))), false) AS has_isbn
FROM (SELECT *, list_filter(ids, lambda v, i: v IS NOT NULL AND list_position(ids, v) = i) AS list_distinct_in_order FROM (SELECT DISTINCT book_id, identifier, list_transform(coalesce(identifiers, []), lambda i: i.value) AS ids FROM {_BOOKS}))
"""


def clears(s, d):
    b = _books(s, d, "publisher", "date", F.length("description").alias("description"))
    cleared = F.when(F.length("book_id") % 2 == 0, F.array(F.lit("publisher"), F.lit("date"))).otherwise(F.array(F.lit("date")))
    return merge.clear(b.withColumn("cleared", cleared), F.col("cleared"), ("publisher", "date")).drop("cleared")


CLEARS = "SELECT book_id, CASE WHEN length(book_id) % 2 <> 0 THEN publisher END AS publisher, NULL::VARCHAR AS date, description FROM (SELECT DISTINCT book_id, publisher, date, length(description) AS description FROM metadata)"


def compose(s, d):
    """Profile layers: the profile of the table, then what each run of a book says, the last word winning per leaf."""
    base = t(s, d, "profiles").select("name", F.lit(0).alias("ord"), "max_chapter_kb", "overlap_bytes", "appendix")
    runs = t(s, d, "convert_stats").where("profile is not null and chapters_split > 0").groupBy(F.col("profile").alias("name")).agg(F.max("chapters").alias("max_chapter_kb"))
    layers = base.unionByName(runs.select("name", F.lit(1).alias("ord"), "max_chapter_kb", F.lit(None).cast("int").alias("overlap_bytes"), F.lit(None).cast("string").alias("appendix")))
    return merge.compose_layers(layers, "name", "ord", ("max_chapter_kb", "overlap_bytes", "appendix"))


COMPOSE = "SELECT p.name, coalesce(r.k, p.max_chapter_kb) AS max_chapter_kb, p.overlap_bytes, p.appendix FROM profiles p LEFT JOIN (SELECT profile AS name, max(chapters) AS k FROM convert_stats WHERE profile IS NOT NULL AND chapters_split > 0 GROUP BY 1) r USING (name)"


def flags(s, d):
    """Flag over document over book, and where a field is both cleared and set."""
    b = _books(s, d, "publisher")
    j = b.join(_docs(s, d).select("book_id", F.col("publisher").alias("doc")), "book_id", "left")
    flag = F.when(F.length("book_id") % 3 == 0, F.lit("Own House"))
    cleared, set_ = F.array(F.lit("publisher")), F.when(flag.isNotNull(), F.array(F.lit("publisher"), F.lit("title"))).otherwise(F.array(F.lit("title")))
    return j.select("book_id", F.coalesce(flag, "doc", "publisher").alias("publisher"), (F.size(merge.conflicts(cleared, set_)) > 0).alias("conflict"))


FLAGS = f"SELECT book_id, coalesce(CASE WHEN length(book_id) % 3 = 0 THEN 'Own House' END, d.publisher, b.publisher) AS publisher, length(book_id) % 3 = 0 AS conflict FROM (SELECT DISTINCT book_id, publisher FROM metadata) b LEFT JOIN {_DOCS} d USING (book_id)"


def seeds(s, d):
    """What to search a catalogue for: the title unless it is the default, and the first author."""
    title, author = merge.search_seed(None, None, F.col("title"), F.col("authors"))
    return t(s, d, "metadata").select("book_id", title.alias("title"), author.alias("author")).distinct()


def documents(s, d):
    """Whole records with documents laid over that give a series, subjects, an identifier that is refused and an ISBN."""
    m = t(s, d, "metadata").select("book_id", "title", "language", "identifier", "authors", "contributors", "identifiers", "subjects", "description", "publisher", "date", "rights", "series").where("book_id is not null")
    docs = t(s, d, "metadata").where("book_id is not null").select("book_id").distinct().select("book_id", F.lit("Shelf").alias("series"), F.lit("1").alias("series_index"), F.array(F.lit("found")).alias("subjects"), F.concat(F.lit("urn:"), "book_id").alias("identifier"), F.concat(F.lit("isbn-"), "book_id").alias("isbn"))
    r = merge.apply_documents(m, docs, "fill")
    return r.select("book_id", F.col("series.name").alias("series"), F.size("subjects").alias("n_subjects"), F.size("identifiers").alias("n_identifiers"), F.col("warning").isNotNull().alias("refused"), F.array_contains("changed", "identifier").alias("took")).distinct()


DOCUMENTS = """
SELECT DISTINCT book_id, CASE WHEN series IS NULL THEN 'Shelf' ELSE series.name END AS series, CASE WHEN coalesce(len(subjects), 0) = 0 THEN 1 ELSE len(subjects) END::INT AS n_subjects,
  (coalesce(len(identifiers), 0) + (identifier IS NOT NULL AND identifier <> 'urn:' || book_id AND NOT list_contains(list_transform(coalesce(identifiers, []), lambda i: i.value), 'urn:' || book_id))::INT + (NOT list_contains(list_transform(coalesce(identifiers, []), lambda i: i.value), 'isbn-' || book_id))::INT)::INT AS n_identifiers,
  identifier IS NOT NULL AND identifier <> 'urn:' || book_id AS refused, identifier IS NULL AS took
FROM metadata WHERE book_id IS NOT NULL
"""




SEEDS = f"SELECT DISTINCT book_id, nullif(title, 'Untitled') AS title, authors[1].name AS author FROM {_BOOKS}"

QUERIES = {
    "mrg_fill": (_merge("fill"), _merge_sql("fill")),
    "mrg_replace": (_merge("replace"), _merge_sql("replace")),
    "agg_missing_fields": (missing, MISSING),
    "agg_missing_counts": (missing_counts, MISSING_COUNTS),
    "mrg_identifiers": (identifiers, IDENTIFIERS),
    "mrg_clears": (clears, CLEARS),
    "mrg_compose": (compose, COMPOSE),
    "mrg_flags": (flags, FLAGS),
    "mrg_documents": (documents, DOCUMENTS),
    "mrg_seeds": (seeds, SEEDS),
}
