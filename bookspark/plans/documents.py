"""Queries that parse documents, with SQL twins where the markup is plain enough."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookspark import engine
from bookspark.functions import text as tx
from bookspark.operators import packing, pages, palette, transforms
from bookspark.plans.relational import HISTOGRAM, histogram
from bookspark.session import table as t
from bookspark.sinks import package
from bookspark.sources import archive, html, markdown, profiles


def _page(s, d):
    return t(s, d, "chapters"), F.col("chapter_id"), F.col("body_html")


def element_counts(s, d):
    """Repeated rows give the same counts, which fall together before they are summed."""
    n = html.page_elements(*_page(s, d)).distinct()
    return n.groupBy("name").agg(F.sum("n").alias("n"), F.count("*").alias("n_docs"))


ELEMENTS = r"SELECT lower(name) AS name, count(*) AS n, count(DISTINCT chapter_id) AS n_docs FROM (SELECT chapter_id, unnest(regexp_extract_all(body_html, '<([A-Za-z][A-Za-z0-9]*)[\s/>]', 1)) AS name FROM (SELECT DISTINCT chapter_id, body_html FROM chapters)) GROUP BY 1"


def headings(s, d):
    h = html.page_texts(*_page(s, d), ("h1", "h2", "h3")).distinct()
    return h.groupBy("name").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


HEADINGS = rf"""
WITH pages AS (SELECT DISTINCT chapter_id, body_html FROM chapters),
h AS ({" UNION ALL ".join(f"SELECT 'h{k}' AS name, unnest(regexp_extract_all(body_html, '(?s)<h{k}(?: [^>]*)?>(.*?)</h{k}>', 1)) AS t FROM pages" for k in (1, 2, 3))})
SELECT name, count(*) AS n, sum(length(replace(replace(replace(replace(regexp_replace(regexp_replace(t, '<[^>]*>', '', 'g'), '&(#[0-9]+|#x[0-9a-fA-F]+|nbsp|ensp|emsp|thinsp|shy|zwnj|zwj|quot|apos|mdash|ndash|hellip|lsquo|rsquo|ldquo|rdquo);', '.', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"')))::BIGINT AS n_chars FROM h GROUP BY name
"""


def tables(s, d):
    return html.linearize(html.page_cells(*_page(s, d)).distinct())


def id_moves(s, d):
    return html.page_id_moves(*_page(s, d)).distinct()


def parts(s, d):
    """Chapters above 16 KiB divided at their blocks: parts, the longest, and whether a part is above the limit because its only block is."""
    c = t(s, d, "chapters").where(F.octet_length("body_html") > 8 * 1024).select("book_id", F.col("chapter_id").cast("string").alias("path"), F.col("body_html").alias("html"))
    p = pages.split_pages(c, 16 * 1024)
    small = p.select("book_id", "path", "part", "n_parts", "n_bytes", F.size("ids").alias("n_ids"), "note").distinct()
    return small.groupBy("book_id", "path").agg(F.max("n_parts").alias("n_parts"), F.max("n_bytes").alias("longest"), F.sum("n_ids").alias("n_ids"), F.max(F.col("note").isNotNull()).alias("noted"))


def whole_books(s, d):
    """Every book of the metadata written with its chapters, then read again: what of it comes back."""
    books = t(s, d, "metadata").where("book_id is not null").groupBy("book_id").agg(*[F.min_by(c, F.struct("ingested_at", "read_at")).alias(c) for c in ("title", "language", "identifier", "authors", "contributors", "identifiers", "subjects", "description", "publisher", "date", "rights", "series")])
    books = books.withColumns({c: tx.strip_controls(F.col(c)) for c in ("title", "language", "description", "publisher", "date", "rights")})
    c = t(s, d, "chapters").where("path is not null and book_id is not null").select("book_id", "ord", "chapter_id", "path", "title", F.col("body_html").alias("html"))
    c = c.groupBy("book_id", "path").agg(F.min_by(F.struct("ord", "chapter_id", "title"), F.struct("ord", "chapter_id")).alias("x")).select("book_id", "path", F.col("x.ord").alias("ord"), "x.title")
    files = c.select("book_id", "ord", "path", F.lit("application/xhtml+xml").alias("media_type"), F.encode(F.concat("book_id", F.lit(" "), "path"), "utf-8").alias("data"))
    toc = c.select("book_id", "ord", F.col("title").alias("title"), "path", F.lit(None).cast("string").alias("fragment"), F.lit(1).alias("level"))
    shell = books.select("book_id", F.lit("package.opf").alias("opf_path"), F.lit(None).cast("string").alias("nav_path"), F.lit(None).cast("string").alias("ncx_path"), F.lit(None).cast("string").alias("cover"))
    made = package.documents(books, files, c, toc, shell, "pocket 1.0", "x4", F.lit("2026-01-01 00:00:00").cast("timestamp"))
    b = engine.books_of(archive.entries(package.write_books(files.join(books.select("book_id"), "book_id", "left_semi"), made)))
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).alias(f"n_{c}")
    got = b.metadata.select("book_id", "title", F.col("series.name").alias("series"), size("authors"), size("subjects"))
    return got.join(b.spine.groupBy("book_id").agg(F.count("*").alias("n_spine")), "book_id", "left").join(b.toc.groupBy("book_id").agg(F.count("*").alias("n_toc")), "book_id", "left").na.fill(0, ["n_spine", "n_toc"])


_WS = r"trim(regexp_replace(regexp_replace({0}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x{{FEFF}}]', '', 'g'), '[\s\p{{Z}}\x0B]+', ' ', 'g'))"
WHOLE = rf"""
WITH m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY ingested_at, read_at) AS rn FROM metadata WHERE book_id IS NOT NULL) WHERE rn = 1),
c AS (SELECT book_id, count(DISTINCT path) AS n FROM chapters WHERE path IS NOT NULL GROUP BY book_id)
SELECT m.book_id, coalesce(nullif({_WS.format("title")}, ''), 'Untitled') AS title, nullif({_WS.format("series.name")}, '') AS series, len(list_filter(coalesce(authors, []), lambda a: trim(coalesce(a.name, '')) <> ''))::INT AS n_authors, len(list_filter(coalesce(subjects, []), lambda x: trim(coalesce(x, '')) <> ''))::INT AS n_subjects,
  coalesce(c.n, 0) AS n_spine, greatest(coalesce(c.n, 0), 1) AS n_toc
FROM m LEFT JOIN c USING (book_id)
"""


def markdown_blocks(s, d):
    b = markdown.blocks(t(s, d, "works").select("ref", "description").distinct(), F.col("ref"), F.col("description"))
    return markdown.chunks(b).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("doc", "chunk").alias("n_chunks"))


def written(s, d):
    """An archive per book of its chapters, read back: entries and bytes agree."""
    c = t(s, d, "chapters").select("book_id", "ord", "path", "body_html").where("path is not null").distinct()
    first = c.groupBy("book_id", "path").agg(F.min_by("body_html", F.struct("ord", "body_html")).alias("body_html"), F.min("ord").alias("ord"))
    books = archive.write_archives(first.select("book_id", "ord", "path", F.encode("body_html", "utf-8").alias("data")))
    e = archive.entries(books).where("path <> 'mimetype'")
    return e.groupBy("book_id").agg(F.count("*").alias("n_entries"), F.sum("size").alias("n_bytes"))


WRITTEN = "SELECT book_id, count(*) AS n_entries, sum(strlen(body_html))::BIGINT AS n_bytes FROM (SELECT *, row_number() OVER (PARTITION BY book_id, path ORDER BY ord, body_html) AS rn FROM chapters WHERE path IS NOT NULL AND book_id IS NOT NULL) WHERE rn = 1 GROUP BY book_id"


def isotonic(s, d):
    """Tones of a label in order, pooled to a rising series with a gap of one; a label has at most 256 tones."""
    def solve(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(label, float(x["n"]), round(y, 4), x["tone"]) for label, xs in pdf.itertuples(index=False) for x, y in zip(xs, packing.isotonic([float(x["n"]) for x in xs], [1.0] * len(xs), 1.0), strict=True)]
            yield pd.DataFrame(rows, columns=["label", "n", "pooled", "tone"])

    g = histogram(s, d).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("tone", "n"))).alias("xs"))
    return g.mapInPandas(solve, "label int, n double, pooled double, tone int")


# the pooled value of a place is the greatest, over all starts before it, of the least mean over all ends behind it
ISOTONIC = f"""
WITH x AS (SELECT label, tone, n::DOUBLE AS n, row_number() OVER w - 1 AS i, n - (row_number() OVER w - 1)::DOUBLE AS y FROM ({HISTOGRAM}) WINDOW w AS (PARTITION BY label ORDER BY tone)),
c AS (SELECT *, sum(y) OVER (PARTITION BY label ORDER BY i) AS upto FROM x),
m AS (SELECT a.label, a.i AS lo, b.i AS hi, (b.upto - a.upto + a.y) / (b.i - a.i + 1) AS mean FROM c a JOIN c b ON a.label = b.label AND b.i >= a.i),
low AS (SELECT m.label, c.i, m.lo, min(mean) AS v FROM c JOIN m ON c.label = m.label AND m.lo <= c.i AND m.hi >= c.i GROUP BY ALL)
SELECT c.label, c.n, round(max(v) + c.i, 4) AS pooled, c.tone FROM c JOIN low ON c.label = low.label AND c.i = low.i GROUP BY c.label, c.n, c.tone, c.i
"""


def panels(s, d):
    """How many built-in profiles have each panel, and their mean chapter limit."""
    return profiles.builtin(s).groupBy("panel").agg(F.count("*").alias("n"), F.max("chapter_kb").alias("most_kb"))


def fitted(s, d):
    """Every chapter rewritten for a small reader: how often each step applied."""
    done = transforms.transform(*_page(s, d)).select("doc", "steps").distinct()
    return transforms.step_counts(done)


FITTED = r"""
WITH p AS (SELECT DISTINCT chapter_id, body_html AS h FROM chapters), k AS (
  SELECT 'boxes' AS kind, len(regexp_extract_all(h, '<(aside|figure|dl)[ >]')) AS n FROM p UNION ALL SELECT 'lists', len(regexp_extract_all(h, '<ol[ >]')) FROM p
  UNION ALL SELECT 'code', len(regexp_extract_all(h, '<pre[ >]')) FROM p UNION ALL SELECT 'links', len(regexp_extract_all(h, '<a [^>]*href="\s*[jJ]ava')) FROM p)
SELECT kind, sum(n)::BIGINT AS n, count(*) AS n_pages FROM k WHERE n > 0 GROUP BY kind
"""


def palette_of_parts(s, d):
    """Colours that parts stand for, per size, on a panel of sixteen grays."""
    p = t(s, d, "part").select(F.col("p_size").cast("string").alias("scope"), *[(F.col("p_partkey") * k % 16 * 17).cast("int").alias(c) for k, c in ((3, "r"), (7, "g"), (11, "b"))], F.when(F.col("p_partkey") % 3 == 0, "text").when(F.col("p_partkey") % 3 == 1, "ground").otherwise("border").alias("role"))
    return palette.palettes(p.groupBy("scope", "r", "g", "b", "role").agg(F.count("*").alias("weight")), 16)



QUERIES = {
    "xfm_fitted": (fitted, FITTED),
    "src_elements": (element_counts, ELEMENTS),
    "src_headings": (headings, HEADINGS),
    "xfm_tables": (tables, None),
    "xfm_id_moves": (id_moves, None),
    "src_markdown": (markdown_blocks, None),
    "xfm_parts": (parts, None),
    "snk_books": (whole_books, WHOLE),
    "img_palettes": (palette_of_parts, None),
    "snk_archives": (written, WRITTEN),
    "win_isotonic": (isotonic, ISOTONIC),
    "mrg_panels": (panels, None),
}
