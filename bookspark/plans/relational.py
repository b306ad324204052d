"""Filters, joins, aggregates, windows, sorts and set operations over the test tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookspark.functions import color, paths
from bookspark.functions import text as tx
from bookspark.operators import filters, lint, naming, packing, pages, relations
from bookspark.session import table as t
from bookspark.sources import css

RULES = [filters.Rule("replace", "harbour", "haven"), filters.Rule("remove", " slowly"), filters.Rule("replace", "haven", "port", frozenset({"text", "href"}))]


def replace_rule(s, d):
    r = filters.rule_hits(t(s, d, "documents").select("doc_id", "text"), "text", RULES)
    return r.select("doc_id", "hits_0", "hits_1", "hits_2", F.length("new_text").alias("n_chars"), F.md5("new_text").alias("digest"))


_N = "((length({0}) - length(replace({0}, '{1}', ''))) // {2})::INT"
REPLACE_RULE = f"""
SELECT doc_id, {_N.format('text', 'harbour', 7)} AS hits_0, {_N.format('a', ' slowly', 7)} AS hits_1, {_N.format('b', 'haven', 5)} AS hits_2, length(replace(b, 'haven', 'port')) AS n_chars, md5(replace(b, 'haven', 'port')) AS digest
FROM (SELECT doc_id, text, replace(text, 'harbour', 'haven') AS a, replace(replace(text, 'harbour', 'haven'), ' slowly', '') AS b FROM documents)
"""


def metadata_rules(s, d):
    m = t(s, d, "metadata").select("book_id", "read_at", "title", "description", "publisher", "subjects")
    r = filters.metadata_rules(m, [filters.Rule("remove", "The "), filters.Rule("replace", "Press", "House")])
    return r.select("book_id", "read_at", "title", F.md5("description").alias("description"), "publisher", F.array_join("subjects", "|").alias("subjects"))


METADATA_RULES = r"""
SELECT book_id, read_at, CASE WHEN trim(x(title)) = '' THEN title ELSE x(title) END AS title, md5(nullif(w(x(description)), '')) AS description, nullif(w(x(publisher)), '') AS publisher,
  array_to_string(list_filter(list_transform(subjects, lambda v: replace(replace(v, 'The ', ''), 'Press', 'House')), lambda v: trim(v) <> ''), '|') AS subjects FROM metadata
"""
METADATA_RULES = METADATA_RULES.replace("x(title)", "replace(replace(title, 'The ', ''), 'Press', 'House')").replace("w(x(description))", r"trim(regexp_replace(replace(replace(description, 'The ', ''), 'Press', 'House'), '[\s\p{Z}\x0B]+', ' ', 'g'))").replace("w(x(publisher))", r"trim(regexp_replace(replace(replace(publisher, 'The ', ''), 'Press', 'House'), '[\s\p{Z}\x0B]+', ' ', 'g'))")


PAGE_RULES = [filters.Rule("replace", "harbour", "haven"), filters.Rule("remove", " slowly"), filters.Rule("remove", "#n1", targets=frozenset({"href"}))]


def rules_pages(s, d):
    """Content rules on the text and links of every page: how often each applied."""
    c = t(s, d, "chapters").select("chapter_id", "body_html", F.xxhash64("body_html").alias("h"))
    r = pages.rule_pages(c, F.col("chapter_id"), F.col("body_html"), PAGE_RULES)
    return r.groupBy(F.col("doc").cast("long").alias("chapter_id")).agg(F.max("replaced").alias("replaced"), F.max("removed").alias("removed"), F.max("links").alias("links"))


_COUNT = "coalesce(list_sum(list_transform(regexp_extract_all('>' || body_html || '<', '>([^<]*)', 1), lambda x: (length(x) - length(replace(x, '{0}', ''))) // {1})), 0)::INT"
RULES_PAGES = f"""SELECT chapter_id, {_COUNT.format('harbour', 7)} AS replaced, {_COUNT.format(' slowly', 7)} AS removed, len(regexp_extract_all(body_html, '<a [^>]*href="[^"]*#n1[^"]*"'))::INT AS links FROM (SELECT DISTINCT chapter_id, coalesce(body_html, '') AS body_html FROM chapters)"""


def drop_resources(s, d):
    files = t(s, d, "warnings").where("file is not null and book_id is not null").select("book_id", F.col("file").alias("path")).distinct()
    kept = t(s, d, "chapters").select("book_id", "path").distinct()
    return filters.drop_resources(files, kept, [filters.Rule("remove", "styles/", targets=frozenset({"file"})), filters.Rule("remove", ".html", targets=frozenset({"file"}))])


DROP = "SELECT DISTINCT w.book_id, w.file AS path FROM warnings w WHERE w.file IS NOT NULL AND w.book_id IS NOT NULL AND (contains(file, 'styles/') OR contains(file, '.html')) AND NOT EXISTS (SELECT 1 FROM chapters c WHERE c.book_id = w.book_id AND c.path = w.file)"


def css_subset(s, d):
    """Class selectors that the chapters' tags use, and a property of each chapter's block sizes, against the style subset."""
    cls = t(s, d, "chapters").select("profile", F.explode(F.regexp_extract_all("body_html", F.lit(r"<(\w+) class=\"([^\"]*)\""), F.lit(0))).alias("m"))
    sel = cls.select("profile", F.concat(F.regexp_extract("m", r"<(\w+)", 1), F.lit("."), F.regexp_replace(F.regexp_extract("m", r'"([^"]*)"', 1), r"\s+", "."), F.when(F.col("profile").isNull(), ":first").otherwise("")).alias("selector"))
    value = F.concat(F.when(F.length(F.coalesce("profile", F.lit(""))) % 2 == 0, F.lit("calc(")).otherwise(F.lit("")), F.coalesce("profile", F.lit("0")))
    name = F.when(F.length(F.coalesce("profile", F.lit(""))) % 3 == 0, "margin").when(F.length(F.coalesce("profile", F.lit(""))) % 3 == 1, "display").otherwise("vertical-align")
    g = sel.groupBy("selector", "profile").agg(F.count("*").alias("n"))
    return g.select("selector", "profile", "n", filters.selector_supported(F.col("selector")).alias("supported"), filters.uses_modern_function(value).alias("modern"), filters.property_supported(name, value).alias("kept"))


CSS_SUBSET = r"""
SELECT selector, profile, count(*) AS n, regexp_matches(selector, '^([A-Za-z0-9_-]+)?(\.[A-Za-z0-9_-]+)?$') AS supported, length(coalesce(profile, '')) % 2 = 0 AS modern, length(coalesce(profile, '')) % 3 = 0 AND length(coalesce(profile, '')) % 2 = 1 AS kept
FROM (SELECT profile, regexp_extract(m, '<(\w+)', 1) || '.' || regexp_replace(regexp_extract(m, '"([^"]*)"', 1), '\s+', '.', 'g') || CASE WHEN profile IS NULL THEN ':first' ELSE '' END AS selector FROM (SELECT profile, unnest(regexp_extract_all(body_html, '<(\w+) class="([^"]*)"', 0)) AS m FROM chapters))
GROUP BY selector, profile
"""


def numeric_share(s, d):
    """Share of numbers among the body cells of each chapter's tables, and how many tables it has."""
    f = relations.table_facts(relations.tables_of(t(s, d, "chapters"), "chapter_id", "body_html"))
    return f.groupBy("chapter_id").agg(F.round(F.avg("numeric"), 4).alias("share"), F.count("*").alias("n_tables"))


_TABLES = r"""
(SELECT *, CASE WHEN headed THEN rows[2:] ELSE rows END AS body FROM (SELECT *, coalesce(NOT contains(rows[1], '<td') AND contains(rows[1], '<th'), false) AS headed FROM (
  SELECT chapter_id, generate_subscripts(ts, 1)::INT - 1 AS table_id, unnest(ts) AS html, regexp_extract_all(unnest(ts), '(?s)<tr>(.*?)</tr>', 1) AS rows FROM (SELECT chapter_id, regexp_extract_all(body_html, '(?s)<table>.*?</table>', 0) AS ts FROM (SELECT DISTINCT chapter_id, body_html FROM chapters)))))
"""
_CELLS = "list_filter(list_transform(regexp_extract_all(array_to_string(body, chr(10)), '(?s)<t[dh]>(.*?)</t[dh]>', 1), lambda c: trim(regexp_replace(c, '<[^>]*>', '', 'g'))), lambda c: c <> '')"
_NUMERIC = rf"(CASE WHEN len({_CELLS}) > 0 THEN len(list_filter({_CELLS}, lambda c: regexp_matches(regexp_replace(c, '[$€£%,()+\-.\s]', '', 'g'), '^[0-9]+$'))) / len({_CELLS}) ELSE 0.0 END)"
NUMERIC = f"SELECT chapter_id, round(avg({_NUMERIC}), 4) AS share, count(*) AS n_tables FROM {_TABLES} GROUP BY chapter_id"


def table_grid(s, d):
    """Per table its rows, body rows and widest row, and whether it becomes a picture or stays text."""
    f = relations.table_facts(relations.tables_of(t(s, d, "chapters"), "chapter_id", "body_html"))
    return f.select("chapter_id", "table_id", "n_rows", "n_body", "n_columns", (F.col("holds_links") | F.col("holds_ids") | F.col("holds_images")).alias("holds_links"), relations.table_fate("image").alias("fate"))


_HOLDS = r"regexp_matches(html, '<img|<svg|<image|<a [^>]*href=|\sid=.[^ ]')"
_COLUMNS = "list_max(list_transform(rows, lambda r: len(regexp_extract_all(r, '<t[dh]>'))))"
GRID = f"""
SELECT chapter_id, table_id, len(rows)::INT AS n_rows, len(body)::INT AS n_body, {_COLUMNS}::INT AS n_columns, {_HOLDS} AS holds_links,
  CASE WHEN {_HOLDS} OR len(body) > 24 THEN 'text' WHEN {_COLUMNS} >= 3 OR {_NUMERIC} > 0.5 THEN 'image' ELSE 'text' END AS fate
FROM {_TABLES}
"""


def manifest_sync(s, d):
    entries = t(s, d, "chapters").select("book_id", "path").distinct()
    manifest = t(s, d, "warnings").where("file is not null").select("book_id", F.col("file").alias("path")).distinct()
    return lint.manifest_sync(entries, manifest)


MANIFEST = """
SELECT book_id, 'error' AS severity, 'manifest-sync' AS code, 'the archive lacks ' || path AS message, path FROM (SELECT DISTINCT book_id, file AS path FROM warnings WHERE file IS NOT NULL) m WHERE NOT EXISTS (SELECT 1 FROM chapters c WHERE c.book_id = m.book_id AND c.path = m.path)
UNION ALL SELECT book_id, 'error', 'manifest-sync', 'the manifest lacks ' || path, path FROM (SELECT DISTINCT book_id, path FROM chapters WHERE path <> 'mimetype' AND NOT starts_with(path, 'META-INF/')) c WHERE NOT EXISTS (SELECT 1 FROM warnings w WHERE w.book_id = c.book_id AND w.file = c.path)
"""


def spine(s, d):
    c = t(s, d, "chapters").select("book_id", "ord", F.coalesce("profile", F.lit("none")).alias("idref"), (F.col("chapter_id") % 4 != 0).alias("linear")).distinct()
    named = t(s, d, "chapters").where("profile is not null").select("book_id", F.col("profile").alias("id")).distinct()
    items = named.join(t(s, d, "profiles").select(F.col("name").alias("id"), F.concat(F.lit("p/"), "name").alias("path")), "id")
    return lint.readable_spine(c, items.join(t(s, d, "metadata").select("book_id"), "book_id", "left_semi"))


SPINE = """
WITH c AS (SELECT DISTINCT book_id, ord, coalesce(profile, 'none') AS idref, chapter_id % 4 <> 0 AS linear FROM chapters),
k AS (SELECT c.*, 'p/' || p.name AS path FROM c JOIN (SELECT DISTINCT book_id FROM metadata) m USING (book_id) JOIN profiles p ON c.idref = p.name)
SELECT book_id, ord, idref, path FROM (SELECT *, bool_or(linear) OVER (PARTITION BY book_id) AS any_linear FROM k) WHERE linear OR NOT any_linear
"""


def toc(s, d):
    toc_rows = t(s, d, "warnings").where("file is not null").select("book_id", F.col("file").alias("path"), F.when(F.col("warning_id") % 2 == 0, F.concat(F.lit("c"), (F.col("warning_id") % 9).cast("string"))).alias("fragment")).distinct()
    chapters = t(s, d, "chapters")
    ids = chapters.select("book_id", "path", F.explode(F.regexp_extract_all("body_html", F.lit(r'\sid="([^"]*)"'), F.lit(1))).alias("id"))
    return lint.toc_targets(toc_rows, chapters.select("book_id", "path").distinct(), ids.distinct())


TOC = r"""
WITH x AS (SELECT DISTINCT book_id, file AS path, CASE WHEN warning_id % 2 = 0 THEN 'c' || warning_id % 9 END AS fragment FROM warnings WHERE file IS NOT NULL),
ids AS (SELECT DISTINCT book_id, path, unnest(regexp_extract_all(body_html, '\sid="([^"]*)"', 1)) AS id FROM chapters)
SELECT book_id, 'error' AS severity, 'spine-toc-sync' AS code, 'no spine document ' || path AS message, path FROM x WHERE NOT EXISTS (SELECT 1 FROM chapters c WHERE c.book_id = x.book_id AND c.path = x.path)
UNION ALL SELECT book_id, 'warning', 'spine-toc-sync', 'no anchor ' || fragment, path FROM x WHERE fragment IS NOT NULL AND EXISTS (SELECT 1 FROM chapters c WHERE c.book_id = x.book_id AND c.path = x.path) AND NOT EXISTS (SELECT 1 FROM ids i WHERE i.book_id = x.book_id AND i.path = x.path AND i.id = x.fragment)
"""


def duplicate_ids(s, d):
    ids = t(s, d, "chapters").select("book_id", "path", F.explode(F.regexp_extract_all("body_html", F.lit(r'\sid="([^"]*)"'), F.lit(1))).alias("id"))
    return lint.duplicate_ids(ids)


DUPLICATES = r"SELECT book_id, 'error' AS severity, 'duplicate-id' AS code, id || ' stands on ' || count(*) || ' elements' AS message, path FROM (SELECT book_id, path, unnest(regexp_extract_all(body_html, '\sid=\"([^\"]*)\"', 1)) AS id FROM chapters) GROUP BY book_id, path, id HAVING count(*) > 1"


def font_findings(s, d):
    m = t(s, d, "warnings").where("file is not null").select("book_id", F.concat(F.regexp_replace("file", r"\.\w+$", ""), F.element_at(F.array(*[F.lit(x) for x in (".ttf", ".css", ".WOFF2")]), (F.col("warning_id") % 3 + 1).cast("int"))).alias("path"), F.lit(None).cast("string").alias("media_type"))
    return lint.fonts(m)


FONTS = r"SELECT book_id, 'warning' AS severity, 'fonts' AS code, 'embedded font' AS message, path FROM (SELECT book_id, regexp_replace(file, '\.\w+$', '') || ['.ttf', '.css', '.WOFF2'][warning_id % 3 + 1] AS path FROM warnings WHERE file IS NOT NULL) WHERE regexp_matches(lower(path), '\.(ttf|otf|woff|woff2|eot)$')"


def zip64(s, d):
    e = t(s, d, "convert_stats").where("bytes_in is not null").select("book_id", (F.col("bytes_in") * 2000).alias("size"), F.coalesce("bytes_out", F.lit(0)).alias("csize"), F.lit(0).cast("long").alias("offset"))
    return lint.zip64(e)


ZIP64 = "SELECT book_id, 'error' AS severity, 'zip64' AS code, 'needs ZIP64' AS message, NULL::VARCHAR AS path FROM convert_stats WHERE bytes_in IS NOT NULL GROUP BY book_id HAVING count(*) > 65535 OR max(bytes_in * 2000) >= 4294967295 OR max(coalesce(bytes_out, 0)) >= 4294967295"


def severity_rollup(s, d):
    w = t(s, d, "warnings").select("book_id", F.when(F.col("message").contains("ignored") | F.col("message").contains("dropped"), "error").when(F.col("message").contains("image"), "warning").otherwise("info").alias("severity"))
    return lint.summary(w)


SEVERITY = """
SELECT book_id, severity, count(*) AS n FROM (SELECT book_id, CASE WHEN contains(message, 'ignored') OR contains(message, 'dropped') THEN 'error' WHEN contains(message, 'image') THEN 'warning' ELSE 'info' END AS severity FROM warnings)
GROUP BY ROLLUP (book_id, severity) HAVING severity IS NOT NULL OR book_id IS NULL
"""


def by_kind(s, d):
    w = t(s, d, "warnings").select("warning_id", F.regexp_extract("message", r"^(\w+)", 1).alias("kind"))
    return relations.by_kind(w, "kind", "warning_id")


def rename_chain(s, d):
    """Vector names to raster names to final names: the later renaming wins where it knows the name."""
    w = t(s, d, "warnings").where("file is not null").select("book_id", F.col("file").alias("a"), paths.with_extension(F.col("file"), "png").alias("b")).distinct()
    x = t(s, d, "chapters").groupBy("book_id", paths.with_extension(F.col("path"), "png").alias("b")).agg(F.concat(F.lit("img/"), F.min("ord").cast("string"), F.lit(".jpg")).alias("c"))
    return relations.compose_renames(w, x)


_PNG = r"CASE WHEN contains({0}, '/') THEN regexp_extract({0}, '^(.*)/[^/]*$', 1) || '/' ELSE '' END || regexp_replace(string_split({0}, '/')[-1], '(.)\.[^.]*$', '\1') || '.png'"
RENAMES = f"WITH w AS (SELECT DISTINCT book_id, file AS a, {_PNG.format('file')} AS b FROM warnings WHERE file IS NOT NULL), x AS (SELECT book_id, {_PNG.format('path')} AS b, 'img/' || min(ord) || '.jpg' AS c FROM chapters GROUP BY ALL) SELECT w.book_id, a, coalesce(c, w.b) AS final FROM w LEFT JOIN x ON w.book_id = x.book_id AND w.b = x.b"


def referenced_fragments(s, d):
    named = t(s, d, "warnings").select("book_id", F.concat(F.lit("n"), (F.col("warning_id") % 5).cast("string")).alias("fragment"))
    return relations.referenced_fragments(t(s, d, "chapters").select("book_id", F.col("body_html").alias("html")), named)


FRAGMENTS = r"""SELECT book_id, unnest(regexp_extract_all(body_html, 'href="[^"#]*#([^"]+)"', 1)) AS fragment FROM chapters UNION SELECT book_id, 'n' || warning_id % 5 FROM warnings"""


def declared_type(s, d):
    """The first declared profile of each file a warning names."""
    m = t(s, d, "chapters").select("book_id", "path", F.col("profile").alias("media_type"), F.struct("ord", "chapter_id").alias("ord"))
    w = t(s, d, "warnings").where("file is not null").select("warning_id", "book_id", F.col("file").alias("path"))
    return lint.declared_types(w, m).select("warning_id", "declared").distinct()


DECLARED = "WITH c AS (SELECT book_id, path, (array_agg(profile ORDER BY ord, chapter_id))[1] AS declared FROM chapters GROUP BY ALL) SELECT DISTINCT warning_id, declared FROM warnings w LEFT JOIN c ON w.book_id = c.book_id AND w.file = c.path WHERE file IS NOT NULL"


def keep_first(s, d):
    c = t(s, d, "chapters").select("book_id", "path", "ord", "chapter_id").distinct()
    return naming.keep_first(c, ["book_id", "path"], ["ord", "chapter_id"], "keeps_id").select("chapter_id", "keeps_id")


KEEP_FIRST = "SELECT chapter_id, row_number() OVER (PARTITION BY book_id, path ORDER BY ord, chapter_id) = 1 AS keeps_id FROM (SELECT DISTINCT book_id, path, ord, chapter_id FROM chapters)"


def numbering(s, d):
    """Ordered-list numbers: a start value, restarted by every line whose quantity is a multiple of ten."""
    li = t(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"))
    return naming.island_numbers(li, "l_orderkey", "l_linenumber", F.when(F.col("q") % 10 == 0, F.col("q").cast("int")), "number").select("l_orderkey", "l_linenumber", "number")


NUMBERING = """
SELECT l_orderkey, l_linenumber, (coalesce(first_value(value) OVER v, 1) + row_number() OVER v - 1)::INT AS number FROM (
  SELECT *, count(value) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS island FROM (SELECT l_orderkey, l_linenumber, CASE WHEN min(l_quantity) % 10 = 0 THEN min(l_quantity)::INT END AS value FROM lineitem GROUP BY ALL))
WINDOW v AS (PARTITION BY l_orderkey, island ORDER BY l_linenumber)
"""


def slugs(s, d):
    """Slugs of headings, later ones of a book numbered."""
    c = t(s, d, "chapters").select("book_id", "ord", "chapter_id", "title").distinct().withColumn("slug", tx.slugify(F.coalesce("title", F.lit(""))))
    return naming.dedupe(c, ["book_id"], "slug", ["ord", "chapter_id"], "anchor").select("chapter_id", "anchor")


SLUGS = r"""
SELECT chapter_id, CASE WHEN n > 1 THEN slug || '-' || n ELSE slug END AS anchor FROM (
  SELECT *, row_number() OVER (PARTITION BY book_id, slug ORDER BY ord, chapter_id) AS n FROM (
    SELECT DISTINCT book_id, ord, chapter_id, coalesce(nullif(regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'section') AS slug FROM chapters))
"""


def id_cap(s, d):
    """Anchors of books with more than eight chapters that no warning names, per book and profile."""
    c = t(s, d, "chapters").select("book_id", "chapter_id", F.col("path").alias("id"), "profile").distinct()
    gone = naming.cap_ids(c, t(s, d, "warnings").where("file is not null").select("book_id", F.col("file").alias("fragment")), ["book_id"], 8)
    return gone.groupBy("book_id", "profile").agg(F.count("*").alias("dropped"))


ID_CAP = "SELECT book_id, profile, count(*) AS dropped FROM (SELECT *, count(*) OVER (PARTITION BY book_id) AS n FROM (SELECT DISTINCT book_id, chapter_id, path, profile FROM chapters)) c WHERE n > 8 AND NOT EXISTS (SELECT 1 FROM warnings w WHERE w.book_id = c.book_id AND w.file = c.path) GROUP BY book_id, profile"


def greedy_pack(s, d):
    """Blocks of a chapter packed into parts of at most 2,000 bytes."""
    c = t(s, d, "chapters").where("size(nodes) > 0").select("chapter_id", F.expr("transform(nodes, x -> x.n_bytes)").alias("sizes")).distinct()
    z = c.withColumn("bin", packing.greedy_bins(F.col("sizes"), F.lit(2000)))
    return z.select("chapter_id", F.inline(F.arrays_zip("bin", "sizes"))).groupBy("chapter_id", "bin").agg(F.sum("sizes").alias("n_bytes"), F.count("*").alias("n_blocks"))


GREEDY = """
WITH RECURSIVE b AS (SELECT chapter_id, list_transform(nodes, lambda x: x.n_bytes) AS s FROM (SELECT DISTINCT chapter_id, nodes FROM chapters) WHERE len(nodes) > 0),
r AS (SELECT chapter_id, s, 1 AS i, 0 AS bin, s[1]::BIGINT AS used FROM b
  UNION ALL SELECT chapter_id, s, i + 1, CASE WHEN used + s[i + 1] > 2000 THEN bin + 1 ELSE bin END, CASE WHEN used + s[i + 1] > 2000 THEN s[i + 1] ELSE used + s[i + 1] END FROM r WHERE i < len(s))
SELECT chapter_id, bin, sum(s[i])::BIGINT AS n_bytes, count(*) AS n_blocks FROM r GROUP BY chapter_id, bin
"""


def page_tiles(s, d):
    c = t(s, d, "convert_stats").where("bytes_in is not null").select("book_id", "finished_at", (F.col("bytes_in") % 6000).cast("int").alias("height"))
    return c.select("book_id", "finished_at", "height", F.size(packing.tiles(F.col("height"), 800)).alias("n_tiles"))


TILES = "SELECT book_id, finished_at, (bytes_in % 6000)::INT AS height, CASE WHEN bytes_in % 6000 <= 1600 THEN 1 ELSE ((bytes_in % 6000 - 81) // 720 + 1)::INT END AS n_tiles FROM convert_stats WHERE bytes_in IS NOT NULL"


def apportion(s, d):
    li = t(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("l_quantity"))
    return packing.apportion(li, "l_orderkey", "l_quantity", "l_linenumber", 1000).select("l_orderkey", "l_linenumber", F.col("share").cast("long").alias("share"))


APPORTION = """
SELECT l_orderkey, l_linenumber, (f + CASE WHEN row_number() OVER (PARTITION BY l_orderkey ORDER BY round(x - f, 9) DESC, l_linenumber) <= 1000 - sum(f) OVER (PARTITION BY l_orderkey) THEN 1 ELSE 0 END)::BIGINT AS share
FROM (SELECT *, floor(x) AS f FROM (SELECT l_orderkey, l_linenumber, q * 1000 / sum(q) OVER (PARTITION BY l_orderkey) AS x FROM (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS q FROM lineitem GROUP BY ALL)))
"""


def histogram(s, d):
    e = t(s, d, "embeddings").select("label", F.explode("embedding").alias("v"))
    return relations.tone_histogram(e.select("label", F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.col("v").cast("double") * 64 + 128))).cast("int").alias("tone")), "label")


HISTOGRAM = "SELECT label, greatest(0, least(255, floor(v::DOUBLE * 64 + 128)))::INT AS tone, count(*) AS n FROM (SELECT label, unnest(embedding) AS v FROM embeddings) GROUP BY ALL"


def tone_kind(s, d):
    """Line art if a label has at most sixteen tones or two tones make 85 % of it; bounds at one per cent from either end."""
    return relations.tone_kind(histogram(s, d), "label")


TONE_KIND = f"""
SELECT label, count(*) AS tones, round(sum(CASE WHEN rank <= 2 THEN n ELSE 0 END) / max(total), 4)::DOUBLE AS top_two, min(CASE WHEN below * 100 > total THEN tone END) AS low, max(CASE WHEN above * 100 > total THEN tone END) AS high,
  count(*) <= 16 OR sum(CASE WHEN rank <= 2 THEN n ELSE 0 END) / max(total) >= 0.85 AS line_art
FROM (SELECT *, sum(n) OVER (PARTITION BY label) AS total, sum(n) OVER (PARTITION BY label ORDER BY tone) AS below, sum(n) OVER (PARTITION BY label ORDER BY tone DESC) AS above, row_number() OVER (PARTITION BY label ORDER BY n DESC, tone) AS rank FROM ({HISTOGRAM})) GROUP BY label
"""


def nearest_level(s, d):
    """The panel level nearest to each part's tone, the darker of two equals."""
    p = t(s, d, "part").select("p_partkey", (F.col("p_partkey") * 37 % 256).cast("int").alias("tone"))
    return p.select("p_partkey", "tone", relations.nearest_level(F.col("tone"), 16).alias("level"))


NEAREST = f"SELECT p_partkey, (p_partkey * 37 % 256)::INT AS tone, arg_min(v, abs(v - p_partkey * 37 % 256) * 1000 + v)::INT AS level FROM part, (SELECT unnest({color.panel_levels(16)}) AS v) GROUP BY p_partkey"


def palette(s, d):
    """Colours by role and weight; tones onto which colours fall that are ten apart or more."""
    p = t(s, d, "part").select((F.col("p_size") % 50).alias("tone"), F.floor(F.col("p_size") / 12).cast("int").alias("level"), F.lit(1).alias("w"))
    used = p.groupBy("level", "tone").agg(F.sum("w").alias("weight"))
    return used.groupBy("level").agg(F.count("*").alias("colours"), F.sum("weight").alias("weight"), F.round(F.sum(F.col("tone") * F.col("weight")) / F.sum("weight"), 4).alias("mean"), (F.max("tone") - F.min("tone") >= 10).alias("collapsed"))


PALETTE = "SELECT level, count(*) AS colours, sum(weight)::BIGINT AS weight, round(sum(tone * weight) / sum(weight), 4)::DOUBLE AS mean, max(tone) - min(tone) >= 10 AS collapsed FROM (SELECT p_size % 50 AS tone, (p_size // 12)::INT AS level, count(*) AS weight FROM part GROUP BY ALL) GROUP BY level"


def run_stats(s, d):
    return relations.run_stats(t(s, d, "convert_stats"), "profile")


RUN_STATS = "SELECT profile, count(*) AS runs, count(DISTINCT book_id) AS books, sum(bytes_in)::BIGINT AS bytes_in, sum(bytes_out)::BIGINT AS bytes_out, sum(images_processed)::BIGINT AS images, sum(chapters_split)::BIGINT AS chapters_split, sum(warnings)::BIGINT AS warnings FROM (SELECT DISTINCT * FROM convert_stats) GROUP BY profile"


def batch_summary(s, d):
    v = t(s, d, "convert_stats").select("profile", F.when(F.col("bytes_out").isNull(), "failed").when(F.col("bytes_out") > F.col("bytes_in"), "grown").otherwise("done").alias("status"))
    return relations.batch_summary(v, "profile", ("done", "failed", "grown"))


BATCH = "SELECT profile, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'grown') AS grown FROM (SELECT profile, CASE WHEN bytes_out IS NULL THEN 'failed' WHEN bytes_out > bytes_in THEN 'grown' ELSE 'done' END AS status FROM convert_stats) GROUP BY profile"


def long_words(s, d):
    d_ = t(s, d, "documents").select("doc_id", tx.long_words(F.col("text"), 17).alias("w"))
    return d_.where("size(w) > 0").select("doc_id", F.size("w").alias("n"), F.array_max(F.transform("w", lambda x: F.octet_length(x))).alias("longest"))


LONG_WORDS = r"SELECT doc_id, len(w)::INT AS n, list_max(list_transform(w, lambda x: strlen(x)))::INT AS longest FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: strlen(x) > 17) AS w FROM documents) WHERE len(w) > 0"


def rule_total(s, d):
    """Braces that close a rule, per book: in the texts of the pages, which hold style samples and mathematics."""
    return css.rule_total(t(s, d, "chapters"), F.col("body_html"), 3)


def top_candidates(s, d):
    return relations.rank_candidates(t(s, d, "candidates"), "source", 5).select("source", "ref", F.col("score").cast("double").alias("score"), F.array_join("subjects", "|").alias("subjects"), "rank")


TOP = "SELECT source, ref, score::DOUBLE AS score, subjects, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC NULLS LAST, ref) AS rank FROM (SELECT DISTINCT source, ref, score, array_to_string(subject[1:12], '|') AS subjects FROM candidates)) WHERE rank <= 5"


def smallest_run(s, d):
    return relations.smallest_attempt(t(s, d, "convert_stats"), "book_id", "bytes_out", "finished_at")


SMALLEST = "SELECT book_id, bytes_out, finished_at FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY bytes_out, finished_at) AS rn FROM convert_stats WHERE bytes_out IS NOT NULL) WHERE rn = 1"


def suffixes(s, d):
    return relations.output_suffixes(t(s, d, "profiles"))


def prior_outputs(s, d):
    m = t(s, d, "metadata").select("book_id").distinct().withColumn("name", F.concat("book_id", F.element_at(F.array(*[F.lit(x) for x in (".epub", ".pocket.epub", ".Slate.EPUB")]), (F.length("book_id") % 3 + 1).cast("int"))))
    return relations.prior_outputs(m, suffixes(s, d))


PRIOR = "WITH s AS (SELECT '.' || lower(appendix) || '.epub' AS suffix FROM profiles WHERE appendix IS NOT NULL UNION SELECT '.fitted.epub'), m AS (SELECT DISTINCT book_id, book_id || ['.epub', '.pocket.epub', '.Slate.EPUB'][length(book_id) % 3 + 1] AS name FROM metadata) SELECT * FROM m WHERE EXISTS (SELECT 1 FROM s WHERE ends_with(lower(name), suffix))"


def copy_chains(s, d):
    """Chains of copies over every key, followed to their first source."""
    return relations.follow(t(s, d, "orders").select(F.col("o_custkey").cast("long").alias("b")).distinct().where("b > 0").select("b", F.floor(F.col("b") / 2).cast("long").alias("a")))


COPY_CHAINS = "WITH RECURSIVE c AS (SELECT DISTINCT o_custkey::BIGINT AS b, o_custkey::BIGINT // 2 AS a FROM orders WHERE o_custkey > 0), r AS (SELECT b, a AS root, 1 AS depth FROM c UNION ALL SELECT r.b, c.a, depth + 1 FROM r JOIN c ON r.root = c.b) SELECT b AS copy, arg_min(root, -depth) AS source, max(depth) AS depth FROM r GROUP BY b"


def events_json(s, d):
    e = t(s, d, "events").select("event_id", "event_type", F.from_json("props", "map<string,string>").alias("p"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.size(F.map_keys("p"))).alias("n_keys"))


EVENTS = "SELECT event_type, count(*) AS n, sum(len(json_keys(props)))::BIGINT AS n_keys FROM events GROUP BY event_type"


def daily_windows(s, d):
    e = t(s, d, "warnings").select("book_id", F.window("read_at", "7 days").alias("w"), "ingested_at", "read_at").withColumn("late", (F.unix_timestamp("ingested_at") - F.unix_timestamp("read_at") > 86400).cast("int"))
    return e.groupBy(F.date_format("w.start", "yyyy-MM-dd").alias("week")).agg(F.count("*").alias("n"), F.sum("late").alias("late"))


WINDOWS = "SELECT strftime(time_bucket(INTERVAL 7 DAY, read_at, TIMESTAMP '1970-01-01'), '%Y-%m-%d') AS week, count(*) AS n, sum((epoch(date_trunc('second', ingested_at)) - epoch(date_trunc('second', read_at)) > 86400)::INT)::BIGINT AS late FROM warnings GROUP BY 1"


QUERIES = {
    "flt_replace_rule": (replace_rule, REPLACE_RULE),
    "flt_rules_pages": (rules_pages, RULES_PAGES),
    "flt_metadata_rules": (metadata_rules, METADATA_RULES),
    "flt_resource_rules": (drop_resources, DROP),
    "flt_css_subset": (css_subset, CSS_SUBSET),
    "flt_numeric_share": (numeric_share, NUMERIC),
    "flt_prior_output": (prior_outputs, PRIOR),
    "agg_table_grid": (table_grid, GRID),
    "jon_manifest_sync": (manifest_sync, MANIFEST),
    "jon_spine": (spine, SPINE),
    "jon_toc_targets": (toc, TOC),
    "jon_renames": (rename_chain, RENAMES),
    "jon_fragments": (referenced_fragments, FRAGMENTS),
    "jon_declared_type": (declared_type, DECLARED),
    "jon_copy_chains": (copy_chains, COPY_CHAINS),
    "agg_duplicate_ids": (duplicate_ids, DUPLICATES),
    "lnt_fonts": (font_findings, FONTS),
    "lnt_zip64": (zip64, ZIP64),
    "agg_severity": (severity_rollup, SEVERITY),
    "agg_by_kind": (by_kind, r"SELECT regexp_extract(message, '^(\w+)', 1) AS kind, count(*) AS n, min(warning_id) AS first_seen FROM warnings GROUP BY 1"),
    "agg_histogram": (histogram, HISTOGRAM),
    "agg_tone_kind": (tone_kind, TONE_KIND),
    "agg_palette": (palette, PALETTE),
    "agg_run_stats": (run_stats, RUN_STATS),
    "agg_batch_summary": (batch_summary, BATCH),
    "agg_long_words": (long_words, LONG_WORDS),
    "agg_rule_total": (rule_total, "SELECT book_id, coalesce(sum(n), 0)::BIGINT AS n_rules, coalesce(sum(n), 0) > 3 AS over_cap FROM (SELECT book_id, len(regexp_extract_all(body_html, '}')) AS n FROM chapters) GROUP BY book_id"),
    "agg_events": (events_json, EVENTS),
    "agg_weekly": (daily_windows, WINDOWS),
    "win_keep_first": (keep_first, KEEP_FIRST),
    "win_numbering": (numbering, NUMBERING),
    "win_slugs": (slugs, SLUGS),
    "win_id_cap": (id_cap, ID_CAP),
    "win_greedy_pack": (greedy_pack, GREEDY),
    "win_tiles": (page_tiles, TILES),
    "srt_apportion": (apportion, APPORTION),
    "srt_nearest_level": (nearest_level, NEAREST),
    "srt_top_candidates": (top_candidates, TOP),
    "srt_smallest": (smallest_run, SMALLEST),
    "srt_suffixes": (suffixes, "SELECT '.' || lower(appendix) || '.epub' AS suffix FROM profiles WHERE appendix IS NOT NULL UNION SELECT '.fitted.epub'"),
}
