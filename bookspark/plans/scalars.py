"""Scalar functions over whole tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookspark.functions import catalogue as cat
from bookspark.functions import color, paths
from bookspark.functions import text as tx
from bookspark.session import table as t

HREF = "concat(coalesce(file, 'text/none.xhtml'), '#n', warning_id)"
_W = "SELECT warning_id, file, message FROM warnings"


def _warn(s, d):
    return t(s, d, "warnings").select("warning_id", "file", "message")


def path_parts(s, d):
    p = F.col("file")
    return _warn(s, d).where("file is not null").select("warning_id", paths.parent_dir(p).alias("parent"), paths.basename(p).alias("base"), paths.stem(p).alias("stem"), paths.extension(p).alias("ext"), paths.with_extension(p, "txt").alias("renamed"))


PATH_PARTS = r"""
SELECT warning_id, regexp_extract(file, '^(.*)/[^/]*$', 1) AS parent, base,
  CASE WHEN regexp_matches(base, '^.+\.[^.]*$') THEN regexp_replace(base, '\.[^.]*$', '') ELSE base END AS stem,
  lower(regexp_extract(base, '^.+\.([^.]*)$', 1)) AS ext,
  CASE WHEN contains(file, '/') THEN regexp_extract(file, '^(.*)/[^/]*$', 1) || '/' ELSE '' END || CASE WHEN regexp_matches(base, '^.+\.[^.]*$') THEN regexp_replace(base, '\.[^.]*$', '') ELSE base END || '.txt' AS renamed
FROM (SELECT *, string_split(file, '/')[-1] AS base FROM warnings WHERE file IS NOT NULL)
"""


def media_types(s, d):
    return _warn(s, d).select("warning_id", paths.media_type(F.coalesce("file", F.lit(""))).alias("media_type"), paths.is_font(F.coalesce("file", F.lit("")), F.lit("")).alias("is_font"))


MEDIA = "SELECT warning_id, CASE lower(regexp_extract(string_split(coalesce(file, ''), '/')[-1], '^.+\\.([^.]*)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in paths.MEDIA_TYPES.items()) + " ELSE 'application/octet-stream' END AS media_type, lower(regexp_extract(string_split(coalesce(file, ''), '/')[-1], '^.+\\.([^.]*)$', 1)) IN ('ttf', 'otf', 'woff', 'woff2', 'eot') AS is_font FROM warnings"


def hrefs(s, d):
    h = F.expr(HREF)
    path, fragment = paths.split_href(h)
    return _warn(s, d).select("warning_id", path.alias("path"), fragment.alias("fragment"), paths.path_part(h).alias("path_part"), paths.has_scheme(F.concat(F.when(F.col("warning_id") % 3 == 0, F.lit("https://")).otherwise(F.lit("")), h)).alias("has_scheme"), paths.is_javascript(F.concat(F.when(F.col("warning_id") % 5 == 0, F.lit(" JavaScript:")).otherwise(F.lit("")), h)).alias("is_javascript"), tx.first_anchor(h).alias("anchor"))


HREFS = f"""
SELECT warning_id, string_split(h, '#')[1] AS path, 'n' || warning_id AS fragment, regexp_extract(h, '^([^#?]*)', 1) AS path_part,
  regexp_matches(CASE WHEN warning_id % 3 = 0 THEN 'https://' ELSE '' END || h, '^[A-Za-z][A-Za-z0-9+.\\-]*:') AS has_scheme,
  starts_with(lower(ltrim(CASE WHEN warning_id % 5 = 0 THEN ' JavaScript:' ELSE '' END || h)), 'javascript:') AS is_javascript,
  nullif(regexp_extract(h, '#[A-Za-z0-9_.:-]+', 0), '') AS anchor
FROM (SELECT warning_id, {HREF} AS h FROM warnings)
"""


def normal_paths(s, d):
    raw = F.expr("concat('OEBPS/../', coalesce(file, 'x'), '/./../', warning_id, '.html')")
    return _warn(s, d).select("warning_id", paths.normalize_segments(raw).alias("normal"), paths.normalize_href(F.lit("text/sub"), F.expr("concat('../', replace(coalesce(file, 'x'), ' ', '%20'), '#a%20b')")).alias("href"))


_FOLD = "list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split({}, '/'), lambda x: [x])), lambda acc, x: CASE WHEN x[1] IN ('', '.') THEN acc WHEN x[1] = '..' THEN acc[1:greatest(len(acc) - 1, 0)] ELSE list_concat(acc, x) END)"
NORMAL_PATHS = f"SELECT warning_id, array_to_string({_FOLD.format('raw')}, '/') AS normal, array_to_string({_FOLD.format('href')}, '/') || '#a b' AS href FROM (SELECT warning_id, 'OEBPS/../' || coalesce(file, 'x') || '/./../' || warning_id || '.html' AS raw, 'text/sub/../' || coalesce(file, 'x') AS href FROM warnings)"


def percent(s, d):
    m = t(s, d, "metadata").select("book_id", "title", "read_at").where("title is not null")
    e = paths.percent_encode(F.col("title"))
    return m.select("book_id", "read_at", e.alias("encoded"), paths.query_encode(F.col("title")).alias("query"), paths.percent_decode(e).alias("decoded"))


PERCENT = "SELECT book_id, read_at, url_encode(title) AS encoded, replace(url_encode(title), '%20', '+') AS query, title AS decoded FROM metadata WHERE title IS NOT NULL"


def relative(s, d):
    c = t(s, d, "chapters").select("chapter_id", "path", F.concat(F.lit("text/"), "profile").alias("dir"))
    return c.where("path is not null and dir is not null").select("chapter_id", paths.relative_href(F.col("dir"), F.col("path")).alias("href"))


RELATIVE = """
SELECT chapter_id, replace(url_encode(array_to_string(list_concat(list_transform(range(len(a) - n), lambda x: '..'), b[n + 1:]), '/')), '%2F', '/') AS href FROM (
  SELECT chapter_id, a, b, CASE WHEN len(b) > 1 AND b[1] = a[1] THEN CASE WHEN len(b) > 2 AND b[2] = a[2] THEN 2 ELSE 1 END ELSE 0 END AS n
  FROM (SELECT chapter_id, ['text', profile] AS a, string_split(path, '/') AS b FROM chapters WHERE path IS NOT NULL AND profile IS NOT NULL))
"""


def texts(s, d):
    m = t(s, d, "metadata").select("book_id", "title", "read_at").where("title is not null")
    x = F.col("title")
    return m.select("book_id", "read_at", tx.collapse_whitespace(x).alias("collapsed"), tx.slugify(x).alias("slug"), tx.xml_escape(x, quote=True).alias("escaped"), tx.is_ncname(F.substring_index(x, " ", 1)).alias("ncname"))


TEXTS = r"""
SELECT book_id, read_at, trim(regexp_replace(title, '[\s\p{Z}\x0B]+', ' ', 'g')) AS collapsed,
  coalesce(nullif(regexp_replace(regexp_replace(lower(title), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'section') AS slug,
  replace(replace(replace(replace(regexp_replace(title, '[\x00-\x08\x0B\x0C\x0E-\x1F\x{FEFF}]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped,
  regexp_matches(string_split(title, ' ')[1], '^[\p{L}_][\p{L}\p{N}\-._]*$') AS ncname
FROM metadata WHERE title IS NOT NULL
"""


def clean(s, d):
    c = t(s, d, "creators").select("creator_id", "name").where("name is not null")
    return c.select("creator_id", tx.clean_string(F.col("name")).alias("clean"))


CLEAN = r"SELECT creator_id, nfc_normalize(regexp_replace(name, '[\x00-\x08\x0B\x0C\x0E-\x1F\x{FEFF}]', '', 'g')) AS clean FROM creators WHERE name IS NOT NULL"


def labels(s, d):
    n, kind = F.col("ord"), F.element_at(F.array(*[F.lit(k) for k in "aAiI1"]), (F.col("chapter_id") % 5 + 1).cast("int"))
    return t(s, d, "chapters").where("ord is not null").select("chapter_id", n.alias("ord"), tx.alpha(n).alias("alpha"), tx.roman(n).alias("roman"), tx.list_token(n, kind).alias("token"), tx.roman(F.col("chapter_id").cast("int")).alias("roman_id"))


def _roman_sql(n):
    rows = [r for r in tx._ROMAN]
    parts = [f"[{', '.join(repr(x) for x in row)}][({n} // {10 ** (3 - i)}) % 10 + 1]" for i, row in enumerate(rows)]
    return f"CASE WHEN {n} BETWEEN 1 AND 3999 THEN {' || '.join(parts)} ELSE {n}::VARCHAR END"


def _alpha_sql(n):
    return f"CASE WHEN {n} < 1 THEN {n}::VARCHAR WHEN {n} <= 26 THEN chr(96 + {n}) WHEN {n} <= 702 THEN chr((96 + ({n} - 1) // 26)::INT) || chr(97 + ({n} - 1) % 26) ELSE chr((96 + (({n} - 1) // 26 - 1) // 26)::INT) || chr((97 + (({n} - 1) // 26 - 1) % 26)::INT) || chr(97 + ({n} - 1) % 26) END"


LABELS = f"SELECT chapter_id, ord, alpha, roman, CASE chapter_id % 5 WHEN 0 THEN alpha WHEN 1 THEN upper(alpha) WHEN 2 THEN roman WHEN 3 THEN upper(roman) ELSE ord::VARCHAR END AS token, roman_id FROM (SELECT chapter_id, ord, {_alpha_sql('ord')} AS alpha, {_roman_sql('ord')} AS roman, {_roman_sql('chapter_id')} AS roman_id FROM chapters WHERE ord IS NOT NULL)"


def sizes(s, d):
    v = t(s, d, "convert_stats")
    return v.select("book_id", "finished_at", tx.kibibytes(F.col("bytes_in")).alias("kb_in"), tx.leading_zero(F.concat(F.lit("margin:."), F.col("chapters").cast("string"), F.lit("em 1.5em"))).alias("css"), cat.quality(F.when(F.col("chapters") % 3 == 0, F.lit("std")).otherwise((F.col("bytes_in") % 130).cast("string"))).alias("quality"))


SIZES = "SELECT book_id, finished_at, (bytes_in + 512) // 1024 AS kb_in, 'margin:0.' || chapters || 'em 1.5em' AS css, CASE WHEN chapters % 3 = 0 THEN 82 WHEN bytes_in % 130 BETWEEN 1 AND 100 THEN (bytes_in % 130)::INT END AS quality FROM convert_stats"


def base64_decode(s, d):
    b = F.base64(F.encode("title", "utf-8"))
    return t(s, d, "metadata").where("title is not null").select("book_id", "read_at", F.decode(F.try_to_binary(F.regexp_replace(b, r"\s", ""), F.lit("base64")), "utf-8").alias("title"))


def match_scores(s, d):
    c = t(s, d, "candidates").select("ref", "title", "author_name")
    return c.distinct().select("ref", "title", F.round(cat.match_score(F.col("title"), F.col("author_name"), F.lit("The Broken Map"), F.lit("Carmen")), 4).alias("score"), *[c.alias(n) for c, n in zip(cat.parse_ref(F.col("ref")), ("source", "olid"), strict=True)])


MATCH_SCORES = """
SELECT ref, title, round(((CASE WHEN lower(title) = 'the broken map' THEN 1.0 WHEN contains(lower(title), 'the broken map') OR contains('the broken map', lower(title)) THEN 0.6 ELSE 0.0 END)
  + (CASE WHEN len(list_filter(coalesce(author_name, []), lambda a: contains(lower(a), 'carmen') OR contains('carmen', lower(a)))) > 0 THEN 1.0 ELSE 0.0 END)) / 2, 4)::DOUBLE AS score,
  string_split(ref, ':')[1] AS source, regexp_extract(ref, '^[^:]*:(.*)$', 1) AS olid
FROM (SELECT DISTINCT ref, title, author_name FROM candidates)
"""


def descriptions(s, d):
    return t(s, d, "works").select("ref", "description").distinct().where("description is not null").select("ref", cat.clean_description(F.col("description")).alias("clean"))


DESCRIPTIONS = r"""
SELECT ref, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(string_split(string_split(string_split(description, chr(10) || '----------')[1], chr(13) || chr(10) || chr(13) || chr(10) || '([source]')[1], chr(10) || '([source]')[1], chr(13) || chr(10), chr(10)),
  '(?s)\[[*_]*([^\]]*?)[*_]*\](?:\([^)]*(?:\)|$)|\[[^\]]*(?:\]|$))?', '\1', 'g'), '(?s)^(.*?)(\[[^\]]*)?$', '\1'), '[*_]', '', 'g') || regexp_extract(regexp_replace(replace(string_split(string_split(string_split(description, chr(10) || '----------')[1], chr(13) || chr(10) || chr(13) || chr(10) || '([source]')[1], chr(10) || '([source]')[1], chr(13) || chr(10), chr(10)), '(?s)\[[*_]*([^\]]*?)[*_]*\](?:\([^)]*(?:\)|$)|\[[^\]]*(?:\]|$))?', '\1', 'g'), '(?s)^(.*?)(\[[^\]]*)?$', 2), '[ \t\r\f]+(\n|$)', '\1', 'g'), '^\s+|\s+$', '', 'g') AS clean
FROM (SELECT DISTINCT ref, description FROM works) WHERE description IS NOT NULL
"""


def display(s, d):
    """Sizes, initials, years and hashes as a list of books shows them."""
    c = t(s, d, "convert_stats").select("book_id", "bytes_in").distinct()
    m = t(s, d, "metadata").select("book_id", "title", "date").distinct()
    j = c.join(m, "book_id")
    return j.select("book_id", cat.size_text(F.col("bytes_in")).alias("size"), cat.initials(F.coalesce("title", F.lit(""))).alias("initials"), cat.year(F.coalesce("date", F.lit(""))).alias("year"), cat.input_kind(F.concat("book_id", F.when(F.length("book_id") % 2 == 0, ".EPUB").otherwise(".txt"))).alias("kind"), cat.fnv32(F.col("book_id")).alias("hash"))


DISPLAY = r"""
SELECT c.book_id, CASE WHEN bytes_in IS NULL OR bytes_in <= 0 THEN '0 B' WHEN bytes_in < 1024 THEN bytes_in || ' B' WHEN bytes_in / 1024 < 10 THEN printf('%.1f KB', bytes_in / 1024) WHEN bytes_in / 1024 < 1000 THEN floor(bytes_in / 1024 + 0.5)::BIGINT || ' KB' ELSE printf('%.1f MB', bytes_in / 1048576) END AS size,
  array_to_string(list_transform(list_filter(regexp_split_to_array(coalesce(title, ''), '[\s_·—–-]+'), lambda w: w <> '')[1:2], lambda w: upper(w[1:1])), '') AS initials, coalesce(regexp_extract(date, '[0-9]{4}', 0), '') AS year, CASE WHEN length(c.book_id) % 2 = 0 THEN 'epub' END AS kind,
  list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split(c.book_id, ''), lambda x: ord(x)::HUGEINT)), lambda h, b: (xor(h, b) * 16777619) % 4294967296)::BIGINT AS hash
FROM (SELECT DISTINCT book_id, bytes_in FROM convert_stats) c JOIN (SELECT DISTINCT book_id, title, date FROM metadata) m USING (book_id)
"""


def file_names(s, d):
    m = t(s, d, "metadata").select("book_id", "title", "authors", "series").distinct()
    values = {"title": F.col("title"), "author": F.try_element_at("authors", F.lit(1)).getField("name"), "series": F.col("series.name"), "series_index": F.col("series.index"), "original": F.col("book_id")}
    out = cat.file_name("{author} - {title} [{series} {series_index}] {nope}", values, F.col("book_id"))
    stem, appendix, number = cat.copy_name(F.concat("book_id", F.lit(".Pocket (2).epub")))
    return m.where("title is not null").select("book_id", "title", out.alias("name"), stem.alias("stem"), appendix.alias("appendix"), number.alias("number"))


FILE_NAMES = r"""
SELECT book_id, title, regexp_replace(substring(regexp_replace(trim(regexp_replace(raw, '-*[/\\:*?"<>|\x00-\x1f][-/\\:*?"<>|\x00-\x1f]*', '-', 'g')), '[. ]+$', ''), 1, 120), '[. ]+$', '') AS name, book_id AS stem, 'pocket' AS appendix, 2 AS number
FROM (SELECT DISTINCT book_id, title, coalesce(authors[1].name, '') || ' - ' || title || ' [' || coalesce(series.name, '') || ' ' || coalesce(series."index", '') || '] {nope}' AS raw, authors, series FROM metadata WHERE title IS NOT NULL)
"""


def stamps(s, d):
    a, v = cat.split_stamp(F.concat("appendix", F.lit(" 1.0 beta")))
    return t(s, d, "profiles").select("name", a.alias("appendix"), v.alias("version"))


STAMPS = "SELECT name, appendix, CASE WHEN appendix IS NOT NULL THEN '1.0 beta' END AS version FROM profiles"


def colours(s, d):
    p = t(s, d, "part").select("p_partkey", (F.col("p_partkey") * 7 % 256).alias("r"), (F.col("p_partkey") * 13 % 256).alias("g"), (F.col("p_size") * 5 % 256).alias("b"))
    light, chroma, hue = color.lch(F.col("r"), F.col("g"), F.col("b"))
    q = p.select("p_partkey", light.alias("l"), chroma.alias("c"), hue.alias("h"), F.col("r"), color.over_white(F.col("r"), F.lit(0.25)).alias("over"))
    return q.select("p_partkey", F.round("l", 3).alias("lightness"), F.round("c", 3).alias("chroma"), F.round(color.apparent_lightness(F.col("l"), F.col("c"), F.col("h")), 3).alias("apparent"), F.round(color.lightness_of_gray(F.col("r")), 3).alias("gray_l"), "over")


def _lin(c):
    return f"(CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92 ELSE pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END)"


def _lab(v):
    return f"(CASE WHEN {v} > 216.0::DOUBLE / 24389 THEN pow({v}, 1.0::DOUBLE / 3) ELSE (24389.0::DOUBLE / 27 * {v} + 16) / 116 END)"


COLOURS = f"""
SELECT p_partkey, round(l, 3) AS lightness, round(c, 3) AS chroma,
  round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, l + (2.5 - 0.025 * l) * (0.116 * abs(sin(radians(h - 90) / 2)) + 0.085) * c)), 3) AS apparent, round(gray_l, 3) AS gray_l, over
FROM (SELECT *, CASE WHEN c0 < 1e-4 THEN 0.0::DOUBLE ELSE c0 END AS c, CASE WHEN c0 < 1e-4 THEN 0.0::DOUBLE WHEN degrees(atan2(bb, a)) < 0 THEN degrees(atan2(bb, a)) + 360 ELSE degrees(atan2(bb, a)) END AS h
  FROM (SELECT *, sqrt(a * a + bb * bb) AS c0 FROM (SELECT p_partkey, 116 * fy - 16 AS l, 500 * (fx - fy) AS a, 200 * (fy - fz) AS bb, 116 * {_lab('lr')} - 16 AS gray_l, floor(r * 0.25 + 255 * 0.75 + 0.5)::INT AS over
    FROM (SELECT *, {_lab('x')} AS fx, {_lab('y')} AS fy, {_lab('z')} AS fz FROM (SELECT *, (0.4124564 * lr + 0.3575761 * lg + 0.1804375 * lb) / 0.95047::DOUBLE AS x, 0.2126729 * lr + 0.7151522 * lg + 0.072175 * lb AS y, (0.0193339 * lr + 0.119192 * lg + 0.9503041 * lb) / 1.08883::DOUBLE AS z
      FROM (SELECT *, {_lin('r')} AS lr, {_lin('g')} AS lg, {_lin('b')} AS lb FROM (SELECT p_partkey, p_partkey * 7 % 256 AS r, p_partkey * 13 % 256 AS g, p_size * 5 % 256 AS b FROM part)))))))
"""


def wrapped(s, d):
    return _warn(s, d).select("warning_id", F.array_join(tx.wrap(F.col("message"), 24), "\n").alias("lines"))


WRAP = r"""
SELECT warning_id, CASE WHEN message IS NULL THEN NULL WHEN len(p) = 0 THEN '' ELSE list_reduce(p, lambda acc, w: CASE WHEN length(string_split(acc, chr(10))[-1]) + 1 + length(w) <= 24 THEN acc || ' ' || w ELSE acc || chr(10) || w END) END AS lines
FROM (SELECT warning_id, message, flatten(list_transform(list_filter(regexp_split_to_array(message, '\s+'), lambda w: w <> ''), lambda w: regexp_extract_all(w, '(?s).{1,24}'))) AS p FROM warnings)
"""

QUERIES = {
    "scl_path_parts": (path_parts, PATH_PARTS),
    "scl_media_type": (media_types, MEDIA),
    "scl_hrefs": (hrefs, HREFS),
    "scl_normalize": (normal_paths, NORMAL_PATHS),
    "scl_percent": (percent, PERCENT),
    "scl_relative_href": (relative, RELATIVE),
    "scl_texts": (texts, TEXTS),
    "scl_clean_string": (clean, CLEAN),
    "scl_labels": (labels, LABELS),
    "scl_sizes": (sizes, SIZES),
    "scl_base64": (base64_decode, "SELECT book_id, read_at, title FROM metadata WHERE title IS NOT NULL"),
    "scl_match_score": (match_scores, MATCH_SCORES),
    "scl_description": (descriptions, DESCRIPTIONS),
    "scl_display": (display, DISPLAY),
    "scl_file_names": (file_names, FILE_NAMES),
    "scl_stamp": (stamps, STAMPS),
    "img_lightness": (colours, COLOURS),
    "scl_wrap": (wrapped, WRAP),
}
