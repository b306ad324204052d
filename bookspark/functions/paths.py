"""Paths and references as Column expressions: everything stays on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: media types by extension
MEDIA_TYPES = {
    "xhtml": "application/xhtml+xml", "html": "application/xhtml+xml", "css": "text/css", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif",
    "svg": "image/svg+xml", "webp": "image/webp", "ttf": "font/ttf", "otf": "font/otf", "woff": "font/woff", "woff2": "font/woff2", "ncx": "application/x-dtbncx+xml", "opf": "application/oebps-package+xml",
}
FONT_EXTENSIONS = ("ttf", "otf", "woff", "woff2", "eot")


def parent_dir(path: Column) -> Column:
    """The part before the last slash, empty without one."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case extension; a name that begins with its only dot has none."""
    return F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1))


def stem(path: Column) -> Column:
    name = basename(path)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def with_extension(path: Column, ext: str) -> Column:
    """The same place and stem with another extension."""
    parent = parent_dir(path)
    return F.concat(F.when(parent == "", F.lit("")).otherwise(F.concat(parent, F.lit("/"))), stem(path), F.lit("." + ext))


def path_part(href: Column) -> Column:
    """Up to the first number sign or question mark."""
    return F.regexp_extract(href, r"^([^#?]*)", 1)


def split_href(href: Column) -> tuple[Column, Column]:
    """(path, fragment): the fragment is null without a number sign and stays undecoded."""
    return F.substring_index(href, "#", 1), F.when(href.contains("#"), F.regexp_extract(href, r"(?s)^[^#]*#(.*)$", 1))


def has_scheme(href: Column) -> Column:
    return href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")


def is_javascript(href: Column) -> Column:
    return F.lower(F.ltrim(href)).startswith("javascript:")


def normalize_segments(path: Column) -> Column:
    """Dots and double dots folded away; a double dot at the root is ignored."""
    kept = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, x: F.when((x == "") | (x == "."), acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))),
    )
    return F.array_join(kept, "/")


def percent_decode(text: Column) -> Column:
    """Percent escapes as UTF-8; a plus stays a plus, an invalid escape stays as it is, and bytes that are no UTF-8 become replacement characters."""
    runs = F.regexp_extract_all(text, F.lit(r"(?:%[0-9A-Fa-f]{2})+|[^%]+|%"), F.lit(0))
    decoded = F.transform(runs, lambda r: F.when(r.rlike("^%[0-9A-Fa-f]{2}"), F.make_valid_utf8(F.unhex(F.replace(r, F.lit("%"), F.lit(""))).cast("string"))).otherwise(r))
    return F.when(text.contains("%"), F.array_join(decoded, "")).otherwise(text)


def percent_encode(text: Column, keep_slash: bool = False) -> Column:
    """All but letters, digits and ``-._~`` as upper-case escapes."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), *((("%2F", "/"),) if keep_slash else ())):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def query_encode(text: Column) -> Column:
    """As in a query string: a space becomes a plus."""
    return F.replace(percent_encode(text), F.lit("%20"), F.lit("+"))


def normalize_href(base_dir: Column, href: Column) -> Column:
    """Archive path of a reference: decoded, resolved against the folder, the fragment kept."""
    path, fragment = split_href(percent_decode(href))
    joined = F.when(path.startswith("/") | (base_dir == ""), path).otherwise(F.concat(base_dir, F.lit("/"), path))
    return F.concat(normalize_segments(joined), F.when(fragment.isNotNull(), F.concat(F.lit("#"), fragment)).otherwise(F.lit("")))


def relative_href(from_dir: Column, to_path: Column) -> Column:
    """The way from a folder to a file, encoded. The file name is never part of the common way."""
    a = F.filter(F.split(from_dir, "/"), lambda x: x != "")
    b = F.split(to_path, "/")
    shared = F.aggregate(
        F.zip_with(a, F.slice(b, 1, F.size(b) - 1), lambda x, y: F.coalesce(x == y, F.lit(False))),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda acc, same: F.struct((acc.n + F.when(acc.on & same, 1).otherwise(0)).alias("n"), (acc.on & same).alias("on")),
        lambda acc: acc.n,
    )
    ups = F.array_repeat(F.lit(".."), F.size(a) - shared)
    return percent_encode(F.array_join(F.concat(ups, F.slice(b, shared + 1, F.size(b))), "/"), keep_slash=True)


def media_type(path: Column, declared: Column | None = None) -> Column:
    """The declared type unless blank, else by extension, else bytes."""
    known = F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv])
    by_name = F.coalesce(F.try_element_at(known, extension(path)), F.lit("application/octet-stream"))
    return by_name if declared is None else F.coalesce(F.nullif(F.trim(declared), F.lit("")), by_name)


def is_font(path: Column, kind: Column) -> Column:
    k = F.lower(kind)
    return k.startswith("font/") | k.isin("application/vnd.ms-opentype", "application/font-woff") | k.startswith("application/x-font-") | extension(path).isin(*FONT_EXTENSIONS)
