"""What a book's pages need beyond a single page's shape: content rules, styles, ids and links across pages, splitting.

Trees live within one Arrow batch; what pages must know of each other travels
as tables: aliases (book_id, path, id, onto), parts (book_id, path, part,
part_path, ids), renames (book_id, path, new_path).
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from html.entities import html5 as _NAMED
from urllib.parse import quote, unquote
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookspark.operators import naming
from bookspark.operators.filters import PROPERTIES, Rule
from bookspark.operators.transforms import Node, serialize, tree
from bookspark.sources import html as source

# fixed values: elements that are content without text, and those that stay when they are empty
CONTENT = frozenset("img br hr svg image video audio object iframe embed input canvas".split())
STAYS = frozenset("html head title body table thead tbody tfoot tr td th colgroup col".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*:")


def prose(root: Node) -> list[Node]:
    """Text nodes that a reader sees."""
    return [n for n in root.walk() if n.name == "#text" and n.parent.name not in ("style", "script")]


def is_hollow(n: Node) -> bool:
    return not any(x.name in CONTENT or x.name == "#text" and x.text.strip() for x in n.walk())


def prune(n: Node | None) -> int:
    """Remove an element that holds nothing any more, and so on upward; how many went."""
    gone = 0
    while n is not None and n.parent is not None and n.name[0] != "#" and n.name not in STAYS and is_hollow(n):
        up = n.parent
        n.replace([])
        n, gone = up, gone + 1
    return gone


def apply_rules(root: Node, rules: list[Rule]) -> dict[str, int]:
    """Content rules in order on prose and link targets; counts of what was replaced, removed, unlinked and pruned.

    A match never spans text nodes. Replacing takes text first, removing takes
    whole links first; what a removal leaves empty goes as well.
    """
    done = dict.fromkeys(("replaced", "removed", "links", "pruned"), 0)
    for r in rules:
        hollow: list[Node] = []
        linked = [a for a in root.find("a") if r.match in a.attrs.get("href", "")] if r.applies_to("href") else []
        texts = prose(root) if r.applies_to("text") else []
        if r.action == "replace":
            for n in texts:
                done["replaced"] += n.text.count(r.match)
                n.text = n.text.replace(r.match, r.with_)
            for a in linked:
                a.attrs["href"] = a.attrs["href"].replace(r.match, r.with_)
                done["links"] += 1
            continue
        for a in linked:
            if a.parent is not None:
                hollow.append(a.parent)
                a.replace([])
                done["links"] += 1
        for n in prose(root) if texts else ():
            k = n.text.count(r.match)
            if k:
                n.text = n.text.replace(r.match, "")
                done["removed"] += k
                if not n.text.strip():
                    hollow.append(n.parent)
                    n.replace([])
        for n in hollow:
            done["pruned"] += prune(n)
    return done


def _map(schema: str, one):
    """A batch function from one that turns each row into rows of ``schema``."""
    names = re.findall(r"(?:^|, )(\w+) ", schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([x for r in pdf.itertuples(index=False) for x in one(r)], columns=names)

    return run


RULED = "doc string, xhtml string, replaced int, removed int, links int, pruned int"


def rule_pages(df: DataFrame, doc: Column, html: Column, rules: list[Rule]) -> DataFrame:
    """Every page with the rules applied to its text and links, and how often. Null pages stay null."""

    def one(r):
        if r.html is None:
            return [(r.doc, None, 0, 0, 0, 0)]
        root = tree(r.html)
        c = apply_rules(root, rules)
        return [(r.doc, serialize(root), c["replaced"], c["removed"], c["links"], c["pruned"])]

    return df.select(doc.cast("string").alias("doc"), html.alias("html")).mapInPandas(_map(RULED, one), RULED)


def kept_style(style: str) -> str:
    """What of a style attribute a small reader supports, without marks of importance."""
    kept = []
    for d in style.split(";"):
        name, _, value = d.partition(":")
        name, value = name.strip().lower(), re.sub(r"\s*!\s*important\s*$", "", value.strip(), flags=re.I)
        plain = not re.search(r"(?i)(calc|var|clamp|min|max|env)\(", value)
        if value and plain and (name in PROPERTIES and name != "vertical-align" or name == "display" and value.lower() == "none" or name == "vertical-align" and value.lower() in ("super", "sub")):
            kept.append(f"{name}:{value}")
    return ";".join(kept)


def lift_styles(root: Node) -> tuple[str, int]:
    """(text of the style elements, which are removed; style attributes that were changed or dropped)."""
    css = []
    for e in root.find("style"):
        css.append(e.plain().strip())
        e.replace([])
    n = 0
    for e in root.walk():
        if "style" in e.attrs:
            new = kept_style(e.attrs["style"])
            n += new != e.attrs["style"]
            if new:
                e.attrs["style"] = new
            else:
                del e.attrs["style"]
    return "\n".join(filter(None, css)), n


def relocate_ids(root: Node) -> tuple[int, dict[str, str]]:
    """Ids of inline elements move to the block around them; where that has one the id becomes an alias of it, and links within the page follow."""
    moved, alias = 0, {}
    for e in root.find(*source.INLINE):
        if "id" not in e.attrs:
            continue
        block = e.parent
        while block is not None and block.name not in source.BLOCKS:
            block = block.parent
        if block is None:
            continue
        i = e.attrs.pop("id")
        moved += 1
        if block.attrs.setdefault("id", i) != i:
            alias[i] = block.attrs["id"]
    for a in root.find("a"):
        href = a.attrs.get("href", "")
        if href[:1] == "#" and href[1:] in alias:
            a.attrs["href"] = "#" + alias[href[1:]]
    return moved, alias


def rows_of(table: Node) -> list[Node]:
    """The table's own rows."""
    out = []
    for n in table.walk():
        if n.name == "tr":
            p = n.parent
            while p.name != "table":
                p = p.parent
            if p is table:
                out.append(n)
    return out


def cells_of(row: Node) -> list[Node]:
    return [c for c in row.children if c.name in ("td", "th")]


def header_of(table: Node) -> tuple[list[Node], list[Node]]:
    """(cells of the header row, body rows): the first row of thead, or the first row if all its cells are headers. Other rows of thead are no body."""
    rows = rows_of(table)
    head = [r for r in rows if r.parent.name == "thead"]
    if head:
        return cells_of(head[0]), [r for r in rows if r not in head]
    if rows and cells_of(rows[0]) and all(c.name == "th" for c in cells_of(rows[0])):
        return cells_of(rows[0]), rows[1:]
    return [], rows


def tables_to_text(root: Node) -> int:
    """Tables as paragraphs, innermost first: "header: value" for each cell under a header, rows apart by a dash; else the cells of a row joined by a dash."""
    tables = root.find("table")
    for t in reversed(tables):
        header, body = header_of(t)
        labels = [" ".join(c.plain().split()) for c in header]
        out: list[Node] = []
        for caption in [c for c in t.children if c.name == "caption"]:
            caption.name = "p"
            out.append(caption)
        for k, row in enumerate(body):
            cells = [c for c in cells_of(row) if c.plain().strip() or any(x.name[0] != "#" for x in c.children)]
            if header and k:
                p = Node("p")
                p.add(Node("#text", text="—"))
                out.append(p)
            line = Node("p")
            after: list[Node] = []
            for c in cells:
                at = cells_of(row).index(c)
                inner = [x for x in c.children if x.name in BLOCK_CHILDREN]
                if header:
                    line = Node("p")
                    if at < len(labels) and labels[at]:
                        line.add(Node("#text", text=f"{labels[at]}: "))
                elif line.children:
                    line.add(Node("#text", text=" — "))
                for x in list(c.children):
                    if x not in inner:
                        line.add(x)
                if header:
                    out += ([line] if line.children else []) + inner
                else:
                    after += inner
            if not header:
                out += ([line] if line.children else []) + after
        if t.attrs.get("id") and out:
            out[0].attrs.setdefault("id", t.attrs["id"])
        t.replace(out)
    return len(tables)


BLOCK_CHILDREN = frozenset("p div ul ol dl table blockquote pre section figure aside h1 h2 h3 h4 h5 h6".split())


def cap_page_ids(root: Node, referenced: frozenset[str], cap: int = naming.ID_CAP) -> int:
    """Above the cap every id that nothing in the book refers to is dropped."""
    held = [e for e in root.walk() if "id" in e.attrs]
    drop = [e for e in held if e.attrs["id"] not in referenced] if len(held) > cap else []
    for e in drop:
        del e.attrs["id"]
    return len(drop)


def resolve(path: str, href: str) -> tuple[str, str | None]:
    """(archive path, fragment) that a reference on a page names; an empty path is the page itself."""
    target, mark, fragment = href.partition("#")
    target = unquote(target)
    if target:
        target = posixpath.normpath(posixpath.join("/", posixpath.dirname(path), target)).lstrip("/") if target[0] != "/" else posixpath.normpath(target).lstrip("/")
    return target or path, fragment if mark else None


def relative(from_path: str, to_path: str) -> str:
    return quote(posixpath.relpath("/" + to_path, "/" + posixpath.dirname(from_path)), safe="/-._~")


def document(root: Node) -> str:
    """The page as a whole file: declaration, document type, name spaces where they are used."""
    for e in root.find("html"):
        e.attrs.setdefault("xmlns", "http://www.w3.org/1999/xhtml")
        if any(k.startswith("epub:") for n in root.walk() for k in n.attrs):
            e.attrs.setdefault("xmlns:epub", "http://www.idpf.org/2007/ops")
        break
    return '<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE html>\n' + serialize(root)


def wellformed_error(text: str) -> str | None:
    """Why a text is no XML, or None. Named references of HTML count as known, as readers know them."""
    body = re.sub(r"<!DOCTYPE[^>\[]*>", "", re.sub(r"^\s*<\?xml[^>]*\?>", "", text), count=1)
    known = re.sub(r"&([A-Za-z][A-Za-z0-9]*);", lambda m: m[0] if m[1] in ("amp", "lt", "gt", "quot", "apos") else "x" if m[1] + ";" in _NAMED else m[0], body)
    try:
        ET.fromstring(known.encode())
    except (ET.ParseError, ValueError) as e:
        return str(e)
    return None


ALIASED = "book_id string, path string, xhtml string, moved int, aliases array<struct<id:string,onto:string>>"


def move_ids(pages: DataFrame) -> DataFrame:
    """(book_id, path, xhtml, moved, aliases) of pages (book_id, path, html)."""

    def one(r):
        if r.html is None:
            return [(r.book_id, r.path, None, 0, [])]
        root = tree(r.html)
        n, alias = relocate_ids(root)
        return [(r.book_id, r.path, serialize(root), n, [{"id": k, "onto": v} for k, v in alias.items()])]

    return pages.select("book_id", "path", "html").mapInPandas(_map(ALIASED, one), ALIASED)


def links_of(pages: DataFrame) -> DataFrame:
    """(book_id, path, href, target, fragment) of every link of pages (book_id, path, html) that has no scheme."""

    def one(r):
        for a in tree(r.html).find("a") if r.html else ():
            h = a.attrs.get("href")
            if h and not _SCHEME.match(h):
                yield r.book_id, r.path, h, *resolve(r.path, h)

    schema = "book_id string, path string, href string, target string, fragment string"
    return pages.select("book_id", "path", "html").mapInPandas(_map(schema, one), schema).distinct()


def retarget(pages: DataFrame, changes: DataFrame) -> DataFrame:
    """(book_id, path, xhtml, n_links): pages with the links that ``changes`` (book_id, path, href, new_href) names rewritten.

    The changes of a page come as one small map, so this is a join by page.
    """
    per_page = changes.where("new_href <> href").groupBy("book_id", "path").agg(F.map_from_entries(F.collect_list(F.struct("href", "new_href"))).alias("m"))

    def one(r):
        m = dict(r.m) if r.m is not None else {}
        if not m or not r.html:
            return [(r.book_id, r.path, r.html, 0)]
        root, n = tree(r.html), 0
        for a in root.find("a"):
            if (new := m.get(a.attrs.get("href"))) is not None:
                a.attrs["href"] = new
                n += 1
        return [(r.book_id, r.path, serialize(root), n)]

    schema = "book_id string, path string, xhtml string, n_links int"
    return pages.select("book_id", "path", "html").join(per_page, ["book_id", "path"], "left").mapInPandas(_map(schema, one), schema)


def follow_aliases(pages: DataFrame, aliases: DataFrame) -> DataFrame:
    """Links to an id that moved onto another (book_id, path, id, onto) follow it, across pages; the path part stays as written."""
    found = links_of(pages).join(aliases.select("book_id", F.col("path").alias("target"), F.col("id").alias("fragment"), "onto"), ["book_id", "target", "fragment"])
    return retarget(pages, found.select("book_id", "path", "href", F.concat(F.substring_index("href", "#", 1), F.lit("#"), "onto").alias("new_href")))


def plan_parts(sizes: list[int], heads: list[bool], budget: int) -> list[tuple[int, int]]:
    """Ranges of blocks below the budget: a cut before the heading nearest to the middle of what fits, else where it ends; a block above it stands alone."""
    out, start, n = [], 0, len(sizes)
    left = sum(sizes)
    while start < n:
        if left <= budget:
            out.append((start, n))
            break
        end, used = start, 0
        while end < n and (end == start or used + sizes[end] <= budget):
            used += sizes[end]
            end += 1
        cut = end
        if used <= budget:
            at, best = 0, None
            for i in range(start + 1, end + 1):
                at += sizes[i - 1]
                if i < n and heads[i] and (best is None or abs(at - budget // 2) < best[0]):
                    best = (abs(at - budget // 2), i)
            cut = best[1] if best else end
        out.append((start, cut))
        left -= sum(sizes[start:cut])
        start = cut
    return out


PARTS = "book_id string, path string, part int, n_parts int, part_path string, xhtml string, n_bytes int, ids array<string>, note string"


def split_page(html: str, limit: int) -> tuple[list[Node], str | None]:
    """(the parts of a page above the limit as trees, a note where it stays whole or a part is still too large); the shell counts towards every part."""
    root = tree(html)
    whole = len(serialize(root).encode())
    if whole <= limit:
        return [root], None
    body = next(iter(root.find("body")), root)
    blocks = [c for c in body.children if c.name[0] != "#"]
    if len(blocks) < 2:
        return [root], "no block boundary to split on"
    sizes = [len(serialize(b).encode()) for b in blocks]
    budget = max(1, limit - (whole - sum(sizes)))
    ranges = plan_parts(sizes, [b.name in HEADINGS for b in blocks], budget)
    parts = []
    for k, (a, z) in enumerate(ranges):
        part = tree(html)
        inner = next(iter(part.find("body")), part)
        for i, b in enumerate([c for c in inner.children if c.name[0] != "#"]):
            if not a <= i < z:
                b.replace([])
        if k:
            for t in part.find("title")[:1]:
                t.add(Node("#text", text=" (contd.)"))
        parts.append(part)
    return parts, "a block above the limit stays whole" if any(z - a == 1 and sizes[a] > budget for a, z in ranges) else None


def split_pages(pages: DataFrame, limit: int) -> DataFrame:
    """The parts of every page (book_id, path, html); a page within the limit is its only part, under its own path.

    Part names that another page of the book has are passed over by the caller
    with ``naming.reserve``; here they are the path with -1, -2 and so on.
    """

    def one(r):
        if r.html is None:
            return
        trees, note = split_page(r.html, limit)
        stem, dot, ext = r.path.rpartition(".") if "." in posixpath.basename(r.path) else (r.path, "", "")
        for k, t in enumerate(trees):
            text = serialize(t)
            name = r.path if len(trees) == 1 else f"{stem}-{k + 1}{dot}{ext}"
            yield r.book_id, r.path, k + 1, len(trees), name, text, len(text.encode()), [e.attrs["id"] for e in t.walk() if e.attrs.get("id")], note

    return pages.select("book_id", "path", "html").mapInPandas(_map(PARTS, one), PARTS)


def retarget_parts(parts: DataFrame) -> DataFrame:
    """The parts with links to pages that were divided: a fragment leads to the part that has it, else to the first; a link within one part stays bare."""
    pages = parts.select("book_id", F.col("part_path").alias("path"), F.col("xhtml").alias("html"))
    origin = parts.select("book_id", F.col("part_path").alias("at"), F.col("path").alias("source"))
    # links are resolved against the page as it was: its parts lie in the same folder
    links = links_of(pages).join(origin.withColumnRenamed("at", "path"), ["book_id", "path"]).withColumn("target", F.when(F.col("target") == F.col("path"), F.col("source")).otherwise(F.col("target")))
    divided = parts.where("n_parts > 1")
    owner = divided.select("book_id", F.col("path").alias("target"), F.explode("ids").alias("fragment"), F.col("part_path").alias("own"))
    first = divided.where("part = 1").select("book_id", F.col("path").alias("target"), F.col("part_path").alias("one"))
    led = links.join(first, ["book_id", "target"]).join(owner, ["book_id", "target", "fragment"], "left").withColumn("to", F.coalesce("own", "one"))
    bare = (F.col("to") == F.col("path")) & F.col("fragment").isNotNull()
    path = F.when(bare, F.lit("")).otherwise(F.substring_index("to", "/", -1))
    same_folder = F.regexp_extract("to", "^(.*/)?[^/]*$", 1) == F.regexp_extract("path", "^(.*/)?[^/]*$", 1)
    written = F.when(same_folder, path).otherwise(F.concat(F.regexp_extract("href", "^([^#]*/)?[^/#]*", 1), path))
    new = F.concat(written, F.when(F.col("fragment").isNotNull(), F.concat(F.lit("#"), "fragment")).otherwise(F.lit("")))
    done = retarget(pages, led.select("book_id", "path", "href", new.alias("new_href")))
    return parts.drop("xhtml").join(done.select("book_id", F.col("path").alias("part_path"), "xhtml", "n_links"), ["book_id", "part_path"])


def retarget_spine(spine: DataFrame, parts: DataFrame) -> DataFrame:
    """(book_id, ord, path): every page of the spine gives way to its parts, in order."""
    j = spine.select("book_id", "ord", "path").join(parts.select("book_id", "path", "part", "part_path"), ["book_id", "path"], "left")
    place = F.row_number().over(Window.partitionBy("book_id").orderBy("ord", F.coalesce("part", F.lit(0))))
    return j.select("book_id", (place - 1).alias("ord"), F.coalesce("part_path", "path").alias("path"))


def retarget_toc(toc: DataFrame, parts: DataFrame) -> DataFrame:
    """The contents with entries to divided pages led to the part that has the fragment, else to the first."""
    divided = parts.where("n_parts > 1")
    owner = divided.select("book_id", "path", F.explode("ids").alias("fragment"), F.col("part_path").alias("_own"))
    first = divided.where("part = 1").select("book_id", "path", F.col("part_path").alias("_one"))
    j = toc.join(owner, ["book_id", "path", "fragment"], "left").join(first, ["book_id", "path"], "left")
    return j.withColumn("path", F.coalesce("_own", "_one", "path")).select(*toc.columns)



def image_refs(pages: DataFrame) -> DataFrame:
    """(book_id, path, href, target) of every picture that pages (book_id, path, html) show, by any of the three ways."""

    def one(r):
        for e in tree(r.html).find("img", "image") if r.html else ():
            h = e.attrs.get("src") or e.attrs.get("href") or e.attrs.get("xlink:href")
            if h and not _SCHEME.match(h):
                yield r.book_id, r.path, h, resolve(r.path, h)[0]

    schema = "book_id string, path string, href string, target string"
    return pages.select("book_id", "path", "html").mapInPandas(_map(schema, one), schema).distinct()


def place_tiles(img: Node, sources: list[str]) -> None:
    """A picture gives way to its tiles: paragraphs of their own if it was alone in one, else one behind the other; id and class stay with the first."""
    tiles = []
    for k, s in enumerate(sources):
        attrs = {a: v for a, v in img.attrs.items() if a not in ("src", "width", "height", "srcset") and (k == 0 or a not in ("id", "class"))}
        tiles.append(Node("img", {**attrs, "src": s}))
    p = img.parent
    alone = p.name == "p" and all(c is img or c.name == "#text" and not c.text.strip() for c in p.children)
    if not alone:
        img.replace(tiles)
        return
    new = []
    for k, t in enumerate(tiles):
        q = Node("p", p.attrs if k == 0 else {a: v for a, v in p.attrs.items() if a != "id"})
        q.add(t)
        new.append(q)
    p.replace(new)


def rename_images(pages: DataFrame, renames: DataFrame) -> DataFrame:
    """(book_id, path, xhtml, n_images): pages whose pictures follow ``renames`` (book_id, path, parts), the new paths of each, several for tiles. Sizes that no longer hold are dropped."""
    refs = image_refs(pages).join(renames.select("book_id", F.col("path").alias("target"), "parts"), ["book_id", "target"])
    per_page = refs.groupBy("book_id", "path").agg(F.map_from_entries(F.collect_list(F.struct("href", "parts"))).alias("m"))

    def one(r):
        m = dict(r.m) if r.m is not None else {}
        if not m or not r.html:
            return [(r.book_id, r.path, r.html, 0)]
        root, n = tree(r.html), 0
        for e in root.find("img", "image"):
            key = next((a for a in ("src", "href", "xlink:href") if e.attrs.get(a) in m), None)
            if key is None:
                continue
            new = [relative(r.path, x) for x in m[e.attrs[key]]]
            n += 1
            if e.name == "img" and len(new) > 1:
                place_tiles(e, new)
                continue
            e.attrs[key] = new[0]
            for a in ("width", "height", "srcset") if e.name == "img" else ():
                e.attrs.pop(a, None)
        return [(r.book_id, r.path, serialize(root), n)]

    schema = "book_id string, path string, xhtml string, n_images int"
    return pages.select("book_id", "path", "html").join(per_page, ["book_id", "path"], "left").mapInPandas(_map(schema, one), schema)
