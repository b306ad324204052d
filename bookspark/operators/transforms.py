"""Rewrites of one page's tree for small readers, fused into one Arrow pass; each step can be left out."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookspark.sources import html as source

STEPS = ("ids", "boxes", "lists", "code", "links")
PAGES = "doc string, xhtml string, steps array<struct<kind:string,n:int>>"
_NBSP = "\u00a0"


class Node:
    """An element, a text or a comment; children are owned by one parent."""

    __slots__ = ("attrs", "children", "name", "parent", "text")

    def __init__(self, name: str, attrs: dict | None = None, text: str = "") -> None:
        self.name, self.attrs, self.text, self.children, self.parent = name, dict(attrs or {}), text, [], None

    def add(self, child: Node, at: int | None = None) -> Node:
        child.parent = self
        self.children.insert(len(self.children) if at is None else at, child)
        return child

    def replace(self, new: list[Node]) -> None:
        p = self.parent
        k = p.children.index(self)
        p.children[k:k + 1] = new
        for n in new:
            n.parent = p
        self.parent = None

    def walk(self) -> Iterator[Node]:
        yield self
        for c in list(self.children):
            yield from c.walk()

    def find(self, *names: str) -> list[Node]:
        return [n for n in self.walk() if n.name in names]

    def inside(self, *names: str) -> bool:
        p = self.parent
        while p is not None:
            if p.name in names:
                return True
            p = p.parent
        return False

    def plain(self) -> str:
        return self.text if self.name == "#text" else "".join(c.plain() for c in self.children)


def tree(markup: str) -> Node:
    root, made = Node("#root"), []
    for _, _, parent, _, kind, name, attrs, text in source.parse(markup):
        n = Node(name if kind == "element" else f"#{kind}", attrs, text or "")
        made.append(n)
        (made[parent] if parent >= 0 else root).add(n)
    return root


_NAME = re.compile(r"[^\W\d][\w.-]*$")


def _escape(text: str, quote: bool = False) -> str:
    out = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f﻿]", "", text).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return out.replace('"', "&quot;") if quote else out


def serialize(n: Node) -> str:
    """Strict XHTML: elements and attributes with names that XML forbids are dropped, their children kept."""
    if n.name == "#text":
        return _escape(n.text)
    if n.name == "#comment":
        body = re.sub("-{2,}", "-", re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", n.text)).strip("-").lstrip(">")
        return f"<!--{body}-->"
    inner = "".join(map(serialize, n.children))
    if n.name == "#root" or not _NAME.match(n.name):
        return inner
    attrs = "".join(f' {k}="{_escape(v, True)}"' for k, v in n.attrs.items() if _NAME.match(k))
    return f"<{n.name}{attrs}/>" if n.name in source.VOID else f"<{n.name}{attrs}>{inner}</{n.name}>"


def first_ids(root: Node) -> int:
    seen: set[str] = set()
    n = 0
    for e in root.walk():
        i = e.attrs.get("id")
        if i in seen:
            del e.attrs["id"]
            n += 1
        elif i:
            seen.add(i)
    return n


_BLOCK = frozenset("p div ul ol dl table blockquote pre section figure aside h1 h2 h3 h4 h5 h6".split())


def degrade_boxes(root: Node) -> int:
    """Asides, figures and definition lists as plain paragraphs: empty asides go, captions follow their figure."""
    n = 0
    for e in root.find("aside"):
        if not e.plain().strip() and not e.find("img"):
            e.replace([])
        elif any(c.name in _BLOCK for c in e.children):
            e.replace(e.children)
        else:
            p = Node("p", {k: v for k, v in e.attrs.items() if k == "id"})
            for c in e.children:
                p.add(c)
            e.replace([p])
        n += 1
    for e in root.find("figure"):
        captions = [c for c in e.children if c.name == "figcaption"]
        for c in captions:
            c.name = "p"
        e.replace([c for c in e.children if c not in captions] + captions)
        n += 1
    for e in root.find("dl"):
        rows = [c for c in e.children if c.name in ("dt", "dd")]
        for c in rows:
            c.name = "p"
        e.replace(rows)
        n += 1
    return n


def _alpha(n: int) -> str:
    out = ""
    while n > 0:
        n, r = divmod(n - 1, 26)
        out = chr(97 + r) + out
    return out


def label(n: int, kind: str) -> str:
    """The number of a list item by the type of its list."""
    if kind in ("a", "A") and n > 0:
        out = _alpha(n)
    elif kind in ("i", "I") and 0 < n < 4000:
        out, rest = "", n
        for v, s in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
            out += s * (rest // v)
            rest %= v
    else:
        return str(n)
    return out.upper() if kind.isupper() else out


def _number(text: str | None, default: int) -> int:
    return int(text) if text and re.fullmatch(r"\s*-?\d{1,6}\s*", text) else default


def bake_lists(root: Node) -> int:
    """Ordered lists as paragraphs with their numbers written out; items of inner lists carry the outer number too."""

    def flat(ol: Node, outer: str) -> list[Node]:
        out: list[Node] = []
        at = _number(ol.attrs.get("start"), 1) - 1
        for li in [c for c in ol.children if c.name == "li"]:
            at = _number(li.attrs.get("value"), at + 1)
            core = outer + label(at, ol.attrs.get("type", "1"))
            p = Node("p", {k: v for k, v in li.attrs.items() if k in ("id", "class")})
            p.add(Node("#text", text=f"{core}.{_NBSP}"))
            out.append(p)
            for c in list(li.children):
                if c.name == "ol":
                    out += flat(c, f"{core}.")
                elif c.name == "p" and len(p.children) == 1 and out[-1] is p:
                    for x in list(c.children):
                        p.add(x)
                elif c.name in _BLOCK:
                    out.append(c)
                else:
                    p.add(c)
        return out

    n = 0
    for e in root.find("ol"):
        if e.parent is not None and not e.inside("ol") and not e.inside("nav"):
            e.replace(flat(e, ""))
            n += 1
    return n


def fast_blanks(line: str) -> str:
    """Blanks at the start of a line, tabs as four, and runs of blanks within it as ones that neither fold nor break; a single blank between words stays."""
    lead = len(line) - len(line.lstrip(" \t"))
    inner = re.sub(" {2,}", lambda m: _NBSP * len(m[0]), line[lead:]).replace("\t", _NBSP * 4)
    return line[:lead].replace("\t", _NBSP * 4).replace(" ", _NBSP) + inner


def preserve_code(root: Node) -> int:
    """Preformatted text as a paragraph with its line ends and its blanks made fast."""
    found = root.find("pre")
    for e in found:
        p = Node("p", {k: v for k, v in e.attrs.items() if k == "id"})
        for i, line in enumerate(e.plain().strip("\n").split("\n")):
            if i:
                p.add(Node("br"))
            p.add(Node("#text", text=fast_blanks(line)))
        e.replace([p])
    return len(found)


def normal_links(root: Node) -> int:
    """Script links point to the place they name, else they are unwrapped."""
    n = 0
    for e in root.find("a"):
        if e.attrs.get("href", "").lstrip().lower().startswith("javascript:"):
            ref = next((m[0] for v in e.attrs.values() if (m := re.search(r"#[A-Za-z0-9_.:-]+", v))), None)
            if ref:
                e.attrs["href"] = ref
            else:
                e.replace(e.children)
            n += 1
    return n


_RUN = {"ids": first_ids, "boxes": degrade_boxes, "lists": bake_lists, "code": preserve_code, "links": normal_links}


def rewrite(markup: str, steps: tuple[str, ...] = STEPS) -> tuple[str, list[tuple[str, int]]]:
    root = tree(markup)
    done = [(s, n) for s in steps if (n := _RUN[s](root))]
    return serialize(root), done


def _pages(steps: tuple[str, ...]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc"], pdf["html"], strict=True):
                out, done = rewrite(text, steps) if text else (text, [])
                rows.append((doc, out, [{"kind": k, "n": n} for k, n in done]))
            yield pd.DataFrame(rows, columns=["doc", "xhtml", "steps"])

    return run


def transform(df: DataFrame, doc: Column, html: Column, steps: tuple[str, ...] = STEPS) -> DataFrame:
    """Every page as strict XHTML with what each step did; null pages stay null. One map, no shuffle."""
    return df.select(doc.cast("string").alias("doc"), html.alias("html")).mapInPandas(_pages(steps), PAGES)


def step_counts(pages: DataFrame) -> DataFrame:
    return pages.select(F.explode("steps").alias("s")).groupBy(F.col("s.kind").alias("kind")).agg(F.sum("s.n").alias("n"), F.count("*").alias("n_pages"))


def compose_text(root: Node) -> int:
    """Text in composed form, without control characters; how many nodes changed."""
    n = 0
    for e in root.walk():
        if e.name == "#text":
            new = unicodedata.normalize("NFC", re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f﻿]", "", e.text))
            n += new != e.text
            e.text = new
    return n
