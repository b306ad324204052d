"""HTML as a node table: one row per element, text and comment with its interval in document order."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NODES = "doc string, pre int, post int, parent int, depth int, kind string, name string, attrs map<string,string>, text string"
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: What an opening tag closes, fixed values of the language.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SCOPE = frozenset("table ul ol dl blockquote div section article body html".split())


class Tree(HTMLParser):
    """Flat list of nodes; missing end tags are implied as the language says."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []

    def _add(self, kind: str, name: str | None, attrs: dict | None, text: str | None) -> int:
        n = len(self.rows)
        self.rows.append([n, n, self.open[-1] if self.open else -1, len(self.open), kind, name, attrs, text])
        return n

    def _close_to(self, k: int) -> None:
        for i in self.open[k:]:
            self.rows[i][1] = len(self.rows) - 1
        del self.open[k:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        closes = _CLOSES.get(tag, set()) | ({"p"} if tag in _ENDS_P else set())
        for k in range(len(self.open) - 1, -1, -1):
            name = self.rows[self.open[k]][5]
            if name in closes:
                self._close_to(k)
                if tag not in ("tr", "tbody"):
                    break
            elif name in _SCOPE and tag != name:
                break
        first: dict[str, str] = {}
        for a, v in attrs:
            first.setdefault(a, v or "")
        n = self._add("element", tag, first, None)
        if tag not in VOID:
            self.open.append(n)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open:
            self._close_to(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[k]][5] == tag:
                self._close_to(k)
                return

    def handle_data(self, data: str) -> None:
        self._add("text", None, None, data)

    def handle_comment(self, data: str) -> None:
        self._add("comment", None, None, data)

    def finish(self) -> list[list]:
        self.close()
        self._close_to(0)
        return self.rows


def parse(html: str) -> list[list]:
    tree = Tree()
    tree.feed(html)
    return tree.finish()


def _nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in NODES.replace("map<string,string>", "map").split(", ")]
    for pdf in batches:
        rows: list[list] = []
        for doc, text in zip(pdf["doc"], pdf["html"], strict=True):
            rows += [[doc, *r] for r in parse(text)] if text else []
            if len(rows) >= 20_000:
                yield pd.DataFrame(rows, columns=columns)
                rows = []
        yield pd.DataFrame(rows, columns=columns)


def nodes(df: DataFrame, doc: Column, html: Column) -> DataFrame:
    """The node table of every document; null or empty ones have no rows."""
    return df.select(doc.cast("string").alias("doc"), html.alias("html")).mapInPandas(_nodes, NODES)


def prose(n: DataFrame) -> DataFrame:
    """Text that a reader sees: not that of styles and scripts."""
    quiet = n.where("name in ('style', 'script')").select("doc", F.col("pre").alias("parent"))
    return n.where("kind = 'text'").join(quiet, ["doc", "parent"], "left_anti")


def drop_subtrees(n: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Without the named elements and all below them."""
    roots = n.where(F.col("name").isin(*names)).select("doc", F.col("pre").alias("lo"), F.col("post").alias("hi"))
    return n.join(roots, (n["doc"] == roots["doc"]) & n["pre"].between(roots["lo"], roots["hi"]), "left_anti")


def without_handlers(n: DataFrame) -> DataFrame:
    """Without attributes that run code."""
    return n.withColumn("attrs", F.map_filter("attrs", lambda k, _: ~F.lower(k).startswith("on")))


def first_ids(n: DataFrame) -> DataFrame:
    """Of elements with one id the first keeps it."""
    w = Window.partitionBy("doc", F.col("attrs")["id"]).orderBy("pre")
    held = F.when(F.col("attrs")["id"].isNotNull(), F.row_number().over(w)).otherwise(1) == 1
    return n.withColumn("keeps", held).withColumn("attrs", F.when(F.col("keeps"), F.col("attrs")).otherwise(F.map_filter("attrs", lambda k, _: k != "id"))).drop("keeps")


#: Inline elements whose ids move to the block around them, and those blocks. Fixed values.
INLINE = tuple("a span em strong b i u small sub sup cite".split())
BLOCKS = tuple("p div section article aside blockquote h1 h2 h3 h4 h5 h6 li dt dd td th pre figure figcaption ul ol table body".split())


def relocate_ids(n: DataFrame) -> DataFrame:
    """(doc, id, onto): each inline id with the place of the nearest block around it, which takes it unless it has one (then an alias)."""
    inner = n.where(F.col("name").isin(*INLINE) & F.col("attrs")["id"].isNotNull()).select("doc", F.col("pre").alias("at"), F.col("attrs")["id"].alias("id"))
    block = n.where(F.col("name").isin(*BLOCKS)).select("doc", "pre", "post", F.col("attrs")["id"].alias("block_id"))
    near = inner.join(block, "doc").where("at between pre and post").groupBy("doc", "at", "id").agg(F.max_by(F.struct("pre", "block_id"), "pre").alias("b"))
    return near.select("doc", "id", F.col("b.pre").alias("onto"), F.col("b.block_id").alias("alias"))


def subtree_text(n: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(doc, pre, name, text) of the named elements: all text below them in order."""
    top = n.where(F.col("name").isin(*names)).select("doc", "pre", "post", "name")
    text = n.where("kind = 'text'").select("doc", F.col("pre").alias("at"), F.col("text").alias("piece"))
    return top.join(text, "doc").where("at between pre and post").groupBy("doc", "pre", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), "").alias("text"))


def table_cells(n: DataFrame) -> DataFrame:
    """(doc, table, row, col, header, text) of every cell, numbered within its own table."""
    cells = subtree_text(n, ("td", "th"))
    every = n.where("name in ('td', 'th')").select("doc", "pre", "name").join(cells.select("doc", "pre", "text"), ["doc", "pre"], "left")
    rows = n.where("name = 'tr'").select("doc", F.col("pre").alias("row_pre"), F.col("post").alias("row_post"))
    tables = n.where("name = 'table'").select("doc", F.col("pre").alias("table"), F.col("post").alias("table_post"))
    placed = every.join(rows, "doc").where("pre between row_pre and row_post").groupBy("doc", "pre", "name", "text").agg(F.max("row_pre").alias("row_pre"))
    placed = placed.join(tables, "doc").where("pre between table and table_post").groupBy("doc", "pre", "name", "text", "row_pre").agg(F.max("table").alias("table"))
    row = F.dense_rank().over(Window.partitionBy("doc", "table").orderBy("row_pre"))
    col = F.row_number().over(Window.partitionBy("doc", "table", "row_pre").orderBy("pre"))
    return placed.select("doc", "table", row.alias("row"), col.alias("col"), (F.col("name") == "th").alias("header"), F.trim(F.coalesce("text", F.lit(""))).alias("text"))


def linearize(cells: DataFrame) -> DataFrame:
    """(doc, table, row, line): cells as "header: value" under a header row, else joined by dashes."""
    head = cells.where("row = 1 and header").select("doc", "table", "col", F.col("text").alias("head"))
    body = cells.where("not (row = 1 and header)").join(head, ["doc", "table", "col"], "left")
    piece = F.when(F.col("head").isNotNull() & (F.col("head") != ""), F.concat("head", F.lit(": "), "text")).otherwise(F.col("text"))
    grouped = body.where("text <> ''").groupBy("doc", "table", "row").agg(F.array_sort(F.collect_list(F.struct("col", piece.alias("piece")))).alias("p"), F.max(F.col("head").isNotNull()).alias("headed"))
    pieces = F.transform("p", lambda x: x["piece"])
    return grouped.select("doc", "table", "row", F.when(F.col("headed"), F.array_join(pieces, "\n")).otherwise(F.array_join(pieces, " — ")).alias("line"))


def _pages(schema: str, one):
    """A batch function that gives rows of ``schema`` for each page, from its flat nodes; linear in the page."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(doc, *r) for doc, text in zip(pdf["doc"], pdf["html"], strict=True) if text for r in one(parse(text))]
            yield pd.DataFrame(rows, columns=columns)

    return run


def _by_page(df: DataFrame, doc: Column, html: Column, schema: str, one) -> DataFrame:
    return df.select(doc.cast("string").alias("doc"), html.alias("html")).mapInPandas(_pages(schema, one), schema)


def page_elements(df: DataFrame, doc: Column, html: Column) -> DataFrame:
    """(doc, name, n) of the elements of every page, counted within the map, so only counts travel."""

    def one(rows: list[list]):
        return Counter(r[5] for r in rows if r[4] == "element").items()

    return _by_page(df, doc, html, "doc string, name string, n int", one)


def page_texts(df: DataFrame, doc: Column, html: Column, names: tuple[str, ...]) -> DataFrame:
    """(doc, pre, name, text) as ``subtree_text`` gives, without a join."""

    def one(rows: list[list]):
        for pre, post, _, _, kind, name, _, _ in rows:
            if kind == "element" and name in names:
                yield pre, name, "".join(r[7] for r in rows[pre:post + 1] if r[4] == "text")

    return _by_page(df, doc, html, "doc string, pre int, name string, text string", one)


def page_cells(df: DataFrame, doc: Column, html: Column) -> DataFrame:
    """(doc, table, row, col, header, text) as ``table_cells`` gives, without a join."""

    def one(rows: list[list]):
        def above(k: int, name: str) -> int:
            k = rows[k][2]
            while k >= 0 and rows[k][5] != name:
                k = rows[k][2]
            return k

        place: dict[int, dict[int, int]] = {}
        width: Counter = Counter()
        for pre, post, _, _, kind, name, _, _ in rows:
            if kind == "element" and name in ("td", "th") and (tr := above(pre, "tr")) >= 0 and (table := above(pre, "table")) >= 0:
                lines = place.setdefault(table, {})
                row = lines.setdefault(tr, len(lines) + 1)
                width[tr] += 1
                yield table, row, width[tr], name == "th", "".join(r[7] for r in rows[pre:post + 1] if r[4] == "text").strip(" ")

    return _by_page(df, doc, html, "doc string, table int, row int, col int, header boolean, text string", one)


def page_id_moves(df: DataFrame, doc: Column, html: Column) -> DataFrame:
    """(doc, id, onto, alias) as ``relocate_ids`` gives, without a join."""

    def one(rows: list[list]):
        for _, _, parent, _, kind, name, attrs, _ in rows:
            if kind == "element" and name in INLINE and "id" in attrs:
                while parent >= 0 and rows[parent][5] not in BLOCKS:
                    parent = rows[parent][2]
                if parent >= 0:
                    yield attrs["id"], parent, rows[parent][6].get("id")

    return _by_page(df, doc, html, "doc string, id string, onto int, alias string", one)
