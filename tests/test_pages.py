"""Rules, ids, links and parts of pages; whole metadata records; escapes, names and sheets."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bookspark.functions import paths
from bookspark.operators import merge, naming, pages, relations, transforms
from bookspark.operators.filters import Rule
from bookspark.sources import css, documents

REMOVE = Rule("remove", "ad")
LINK = Rule("remove", "ads.example", targets=frozenset({"href"}))
RULED = [
    ("<p>a harbour</p>", [Rule("replace", "harbour", "port")], "<p>a port</p>"),
    ('<p title="ad">x ad</p>', [REMOVE], '<p title="ad">x </p>'),
    ("<div><p><i>ad</i></p></div><p>k</p>", [REMOVE], "<p>k</p>"),
    ("<div><p>ad</p><img src='i'/></div>", [REMOVE], '<div><img src="i"/></div>'),
    ("<table><tr><td>ad</td></tr></table>", [REMOVE], "<table><tr><td></td></tr></table>"),
    ("<style>ad</style><script>ad</script><p>ad</p>", [REMOVE], "<style>ad</style><script>ad</script>"),
    ('<p>see <a href="http://ads.example/1">x</a></p>', [LINK], "<p>see </p>"),
    ('<div><a href="http://ads.example/1"><b>x</b></a></div>', [LINK], ""),
    ("<p>a<b>d</b></p>", [REMOVE], "<p>a<b>d</b></p>"),
    ("<p>one</p>", [Rule("replace", "one", "two"), Rule("replace", "two", "three")], "<p>three</p>"),
    ('<a href="x/y">x</a>', [Rule("replace", "x", "z", frozenset({"text", "href"}))], '<a href="z/y">z</a>'),
]


@pytest.mark.parametrize("markup,rules,want", RULED)
def test_rules(markup, rules, want):
    root = transforms.tree(markup)
    pages.apply_rules(root, rules)
    assert transforms.serialize(root) == want


def test_rule_counts(spark):
    df = spark.createDataFrame([("a", "<div><p>ad ad</p></div>"), ("b", None), ("c", "")], "d string, h string")
    got = {r.doc: (r.xhtml, r.removed, r.pruned) for r in pages.rule_pages(df, F.col("d"), F.col("h"), [REMOVE]).collect()}
    assert got == {"a": ("", 2, 2), "b": (None, 0, 0), "c": ("", 0, 0)}


def naive_parts(sizes, heads, budget):
    """The plan read straight from its definition."""
    out, start, n = [], 0, len(sizes)
    while start < n:
        if sum(sizes[start:]) <= budget:
            return [*out, (start, n)]
        if sizes[start] > budget:
            cut = start + 1
        else:
            end = max(e for e in range(start + 1, n + 1) if sum(sizes[start:e]) <= budget)
            tops = [i for i in range(start + 1, end + 1) if i < n and heads[i]]
            cut = min(tops, key=lambda i: (abs(sum(sizes[start:i]) - budget // 2), i)) if tops else end
        out.append((start, cut))
        start = cut
    return out


@given(st.lists(st.tuples(st.integers(1, 40), st.booleans()), min_size=1, max_size=14), st.integers(5, 80))
@settings(max_examples=300, deadline=None)
def test_plan_of_parts(blocks, budget):
    sizes, heads = [b for b, _ in blocks], [h for _, h in blocks]
    assert pages.plan_parts(sizes, heads, budget) == naive_parts(sizes, heads, budget)


def test_aliases_and_parts_across_pages(spark):
    long = "<p>" + "w" * 60 + "</p>"
    rows = [("b", "t/a.xhtml", f'<html><body><h1 id="top"><span id="in">x</span></h1>{long}<h2 id="two">y</h2>{long}<p><a href="#in">i</a><a href="#two">2</a></p></body></html>'), ("b", "t/c.xhtml", '<html><body><a href="a.xhtml#in">i</a><a href="a.xhtml#two">2</a><a href="a.xhtml">a</a><a href="http://x/a.xhtml#in">o</a></body></html>'), ("n", "t/a.xhtml", None)]
    p = spark.createDataFrame(rows, "book_id string, path string, html string")
    moved = pages.move_ids(p)
    a = moved.where("book_id = 'b'").select("book_id", "path", F.inline("aliases"))
    assert [(r.id, r.onto) for r in a.collect()] == [("in", "top")]
    texts = pages.follow_aliases(moved.select("book_id", "path", F.col("xhtml").alias("html")), a).select("book_id", "path", F.col("xhtml").alias("html"))
    c = texts.where("path = 't/c.xhtml'").first().html
    assert 'href="a.xhtml#top"' in c and 'href="http://x/a.xhtml#in"' in c
    parts = pages.retarget_parts(pages.split_pages(texts, 200))
    by = {r.part_path: r.xhtml for r in parts.collect()}
    assert set(by) == {"t/a-1.xhtml", "t/a-2.xhtml", "t/c.xhtml"}
    assert 'href="a-1.xhtml#top"' in by["t/c.xhtml"] and 'href="a-2.xhtml#two"' in by["t/c.xhtml"] and 'href="a-1.xhtml"' in by["t/c.xhtml"]
    assert 'href="a-1.xhtml#top"' in by["t/a-2.xhtml"] and 'href="#two"' in by["t/a-2.xhtml"]
    spine = spark.createDataFrame([("b", 0, "t/c.xhtml"), ("b", 1, "t/a.xhtml")], "book_id string, ord int, path string")
    assert [r.path for r in pages.retarget_spine(spine, parts).orderBy("ord").collect()] == ["t/c.xhtml", "t/a-1.xhtml", "t/a-2.xhtml"]


def test_ids_above_the_cap(spark):
    ids = spark.createDataFrame([("b", "p", f"i{k}") for k in range(6)] + [("b", "q", "i0")], "book_id string, path string, id string")
    used = spark.createDataFrame([("b", "i1"), ("c", "i2")], "book_id string, fragment string")
    assert {r.id for r in naming.cap_ids(ids, used, ["book_id", "path"], 5).collect()} == {"i0", "i2", "i3", "i4", "i5"}
    root = transforms.tree("".join(f"<p id='x{k}'>.</p>" for k in range(4)))
    assert pages.cap_page_ids(root, frozenset(("x1",)), 3) == 3 and transforms.serialize(root).count("id=") == 1


@given(st.text(alphabet="%aé0F/+ C39", max_size=14))
@settings(max_examples=15, deadline=None)
def test_percent_decode(spark, text):
    from urllib.parse import unquote

    got = spark.createDataFrame([(text,)], "t string").select(paths.percent_decode(F.col("t"))).first()[0]
    assert got == unquote(text)


def test_documents_over_books(spark):
    person = "array<struct<name:string,file_as:string,role:string>>"
    m = spark.createDataFrame([("a", "Untitled", "en", "urn:a", None, [], [("978-1", "ISBN")], [], None, "House", None, None, None), ("b", "B", "en", None, [("Ann", None, None)], None, None, ["s"], "d", None, None, None, ("S", None))], f"book_id string, title string, language string, identifier string, authors {person}, contributors {person}, identifiers array<struct<value:string,scheme:string>>, subjects array<string>, description string, publisher string, date string, rights string, series struct<name:string,index:string>")
    texts = spark.createDataFrame([("a", "title: New\nauthor: Bob\nidentifier: other\nisbn: 978-1\npublisher: X\nseries: T\nseries_index: 2\n"), ("b", '{"identifier": "urn:b", "series_index": "3", "subjects": ["t"]}'), ("c", "x: [")], "i string, t string")
    docs = documents.documents(texts, F.col("i"), F.col("t"))
    assert docs.where("error is not null").first().doc_id == "c"
    docs = docs.where("error is null").withColumnRenamed("doc_id", "book_id").drop("error")
    fill = {r.book_id: r for r in merge.apply_documents(m, docs, "fill").collect()}
    assert fill["a"].title == "New" and fill["a"].publisher == "House" and fill["a"].identifier == "urn:a" and fill["a"].warning and [i.value for i in fill["a"].identifiers] == ["978-1", "other"] and fill["a"].series["index"] == "2" and fill["a"].authors[0].name == "Bob"
    assert fill["b"].identifier == "urn:b" and fill["b"].warning is None and fill["b"].series["index"] == "3" and fill["b"].subjects == ["s"] and set(fill["b"].changed) == {"series", "identifier"}
    over = {r.book_id: r for r in merge.apply_documents(m, docs, "replace", F.array(F.lit("description"))).collect()}
    assert over["a"].publisher == "X" and over["b"].subjects == ["t"] and over["b"].description is None
    assert merge.apply_documents(m.limit(0), docs).count() == 0


def test_sheets_with_conditions(spark):
    text = "@charset 'x';@media print{p{color:red}a{margin:0}}h1{margin:0!important}"
    df = spark.createDataFrame([("s", text)], "s string, c string")
    cut = df.select(css.split_by_bytes(F.col("c"), 40)).first()[0]
    assert cut == ["@charset 'x';", "@media print{p{color:red}a{margin:0}}", "h1{margin:0!important}"]
    back = css.emit(css.rules(df, F.col("s"), F.col("c"))).first().css
    assert "@media print{p{color:red}}" in back and "h1{margin:0!important}" in back
    assert [r[0] for r in spark.createDataFrame([("a/m.css", 1), ("a/m.css", 2), ("m", 3)], "p string, n int").select(css.part_path(F.col("p"), F.col("n"))).collect()] == ["a/m.css", "a/m-2.css", "m-3"]


def test_names_and_chains(spark):
    d = spark.createDataFrame([("b", k, s) for k, s in enumerate(("x", "x", "x", "y"))], "b string, k int, s string")
    assert [r.a for r in naming.dedupe(d, ["b"], "s", ["k"], "a").orderBy("k").collect()] == ["x", "x-2", "x-3", "y"]
    chains = {r.copy: (r.source, r.depth) for r in relations.follow(spark.createDataFrame([(k, k - 1) for k in range(1, 20)] + [(40, 30)], "b bigint, a bigint")).collect()}
    assert chains[19] == (0, 19) and chains[40] == (30, 1)
    files = spark.createDataFrame([("One.Fitted.EPUB",), ("two.epub",), ("fitted.epub",)], "name string")
    assert [r.name for r in relations.prior_outputs(files, relations.output_suffixes(spark.createDataFrame([("Pocket",), (None,)], "appendix string"))).collect()] == ["One.Fitted.EPUB"]
