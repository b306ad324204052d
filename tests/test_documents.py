"""HTML, CSS, Markdown, images, packing: small cases and properties."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bookspark.functions import paths, text
from bookspark.operators import packing
from bookspark.sources import catalogue, css, html, images, markdown


def test_implied_ends():
    rows = html.parse("<ul><li>a<li>b<ul><li>c</ul></ul><p>x<p>y<table><tr><td>1<td>2<tr><td>3</table>")
    depth = {r[7]: r[3] for r in rows if r[4] == "text"}
    assert depth["a"] == depth["b"] == 2 and depth["c"] == 4 and depth["x"] == depth["y"] == 1
    assert len([r for r in rows if r[5] == "tr"]) == 2 and len([r for r in rows if r[5] == "td"]) == 3


@given(st.text(alphabet="<>/abp ul=\"'&;", max_size=60))
@settings(max_examples=150, deadline=None)
def test_intervals_nest(markup):
    rows = html.parse(markup)
    for pre, post, parent, *_ in rows:
        assert pre <= post < len(rows) or not rows
        if parent >= 0:
            assert rows[parent][0] < pre and rows[parent][1] >= post


def test_node_operators(spark):
    d = spark.createDataFrame([("d", '<div><script>q</script><p id="a" onclick="z">T <span id="s">in</span></p><p id="a">U</p><table><tr><th>H</th></tr><tr><td>1</td></tr></table></div>')], "d string, h string")
    n = html.nodes(d, F.col("d"), F.col("h"))
    assert "q" not in [r.text for r in html.prose(n).collect()]
    assert html.drop_subtrees(n, ("script",)).where("text = 'q' or name = 'script'").count() == 0
    assert html.without_handlers(n).where("attrs['onclick'] is not null").count() == 0
    assert html.first_ids(n).where("attrs['id'] = 'a'").count() == 1
    assert html.relocate_ids(n).first().alias == "a"
    assert [r.line for r in html.linearize(html.table_cells(n)).collect()] == ["H: 1"]
    assert html.nodes(spark.createDataFrame([("x", None)], "d string, h string"), F.col("d"), F.col("h")).count() == 0


def test_css(spark):
    sheet = "@import 'x'; p, .a > b {margin: 0; color: red; padding: calc(1px + 2px)} @media print {p{margin:1px}} @media screen {.c{text-align:left !important}} p{--x:1}"
    r = css.rules(spark.createDataFrame([("s", sheet)], "s string, c string"), F.col("s"), F.col("c"))
    once = css.emit(css.subset(r)).first().css
    again = css.emit(css.subset(css.rules(spark.createDataFrame([("s", once)], "s string, c string"), F.col("s"), F.col("c")))).first().css
    assert once == again == "p{margin:0}.c{text-align:left}"
    assert css.sanitized(r).where("prop = '--x' or value like '%calc%'").count() == 0
    parts = spark.range(1).select(css.split_by_bytes(F.lit("a{b:c}d{e:f}g{h:i}"), 12).alias("p")).first().p
    assert parts == ["a{b:c}d{e:f}", "g{h:i}"]


def test_markdown(spark):
    md = "---\ntitle: Own\n---\nintro[^n]\n\n# One\n\n```\n# no heading\n```\n\n# One\n\ntext[^n]\n\n[^n]: note\n[^q]: other\n"
    b = markdown.blocks(spark.createDataFrame([("d", md), ("e", None)], "d string, m string"), F.col("d"), F.col("m"))
    c = markdown.chunks(b)
    assert c.agg(F.max("chunk")).first()[0] == 2
    assert markdown.titles(b).first().title == "Own"
    assert {(r.note, r.chunk, r.shared) for r in markdown.note_homes(b, c).collect()} == {("n", 0, True), ("q", 2, False)}
    assert [r.anchor for r in markdown.heading_anchors(c).orderBy("ord").collect()] == ["one", "one"]


def test_images(spark):
    png = bytes.fromhex("89504E470D0A1A0A0000000D49484452000001000000002000")
    jpg = bytes.fromhex("FFD8FFE00004AAAAFFC2000B08001000200101110000")
    df = spark.createDataFrame([(bytearray(png),), (bytearray(jpg),), (bytearray(b"GIF89a\x05\x00\x07\x00"),), (None,)], "b binary")
    w, h = images.png_gif_size(F.col("b"))
    rows = df.select(images.sniff(F.col("b")).alias("k"), w.alias("w"), h.alias("h"), images.jpeg_probe(F.col("b")).alias("j")).collect()
    assert [(r.k, r.w, r.h) for r in rows] == [("png", 256, 32), ("jpeg", None, None), ("gif", 5, 7), (None, None, None)]
    assert (rows[1].j.width, rows[1].j.height, rows[1].j.progressive) == (32, 16, True)
    ramp = np.arange(100, 150, dtype=np.uint8).repeat(20)
    assert images.autocontrast(ramp).min() == 0 and images.autocontrast(ramp).max() == 255
    assert images.line_art(np.zeros((4, 4), np.uint8)) and images.fit_box(100, 50, 40, 40) == (40, 20)


def test_catalogue(spark):
    body = '{"docs":[{"key":"/w/1","title":"The Sea","author_name":["A B"]},{"title":"no key"},{"key":"/w/2","title":"Sea"}]}'
    df = spark.createDataFrame([(body,), ("broken",)], "body string")
    assert [(r.ref, round(r.score, 1)) for r in catalogue.search(df, want_title="sea").collect()] == [("/w/2", 1.0), ("/w/1", 0.6)]
    one = spark.createDataFrame([('["a","b"]',), ('"a"',), ("a",), (None,)], "v string").select(catalogue.one_or_many(F.col("v")).alias("x")).collect()
    assert [r.x for r in one] == [["a", "b"], ["a"], ["a"], None]


def test_scalars(spark):
    one = spark.range(1)
    f = lambda c: one.select(c.alias("x")).first().x
    assert f(paths.normalize_href(F.lit("a/b"), F.lit("../c%20d.html#x%20y"))) == "a/c d.html#x y"
    assert f(paths.percent_decode(F.lit("50%"))) == "50%" and f(paths.percent_decode(F.lit("a+b%41"))) == "a+bA"
    assert f(paths.relative_href(F.lit("a/b"), F.lit("a/c d/e.x"))) == "../c%20d/e.x"
    assert f(text.wrap(F.lit("aa bbb cccccccc"), 6)) == ["aa bbb", "cccccc", "cc"] and f(text.wrap(F.lit(""), 5)) == [""]
    assert [f(text.alpha(F.lit(n))) for n in (0, 1, 26, 27, 703)] == ["0", "a", "z", "aa", "aaa"]
    assert [f(text.roman(F.lit(n))) for n in (0, 4, 1994, 4000)] == ["0", "iv", "mcmxciv", "4000"]


@given(st.lists(st.tuples(st.floats(-50, 50), st.floats(0.1, 5)), min_size=1, max_size=25), st.floats(0, 3))
@settings(max_examples=100, deadline=None)
def test_isotonic(pairs, gap):
    v, w = zip(*pairs, strict=True)
    out = packing.isotonic(list(v), list(w), gap)
    assert all(b - a >= gap - 1e-6 for a, b in zip(out, out[1:], strict=False))
    if all(b - a >= gap for a, b in zip(v, v[1:], strict=False)):
        assert all(abs(a - b) < 1e-6 for a, b in zip(v, out, strict=True))


def test_greedy(spark):
    df = spark.createDataFrame([([5, 5, 1, 20, 3],), ([],), ([7],)], "s array<int>")
    assert [r.b for r in df.select(packing.greedy_bins(F.col("s"), F.lit(10)).alias("b")).collect()] == [[0, 0, 1, 2, 3], [], [0]]
    assert packing.nearest_heading_cut([0, 40, 60, 90], [True, True, True, False], 100) == 1
