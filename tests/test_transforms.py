from xml.etree import ElementTree as ET

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bookspark.operators import transforms as tf

CASES = [
    ('<ol start="3"><li>a</li><li value="7">b<ol type="a"><li>c</li></ol></li></ol>', "lists", "<p>3. a</p><p>7. b</p><p>7.a. c</p>"),
    ("<aside> </aside><aside>x <b>y</b></aside><aside><p>z</p></aside>", "boxes", "<p>x <b>y</b></p><p>z</p>"),
    ("<figure><figcaption>c</figcaption><img src='i'/></figure>", "boxes", '<img src="i"/><p>c</p>'),
    ("<dl><dt>t</dt><dd>d</dd></dl>", "boxes", "<p>t</p><p>d</p>"),
    ("<pre>a\n  b  c d</pre>", "code", "<p>a<br/>\u00a0\u00a0b\u00a0\u00a0c d</p>"),
    ("<a href='javascript:go(\"#n1\")'>x</a><a href=' JavaScript:z()'>y</a>", "links", '<a href="#n1">x</a>y'),
    ("<p id='a'>x</p><p id='a'>y</p>", "ids", '<p id="a">x</p><p>y</p>'),
]


@pytest.mark.parametrize("markup,step,want", CASES)
def test_steps(markup, step, want):
    assert tf.rewrite(markup, (step,))[0] == want


@given(st.text(alphabet="<>/abpolidt =\"'&;-!1", max_size=80))
@settings(max_examples=300, deadline=None)
def test_strict_and_fixed(markup):
    once = tf.rewrite(markup)[0]
    ET.fromstring(f"<r>{once}</r>")
    assert tf.rewrite(once)[0] == once


def test_pages(spark):
    df = spark.createDataFrame([("a", "<ol><li>x</ol>"), ("b", None), ("c", "")], "d string, h string")
    out = tf.transform(df, F.col("d"), F.col("h"))
    assert {r.doc: r.xhtml for r in out.collect()} == {"a": "<p>1. x</p>", "b": None, "c": ""}
    assert [(r.kind, r.n) for r in tf.step_counts(out).collect()] == [("lists", 1)]
