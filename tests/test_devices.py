"""Palettes, raster pictures, profiles and the checks of a device, against brute force and Spark's own decoder."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bookspark.functions import color
from bookspark.operators import lint, palette, relations
from bookspark.sources import css, profiles, raster

TONES = st.lists(st.tuples(st.floats(0, 100), st.floats(0, 30), st.floats(0.5, 5)), min_size=1, max_size=4)


@given(TONES)
@settings(max_examples=60, deadline=None)
def test_spread_is_least_squares(raw):
    """No grid of tones in order, a gap apart and within the ranges is better."""
    tones = sorted((palette.Tone(t, w, max(0, t - r), min(100, t + r)) for t, r, w in raw), key=lambda x: x.want)
    gap = 8.0
    if not palette.keeps_apart(tones, gap):
        return
    got = palette.spread(tones, gap)
    assert all(b - a >= gap - 1e-3 for a, b in zip(got, got[1:], strict=False))
    if any(not t.low - 1e-3 <= g <= t.high + 1e-3 for t, g in zip(tones, got, strict=True)):
        return  # pooling is exact in the order, the ranges bend it
    cost = sum(t.weight * (g - t.want) ** 2 for t, g in zip(tones, got, strict=True))
    grid = [np.linspace(t.low, t.high, 12) for t in tones]
    best = min((sum(t.weight * (g - t.want) ** 2 for t, g in zip(tones, c, strict=True)) for c in itertools.product(*grid) if all(b - a >= gap for a, b in zip(c, c[1:], strict=False))), default=None)
    assert best is None or cost <= best + 1e-3


@given(st.lists(st.tuples(st.integers(0, 255), st.integers(0, 255), st.integers(0, 255)), min_size=1, max_size=12, unique=True), st.sampled_from([4, 16]))
@settings(max_examples=60, deadline=None)
def test_solve(colours, levels):
    got, collapsed = palette.solve([(c, "text" if k % 2 else "border", k + 1) for k, c in enumerate(colours)], levels)
    assert len(got) == len(colours) and set(got.values()) <= set(color.panel_levels(levels)) and 0 <= collapsed <= len(colours)
    order = sorted(got, key=lambda k: palette.tone_of(k[0], k[1], 1).want)
    assert all(got[a] <= got[b] for a, b in zip(order, order[1:], strict=False))


def test_colours_of_sheets(spark):
    text = "p{color:#c00;background:rgb(255 255 200)}@media screen{h1{border-top-color:navy}}a{margin:0 red}"
    sheets = spark.createDataFrame([("b", text), ("b", text), ("c", "p{margin:0}"), ("d", None)], "scope string, text string")
    rules = css.rules(sheets, F.col("scope"), F.col("text"))
    seen = palette.collect(rules, F.col("sheet"))
    assert {(r.role, r.weight) for r in seen.collect()} == {("text", 2), ("ground", 2), ("border", 2)}
    p = palette.palettes(seen, 16)
    out = {r.scope: (r.new_text, r.n_changed) for r in palette.rewrite(sheets.distinct(), p).collect()}
    assert out["b"][1] == 3 and "navy" not in out["b"][0] and "margin:0 red" in out["b"][0] and out["c"] == (None, 0) and out["d"] == (None, 0)
    assert palette.lookup(seen, p).where("gray is null").count() == 0


def pictures():
    rng = np.random.default_rng(1)
    y, x = np.mgrid[0:90, 0:70]
    g = ((np.sin(x / 9) + np.cos(y / 13)) * 60 + 128).astype(np.uint8)
    return {"gray": g, "rgb": np.stack([g, 255 - g, (x * 3 % 256).astype(np.uint8)], 2), "noise": rng.integers(0, 256, (40, 33), dtype=np.uint8), "dot": np.zeros((1, 1), np.uint8)}


def test_jpeg_against_the_decoder_of_spark(spark, tmp_path):
    for name, px in pictures().items():
        (tmp_path / f"{name}.jpg").write_bytes(raster.encode_jpeg(px, 95))
        row = spark.read.format("image").load(f"file://{tmp_path}/{name}.jpg").select("image.*").first()
        back = np.frombuffer(bytes(row.data), np.uint8).reshape(row.height, row.width, row.nChannels).astype(int)
        want = (px[..., None] if px.ndim == 2 else px[..., ::-1]).astype(int)
        assert back.shape == want.shape and np.abs(back - want).mean() < 3


@given(st.integers(1, 20), st.integers(1, 20), st.sampled_from([1, 3]), st.integers(0, 2**32 - 1))
@settings(max_examples=40, deadline=None)
def test_png_round_trip(w, h, n, seed):
    px = np.random.default_rng(seed).integers(0, 256, (h, w) if n == 1 else (h, w, 3), dtype=np.uint8)
    assert (raster.decode(raster.encode_png(px)) == px).all()


def test_budget_and_tiles():
    noise = pictures()["noise"]
    data, w, h, q, over = raster.fit_budget(noise, 82, 900)
    assert len(data) <= 900 and not over and (q == raster.FLOOR or (w, h) == (33, 40))
    assert raster.fit_budget(noise, 82, 10)[4]
    assert raster.tile_rows(1600, 800) == [] and raster.tile_rows(2000, 800)[-1][1] == 2000
    caps = profiles.compose(["x4"]).caps
    assert raster.process(b"\xff\xd8\xff", caps, 82)[0][0] is None
    tall = np.repeat(np.arange(200, dtype=np.uint8)[None, :], 1000, 0)
    assert len(raster.process(raster.encode_png(tall), profiles.Caps(100, 200, "gray16", 100, 200), 82, tiles=True)) > 1


def test_profiles(spark, tmp_path):
    o = profiles.compose(["X4", {"features": {"split": False}, "rules": [{"action": "remove", "match": "ad"}]}, {"quality": 70}], quality=None, chapter_kb=9)
    assert o.quality == 70 and o.chapter_kb == 9 and not o.on("split") and o.on("boxes") and o.caps.css_rules == 1500 and o.rules[0].match == "ad" and not o.remaps
    assert profiles.compose([]).features == profiles.REPAIR and profiles.compose(["kindle"]).chapter_kb == 20480
    assert profiles.catalogue(spark).count() == 27
    (tmp_path / "own.json").write_text('{"base": "kindle", "quality": 60}')
    assert profiles.compose([str(tmp_path / "own.json")]).caps.width == 1072
    for bad in ('{"colour": 1}', '{"caps": {"w": 1}}', '{"features": {"x": true}}', '{"rules": [{"action": "remove", "match": "x", "why": 1}]}'):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(ValueError):
            profiles.load_layer(str(tmp_path / "bad.json"))
    with pytest.raises(KeyError):
        profiles.load_layer("nowhere")


def test_device_checks(spark):
    caps = profiles.compose(["x4"]).caps
    big = raster.encode_png(np.zeros((900, 10), np.uint8))
    rows = [("b", "a.svg", b"<?xml version='1.0'?><svg/>", None), ("b", "b.png", big, "image/png"), ("b", "c.webp", b"RIFF0000WEBPVP8 ", None), ("b", "d.css", b"p{}" * 60_000, "text/css"), ("b", "e.xhtml", b"<p>x", None), ("b", "f.xhtml", "é".encode(), None), ("b", "g.png", None, "image/png")]
    e = spark.createDataFrame([(b, p, None if d is None else bytearray(d), t) for b, p, d, t in rows], "book_id string, path string, data binary, declared string")
    got = {(r.path, r.severity) for r in lint.image_format(e, caps).collect()}
    assert got == {("a.svg", "error"), ("b.png", "error"), ("c.webp", "error")}
    assert {(r.path, r.severity) for r in lint.css_caps(e.where("path like '%.css'"), caps).collect()} == {("d.css", "error"), (None, "warning")}
    assert [r.path for r in lint.content_wellformed(e.where("path like '%.xhtml'")).collect()] == ["e.xhtml", "f.xhtml"]
    assert [(r.path, r.severity) for r in lint.encoding(e.where("data is not null")).collect()] == [("f.xhtml", "warning")]


def test_table_facts(spark):
    pages = spark.createDataFrame([(1, "<table><thead><tr><th>a</th></tr></thead>" + "<tr><td>1</td></tr>" * 24 + "</table><table><tr><td id='x'>1</td></tr></table>"), (1, "same key"), (2, None)], "k int, html string")
    rows = relations.table_facts(relations.tables_of(pages.where("html <> 'same key' or html is null"), "k")).withColumn("fate", relations.table_fate()).orderBy("table_id").collect()
    assert [(r.n_rows, r.n_body, r.fate) for r in rows] == [(25, 24, "image"), (1, 1, "text")]
