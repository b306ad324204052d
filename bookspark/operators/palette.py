"""Colours of style sheets and vector pictures on panels of few grays: collect, solve, rewrite.

Colours are counted per scope (a book, a picture) and role with a map-side
sum; the distinct ones of a scope are one small group, which is solved; the
answer goes back as one map per scope.
"""

from __future__ import annotations

import colorsys
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookspark.functions import color

# fixed values: the least difference that is seen, what counts as one tone, how far a tone may move, limits of text and background
SEEN, SAME, SHIFT, TEXT_MOST, GROUND_LEAST = 10.0, 3.0, 30.0, 60.0, 80.0
#: Range of lightness of each role, and the role of each property.
RANGES = {"text": (0.0, TEXT_MOST), "ground": (GROUND_LEAST, 100.0), "border": (0.0, 100.0), "fill": (0.0, 100.0), "stroke": (0.0, 100.0), "stop": (0.0, 100.0)}
ROLES = {"color": "text", "background-color": "ground", "background": "ground", "border": "border", "border-color": "border", "border-top-color": "border", "border-right-color": "border", "border-bottom-color": "border", "border-left-color": "border", "fill": "fill", "stroke": "stroke", "stop-color": "stop"}
#: Named colours of the style language, in its order.
_NAMED = """aliceblue f0f8ff antiquewhite faebd7 aqua 00ffff aquamarine 7fffd4 azure f0ffff beige f5f5dc bisque ffe4c4 black 000000 blanchedalmond ffebcd blue 0000ff blueviolet 8a2be2 brown a52a2a burlywood deb887 cadetblue 5f9ea0 chartreuse 7fff00 chocolate d2691e
coral ff7f50 cornflowerblue 6495ed cornsilk fff8dc crimson dc143c cyan 00ffff darkblue 00008b darkcyan 008b8b darkgoldenrod b8860b darkgray a9a9a9 darkgreen 006400 darkgrey a9a9a9 darkkhaki bdb76b darkmagenta 8b008b darkolivegreen 556b2f darkorange ff8c00
darkorchid 9932cc darkred 8b0000 darksalmon e9967a darkseagreen 8fbc8f darkslateblue 483d8b darkslategray 2f4f4f darkslategrey 2f4f4f darkturquoise 00ced1 darkviolet 9400d3 deeppink ff1493 deepskyblue 00bfff dimgray 696969 dimgrey 696969 dodgerblue 1e90ff
firebrick b22222 floralwhite fffaf0 forestgreen 228b22 fuchsia ff00ff gainsboro dcdcdc ghostwhite f8f8ff gold ffd700 goldenrod daa520 gray 808080 green 008000 greenyellow adff2f grey 808080 honeydew f0fff0 hotpink ff69b4 indianred cd5c5c indigo 4b0082
ivory fffff0 khaki f0e68c lavender e6e6fa lavenderblush fff0f5 lawngreen 7cfc00 lemonchiffon fffacd lightblue add8e6 lightcoral f08080 lightcyan e0ffff lightgoldenrodyellow fafad2 lightgray d3d3d3 lightgreen 90ee90 lightgrey d3d3d3 lightpink ffb6c1
lightsalmon ffa07a lightseagreen 20b2aa lightskyblue 87cefa lightslategray 778899 lightslategrey 778899 lightsteelblue b0c4de lightyellow ffffe0 lime 00ff00 limegreen 32cd32 linen faf0e6 magenta ff00ff maroon 800000 mediumaquamarine 66cdaa mediumblue 0000cd
mediumorchid ba55d3 mediumpurple 9370db mediumseagreen 3cb371 mediumslateblue 7b68ee mediumspringgreen 00fa9a mediumturquoise 48d1cc mediumvioletred c71585 midnightblue 191970 mintcream f5fffa mistyrose ffe4e1 moccasin ffe4b5 navajowhite ffdead navy 000080
oldlace fdf5e6 olive 808000 olivedrab 6b8e23 orange ffa500 orangered ff4500 orchid da70d6 palegoldenrod eee8aa palegreen 98fb98 paleturquoise afeeee palevioletred db7093 papayawhip ffefd5 peachpuff ffdab9 peru cd853f pink ffc0cb plum dda0dd powderblue b0e0e6
purple 800080 rebeccapurple 663399 red ff0000 rosybrown bc8f8f royalblue 4169e1 saddlebrown 8b4513 salmon fa8072 sandybrown f4a460 seagreen 2e8b57 seashell fff5ee sienna a0522d silver c0c0c0 skyblue 87ceeb slateblue 6a5acd slategray 708090 slategrey 708090
snow fffafa springgreen 00ff7f steelblue 4682b4 tan d2b48c teal 008080 thistle d8bfd8 tomato ff6347 turquoise 40e0d0 violet ee82ee wheat f5deb3 white ffffff whitesmoke f5f5f5 yellow ffff00 yellowgreen 9acd32"""
NAMED = dict(zip(_NAMED.split()[::2], _NAMED.split()[1::2], strict=True))
COLOR = re.compile(r"#[0-9a-fA-F]{3,8}\b|\b(?:rgb|hsl)a?\([^()]*\)|(?<![\w#.-])(?:" + "|".join(sorted(NAMED, key=len, reverse=True)) + r")(?![\w-])", re.I)


def parse(text: str) -> tuple[int, int, int] | None:
    """A colour on white paper; None for what is fully transparent or no colour."""
    t = text.strip().lower()
    t = "#" + NAMED[t] if t in NAMED else t
    alpha = 1.0
    if t[:1] == "#" and len(t) in (4, 5, 7, 9):
        h = t[1:] if len(t) > 5 else "".join(c * 2 for c in t[1:])
        try:
            rgb = [int(h[i:i + 2], 16) for i in (0, 2, 4)]
            alpha = int(h[6:8], 16) / 255 if len(h) == 8 else 1.0
        except ValueError:
            return None
    elif m := re.fullmatch(r"(rgb|hsl)a?\(([^()]*)\)", t):
        parts = [p for p in re.split(r"[\s,/]+", m[2].strip()) if p]
        if len(parts) not in (3, 4):
            return None
        try:
            if len(parts) == 4:
                alpha = float(parts[3].rstrip("%")) / (100 if parts[3].endswith("%") else 1)
            if m[1] == "rgb":
                rgb = [round(float(p[:-1]) * 2.55) if p.endswith("%") else round(float(p)) for p in parts[:3]]
            else:
                hue, sat, light = float(parts[0].removesuffix("deg")) % 360 / 360, float(parts[1].rstrip("%")) / 100, float(parts[2].rstrip("%")) / 100
                rgb = [round(255 * v) for v in colorsys.hls_to_rgb(hue, light, sat)]
        except ValueError:
            return None
    else:
        return None
    alpha = min(1.0, max(0.0, alpha))
    if alpha == 0:
        return None
    return tuple(math.floor(min(255, max(0, c)) * alpha + 255 * (1 - alpha) + 0.5) for c in rgb)


def gray_lightness(v: int) -> float:
    u = v / 255
    y = u / 12.92 if u <= 0.04045 else ((u + 0.055) / 1.055) ** 2.4
    return 116 * (y ** (1 / 3) if y > color.EPSILON else (color.KAPPA * y + 16) / 116) - 16


def lightness(rgb: tuple[int, int, int]) -> float:
    """How light a colour looks, as the Column functions have it."""
    lin = [u / 12.92 if u <= 0.04045 else ((u + 0.055) / 1.055) ** 2.4 for u in (c / 255 for c in rgb)]
    x, y, z = ((t ** (1 / 3) if t > color.EPSILON else (color.KAPPA * t + 16) / 116) for t in (sum(m * c for m, c in zip(row, lin, strict=True)) / w for row, w in zip(color.MATRIX, color.WHITE, strict=True)))
    light, a, b = 116 * y - 16, 500 * (x - y), 200 * (y - z)
    chroma = math.hypot(a, b)
    if chroma < 1e-4:
        return min(100.0, max(0.0, light))
    hue = math.degrees(math.atan2(b, a)) % 360
    return min(100.0, max(0.0, light + (2.5 - 0.025 * light) * (0.116 * abs(math.sin(math.radians(hue - 90) / 2)) + 0.085) * chroma))


@dataclass
class Tone:
    """A wanted lightness with its weight, the range it may take, and the colours it stands for."""

    want: float
    weight: float
    low: float
    high: float
    of: list[int] = field(default_factory=list)

    def meets(self, other: Tone) -> bool:
        return max(self.low, other.low) <= min(self.high, other.high)

    def joined(self, other: Tone) -> Tone:
        w = self.weight + other.weight
        return Tone((self.want * self.weight + other.want * other.weight) / w, w, max(self.low, other.low), min(self.high, other.high), self.of + other.of)


def tone_of(rgb: tuple[int, int, int], role: str, weight: float) -> Tone:
    """Black and white stay what they are where the role allows; others may move by a bound within the range of the role."""
    least, most = RANGES[role]
    for pure, end in (((0, 0, 0), 0.0), ((255, 255, 255), 100.0)):
        if rgb == pure and end in (least, most):
            return Tone(end, weight, end, end)
    want = min(most, max(least, lightness(rgb)))
    return Tone(want, weight, max(least, want - SHIFT), min(most, want + SHIFT))


def keeps_apart(tones: list[Tone], gap: float) -> bool:
    """Whether all can lie a gap apart within their ranges: each as low as it may."""
    at = -math.inf
    for t in tones:
        at = max(t.low, at + gap)
        if at > t.high + 1e-4:
            return False
    return True


def grouped(tones: list[Tone], gap: float) -> list[Tone]:
    """Neighbours that look the same become one; then the closest pairs, until the rest can keep the gap."""
    out: list[Tone] = []
    for t in tones:
        if out and t.want - out[-1].want < SAME and out[-1].meets(t):
            out[-1] = out[-1].joined(t)
        else:
            out.append(t)
    while not keeps_apart(out, gap):
        near = [(b.want - a.want, k) for k, (a, b) in enumerate(zip(out, out[1:], strict=False)) if a.meets(b)]
        if not near:
            break
        k = min(near)[1]
        out[k:k + 2] = [out[k].joined(out[k + 1])]
    return out


def spread(tones: list[Tone], gap: float) -> list[float]:
    """Least squares to what is wanted, in order, a gap apart, within the ranges: pooled neighbours on values less their gaps."""
    pools: list[Tone] = []

    def level(p: Tone) -> float:
        return (p.low + p.high) / 2 if p.low > p.high else min(p.high, max(p.low, p.want))

    for k, t in enumerate(tones):
        p = Tone(t.want - k * gap, max(t.weight, 1e-7), t.low - k * gap, t.high - k * gap, [k])
        while pools and level(pools[-1]) > level(p) + 1e-6:
            p = pools.pop().joined(p)
        pools.append(p)
    return [level(p) + k * gap for p in pools for k in p.of]


def on_panel(tones: list[Tone], wanted: list[float], levels: int) -> list[int]:
    """A gray of the panel for each tone: the nearest within its range, the darker of two, and a step (two on fine panels) above the one before where the range allows."""
    grays = color.panel_levels(levels)
    light = [gray_lightness(v) for v in grays]
    step = 1 if levels <= 4 else 2
    out: list[int] = []
    for t, want in zip(tones, wanted, strict=True):
        within = [i for i, x in enumerate(light) if t.low - 1e-3 <= x <= t.high + 1e-3] or range(len(grays))
        i = min(within, key=lambda i: (abs(light[i] - want), i))  # noqa: B023
        if out and i < out[-1] + step:
            i = next((k for k in range(out[-1] + step, len(grays)) if light[k] <= t.high + 1e-3), out[-1])
        out.append(i)
    return [grays[i] for i in out]


def solve(colours: list[tuple[tuple[int, int, int], str, int]], levels: int) -> tuple[dict[tuple, int], int]:
    """({(rgb, role): gray}, colours that fell together though they differ visibly) of (rgb, role, count)."""
    every = sorted(((t := tone_of(rgb, role, n)).want, rgb, role, t) for rgb, role, n in colours)
    for k, (_, _, _, t) in enumerate(every):
        t.of = [k]
    gap = color.min_gap(levels)
    tones = grouped([t for *_, t in every], gap)
    grays = on_panel(tones, spread(tones, gap), levels)
    out: dict[tuple, int] = {}
    spans: dict[int, list[float]] = {}
    for t, g in zip(tones, grays, strict=True):
        for k in t.of:
            out[every[k][1], every[k][2]] = g
            spans.setdefault(g, []).append(every[k][0])
    return out, sum(len(v) for v in spans.values() if max(v) - min(v) >= SEEN)


def collect(rules: DataFrame, scope: Column) -> DataFrame:
    """(scope, r, g, b, role, weight) of the colours in rule tables (prop, value): each occurrence counts."""
    schema = "scope string, r int, g int, b int, role string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(s, *c, ROLES[p]) for s, p, v in pdf.itertuples(index=False) for m in COLOR.finditer(v) if (c := parse(m[0]))]
            yield pd.DataFrame(rows, columns=["scope", "r", "g", "b", "role"])

    found = rules.where(F.col("prop").isin(*ROLES) & F.col("value").isNotNull()).select(scope.alias("scope"), "prop", "value").mapInPandas(run, schema)
    return found.groupBy("scope", "r", "g", "b", "role").agg(F.count("*").alias("weight"))


PALETTE = "scope string, r int, g int, b int, role string, weight bigint, gray int, n_colours int, n_tones int, n_collapsed int"


def palettes(colours: DataFrame, levels: int) -> DataFrame:
    """Counted colours with the gray of each; one solve for each scope, over its distinct colours."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf[["r", "g", "b", "role", "weight"]].itertuples(index=False, name=None))
        got, collapsed = solve([((r, g, b), role, w) for r, g, b, role, w in rows], levels)
        gray = [got[(r, g, b), role] for r, g, b, role, _ in rows]
        return pdf.assign(gray=gray, n_colours=len(rows), n_tones=len(set(gray)), n_collapsed=collapsed)[[c.split()[0] for c in PALETTE.split(", ")]]

    return colours.groupBy("scope").applyInPandas(one, PALETTE)


def recolour(text: str, grays: dict[tuple, int], role_of) -> tuple[str, int]:
    """A text whose colours are replaced by the grays of their place; ``role_of`` gives the role of a place or None."""
    n = 0

    def one(m: re.Match) -> str:
        nonlocal n
        role = role_of(m)
        rgb = parse(m[0]) if role else None
        g = grays.get((rgb, role)) if rgb else None
        if g is None or rgb == (g, g, g):
            return m[0]
        n += 1
        return f"#{g:02x}{g:02x}{g:02x}"

    return COLOR.sub(one, text), n


_PROPERTY = re.compile(r"([-\w]+)\s*:\s*[^;:{}]*$")
_ATTRIBUTE = re.compile(r"\b(fill|stroke|stop-color|color)\s*=\s*[\"'][^\"'<>]*$")


def _role_at(m: re.Match) -> str | None:
    before = m.string[max(0, m.start() - 120):m.start()]
    p = _PROPERTY.search(before) or _ATTRIBUTE.search(before)
    return ROLES.get(p[1].lower()) if p else None


def rewrite(sheets: DataFrame, palette: DataFrame) -> DataFrame:
    """``sheets`` (scope, text) with ``new_text`` and ``n_changed``: the colours of each scope as its grays; null where nothing changes, so the bytes stay."""
    maps = palette.groupBy("scope").agg(F.collect_list(F.struct("r", "g", "b", "role", "gray")).alias("grays"))
    joined = sheets.join(maps, "scope", "left")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sheets.schema) + ", new_text string, n_changed int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            new = []
            for text, grays in zip(pdf["text"], pdf["grays"], strict=True):
                table = {((g["r"], g["g"], g["b"]), g["role"]): g["gray"] for g in grays} if grays is not None else {}
                out, n = recolour(text, table, _role_at) if text else (text, 0)
                new.append((out if n else None, n))
            yield pdf.drop(columns="grays").assign(new_text=[a for a, _ in new], n_changed=[n for _, n in new])

    return joined.select(*sheets.columns, "grays").mapInPandas(run, schema)


def remap_svg(svg: str, levels: int) -> tuple[str, int]:
    """A vector picture in grays of its own solve."""
    seen: dict[tuple, int] = {}
    for m in COLOR.finditer(svg):
        if (role := _role_at(m)) and (c := parse(m[0])):
            seen[c, role] = seen.get((c, role), 0) + 1
    if not seen:
        return svg, 0
    grays, _ = solve([(c, r, n) for (c, r), n in seen.items()], levels)
    return recolour(svg, grays, _role_at)


def lookup(colours: DataFrame, palette: DataFrame) -> DataFrame:
    """``colours`` (scope, r, g, b, role) with the gray of each, null for one the palette does not hold."""
    return colours.join(palette.select("scope", "r", "g", "b", "role", "gray"), ["scope", "r", "g", "b", "role"], "left")
