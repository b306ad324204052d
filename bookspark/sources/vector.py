"""Vector pictures as text: wrappers around a raster picture, whether they hold tones, and tables drawn as one. Nothing here paints them."""

from __future__ import annotations

import base64
import binascii
import re
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Groups that may lie around the only picture, and elements that say nothing, fixed values.
DEPTH, SILENT = 4, frozenset(("title", "desc", "defs", "metadata"))
#: Fixed values of drawn tables: font, advance of a letter, line, paddings, border.
FONT, ADVANCE, LINE, PAD_X, PAD_Y, BORDER = 15, 9, 20, 6, 4, 1


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def wrapped(svg: str) -> str | bytes | None:
    """The reference or the bytes of the one picture that a vector picture only wraps, else None."""
    try:
        at = ET.fromstring(svg)
    except ET.ParseError:
        return None
    if _local(at.tag) != "svg":
        return None
    for _ in range(DEPTH + 1):
        shown = [c for c in at if _local(str(c.tag)) not in SILENT]
        if len(shown) != 1 or _local(shown[0].tag) not in ("image", "g"):
            return None
        at = shown[0]
        if _local(at.tag) == "image":
            break
    else:
        return None
    href = next((v.strip() for k, v in at.attrib.items() if _local(k) == "href"), "")
    if not href.startswith("data:"):
        return href or None
    head, comma, body = href[5:].partition(",")
    if not comma or "base64" not in head:
        return None
    try:
        return base64.b64decode("".join(body.split()), validate=True) or None
    except binascii.Error:
        return None


def has_tones(svg: Column) -> Column:
    """Whether a vector picture holds what blends: pictures, gradients, patterns or filters; others are line art."""
    return svg.rlike(r"<(?:\w+:)?(?:image|linearGradient|radialGradient|pattern|filter)[\s/>]")


def column_widths(lengths: list[int], available: int) -> list[int]:
    """Whole widths in proportion to the longest text of each column: floors first, what is left to the largest remainders, the earlier of equals."""
    total = sum(lengths) or 1
    exact = [n * available / total for n in lengths]
    out = [int(x) for x in exact]
    order = sorted(range(len(exact)), key=lambda k: (-(exact[k] - out[k]), k))
    for k in order[: max(0, available - sum(out))]:
        out[k] += 1
    return out


def wrap(text: str, width: int) -> list[str]:
    """Lines of at most so many letters, word by word, longer words broken; at least one."""
    lines: list[str] = []
    for word in text.split():
        for piece in re.findall(f".{{1,{max(1, width)}}}", word):
            if lines and len(lines[-1]) + 1 + len(piece) <= width:
                lines[-1] += " " + piece
            else:
                lines.append(piece)
    return lines or [""]


def draw_table(rows: list[list[str]], header: list[str] | None, caption: str | None, width: int) -> str:
    """A table as a vector picture of one width; the same rows give the same picture."""
    every = ([header] if header else []) + rows
    n = max((len(r) for r in every), default=1)
    lengths = [max([1, *(len(r[k]) for r in every if k < len(r))]) for k in range(n)]
    widths = column_widths(lengths, width - BORDER * (n + 1))
    y, parts = BORDER, []
    if caption:
        for line in wrap(caption, width // ADVANCE):
            parts.append(f'<text x="{width // 2}" y="{y + FONT}" text-anchor="middle">{escape(line)}</text>')
            y += LINE
    for k, row in enumerate(every):
        cells = [wrap(c, max(1, (w - 2 * PAD_X) // ADVANCE)) for c, w in zip([*row, *[""] * (n - len(row))], widths, strict=True)]
        high = max(map(len, cells)) * LINE + 2 * PAD_Y
        x = BORDER
        for lines, w in zip(cells, widths, strict=True):
            fill = "#dddddd" if header and k == 0 else "none"
            parts.append(f'<rect x="{x}" y="{y}" width="{w}" height="{high}" fill="{fill}" stroke="#000000" stroke-width="{BORDER}"/>')
            parts += [f'<text x="{x + PAD_X}" y="{y + PAD_Y + FONT + i * LINE}">{escape(line)}</text>' for i, line in enumerate(lines)]
            x += w + BORDER
        y += high + BORDER
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{y}" font-family="monospace" font-size="{FONT}"><rect width="{width}" height="{y}" fill="#ffffff"/>' + "".join(parts) + "</svg>"


def fit_size(width: Column, height: Column, box_w: int, box_h: int) -> tuple[Column, Column]:
    """The size within a box; small pictures may double."""
    scale = F.least(F.lit(box_w) / width, F.lit(box_h) / height)
    grown = F.when((width < 100) & (height < 100), F.least(scale, F.lit(2.0))).otherwise(F.least(scale, F.lit(1.0)))
    return F.greatest(F.lit(1), F.floor(width * grown + 0.5)).cast("int"), F.greatest(F.lit(1), F.floor(height * grown + 0.5)).cast("int")
