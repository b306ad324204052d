"""Raster files by their bytes: format and size as Columns, tone work with numpy in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def sniff(data: Column) -> Column:
    """The format by the first bytes, never by the name; null if none is known."""
    head = F.hex(F.substring(data, 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("474946383761") | head.startswith("474946383961"), "gif")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp").when(head.startswith("49492A00") | head.startswith("4D4D002A"), "tiff").when(head.startswith("424D"), "bmp")
    )


def is_svg(data: Column) -> Column:
    """Whether the root element in the first bytes is that of a vector picture, behind marks, declarations and comments."""
    head = F.decode(F.substring(data, 1, 4096), "iso-8859-1")
    return head.rlike(r"(?is)^(?:\x{EF}\x{BB}\x{BF})?\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*|<!DOCTYPE[^>\[]*(?:\[.*?\])?\s*>\s*)*<(?:\w+:)?svg[\s>/]")


def is_candidate(data: Column, declared: Column) -> Column:
    """Whether an entry is a raster picture to work on: never vector; a declared raster type or raster bytes."""
    d = F.lower(F.coalesce(declared, F.lit("")))
    return ~is_svg(data) & (d != "image/svg+xml") & (d.startswith("image/") | sniff(data).isNotNull())


def _number(data: Column, at: int, n: int, little: bool = False) -> Column:
    h = F.hex(F.substring(data, at, n))
    if little:
        h = F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(n))])
    return F.conv(h, 16, 10).cast("int")


def png_gif_size(data: Column) -> tuple[Column, Column]:
    """Width and height from the headers that hold them at a fixed place; null for other formats."""
    kind = sniff(data)
    return F.when(kind == "png", _number(data, 17, 4)).when(kind == "gif", _number(data, 7, 2, True)), F.when(kind == "png", _number(data, 21, 4)).when(kind == "gif", _number(data, 9, 2, True))


def jpeg_frame(data: bytes) -> tuple[int, int, bool] | None:
    """(width, height, progressive) of a JPEG from its markers; None if they are broken."""
    i = 2
    while i + 9 <= len(data):
        if data[i] != 0xFF:
            return None
        marker = data[i + 1]
        if marker in (0xD9, 0xDA):
            return None
        if marker == 0xFF or 0xD0 <= marker <= 0xD8 or marker == 1:
            i += 1 if marker == 0xFF else 2
            continue
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[i + 7:i + 9]), int.from_bytes(data[i + 5:i + 7]), marker in (0xC2, 0xC6, 0xCA, 0xCE)
        i += 2 + int.from_bytes(data[i + 2:i + 4])
    return None


def jpeg_probe(data: Column) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([jpeg_frame(x) or (None, None, None) if x else (None, None, None) for x in s], columns=["width", "height", "progressive"]).astype({"width": "Int32", "height": "Int32", "progressive": "boolean"})

    return F.pandas_udf(run, "width int, height int, progressive boolean")(data)


def autocontrast(gray: np.ndarray, clip: float = 0.01) -> np.ndarray:
    """Tones stretched so that one per cent lies outside either end; a flat picture stays as it is."""
    hist = np.bincount(gray.ravel(), minlength=256)
    limit = int(gray.size * clip)
    low = int(np.argmax(np.cumsum(hist) > limit))
    high = 255 - int(np.argmax(np.cumsum(hist[::-1]) > limit))
    if high <= low:
        return gray
    table = np.clip((np.arange(256) - low) * 255 // (high - low), 0, 255).astype(np.uint8)
    return table[gray]


def flatten_alpha(rgba: np.ndarray) -> np.ndarray:
    """Colours laid on white, in whole numbers."""
    c, a = rgba[..., :3].astype(np.int32), rgba[..., 3:].astype(np.int32)
    return ((c * a + 255 * (255 - a)) // 255).astype(np.uint8)


def line_art(gray: np.ndarray) -> bool:
    """At most sixteen tones, or two that make 85 %."""
    hist = np.bincount(gray.ravel(), minlength=256)
    return bool((hist > 0).sum() <= 16 or np.sort(hist)[-2:].sum() >= 0.85 * gray.size)


def fit_box(width: int, height: int, box_w: int, box_h: int) -> tuple[int, int]:
    """The size within a box, never larger than the picture."""
    scale = min(1.0, box_w / width, box_h / height)
    return max(1, int(width * scale + 0.5)), max(1, int(height * scale + 0.5))
