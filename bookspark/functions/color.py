"""Colour as Column arithmetic: lightness of an sRGB colour and what a panel of few grays makes of it."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: D65 white, the constants of CIE Lab, the sRGB matrix
WHITE = (0.95047, 1.0, 1.08883)
EPSILON, KAPPA = 216 / 24389, 24389 / 27
MATRIX = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.072175), (0.0193339, 0.119192, 0.9503041))


def linear(channel: Column) -> Column:
    u = channel / 255.0
    return F.when(u <= 0.04045, u / 12.92).otherwise(F.pow((u + 0.055) / 1.055, F.lit(2.4)))


def _f(t: Column) -> Column:
    return F.when(t > EPSILON, F.pow(t, F.lit(1 / 3))).otherwise((KAPPA * t + 16) / 116)


def lch(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Lightness, chroma and hue in degrees; chroma below 1e-4 counts as none."""
    rgb = [linear(c) for c in (r, g, b)]
    x, y, z = (_f(sum((m * c for m, c in zip(row, rgb, strict=True)), F.lit(0.0)) / w) for row, w in zip(MATRIX, WHITE, strict=True))
    light, a, bb = 116 * y - 16, 500 * (x - y), 200 * (y - z)
    chroma = F.sqrt(a * a + bb * bb)
    grey = chroma < 1e-4
    hue = F.degrees(F.atan2(bb, a))
    return light, F.when(grey, 0.0).otherwise(chroma), F.when(grey, 0.0).otherwise(F.when(hue < 0, hue + 360).otherwise(hue))


def apparent_lightness(light: Column, chroma: Column, hue: Column) -> Column:
    """Lightness corrected for how strong colours look brighter, within 0 to 100."""
    factor = 0.116 * F.abs(F.sin((hue - 90) * (math.pi / 180) / 2)) + 0.085
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), light + (2.5 - 0.025 * light) * factor * chroma))


def lightness_of_gray(value: Column) -> Column:
    return 116 * _f(linear(value)) - 16


def over_white(channel: Column, alpha: Column) -> Column:
    """A translucent channel on a white page."""
    a = F.greatest(F.lit(0.0), F.least(F.lit(1.0), alpha))
    return F.floor(channel * a + 255 * (1 - a) + 0.5).cast("int")


def panel_levels(n: int) -> list[int]:
    """The gray values of a panel with n levels."""
    return [math.floor(255 * i / (n - 1) + 0.5) for i in range(n)]


def min_gap(levels: int) -> float:
    """The least difference of lightness that two tones must keep: a step on a panel of 4, else at least ten and two steps."""
    step = 100 / (levels - 1)
    return step if levels <= 4 else max(10.0, 2 * step)
