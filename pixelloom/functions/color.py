"""Colour transforms and sample arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import YCBCR_TO_RGB, RGB_TO_YCBCR


def clamp(col: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col))


def rounded(col: Column) -> Column:
    """Halves away from zero, as for all samples here (which are not negative)."""
    return F.floor(col + 0.5)


def rgb_to_ycbcr(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    out = [rounded(r * a + g * c + b * d + off) for (a, c, d), off in zip(RGB_TO_YCBCR, (0, 128, 128), strict=True)]
    return tuple(clamp(x, 0, 255).cast("int") for x in out)


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column, truncate: bool = False) -> tuple[Column, Column, Column]:
    """truncate: towards zero after clamping, as some decoders do, instead of to the nearest."""
    u, v = cb - 128, cr - 128
    exact = [y + u * a + v * b for a, b in YCBCR_TO_RGB]
    out = [F.floor(clamp(e, 0, 255)) if truncate else rounded(e) for e in exact]
    return tuple(clamp(x, 0, 255).cast("int") for x in out)


def rct_forward(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """The reversible transform of lossless wavelet coding."""
    return F.floor((r + 2 * g + b) / 4).cast("int"), b - g, r - g


def rct_inverse(y: Column, u: Column, v: Column) -> tuple[Column, Column, Column]:
    g = y - F.floor((u + v) / 4).cast("int")
    return v + g, g, u + g


def med(a: Column, b: Column, c: Column) -> Column:
    """The median edge detector of left, above and upper left."""
    return F.when(c >= F.greatest(a, b), F.least(a, b)).when(c <= F.least(a, b), F.greatest(a, b)).otherwise(a + b - c)


def predictors(a: Column, b: Column, c: Column) -> dict[int, Column]:
    """The seven predictors of lossless coding; halves are shifts."""
    half = lambda x: F.floor(x / 2).cast("int")
    return {1: a, 2: b, 3: c, 4: a + b - c, 5: a + half(b - c), 6: b + half(a - c), 7: half(a + b)}


def mapped_error(e: Column) -> Column:
    """Signed errors as unsigned ones: 0, -1, 1, -2, 2, ..."""
    return F.when(e >= 0, 2 * e).otherwise(-2 * e - 1)


def category(v: Column) -> Column:
    """The number of bits of a magnitude."""
    return F.when(v == 0, 0).otherwise(F.length(F.bin(F.abs(v).cast("long")))).cast("int")
