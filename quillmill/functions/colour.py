"""Contrast of two colours written as ``#rrggbb``, as a share of light, rounded so that no ratio reads too high."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: weights of the channels, and the ratios that uses require
WEIGHTS = (0.2126, 0.7152, 0.0722)
REQUIRED = {"text": 4.5, "large": 3.0, "graphic": 3.0}


def luminance(colour: Column) -> Column:
    """Relative luminance, 0 to 1; null for what is no ``#rrggbb``."""

    def share(at: int) -> Column:
        c = F.conv(F.substring(colour, at, 2), 16, 10).cast("double") / 255
        return F.when(c <= 0.03928, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))

    sum_ = WEIGHTS[0] * share(2) + WEIGHTS[1] * share(4) + WEIGHTS[2] * share(6)
    return F.when(colour.rlike(r"\A#[0-9A-Fa-f]{6}\z"), sum_)


def contrast(a: Column, b: Column) -> Column:
    """1 to 21, whichever of the two is lighter."""
    x, y = luminance(a), luminance(b)
    ratio = (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)
    return F.when(x.isNotNull() & y.isNotNull(), ratio)


def shown(ratio: Column) -> Column:
    """Two decimals, cut and not rounded."""
    return F.format_string("%.2f", F.floor(ratio * 100) / 100)


def meets(ratio: Column, use: str) -> Column:
    return F.floor(ratio * 100) / 100 >= REQUIRED[use]
