"""How many columns a text takes in a terminal: none for marks and format characters, two for wide ones.

The classes come from the Unicode data of the Python that builds the plan, as intervals packed into
one character class each, which a regular expression searches by interval.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def point_width(character: str) -> int:
    """Of one code point: 0 for non-spacing and enclosing marks and format characters, 2 for East Asian
    wide and fullwidth ones, else 1. Code points that are not assigned take one column, or two where the
    data say that their block is wide."""
    if unicodedata.category(character) in ("Mn", "Me", "Cf"):
        return 0
    return 2 if unicodedata.east_asian_width(character) in "WF" else 1


@functools.cache
def intervals(width: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for point in range(sys.maxunicode + 1):
        if not 0xD800 <= point < 0xE000 and point_width(chr(point)) == width:
            if out and out[-1][1] == point - 1:
                out[-1][1] = point
            else:
                out.append([point, point])
    return [(a, b) for a, b in out]


def character_class(width: int) -> str:
    """The intervals as the inside of a regular expression's brackets."""
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in intervals(width))


#: Code points below the first combining mark take one column, but for the soft hyphen.
PLAIN = "[\\x00-\\xac\\xae-\\x{2ff}]+"


def cell_width(c: Column) -> Column:
    """Columns of a text; null for null. What stands below the first mark is counted without looking."""
    rest = F.regexp_replace(c, PLAIN, "")
    count = lambda width: F.length(F.regexp_replace(rest, f"[^{character_class(width)}]+", ""))
    return F.when(rest == "", F.length(c)).otherwise(F.length(c) + count(2) - count(0)).cast("long")
