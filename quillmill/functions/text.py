"""Text to comparable terms and keys.

Folding is lower case, canonical decomposition, and removal of every character with the Unicode
property Diacritic. The rule gives a one-to-one table for ``translate`` (built once from the JVM's
Unicode data), applied only to rows that need it. Characters that decompose into several others
(Hangul syllables and a few dozen more) are left whole by the table; ``fold_exact`` is an Arrow UDF
for corpora that hold them.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..constants import STOP_WORDS

#: What the trimming and blank tests of the data model call white space.
SPACE = r"[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def let(c: Column, use) -> Column:
    """``use`` of ``c``, which is evaluated once however often ``use`` names it."""
    return F.transform(F.array(c), use)[0]


def trim(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, rf"\A{SPACE}+", ""), rf"{SPACE}+\z", "")


def is_blank(c: Column) -> Column:
    return c.rlike(rf"\A{SPACE}*\z")


@lru_cache(1)
def diacritics() -> frozenset[str]:
    found = SparkSession.active()._jvm.com.ibm.icu.text.UnicodeSet("[:Diacritic:]")
    return frozenset(chr(x) for i in range(found.getRangeCount()) for x in range(found.getRangeStart(i), found.getRangeEnd(i) + 1))


@lru_cache(1)
def fold_table() -> tuple[str, str]:
    gone, source, target, deleted = diacritics(), [], [], []
    for code in range(0x10000):
        c = chr(code)
        if 0xD800 <= code < 0xE000:
            continue
        out = "".join(x for x in unicodedata.normalize("NFD", c) if x not in gone)
        if out == "":
            deleted.append(c)
        elif out != c and len(out) == 1:
            source.append(c)
            target.append(out)
    return "".join(source + deleted), "".join(target)


def fold(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.rlike(r"[^\x00-\x7F]|[\^`]"), F.translate(low, *fold_table())).otherwise(low)


def fold_exact():
    """An Arrow UDF that folds every character, for text that decomposes into several."""
    gone = {ord(c): None for c in diacritics()}

    @F.pandas_udf("string")
    def exact(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFD", t.lower()).translate(gone))

    return exact


def tokens(c: Column, folded: bool = False) -> Column:
    """Terms of a text, in order: folded runs of letters and numbers, no single characters or stop words."""
    parts = F.split(c if folded else fold(c), r"[^\p{L}\p{N}]+")
    long_enough = lambda t: (F.length(t) > 1) | (F.octet_length(t) == 4)  # noqa: E731  an astral letter is two units
    return F.coalesce(F.filter(parts, lambda t: long_enough(t) & ~t.isin(*STOP_WORDS)), F.array().cast("array<string>"))


def _nfc():
    @F.pandas_udf("string")
    def nfc(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return nfc


def composed(c: Column, exact: bool = False) -> Column:
    """NFC; without ``exact`` the text is taken to be composed already."""
    return _nfc()(c) if exact else c


def name_key(c: Column, exact: bool = False) -> Column:
    return F.lower(F.regexp_replace(trim(composed(c, exact)), rf"{SPACE}+", " "))


def id_key(c: Column, exact: bool = False) -> Column:
    return trim(composed(c, exact))


def slug(c: Column, length: int) -> Column:
    """A file name of letters, numbers and hyphens, cut back to a whole word; empty becomes ``capture``."""
    words = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", "")

    def shorter(cut: Column) -> Column:
        back = F.regexp_extract(cut, r"^(.+)-[^-]*$", 1)
        return F.when(back != "", back).otherwise(cut)

    return let(words, lambda w: F.when(w == "", "capture").when(F.length(w) <= length, w).otherwise(let(F.substring(w, 1, length), shorter)))


def yaml_quoted(c: Column) -> Column:
    """YAML double-quoted style: backslash, quote, C0 and DEL escaped."""
    named = {0: "0", 7: "a", 8: "b", 9: "t", 10: "n", 11: "v", 12: "f", 13: "r", 27: "e"}
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    risky = out.rlike(r"[\x00-\x1F\x7F]")
    escaped = out
    for code in [*range(0x20), 0x7F]:
        escaped = F.replace(escaped, F.lit(chr(code)), F.lit("\\" + named[code] if code in named else f"\\x{code:02x}"))
    return F.concat(F.lit('"'), F.when(risky, escaped).otherwise(out), F.lit('"'))


def yaml_scalar(c: Column) -> Column:
    """Plain where it reads back as the same text, single-quoted otherwise."""
    plain = c.rlike(r"\A[A-Za-z0-9][A-Za-z0-9._/@+-]*\z") & ~c.rlike(r"(?i)\A([-+]?(\d+\.?\d*|\.\d+)(e[-+]?\d+)?|true|false|null|yes|no|on|off|~)\z")
    return F.when(plain, c).otherwise(F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'")))


def redact(c: Column) -> Column:
    """A value for a message: credentials out first, then cut to 77 characters and dots, quoted."""
    safe = F.regexp_replace(c, r"//[^/?#@\s]*@", "//<redacted>@")
    shown = lambda x: F.when(F.length(x) > 80, F.concat(F.substring(x, 1, 77), F.lit("..."))).otherwise(x)
    return let(safe, lambda x: F.when(x == "", "an empty string").otherwise(F.concat(F.lit('"'), shown(x), F.lit('"'))))


def stamp(at: Column) -> Column:
    return F.date_format(at, "yyyyMMdd-HHmmss")


def local_timestamp(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssxxx")


def address(path: Column, anchor: Column, start: Column, end: Column) -> Column:
    return F.concat(path, F.when(anchor.isNull(), "").otherwise(F.concat(F.lit("#"), anchor)), F.lit(":"), start, F.lit("-"), end)
