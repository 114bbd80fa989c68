"""Byte-preserving edits of ``derived_from`` in a file's frontmatter.

An edit is a list of range splices over the text; all bytes outside them stay. The field's value is
scanned for the spans of its items, the smallest splice is planned, and the result is read back: it
must parse, hold no new blank item, hold the id (or not), and keep every other item in order.
Otherwise the text is returned as it was, with a refusal code.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.frontmatter import SPACES, YamlError, list_text, locate, read_block

FIELD = "derived_from"
RESULT = "text string, changed boolean, edits array<struct<start:int,end:int,text:string>>, code string"
_KEY = re.compile(rf"""(?m)^(?:{FIELD}|"{FIELD}"|'{FIELD}')[ \t]*:(?=[ \t\r]|$)""")


class Refused(ValueError):
    """Carries a refusal code."""


def apply_edits(text: Column, edits: Column) -> Column:
    """Splices (start, end, text) from right to left; overlapping or outside ones raise an error."""
    ordered = F.reverse(F.array_sort(edits))
    begin = F.struct(text.alias("t"), F.length(text).alias("low"))

    def step(s, e):
        bad = (e["start"] < 0) | (e["end"] < e["start"]) | (e["end"] > s["low"])
        cut = F.concat(F.substr(s["t"], F.lit(1), e["start"]), e["text"], F.substr(s["t"], e["end"] + 1, F.length(s["t"])))
        return F.struct(F.when(bad, F.raise_error(F.lit("edits overlap or lie outside the text"))).otherwise(cut).alias("t"), e["start"].alias("low"))

    return F.aggregate(ordered, begin, step, lambda s: s["t"])


def splice(text: str, edits: list[tuple[int, int, str]]) -> str:
    low = len(text)
    for start, end, new in sorted(edits, reverse=True):
        if not 0 <= start <= end <= low:
            raise ValueError("edits overlap or lie outside the text")
        text, low = text[:start] + new + text[end:], start
    return text


def scalar(value: str) -> str:
    plain = re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._/@+-]*", value) and not re.fullmatch(r"(?i)([-+]?(\d+\.?\d*|\.\d+)(e[-+]?\d+)?|true|false|null|yes|no|on|off|~)", value)
    return value if plain else "'" + value.replace("'", "''") + "'"


def key_of(value: str) -> str:
    import unicodedata

    return unicodedata.normalize("NFC", value).strip(SPACES)


def _quoted_end(s: str, i: int) -> int:
    """The offset past a quotation that starts at ``i``."""
    if s[i] == "'":
        m = re.compile(r"'(?:[^']|'')*'").match(s, i)
    else:
        m = re.compile(r'"(?:[^"\\]|\\[\s\S])*"').match(s, i)
    if not m:
        raise Refused("mutation-unsafe")
    return m.end()


def _flow_items(s: str, at: int) -> tuple[list[tuple[int, int]], list[int], int]:
    """(item spans, comma offsets, offset of the closing bracket) of a flow list that opens at ``at``."""
    items, commas, i, depth, start, last = [], [], at + 1, 0, None, None
    while i < len(s):
        c = s[i]
        if c == "#" and s[i - 1] in " \t\n":
            i = s.find("\n", i)
            if i < 0:
                break
            continue
        if c in "]," and depth == 0:
            if start is not None:
                items.append((start, last))
            start = None
            if c == "]":
                return items, commas, i
            commas.append(i)
        elif c not in " \t\r\n":
            start = i if start is None else start
            if c in "\"'" and (start == i or depth):
                i = _quoted_end(s, i)
                last = i
                continue
            depth += (c in "[{") - (c in "]}")
            last = i + 1
        i += 1
    raise Refused("mutation-unsafe")


def _region(raw: str, after: int) -> int:
    """Where the field's value ends: at the next line that starts a top-level entry."""
    at = raw.find("\n", after)
    while 0 <= at < len(raw) - 1:
        line = raw[at + 1 :].split("\n", 1)[0]
        if line.strip(" \t\r") and line[0] not in " \t#-" and not line.startswith(("]", "}")):
            return at + 1
        at = raw.find("\n", at + 1)
    return len(raw)


class Field:
    """Where the field stands in a block's raw content and how its value is written."""

    def __init__(self, raw: str):
        self.raw = raw
        m = _KEY.search(raw)
        self.present = m is not None
        if not m:
            return
        self.line, self.colon = m.start(), m.end()
        self.end = _region(raw, m.end())
        body = raw[m.end() : self.end]
        lead = re.compile(r"[ \t]*(?:&([^ \t\r\n,\[\]{}]+)[ \t]*|![^ \t\r\n]*[ \t]*)*").match(body)
        self.value = m.end() + lead.end()
        anchor = re.search(r"&([^ \t\r\n,\[\]{}]+)", body)
        if anchor and re.search(rf"\*{re.escape(anchor[1])}(?![^ \t\r\n,\]\}}])", raw[: self.line] + raw[self.end :]):
            raise Refused("anchor-aliased")
        head = raw[self.value : self.value + 1]
        rest = raw[self.value : self.end]
        if head in ("|", ">", "{", "*"):
            raise Refused("field-not-list")
        if head == "[":
            self.kind = "flow"
            self.items, self.commas, self.close = _flow_items(raw, self.value)
        elif head in ("", "\n", "\r", "#"):
            self.items = self._block(self.value)
            self.kind = "block" if self.items else "empty"
            text = "\n".join(x for x in rest.split("\n")[1:] if x.strip() and not x.lstrip().startswith("#"))
            if self.kind == "empty" and text.strip():
                raise Refused("field-not-list")
        else:
            self.kind = "scalar"
            stop = _quoted_end(raw, self.value) if head in "\"'" else self._plain_end()
            self.items = [(self.value, stop)]

    def _plain_end(self) -> int:
        line = self.raw[self.value : self.end].split("\n", 1)[0]
        m = re.search(r"[ \t]#", line)
        return self.value + len((line[: m.start()] if m else line).rstrip(" \t\r"))

    def _block(self, at: int) -> list[tuple[int, int]]:
        """Spans of the items' values in a block list; the dash is ``dashes`` of the same index."""
        out, self.dashes = [], []
        pos = self.raw.find("\n", at)
        indent = None
        while 0 <= pos < self.end - 1:
            stop = self.raw.find("\n", pos + 1)
            stop = self.end if stop < 0 or stop > self.end else stop
            line = self.raw[pos + 1 : stop]
            m = re.match(r"([ ]*)-(?:([ \t]+)|(?=\r?$))", line)
            if m and (indent is None or len(m[1]) == indent):
                indent = len(m[1])
                start = pos + 1 + m.end()
                tail = line[m.end() :]
                if tail[:1] in ("|", ">", "{", "[", "-"):
                    raise Refused("field-not-list")
                if tail[:1] in ("'", '"'):
                    end = _quoted_end(self.raw, start)
                else:
                    c = re.search(r"(?:^|[ \t])#", tail)
                    end = start + len((tail[: c.start()] if c else tail).rstrip(" \t\r"))
                out.append((start, end))
                self.dashes.append(pos + 1)
            elif line.strip(" \t\r") and not line.lstrip().startswith("#") and indent is not None and len(line) - len(line.lstrip(" ")) <= indent:
                break
            pos = stop if stop < self.end else -1
        return out


def _value_of(written: str) -> str | None:
    try:
        data, error, _ = read_block(f"x: {written}\n") if written else ({}, None, [])
    except YamlError:
        return None
    found = list_text(data.get("x")) if error is None else []
    return found[0] if len(found) == 1 else None


def _plan_add(text: str, block: dict | None, value: str) -> list[tuple[int, int, str]]:
    new = scalar(value)
    if block is None:
        nl = text.find("\n")
        eol = "\r\n" if nl > 0 and text[nl - 1] == "\r" else "\n"
        at = 1 if text.startswith("﻿") else 0
        return [(at, at, f"---{eol}{FIELD}: [{new}]{eol}---{eol}")]
    base, raw = block["content_start"], block["raw"]
    field = Field(raw)
    if not field.present:
        eol = "\r\n" if raw.endswith("\r\n") else "\n" if raw else block["eol"]
        return [(block["content_end"], block["content_end"], f"{FIELD}: [{new}]{eol}")]
    if field.kind == "flow":
        if not field.items:
            return [(base + field.value, base + field.close + 1, f"[{new}]")]
        end = field.items[-1][1]
        after = [c for c in field.commas if c >= end]
        if after:  # a comma stands after the last item already
            return [(base + after[0] + 1, base + after[0] + 1, f" {new}")]
        return [(base + end, base + end, f", {new}")]
    if field.kind == "block":
        start, end = field.items[-1]
        dash = field.dashes[-1]
        stop = raw.find("\n", end)
        lead = raw[dash:start] if raw[dash:start].strip("- \t") == "" and start > dash else raw[dash : dash + 1] + " "
        lead = lead if lead.endswith((" ", "\t")) else lead + " "
        if stop < 0:
            return [(base + len(raw), base + len(raw), block["eol"] + lead + new)]
        eol = "\r\n" if raw[stop - 1 : stop] == "\r" else "\n"
        return [(base + stop + 1, base + stop + 1, lead + new + eol)]
    if field.kind == "empty":
        at = field.value
        while at > field.colon and raw[at - 1] in " \t":
            at -= 1
        return [(base + at, base + at, f" [{new}]")]
    start, end = field.items[0]
    written = raw[start:end]
    if written in ("null", "Null", "NULL", "~"):
        return [(base + start, base + end, f"[{new}]")]
    return [(base + start, base + end, f"[{written}, {new}]")]


def _plan_remove(text: str, block: dict, wanted: str) -> list[tuple[int, int, str]]:
    base, raw = block["content_start"], block["raw"]
    field = Field(raw)
    gone = [i for i, (a, b) in enumerate(field.items) if (v := _value_of(raw[a:b])) is not None and key_of(v) == wanted] if field.present else []
    if not gone:
        raise Refused("entry-not-removable")
    if len(gone) == len(field.items):
        stop = field.end
        # comments and blank lines before the next entry are not the field's
        if field.kind != "flow":
            last = raw.find("\n", field.items[-1][1])
        else:
            last = raw.find("\n", field.close)
        stop = len(raw) if last < 0 else last + 1
        return [(base + field.line, base + stop, "")]
    if field.kind == "block":
        out = []
        for i in gone:
            stop = raw.find("\n", field.items[i][1])
            out.append((base + field.dashes[i], base + (len(raw) if stop < 0 else stop + 1), ""))
        return out
    out = []
    for i in gone:
        a, b = field.items[i]
        later = [c for c in field.commas if c >= b]
        if i + 1 < len(field.items) and any(k not in gone for k in range(i + 1, len(field.items))):
            comma = later[0] + 1
            gap = re.compile(r"[ \t]*").match(raw, comma).end()
            # up to the next item if it stands on the same line
            out.append((base + a, base + (gap if raw[gap : gap + 1] not in ("\r", "\n", "#") else comma), ""))
        else:
            before = max(c for c in field.commas if c < a)
            out.append((base + before, base + b, ""))
    return out


def edit_one(text: str, value: str, adding: bool) -> tuple[str, bool, list[tuple[int, int, str]], str | None]:
    """(text, changed, edits, refusal code) of adding or removing one id."""
    if not value.strip(SPACES):
        return text, False, [], "value-blank" if adding else None
    block = locate(text)
    data, error, repeated = read_block(block["raw"]) if block else ({}, None, [])
    if error is not None:
        return text, False, [], "frontmatter-unreadable"
    if FIELD in repeated:
        return text, False, [], "duplicate-key"
    wanted, held = key_of(value), list_text(data.get(FIELD))
    if isinstance(data.get(FIELD), dict) or (isinstance(data.get(FIELD), list) and any(isinstance(x, dict) for x in data[FIELD])):
        return text, False, [], "field-not-list"
    try:
        if block:
            Field(block["raw"])
        if (wanted in map(key_of, held)) == adding:
            return text, False, [], None
        edits = _plan_add(text, block, value) if adding else _plan_remove(text, block, wanted)
        new = splice(text, edits)
    except Refused as e:
        return text, False, [], str(e)
    after = locate(new)
    left, error, _ = read_block(after["raw"]) if after else ({}, None, [])
    blanks = lambda v: sum(x is None or (isinstance(x, str) and not x.strip(SPACES)) for x in v) if isinstance(v, list) else 0
    others = lambda d: [k for k in map(key_of, list_text(d.get(FIELD))) if k not in ("", wanted)]
    sound = error is None and blanks(left.get(FIELD)) <= blanks(data.get(FIELD)) and (wanted in map(key_of, list_text(left.get(FIELD)))) == adding and others(left) == others(data)
    sound = sound and {k: v for k, v in left.items() if k != FIELD} == {k: v for k, v in data.items() if k != FIELD}
    return (new, True, edits, None) if sound else (text, False, [], "mutation-unsafe")


def _edited(files: DataFrame, adding: bool) -> DataFrame:
    @F.pandas_udf(RESULT)
    def run(text: pd.Series, value: pd.Series) -> pd.DataFrame:
        rows = [edit_one(t or "", v or "", adding) for t, v in zip(text, value, strict=True)]
        return pd.DataFrame({"text": [r[0] for r in rows], "changed": [r[1] for r in rows], "edits": [[{"start": a, "end": b, "text": c} for a, b, c in r[2]] for r in rows], "code": [r[3] for r in rows]})

    return files.withColumn("result", run("text", "source_id"))


def add_edges(files: DataFrame) -> DataFrame:
    """files(text, source_id, …) with result(text, changed, edits, code): the id is in ``derived_from`` once."""
    return _edited(files, True)


def remove_edges(files: DataFrame) -> DataFrame:
    """The same for removal: no item with the id is left, and the field goes with its last item."""
    return _edited(files, False)
