"""Frontmatter of Markdown files: locating the block, reading YAML 1.2, the typed view.

``with_frontmatter`` adds the block's place and content, the body and the typed fields by one Arrow
UDF. The reader covers the core schema in block and flow style: mappings, sequences, plain, quoted,
literal and folded scalars, comments, anchors and aliases. Repeated keys are told and the last one
holds; any other fault leaves the data empty and a message that quotes nothing of the content.
Offsets count UTF-16 units.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import LIST_FIELDS, SCALAR_FIELDS

SPACES = " \t\n\r\f\v                 　﻿"


class YamlError(ValueError):
    pass


def locate(text: str) -> dict | None:
    """Offsets in characters of the block and its content, its raw content and line end; None without one."""
    start = 1 if text.startswith("﻿") else 0
    m = re.compile(r"---[ \t]*(\r?\n)").match(text, start)
    if not m:
        return None
    at = m.end()
    while at <= len(text):
        stop = text.find("\n", at)
        line = text[at : len(text) if stop < 0 else stop]
        if line.rstrip(SPACES) == "---":
            return {"start": start, "content_start": m.end(), "content_end": at, "end": len(text) if stop < 0 else stop + 1, "raw": text[m.end() : at], "eol": m[1]}
        if stop < 0:
            return None
        at = stop + 1
    return None


_INT, _OCT, _HEX = re.compile(r"[-+]?[0-9]+\Z"), re.compile(r"0o[0-7]+\Z"), re.compile(r"0x[0-9a-fA-F]+\Z")
_FLOAT = re.compile(r"[-+]?(\.[0-9]+|[0-9]+(\.[0-9]*)?)([eE][-+]?[0-9]+)?\Z")


def resolve(s: str):
    """A plain scalar by the core schema; dates and yes/no stay text."""
    if s in ("", "~", "null", "Null", "NULL"):
        return None
    if s in ("true", "True", "TRUE"):
        return True
    if s in ("false", "False", "FALSE"):
        return False
    if _INT.match(s):
        return int(s)
    if _OCT.match(s):
        return int(s[2:], 8)
    if _HEX.match(s):
        return int(s, 16)
    if _FLOAT.match(s):
        return float(s)
    if re.match(r"[-+]?\.(inf|Inf|INF)\Z", s):
        return float("-inf") if s[0] == "-" else float("inf")
    if s in (".nan", ".NaN", ".NAN"):
        return float("nan")
    return s


# fixed values: escapes of double-quoted style
_ESCAPES = {"0": "\0", "a": "\a", "b": "\b", "t": "\t", "\t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", "e": "\x1b", " ": " ", '"': '"', "/": "/", "\\": "\\", "N": "\x85", "_": "\xa0", "L": " ", "P": " "}


class Reader:
    """A recursive reader over the block's lines; ``mapping`` is the entry point."""

    def __init__(self, raw: str):
        self.lines = raw.replace("\r\n", "\n").split("\n")
        self.i = 0
        self.anchors: dict[str, object] = {}
        self.repeated: list[str] = []

    def _blank(self, line: str) -> bool:
        s = line.strip(" \t")
        return not s or s[0] == "#"

    def _next(self) -> tuple[int, str] | None:
        while self.i < len(self.lines) and self._blank(self.lines[self.i]):
            self.i += 1
        if self.i == len(self.lines):
            return None
        line = self.lines[self.i]
        body = line.lstrip(" ")
        if body.startswith("\t"):
            raise YamlError("a tab indents a line")
        return len(line) - len(body), body

    def document(self):
        first = self._next()
        if first is None:
            return {}
        value = self.node(first[0], top=True)
        if self._next() is not None:
            raise YamlError("text follows the mapping")
        return value

    def node(self, indent: int, top: bool = False):
        at = self._next()
        if at is None or at[0] < indent:
            return None
        column, body = at
        if body == "-" or body.startswith("- "):
            return self.sequence(column)
        if self._key(body) is not None:
            return self.mapping(column, top)
        self.i += 1
        return self.inline(body, column)

    def _key(self, body: str):
        """(key, rest) if the line opens an entry of a block mapping."""
        if body[:1] in "\"'":
            try:
                key, rest = self._quoted(body)
            except YamlError:
                return None
            rest = rest.lstrip(" \t")
            return (key, rest[1:]) if rest[:1] == ":" and rest[1:2] in ("", " ", "\t") else None
        if body[:1] in "[{#|>@`%&*!" or body.startswith("? "):
            return None
        m = re.match(r"((?:[^:#]|:(?=[^ \t])|(?<=[^ \t])#)*?)[ \t]*:(?=[ \t]|\Z)", body)
        return (m[1], body[m.end() :]) if m and m[1] != "" else None

    def mapping(self, indent: int, top: bool) -> dict:
        out: dict = {}
        while (at := self._next()) is not None and at[0] == indent:
            found = self._key(at[1])
            if found is None:
                raise YamlError("a line is no entry of the mapping")
            key, rest = found
            self.i += 1
            value = self.value(rest, indent)
            if key in out and top and key not in self.repeated:
                self.repeated.append(key)
            elif key in out and not top:
                self.repeated.append(key)
            out[key] = value
        if at is not None and at[0] > indent:
            raise YamlError("a line is indented too far")
        return out

    def sequence(self, indent: int) -> list:
        out = []
        while (at := self._next()) is not None and at[0] == indent and (at[1] == "-" or at[1].startswith("- ")):
            rest = at[1][1:]
            lead = len(rest) - len(rest.lstrip(" "))
            inner = rest.lstrip(" ")
            if inner and inner[0] != "#" and (inner.startswith("- ") or self._key(inner) is not None):
                # a compact mapping or sequence: it starts on this line, further in
                self.lines[self.i] = " " * (indent + 1 + lead) + inner
                out.append(self.node(indent + 1 + lead))
            else:
                self.i += 1
                out.append(self.value(rest, indent))
        if at is not None and at[0] > indent:
            raise YamlError("a line is indented too far")
        return out

    def value(self, rest: str, indent: int):
        rest = rest.strip(" \t")
        anchor = None
        while m := re.match(r"(&|!)([^ \t]*)(?:[ \t]+|\Z)", rest):
            anchor = m[2] if m[1] == "&" else anchor
            rest = rest[m.end() :]
        if rest[:1] in ("|", ">"):
            out = self.block_scalar(rest, indent)
        elif rest == "" or rest[0] == "#":
            at = self._next()
            if at is not None and (at[0] > indent or at[0] == indent and (at[1] == "-" or at[1].startswith("- ")) and indent >= 0 and not self._in_sequence(indent)):
                out = self.node(at[0])
            else:
                out = None
        else:
            out = self.inline(rest, indent)
        if anchor:
            self.anchors[anchor] = out
        return out

    def _in_sequence(self, indent: int) -> bool:
        """Whether the value belongs to a sequence item at this column, whose brother the dash would be."""
        line = self.lines[self.i - 1] if self.i else ""
        for back in range(self.i - 1, -1, -1):
            if not self._blank(self.lines[back]):
                line = self.lines[back]
                break
        return line.lstrip(" ").startswith("-")

    def block_scalar(self, head: str, indent: int) -> str:
        m = re.match(r"([|>])(?:([1-9])?([-+])?|([-+])([1-9]))?[ \t]*(?:#.*)?\Z", head)
        if not m:
            raise YamlError("a block scalar's header is malformed")
        keep, width = m[3] or m[4] or "", m[2] or m[5]
        rows, inner = [], None if width is None else max(indent, 0) + int(width)
        while self.i < len(self.lines):
            line = self.lines[self.i]
            if line.strip(" ") == "":
                rows.append("" if inner is None else line[inner:])
                self.i += 1
                continue
            lead = len(line) - len(line.lstrip(" "))
            inner = lead if inner is None and lead > indent else inner
            if inner is None or lead < inner:
                break
            rows.append(line[inner:])
            self.i += 1
        tail = 0
        while rows and rows[-1] == "":
            rows.pop()
            tail += 1
        if m[1] == "|":
            text = "\n".join(rows)
        else:
            text, before = "", None
            for r in rows:
                if before is None:
                    text = r
                elif r == "":
                    text += "\n"
                elif before == "" or r[0] in " \t" or before[0] in " \t":
                    text += r if before == "" and r[0] not in " \t" else "\n" + r
                else:
                    text += " " + r
                before = r
        return text + ("" if keep == "-" or not rows else "\n" + "\n" * (tail - 1 if keep == "+" and tail else 0))

    def inline(self, text: str, indent: int):
        """A flow collection, a quoted or a plain scalar, which may go on over deeper lines."""
        if text[0] in "[{":
            value, rest = self._flow(text, 0, indent)
            if rest.strip(" \t") and not rest.lstrip(" \t").startswith("#"):
                raise YamlError("text follows a flow collection")
            return value
        if text[0] in "\"'":
            while True:
                try:
                    value, rest = self._quoted(text)
                    break
                except YamlError:
                    if self.i >= len(self.lines):
                        raise
                    line = self.lines[self.i].strip(" \t")
                    # lines fold: a line break is a space, an empty line a line break
                    text = text.rstrip(" \t") + ("\n" if line == "" else ("" if text.endswith("\n") else " ") + line)
                    self.i += 1
            if rest.strip(" \t") and not rest.lstrip(" \t").startswith("#"):
                raise YamlError("text follows a quoted scalar")
            return value
        if text[0] == "*":
            name = text[1:].split("#")[0].strip()
            if name not in self.anchors:
                raise YamlError("an alias names no anchor")
            return self.anchors[name]
        if text[0] in "@`%":
            raise YamlError("a plain scalar starts with a reserved character")
        parts = [self._comment_off(text)]
        if re.search(r":(?=[ \t]|\Z)", parts[0]):
            raise YamlError("a mapping stands where a scalar should")
        while parts[-1] is not None and self.i < len(self.lines):
            line = self.lines[self.i]
            body = line.lstrip(" ")
            if body.strip(" \t") == "" or len(line) - len(body) <= indent or body[0] == "#":
                break
            if self._key(body) is not None:
                raise YamlError("a mapping stands inside a scalar")
            parts.append(self._comment_off(body))
            self.i += 1
        return resolve(" ".join(p.strip(" \t") for p in parts))

    def _comment_off(self, s: str) -> str:
        m = re.search(r"(?:^|[ \t])#", s)
        return s[: m.start()] if m else s

    def _quoted(self, s: str) -> tuple[str, str]:
        if s[0] == "'":
            m = re.match(r"'((?:[^']|'')*)'", s)
            if not m:
                raise YamlError("a quotation is not closed")
            return m[1].replace("''", "'"), s[m.end() :]
        out, i = [], 1
        while i < len(s):
            c = s[i]
            if c == '"':
                return "".join(out), s[i + 1 :]
            if c != "\\":
                out.append(c)
                i += 1
                continue
            e = s[i + 1 : i + 2]
            width = {"x": 2, "u": 4, "U": 8}.get(e)
            if width:
                code = s[i + 2 : i + 2 + width]
                if not re.fullmatch(r"[0-9a-fA-F]+", code) or len(code) < width:
                    raise YamlError("an escape is malformed")
                out.append(chr(int(code, 16)))
                i += 2 + width
            elif e in _ESCAPES and e:
                out.append(_ESCAPES[e])
                i += 2
            else:
                raise YamlError("an escape is unknown")
        raise YamlError("a quotation is not closed")

    def _more(self, text: str) -> str:
        if self.i >= len(self.lines):
            raise YamlError("a flow collection is not closed")
        line = self.lines[self.i].strip(" \t")
        self.i += 1
        return "" if line.startswith("#") else line

    def _skip(self, s: str) -> str:
        while True:
            s = s.lstrip(" \t")
            if s == "" or s[0] == "#":
                s = self._more(s)
                continue
            return s

    def _flow(self, s: str, depth: int, indent: int):
        """(value, rest) of a flow value at the start of ``s``."""
        if depth > 200:
            raise YamlError("collections are nested too deeply")
        s = self._skip(s)
        if s[0] == "[":
            out: list = []
            s = self._skip(s[1:])
            while s[0] != "]":
                value, s = self._flow(s, depth + 1, indent)
                s = self._skip(s)
                if s[0] == ":" and s[1:2] in ("", " ", "\t"):
                    inner, s = self._flow(s[1:], depth + 1, indent)
                    value, s = {value: inner}, self._skip(s)
                out.append(value)
                if s[0] == ",":
                    s = self._skip(s[1:])
                elif s[0] != "]":
                    raise YamlError("a comma is missing in a flow collection")
            return out, s[1:]
        if s[0] == "{":
            found: dict = {}
            s = self._skip(s[1:])
            while s[0] != "}":
                key, s = self._flow(s, depth + 1, indent)
                s = self._skip(s)
                value = None
                if s[0] == ":":
                    s = self._skip(s[1:])
                    if s[0] not in ",}":
                        value, s = self._flow(s, depth + 1, indent)
                        s = self._skip(s)
                if key in found:
                    self.repeated.append(str(key))
                found[key] = value
                if s[0] == ",":
                    s = self._skip(s[1:])
                elif s[0] != "}":
                    raise YamlError("a comma is missing in a flow collection")
            return found, s[1:]
        if s[0] in "\"'":
            return self._quoted(s)
        if s[0] in ",":
            raise YamlError("an item is missing in a flow collection")
        m = re.match(r"(?:[^,\[\]{}:#]|:(?=[^ \t,\[\]{}])|(?<=[^ \t])#)+", s)
        if not m:
            raise YamlError("a flow collection is malformed")
        word = m[0].strip(" \t")
        if word[:1] == "*":
            if word[1:] not in self.anchors:
                raise YamlError("an alias names no anchor")
            return self.anchors[word[1:]], s[m.end() :]
        return resolve(word), s[m.end() :]


def read_block(raw: str) -> tuple[dict, str | None, list[str]]:
    """(data, error, repeated keys) of a block's content."""
    reader = Reader(raw)
    try:
        data = reader.document()
    except (YamlError, RecursionError, TypeError, IndexError) as e:
        return {}, str(e) or "the block is malformed", []
    if not isinstance(data, dict):
        return {}, "the block is no mapping", []
    return data, None, reader.repeated


def number_text(x: float | int) -> str:
    """A number as the shortest text that reads back, whole numbers without a point, 1e21 and up with an exponent."""
    if isinstance(x, int) and abs(x) < 10**21:
        return str(x)
    x = float(x)
    if x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "Infinity" if x > 0 else "-Infinity"
    if x == 0:
        return "0"
    digits, exponent = f"{x:.17e}", 0
    digits = repr(x)
    m = re.fullmatch(r"(-?)(\d+)(?:\.(\d+))?(?:e([-+]\d+))?", digits)
    sign, whole, part, exponent = m[1], m[2], m[3] or "", int(m[4] or 0)
    all_ = (whole + part).lstrip("0")
    point = len(whole) + exponent - (len(whole + part) - len((whole + part).lstrip("0")))
    all_ = all_.rstrip("0") or "0"
    if 0 < point <= 21:
        return sign + (all_ + "0" * (point - len(all_)) if point >= len(all_) else all_[:point] + "." + all_[point:])
    if -6 < point <= 0:
        return sign + "0." + "0" * -point + all_
    e = point - 1
    return sign + all_[0] + ("." + all_[1:] if len(all_) > 1 else "") + "e" + ("+" if e >= 0 else "-") + str(abs(e))


def scalar_text(v) -> str | None:
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return number_text(v)
    return v if isinstance(v, str) else None


def list_text(v) -> list[str]:
    if isinstance(v, list):
        return [t for t in map(scalar_text, v) if t is not None]
    one = scalar_text(v)
    return [] if one is None else [one]


def view(data: dict) -> dict:
    """The typed fields, what could not be read, and the rest."""
    out = {k: scalar_text(data.get(k)) for k in SCALAR_FIELDS} | {k: list_text(data.get(k)) for k in LIST_FIELDS}
    lists = {k: data[k] for k in LIST_FIELDS if data.get(k) is not None}
    known = {*SCALAR_FIELDS, *LIST_FIELDS}
    title = data.get("title")
    return out | {
        "unread_scalars": [k for k in SCALAR_FIELDS if data.get(k) is not None and out[k] is None],
        "unread_lists": [k for k, v in lists.items() if not isinstance(v, list) and not out[k]],
        "dropped": [{"field": k, "n": len(v) - len(out[k]), "of": len(v)} for k, v in lists.items() if isinstance(v, list) and len(v) > len(out[k])],
        "written_title": title.strip(SPACES) if isinstance(title, str) and title.strip(SPACES) else None,
        "fields": [str(k) for k in data],
        "unrecognized": json.dumps({str(k): v for k, v in data.items() if k not in known}, ensure_ascii=False, default=str),
    }


def _units(s: str) -> int:
    return len(s) + sum(c > "￿" for c in s)


_STRINGS = T.ArrayType(T.StringType())
_FIELDS = [
    *[(k, T.StringType()) for k in SCALAR_FIELDS],
    *[(k, _STRINGS) for k in LIST_FIELDS],
    ("unread_scalars", _STRINGS),
    ("unread_lists", _STRINGS),
    ("dropped", T.ArrayType(T.StructType([T.StructField("field", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("of", T.IntegerType())]))),
    ("written_title", T.StringType()),
    ("fields", _STRINGS),
    ("unrecognized", T.StringType()),
    ("parse_error", T.StringType()),
    ("duplicate_keys", _STRINGS),
    ("body", T.StringType()),
    ("body_line", T.IntegerType()),
    ("block_start", T.IntegerType()),
    ("content_start", T.IntegerType()),
    ("content_end", T.IntegerType()),
    ("block_end", T.IntegerType()),
    ("raw", T.StringType()),
    ("eol", T.StringType()),
]


def read_text(text: str) -> dict:
    block = locate(text)
    data, error, repeated = read_block(block["raw"]) if block else ({}, None, [])
    end = block["end"] if block else 0
    units = {k: _units(text[: block[k]]) if block else None for k in ("start", "content_start", "content_end", "end")}
    return view(data) | {"parse_error": error, "duplicate_keys": repeated, "body": text[end:], "body_line": text[:end].count("\n"), "block_start": units["start"], "content_start": units["content_start"], "content_end": units["content_end"], "block_end": units["end"], "raw": block and block["raw"], "eol": block and block["eol"]}


def with_frontmatter(files: DataFrame) -> DataFrame:
    """files(path, name, text, …) with the typed fields, the body and the block's place added.

    A null text is read as empty. Columns of the added names are replaced.
    """
    added = [k for k, _ in _FIELDS]
    keep = [c for c in files.columns if c not in added]
    schema = T.StructType([*[files.schema[c] for c in keep], *[T.StructField(k, t) for k, t in _FIELDS]])

    def run(batches):
        import pyarrow as pa

        kinds = {k: {T.StringType: pa.string(), T.IntegerType: pa.int32()}.get(type(t)) for k, t in _FIELDS}
        for batch in batches:
            rows = [read_text(t.as_py() or "") for t in batch.column("text")]
            made = []
            for k, t in _FIELDS:
                kind = kinds[k] or (pa.list_(pa.string()) if t is _STRINGS else pa.list_(pa.struct([("field", pa.string()), ("n", pa.int32()), ("of", pa.int32())])))
                made.append(pa.array([r[k] for r in rows], kind))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], names=[*keep, *added])

    return files.mapInArrow(run, schema)


def read_documents(files: DataFrame) -> DataFrame:
    """Documents ready for passages, links and validation: frontmatter, first heading, title, numbering."""
    from ..operators.spans import first_h1

    d = with_frontmatter(files).withColumn("h1", first_h1(F.col("body")))
    d = d.withColumn("title", F.coalesce("written_title", "h1", "name"))
    return d if "walk_no" not in d.columns else d.withColumn("doc_no", F.col("walk_no"))
