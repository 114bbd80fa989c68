"""Token counts by offset-mapped attribution (operator 5).

A whole document is encoded once by a byte-level BPE; the running sum of the tokens' byte lengths
gives every token its byte span, which is mapped to the span of characters that it touches (a token
may end within a character, and the next begin there). Sections are spans of characters of the same
document: its lines, spans that a column names, or named fields laid end to end. An interval join on
sorted ends finds the sections that each token's span meets; a token that crosses a boundary is
allocated by an explicit rule:

* ``first``: to the section that holds its first character (the default);
* ``last``: to the section that holds its last character;
* ``most``: to the section that holds most of its characters, the earlier one if equal.

Every token counts once. Lines cover a document, so their counts sum to the document's; tokens that
fall between the spans of a column are told apart. A line owns its line feed.

Nulls and edges: null and empty texts have no tokens, no lines and counts of 0 for any spans. Texts of
any length are encoded whole. Rows that repeat are answered each; an empty table stays empty. Columns
that are not asked for are ignored, and the key may have any name but a result's.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("first", "last", "most")
_LOADED: dict[str, tuple] = {}


def encoder(rank_path: str):
    """(encoding, byte length of each id) of a file of base64 tokens and ranks; kept per process."""
    if rank_path not in _LOADED:
        import public_tokenizers
        import tiktoken

        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        length = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            length[rank] = len(token)
        _LOADED[rank_path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), length
    return _LOADED[rank_path]


def line_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where the lines of a text start and end, in characters, each with its line feed; an empty text has none."""
    ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32) == 10) + 1
    if len(text) and (not len(ends) or ends[-1] < len(text)):
        ends = np.append(ends, len(text))
    return np.concatenate(([0], ends[:-1])) if len(ends) else ends, ends


def spans(text: str, rank_path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, start, end) of a text's tokens; a span covers each character that the token holds a byte of."""
    coding, length = encoder(rank_path)
    ids = np.array(coding.encode_ordinary(text), dtype=np.int64)
    if not len(ids):
        return ids, ids, ids
    stop = np.cumsum(length[ids])
    character = np.cumsum((np.frombuffer(text.encode(), dtype=np.uint8) & 0xC0) != 0x80) - 1
    return ids, character[stop - length[ids]], character[stop - 1] + 1


def allocate(start: np.ndarray, end: np.ndarray, section_start: np.ndarray, section_end: np.ndarray, rule: str) -> np.ndarray:
    """The section number of each token span, -1 where it meets none; sections are sorted and disjoint."""
    if not len(section_end) or not len(start):
        return np.full(len(start), -1, dtype=np.int64)

    def holding(at):
        i = np.minimum(np.searchsorted(section_end, at, side="right"), len(section_end) - 1)
        return np.where((section_start[i] <= at) & (at < section_end[i]), i, -1)

    if rule != "most":
        return holding(start if rule == "first" else end - 1)
    first = np.searchsorted(section_end, start, side="right")  # the first section that ends behind the start
    last = np.searchsorted(section_start, end - 1, side="right") - 1
    out = np.where(first == last, first, -1)
    for t in np.flatnonzero(last > first):
        held = np.minimum(section_end[first[t] : last[t] + 1], end[t]) - np.maximum(section_start[first[t] : last[t] + 1], start[t])
        out[t] = first[t] + int(np.argmax(held))
    return out


def attribute(text: str, rank_path: str, rule: str, sections: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, tokens of each section, tokens of none) of one text; sections are its lines unless given."""
    ids, start, end = spans(text, rank_path)
    section_start, section_end = line_spans(text) if sections is None else sections
    to = allocate(start, end, section_start, section_end, rule)
    return ids, np.bincount(to[to >= 0], minlength=len(section_end)), int((to < 0).sum())


def token_spans(df: DataFrame, rank_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>, start array<int>, end array<int>): each token's span of characters."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            got = [spans(t.as_py() or "", rank_path) for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([batch.column("_key"), *(pa.array([g[i].astype(np.int32) for g in got], pa.list_(pa.int32())) for i in range(3))], names=["_key", "ids", "start", "end"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, f"_key {kind}, ids array<int>, start array<int>, end array<int>").withColumnRenamed("_key", key)


def section_counts(df: DataFrame, rank_path: str, rule: str = "first", key: str = "doc_id", text: str = "text", sections: str | None = None) -> DataFrame:
    """(key, n_tokens, n_sections, section_tokens array<int>, n_outside, ids_sha256) per row.

    Sections are the lines, or the spans in the column ``sections`` (array<struct<start,end>>, in
    characters, sorted and disjoint; null: none). ``n_outside`` counts the tokens that meet none by the rule.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n, s, c, o, h = [], [], [], [], []
            given = batch.column("_sections").to_pylist() if sections else [None] * batch.num_rows
            for t, each in zip(batch.column("_text"), given, strict=True):
                own = None if not sections else tuple(np.array([x[k] for x in each or ()], dtype=np.int64) for k in ("start", "end"))
                ids, counts, outside = attribute(t.as_py() or "", rank_path, rule, own)
                n.append(len(ids))
                s.append(len(counts))
                c.append(counts.astype(np.int32))
                o.append(outside)
                h.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(n, pa.int64()), pa.array(s, pa.int64()), pa.array(c, pa.list_(pa.int32())), pa.array(o, pa.int64()), pa.array(h, pa.string())], names=["_key", "n_tokens", "n_sections", "section_tokens", "n_outside", "ids_sha256"])

    kind = df.schema[key].dataType.simpleString()
    asked = [F.col(key).alias("_key"), F.col(text).alias("_text")]
    if sections:
        asked.append(F.transform(F.coalesce(F.col(sections), F.array().cast(df.schema[sections].dataType)), lambda x: F.struct(x["start"].cast("long").alias("start"), x["end"].cast("long").alias("end"))).alias("_sections"))
    out = df.select(*asked).mapInArrow(run, f"_key {kind}, n_tokens long, n_sections long, section_tokens array<int>, n_outside long, ids_sha256 string")
    return out.withColumnRenamed("_key", key)


def field_counts(df: DataFrame, fields: list[str], rank_path: str, rule: str = "first", key: str = "doc_id", joiner: str = "\n") -> DataFrame:
    """(key, field, n_tokens): the fields are laid end to end, encoded as one text and attributed.

    A joiner belongs to the field before it. A null field is empty and has no tokens of its own.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = {"_key": [], "field": [], "n_tokens": []}
            columns = [batch.column(f"_f{i}").to_pylist() for i in range(len(fields))]
            for k, *values in zip(batch.column("_key").to_pylist(), *columns, strict=True):
                parts = [(v or "") + (joiner if i + 1 < len(fields) else "") for i, v in enumerate(values)]
                ends = np.cumsum([len(p) for p in parts])
                _, counts, _ = attribute("".join(parts), rank_path, rule, (ends - [len(p) for p in parts], ends))
                out["_key"] += [k] * len(fields)
                out["field"] += fields
                out["n_tokens"] += counts[: len(fields)].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out["_key"], batch.column("_key").type), pa.array(out["field"], pa.string()), pa.array(out["n_tokens"], pa.int64())], names=list(out))

    out = df.select(F.col(key).alias("_key"), *[F.col(f).cast("string").alias(f"_f{i}") for i, f in enumerate(fields)]).mapInArrow(run, f"_key {kind}, field string, n_tokens long")
    return out.withColumnRenamed("_key", key)
