"""Scores of passages for many wordings, made where the passages are read.

Where wordings hold words that most passages share, there are nearly as many scores as wordings times
passages. They are made in blocks of CELLS and a task keeps no more than each wording's best, so none is
shuffled or written. numpy counts and adds within a block; Spark deals the passages and merges what is kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..constants import BM25_B, BM25_K1

#: Scores, and parts of scores, that a task holds at a time (a single passage may have more).
CELLS = 2_000_000
#: More than rounding can move a score, so that none is left out that ties once rounded.
MARGIN = 1e-8


@dataclass
class Asked:
    """Wordings (query_id, wording_no) by number, their distinct terms, and term by term the wordings that
    hold it, how often, and its idf in each field."""

    wordings: pa.Table
    terms: pa.Array
    start: np.ndarray
    wording: np.ndarray
    times: np.ndarray
    idf: dict[str, np.ndarray]
    average: dict[str, float]
    weight: dict[str, float]


def prepared(asked: pa.Table, df: pa.Table, stats: dict[str, tuple[int, float]], weight: dict[str, float]) -> Asked:
    """From (query_id, wording_no, term, times), (field, term, df), each field's (n, average) and weight."""
    one = lambda t, c: t.column(c).combine_chunks()
    words = one(asked, "term").cast(pa.string())
    terms = words.unique()
    code = [one(asked, c).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in ("query_id", "wording_no")]
    _, first, number = np.unique(code[0] * (code[1].max(initial=0) + 1) + code[1], return_index=True, return_inverse=True)
    term = pc.index_in(words, value_set=terms).to_numpy(zero_copy_only=False)
    order = np.lexsort((number, term))
    idf = {}
    for field, (n, _) in stats.items():
        of = df.filter(pc.equal(df["field"], field))
        count = np.zeros(len(terms))
        count[pc.index_in(one(of, "term").cast(pa.string()), value_set=terms).to_numpy(zero_copy_only=False)] = one(of, "df").to_numpy()
        idf[field] = np.log(1 + (n - count + 0.5) / (count + 0.5))
    times = one(asked, "times").to_numpy().astype(float)
    return Asked(asked.select(["query_id", "wording_no"]).take(pa.array(first)), terms, np.searchsorted(term[order], np.arange(len(terms) + 1)), number[order], times[order], idf, {f: a for f, (_, a) in stats.items()}, {f: w for f, w in weight.items() if w and f in stats})


def _parts(batch: pa.RecordBatch, asked: Asked) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, part) of each asked term of each row's fields, in the order of rows."""
    found = []
    for field, weight in asked.weight.items():
        lists = batch.column(field)
        term = pc.index_in(lists.flatten(), value_set=asked.terms)
        held = np.flatnonzero(term.is_valid().to_numpy(zero_copy_only=False))
        row = pc.list_parent_indices(lists).to_numpy()[held].astype(np.int64)
        key, tf = np.unique(row * len(asked.terms) + term.drop_null().to_numpy(), return_counts=True)
        row, term = key // len(asked.terms), key % len(asked.terms)
        length = batch.column(f"{field}_length").to_numpy(zero_copy_only=False)[row]
        norm = BM25_K1 * (1 - BM25_B + BM25_B * length / asked.average[field]) if len(row) else 0
        found.append((row, term, weight * (asked.idf[field][term] * (tf * (BM25_K1 + 1)) / (tf + norm))))
    row, term, part = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(row, kind="stable")
    return row[order], term[order], part[order]


def _blocks(row: np.ndarray, width: np.ndarray, most: int):
    """(lo, hi) of what holds whole rows, at most ``most`` of them and CELLS parts, but one row at least."""
    ends = np.append(np.flatnonzero(np.diff(row)) + 1, len(row))
    upto, lo, at = np.cumsum(width)[ends - 1], 0, 0
    while at < len(ends):
        base = upto[at - 1] if at else 0
        to = max(at + 1, min(at + most, int(np.searchsorted(upto, base + CELLS, "right"))))
        yield lo, ends[to - 1]
        lo, at = ends[to - 1], to


def _first(found: pa.Table, limit: int) -> tuple[pa.Table, np.ndarray]:
    """Each wording's first rows, and their places from 0: score descending, then path and start line."""
    found = found.take(pc.sort_indices(found, sort_keys=[("w", "ascending"), ("rounded", "descending"), ("path", "ascending"), ("start_line", "ascending")]))
    w = found["w"].to_numpy()
    place = np.arange(len(w)) - np.searchsorted(w, w, "left")
    return found.filter(pa.array(place < limit)), place[place < limit]


def best_in_task(asked: Asked, limit: int, decimals: int, schema: pa.Schema):
    """A function for mapInArrow: passages to each wording's best (query_id, wording_no, score, path, lines)."""

    def run(batches):
        n = len(asked.wordings)
        least = np.full(n, np.nextafter(0, 1))
        kept, fresh, held = [], [], 0

        def merge():
            nonlocal kept, fresh, held
            table, place = _first(pa.concat_tables([*kept, *fresh]), limit)
            last = place == limit - 1
            least[table["w"].to_numpy()[last]] = np.maximum(table["rounded"].to_numpy()[last] - MARGIN, np.nextafter(0, 1))
            kept, fresh, held = [table], [], 0

        for batch in batches:
            row, term, part = _parts(batch, asked)
            if not len(row):
                continue
            width = asked.start[term + 1] - asked.start[term]
            for lo, hi in _blocks(row, width, max(1, CELLS // n)):
                rows, near = np.unique(row[lo:hi], return_inverse=True)
                wide = width[lo:hi]
                each = np.repeat(np.arange(hi - lo), wide)
                at = np.arange(len(each)) + np.repeat(asked.start[term[lo:hi]] - np.cumsum(wide) + wide, wide)
                score = np.bincount(near[each] * n + asked.wording[at], weights=part[lo:hi][each] * asked.times[at], minlength=len(rows) * n).reshape(len(rows), n)
                good = score >= least
                if len(rows) > limit and np.count_nonzero(good) > 4 * n * limit:
                    good &= score >= np.partition(score, len(rows) - limit, axis=0)[len(rows) - limit] - MARGIN
                r, w = np.nonzero(good)
                if not len(r):
                    continue
                of = pa.Table.from_batches([batch.select(["path", "start_line", "end_line"])]).take(pa.array(rows[r]))
                fresh.append(of.append_column("w", pa.array(w)).append_column("score", pa.array(score[r, w])).append_column("rounded", pa.array(np.round(score[r, w], decimals))))
                held += len(r)
                if held >= max(n * limit, 10_000):
                    merge()
        if fresh:
            merge()
        for table in kept:
            names = asked.wordings.take(table["w"])
            out = {**{c: names[c] for c in names.column_names}, **{c: table[c] for c in ("score", "path", "start_line", "end_line")}}
            yield from pa.table([out[f.name].cast(f.type) for f in schema], schema=schema).to_batches(10_000)

    return run
