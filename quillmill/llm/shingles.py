"""Word-shingle hashes of whole texts, computed batch-wise with numpy on the raw UTF-8 bytes.

Words are runs of bytes other than space and TAB..CR after lower-casing A-Z; a shingle is
``width`` consecutive words, or the whole sequence of a shorter text. 64-bit hashes stand for
words and shingles.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[[9, 10, 11, 12, 13, 32]] = False
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        m = max(n, 1 << 21)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(m, U(base), dtype=U)
            x[0] = U(1)
            _POWERS[name] = np.cumprod(x, dtype=U)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser; distinct salts give independent orders of the same tokens."""
    x = x ^ U(salt * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document number) of each word; ``bounds`` are the byte offsets of the documents."""
    data = _LOWER[data]
    inside = _IN_WORD[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[bounds] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=total[1:])
    words = mix((total[end] - total[start]) * down[start] + (end - start).astype(U))
    return words, np.searchsorted(bounds, start, side="right") - 1


def shingle_sets(column, width: int = 5) -> list[np.ndarray]:
    """For each text of an Arrow string column (null: empty) its sorted distinct shingle hashes."""
    import pyarrow as pa

    column = column.fill_null("").cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[bounds[0] : bounds[-1]] if raw is not None else np.zeros(0, dtype=np.uint8)
    words, docs = word_hashes(data, bounds - bounds[0])
    ends = np.searchsorted(docs, np.arange(len(column) + 1))
    if len(words) >= width:
        v = words[: len(words) - width + 1].copy()
        for k in range(1, width):
            v = (v ^ (v >> U(29))) * U(0xBF58476D1CE4E5B9) + words[k : len(words) - width + 1 + k]
        v = mix(v, width)
    out = []
    for i in range(len(column)):
        a, b = ends[i], ends[i + 1]
        if b - a >= width:
            s = np.sort(v[a : b - width + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            x = np.zeros(1, dtype=U)
            for w in words[a:b]:
                x = mix(x * U(3) + w, 7 + int(b - a))
            out.append(x)
        else:
            out.append(np.zeros(0, dtype=U))
    return out
