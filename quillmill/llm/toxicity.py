"""Toxicity by a weighted lexicon matched with Aho-Corasick (operator 2).

Texts are folded first: lower case, compatibility forms, Cyrillic, Greek and other look-alikes to
Latin letters, and digits and signs that stand for letters; all else that is no letter becomes a
space. Lexicon entries are beginnings of words of ``LENGTHS`` letters, or whole words of any length,
each with a weight. Exceptions weigh nothing: longer beginnings that clean texts hold, and phrases of
two words, one of which an entry fits, that clean texts hold and toxic ones rather do not. One
automaton holds all; at a word the longest entry wins, and a phrase takes both its words, so an
exception silences the entry it extends or holds. The sum of the weights, normalised by the number of
words and by its logarithm, goes through a logistic curve to a score from 0 to 1.

The lexicon is learned from document frequencies in labelled rows, its curve from the same rows: a
sample of about ``ROWS`` of each label, by a hash of the id. In it copies and near copies count as one
document (they share a least shingle hash), so that the words of a text that is often copied are not
taken for signs of its label; entries found in fewer than one toxic document of 80, or ``LEAST`` of
them, are left out, and of what is left the ``ENTRIES`` of the most weight stay. Texts of any length are
learned from and scored whole.

Null, empty and wordless texts get the score of no match. Without a toxic labelled row all scores
are 0. Repeated rows are answered each; an id labelled twice has the larger label. An empty table
stays empty. Extra columns are ignored or kept, as asked; a kept column named as a result is replaced.
"""

from __future__ import annotations

import itertools
import math
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_results
from .shingles import mix, shingle_sets

ROWS = 4_000
LEAST = 6
LENGTHS = range(4, 11)
ENTRIES = 4_000
LOG_ODDS = 3.0
SKETCHES = 3

# fixed values: look-alikes of Latin letters, and digits and signs that stand for letters
LOOKALIKES = {"а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ʟ": "l"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}
DIGIT_CHARS = "".join(DIGITS)


class _Fold(dict):
    """Maps code points for str.translate; learns as it goes."""

    def __missing__(self, code: int):
        c = chr(code)
        out = "".join(LOOKALIKES.get(x, x) for x in unicodedata.normalize("NFKC", c).lower())
        out = "".join(x if x.isalpha() else " " for x in unicodedata.normalize("NFC", out)) or " "
        if unicodedata.combining(c) or unicodedata.category(c) == "Cf":
            out = ""
        self[code] = out
        return out


_FOLD = _Fold()
_SUBSTITUTE = str.maketrans(DIGITS)


def _unmask(text: str) -> str:
    """Digits and signs between or beside letters of one word become letters."""
    import re

    return re.sub(rf"(?<=[^\W\d_])[{DIGIT_CHARS}]+(?=[^\W\d_])|\b[013457]+(?=[^\W\d_])", lambda m: m[0].translate(_SUBSTITUTE), text)


def fold(text: str) -> str:
    if any(c in text for c in DIGIT_CHARS):
        text = _unmask(text)
    if text.isascii():
        return text.lower().translate(_ASCII)
    return text.lower().translate(_FOLD)


_ASCII = "".join(chr(i) if chr(i).isalpha() else " " for i in range(128))


class Lexicon:
    """Entries (weight 0: exception) in an automaton, and the curve's coefficients."""

    def __init__(self, entries: dict[str, float], curve: tuple[float, ...]):
        self.entries, self.curve, self._automaton = entries, curve, None

    def __getstate__(self):
        return {"entries": self.entries, "curve": self.curve, "_automaton": None}

    def matched(self, text: str) -> tuple[float, int]:
        """(sum of weights, number of words) of a whole text."""
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for k, v in self.entries.items():
                self._automaton.add_word(" " + k, v)
            self._automaton.make_automaton()
        words = fold(text).split()
        # two blanks between words: a match that takes a word's end blank leaves the next word's first
        found = self._automaton.iter_long(" " + "  ".join(words) + " ") if self.entries else ()
        return float(sum(w for _, w in found)), len(words)

    def score(self, text: str | None) -> tuple[float, float, int]:
        total, words = self.matched(text or "")
        return self.curve_at(total, words), total, words

    def curve_at(self, total: float, words: int) -> float:
        z = sum(a * b for a, b in zip(self.curve, features(total, words), strict=True))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def features(total: float, words: int) -> tuple[float, float, float]:
    """1, and the sum of the weights in two measures of the length."""
    return 1.0, math.log1p(total) / math.log(words + 2), math.log1p(100 * total / max(words, 1))


def _curve(rows: list[tuple[int, float, int]], weights: dict[int, float]) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps; rows are weighted to their label's true share."""
    x = np.array([features(t, n) for _, t, n in rows])
    y = np.array([label for label, _, _ in rows], dtype=float)
    w = np.array([weights[label] for label, _, _ in rows])
    b = np.zeros(3)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (w * (y - p)) - 0.05 * b
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3)
        step = np.linalg.solve(hess, grad)
        b += np.clip(step, -2, 2)
    return tuple(b)


def beginnings(text: str) -> set[str]:
    out = set()
    for w in set(fold(text).split()):
        out.update(w[:n] for n in LENGTHS if n <= len(w))
        out.add(w + " ")
    return out


def phrases(text: str, entries: dict[str, float]) -> set[str]:
    """The pairs of neighbouring words of which an entry fits one, as the automaton meets them."""
    words = fold(text).split()
    fits = {w: w + " " in entries or any(w[:n] in entries for n in LENGTHS) for w in set(words)}
    return {f"{a}  {b} " for a, b in itertools.pairwise(words) if fits[a] or fits[b]}


def _odds(t: int, c: int, toxic: int, clean: int) -> float:
    return math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))


def choose(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Entries with weights, and exceptions, from (toxic, clean) document frequencies."""

    def odds(t, c):
        return _odds(t, c, toxic, clean)

    least = max(LEAST, toxic // 80)
    good = {k: odds(t, c) for k, (t, c) in counts.items() if t >= least and odds(t, c) >= LOG_ODDS}
    longer: dict[str, list[str]] = {}
    for k in good:
        longer.setdefault(k[:-1], []).append(k)
    out: dict[str, float] = {}
    for k in sorted(good, key=lambda k: (len(k), k)):
        # a longer beginning adds nothing to one that is as telling
        if not any(k[:n] in out for n in range(LENGTHS.start, len(k))):
            # but the longest one that nearly as many texts hold is the surer
            while more := [x for x in longer.get(k, ()) if not x.endswith(" ") and counts[x][0] >= 0.98 * counts[k][0]]:
                k = min(more)
            out[k] = good[k]
    top = sorted(out, key=lambda k: (-counts[k][0] * out[k], k))[:ENTRIES]
    out = {k: out[k] for k in top}
    for k, (t, c) in counts.items():
        if c >= 2 and odds(t, c) < 0 and k not in out and any(k[:n] in out for n in range(LENGTHS.start, len(k))):
            out[k] = 0.0
    return out


def _without_copies(sample: DataFrame) -> DataFrame:
    """(toxic, text): of rows of one label that share one of ``SKETCHES`` least shingle hashes the one of the least id stays."""
    names = [f"m{i}" for i in range(SKETCHES)]

    def sketch(batches):
        import pyarrow as pa

        for batch in batches:
            sets = shingle_sets(batch.column("text"))
            out = {c: batch.column(c) for c in ("doc_id", "toxic", "text")}
            for i, name in enumerate(names):
                out[name] = pa.array([int(mix(s, 31 + i).min().view(np.int64)) if len(s) else 0 for s in sets], pa.int64())
            yield pa.RecordBatch.from_pydict(out)

    schema = sample.select("doc_id", "toxic", "text").schema
    out = sample.select("doc_id", "toxic", "text").mapInArrow(sketch, ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in schema] + [f"{n} long" for n in names]))
    for name in names:
        rest = [c for c in out.columns if c not in ("toxic", name)]
        out = out.groupBy("toxic", name).agg(F.min(F.struct(*rest)).alias("row")).select("toxic", name, "row.*")
    return out.select("toxic", "text")


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Lexicon:
    """Learns from ``docs`` (doc_id, text) joined to ``labels`` (doc_id, toxic 0 or 1)."""
    labels = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r.toxic: r["count"] for r in labels.groupBy("toxic").count().collect()}
    if not n.get(1):
        return Lexicon({}, (-40.0, 0.0, 0.0))
    share = F.when(F.col("toxic") == 1, int(min(1.0, rows / n[1]) * 1_000_000)).otherwise(int(min(1.0, rows / max(n.get(0, 0), 1)) * 1_000_000))
    chosen = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
    texts = _without_copies(docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))

    def frequencies(batches, what):
        import pyarrow as pa

        seen: dict[str, list[int]] = {"": [0, 0]}
        for batch in batches:
            for label, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for k in {"", *what(text)}:
                    seen.setdefault(k, [0, 0])[label] += 1
        yield pa.RecordBatch.from_pydict({"k": pa.array(list(seen), pa.string()), "c": pa.array([v[0] for v in seen.values()], pa.int64()), "t": pa.array([v[1] for v in seen.values()], pa.int64())})

    def counted(what):
        return texts.mapInArrow(lambda batches: frequencies(batches, what), "k string, c long, t long").groupBy("k").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))

    # what may be an entry, and what could be an exception to one: bounded by the sample
    table = counted(beginnings).where(f"k = '' or t >= {LEAST} and t > c or c >= 2 and length(k) > {LENGTHS.start}").collect()
    counts = {r.k: (r.t, r.c) for r in table}
    toxic, clean = counts.pop("", (0, 0))
    entries = choose(counts, toxic, clean)
    if entries:
        told = counted(lambda text: phrases(text, entries)).where("k <> '' and c >= 2 and c > t").collect()
        entries |= {r.k: 0.0 for r in told if _odds(r.t, r.c, toxic, clean) < 0}
    lexicon = Lexicon(entries, (0.0, 0.0, 0.0))

    def match(batches):
        import pyarrow as pa

        for batch in batches:
            got = [lexicon.matched(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"toxic": batch.column("toxic").cast(pa.int32()), "total": pa.array([g[0] for g in got], pa.float64()), "words": pa.array([g[1] for g in got], pa.int64())})

    seen = [(r.toxic, r.total, r.words) for r in texts.mapInArrow(match, "toxic int, total double, words long").collect()]
    have = {k: max(1, sum(r[0] == k for r in seen)) for k in (0, 1)}
    lexicon.curve = _curve(seen, {k: n.get(k, 0) / have[k] / (sum(n.values()) / max(len(seen), 1)) for k in (0, 1)})
    return lexicon


def toxicity(docs: DataFrame, lexicon: Lexicon, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` with score, weight (sum of the entries' weights) and words."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            got = [lexicon.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.int64())], names=["row", "score", "weight", "words"])

    return with_results(docs, keep, text, run, "score double, weight double, words long")
