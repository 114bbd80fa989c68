"""Language identification by interpolated Kneser-Ney character models (operator 1).

A text's words are its runs of letters, lower-cased, each read with a begin and an end mark; per
language, an order-5 interpolated Kneser-Ney model gives every character and end mark a probability.
The models of all languages lie in one set of sorted arrays of n-gram hashes with a column of log
probabilities per language and one of back-off weights for contexts. The language of the lowest
cross-entropy per character wins. The score is a softmax of the cross-entropies, its scale fitted on
rows kept out of the counts. A text is rejected if its cross-entropy, each word read by the model that
fits it best, exceeds a calibrated limit that widens for short texts: a text in two known languages
is kept, one in none is not.

Models are fitted on a bounded sample of every language that labels a text with letters: the ``ROWS``
distinct texts of the least hash (fewer each beyond ``FULL_LANGUAGES`` languages), of ``TEXT_CHARS``
characters or fewer; of a language with longer texts only, their first ``TEXT_CHARS`` letters. A
language of fewer than ``KEPT_OUT`` texts is learned from all of them. More than ``LANGUAGES``
languages are an error, not cut. Every text is predicted whole: a task scores each distinct word once
while its word table lasts, and sums.

A null or empty text, or one without letters, is ``und`` with score 0 and rejected. Without any
labelled row every text is. Ties go to the language that sorts first. Texts of any length are read
whole. Rows that repeat are answered each; an empty table stays empty. Extra columns are ignored or
kept, as asked; a kept column named as a result is replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, with_results
from .shingles import U, _powers, mix

ORDER = 5
ROWS = 400
LANGUAGES = 256  # models are dense in languages
FULL_LANGUAGES = 64
TEXT_CHARS = 20_000
KEPT_OUT = 5  # every fifth row calibrates
UNSEEN = 5_000  # characters that share the probability of unseen ones
MARGIN = 2.0  # times the widest deviation among the rows that calibrate
KNOWN_WORDS = 600_000
SLICE_BYTES = 500_000  # of texts that are scored at once; arrays take some fifty times as much
BEGIN, END = 0x110000, 0x110001
_TABLES: dict[str, np.ndarray] = {}


def _characters() -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES:
        every = [chr(i) for i in range(0x110000)]
        _TABLES["letter"] = np.array([c.isalpha() for c in every])
        _TABLES["lower"] = np.array([ord(c.lower()[0]) for c in every], dtype=np.uint32)
    return _TABLES["letter"], _TABLES["lower"]


def split_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, start, end, document number) of the words of some texts, laid end to end."""
    letter, lower = _characters()
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), dtype=np.uint32)
    bounds = np.cumsum([0] + [len(t) for t in texts])
    inside, codes = letter[codes], lower[codes]
    edge = np.zeros(len(codes) + 1, dtype=bool)
    edge[bounds] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    return codes, start, end, np.searchsorted(bounds, start, side="right") - 1


def grams(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes by order of the n-grams that end at each place of the marked words; the places that
    are predicted (letters and end marks); how many each word has."""
    n = end - start
    first = np.cumsum(n + ORDER) - (n + ORDER)  # ORDER - 1 begin marks, the word, an end mark
    buffer = np.full(int((n + ORDER).sum()), BEGIN, dtype=U)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    buffer[np.repeat(first + ORDER - 1, n) + at] = codes[np.repeat(start, n) + at]
    buffer[first + n + ORDER - 1] = END
    out = [np.zeros(len(buffer), dtype=U), mix(buffer, 1)]
    for k in range(2, ORDER + 1):
        h = out[-1].copy()
        h[k - 1 :] = mix(h[k - 1 :] * U(0x9E3779B97F4A7C15) + buffer[: len(buffer) - k + 1], k)
        out.append(h)
    predicted = np.ones(len(buffer), dtype=bool)
    for k in range(ORDER - 1):
        predicted[first + k] = False
    return out, np.flatnonzero(predicted), n + 1


def count_language(texts: list[str]) -> list[dict[str, np.ndarray]]:
    """Per order from 1: n-gram hashes, their contexts' and suffixes' hashes, and Kneser-Ney counts."""
    codes, start, end, _ = split_words(texts)
    if not len(start):
        return []
    h, at, _ = grams(codes, start, end)
    out = []
    key, where, count = np.unique(h[ORDER][at], return_index=True, return_counts=True)
    where = at[where]
    for k in range(ORDER, 0, -1):
        out.append({"key": key, "context": h[k - 1][where - 1], "suffix": h[k - 1][where], "count": count})
        if k > 1:  # lower orders count the distinct characters before
            key, pick, count = np.unique(h[k - 1][where], return_index=True, return_counts=True)
            where = where[pick]
    return out[::-1]


def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=bool)
    i = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return i, keys[i] == x


class Model:
    """Sorted hash arrays for all languages, and the calibration."""

    def __init__(self, counts: dict[str, list[dict[str, np.ndarray]]]):
        self.languages = sorted(counts)
        n = len(self.languages)
        self.keys, self.logp, self.contexts, self.backoff = [], [], [], []
        below, below_keys = np.full((1, n), 1 / UNSEEN), np.zeros(1, dtype=U)
        self.unseen = np.zeros(n)
        for k in range(ORDER):
            parts = [counts[x][k] for x in self.languages]
            keys, pick = np.unique(np.concatenate([p["key"] for p in parts]), return_index=True)
            context = np.concatenate([p["context"] if k else np.zeros_like(p["context"]) for p in parts])[pick]
            suffix = np.concatenate([p["suffix"] if k else np.zeros_like(p["suffix"]) for p in parts])[pick]
            contexts = np.unique(context)
            at = np.searchsorted(below_keys, suffix)
            prob, back = np.empty((len(keys), n)), np.zeros((len(contexts), n))
            for j, p in enumerate(parts):
                one, two = (p["count"] == 1).sum(), (p["count"] == 2).sum()
                discount = min(0.95, max(0.1, one / max(one + 2 * two, 1)))
                own, inverse = np.unique(p["context"] if k else np.zeros_like(p["context"]), return_inverse=True)
                total, kinds = np.bincount(inverse, weights=p["count"]), np.bincount(inverse)
                i, has = _find(p["key"], keys)
                c = np.where(has, p["count"][i], 0)
                i, known = _find(own, context)
                prob[:, j] = np.where(known, np.maximum(c - discount, 0) / total[i] + discount * kinds[i] / total[i] * below[at, j], below[at, j])
                i, known = _find(own, contexts)
                back[:, j] = np.where(known, np.log(discount * kinds[i] / total[i]), 0)
            self.keys.append(keys)
            self.logp.append(np.log(prob).astype(np.float32))
            self.contexts.append(contexts)
            self.backoff.append(back.astype(np.float32))
            below, below_keys = prob, keys
        self.unseen = (self.backoff[0][0] + np.log(1 / UNSEEN)).astype(np.float32)
        self.scale, self.mean, self.spread = 1.0, 0.0, np.inf

    def word_scores(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Log probabilities, words x languages."""
        h, at, n = grams(codes, start, end)
        total = np.zeros((len(at), len(self.languages)), dtype=np.float32)
        open_ = np.arange(len(at))
        for k in range(ORDER, 0, -1):
            i, hit = _find(self.keys[k - 1], h[k][at[open_]])
            total[open_[hit]] += self.logp[k - 1][i[hit]]
            open_ = open_[~hit]
            if k > 1 and len(open_):
                i, hit = _find(self.contexts[k - 1], h[k - 1][at[open_] - 1])
                total[open_[hit]] += self.backoff[k - 1][i[hit]]
        total[open_] += self.unseen
        return np.add.reduceat(total, np.cumsum(n) - n, axis=0)

    def cross_entropies(self, texts: list[str], known: "Known | None" = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nats per character, texts x languages; the same with the best model for each word;
        characters counted) of whole texts."""
        codes, start, end, doc = split_words(texts)
        n = np.bincount(doc, weights=end - start + 1, minlength=len(texts))
        if not len(start):
            return np.zeros((len(texts), len(self.languages))), np.zeros(len(texts)), n
        up, down = _powers(len(codes) + 1)
        total = np.zeros(len(codes) + 1, dtype=U)
        np.cumsum((codes.astype(U) + U(1)) * up[: len(codes)], out=total[1:])
        word = mix((total[end] - total[start]) * down[start] + (end - start).astype(U))
        distinct, first, inverse = np.unique(word, return_index=True, return_inverse=True)
        scores = (known or Known()).scores(self, distinct, codes, start[first], end[first])
        sums = np.stack([np.bincount(doc, weights=scores[inverse, j], minlength=len(texts)) for j in range(len(self.languages))], axis=1)
        best = np.bincount(doc, weights=scores.max(axis=1)[inverse], minlength=len(texts))
        return -sums / np.maximum(n, 1)[:, None], -best / np.maximum(n, 1), n

    def calibrate(self, texts: list[str], languages: list[str]) -> None:
        ce, best, n = self.cross_entropies(texts)
        truth = np.array([self.languages.index(x) for x in languages], dtype=np.int64)
        use = n > 0
        ce, best, n, truth = ce[use], best[use], n[use], truth[use]
        if not len(n):
            return
        likelihood = [(-np.log(np.maximum(self._soft(ce, s)[np.arange(len(truth)), truth], 1e-12)).mean(), s) for s in 2.0 ** np.arange(-2, 7)]
        self.scale = min(likelihood)[1]
        self.mean = float(np.median(best))
        self.spread = MARGIN * max(float(np.max((best - self.mean) / self._width(n))), 1.0)

    def _width(self, n: np.ndarray) -> np.ndarray:
        """A deviation shrinks with the root of the length, down to what long texts differ by."""
        return 1 / np.sqrt(np.maximum(n, 1)) + 0.05

    def _soft(self, ce: np.ndarray, scale: float) -> np.ndarray:
        e = np.exp(-scale * (ce - ce.min(axis=1, keepdims=True)))
        return e / e.sum(axis=1, keepdims=True)

    def predict(self, texts: list[str], known: "Known | None" = None) -> list[tuple[str, float, float | None, bool]]:
        """(language, score, cross-entropy, accepted) of whole texts."""
        ce, fit, n = self.cross_entropies(texts, known)
        best = ce.argmin(axis=1)
        row = np.arange(len(texts))
        score = self._soft(ce, self.scale)[row, best]
        accepted = fit <= self.mean + self.spread * self._width(n)
        return [(self.languages[b], float(s), float(c), bool(a)) if m else ("und", 0.0, None, False) for b, s, c, a, m in zip(best, score, ce[row, best], accepted, n, strict=True)]


class Known:
    """Scores of the distinct words that a task has met, up to ``KNOWN_WORDS`` of them."""

    def __init__(self):
        self.keys, self.values = np.zeros(0, dtype=U), None

    def scores(self, model: Model, keys, codes, start, end) -> np.ndarray:
        i, hit = _find(self.keys, keys)
        out = np.empty((len(keys), len(model.languages)), dtype=np.float32)
        if hit.any():
            out[hit] = self.values[i[hit]]
        new = ~hit
        if new.any():
            out[new] = model.word_scores(codes, start[new], end[new])
            if len(self.keys) + new.sum() > KNOWN_WORDS:
                self.keys, self.values = keys, out
            else:
                both = np.concatenate([self.keys, keys[new]])
                o = np.argsort(both, kind="stable")
                self.keys = both[o]
                self.values = (out[new] if self.values is None else np.concatenate([self.values, out[new]]))[o]
        return out


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", rows: int = ROWS) -> Model | None:
    """A model of the labelled rows' languages, from a bounded sample; None without any."""
    sized = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sized = sized.select("lang", "text", F.xxhash64("text").alias("h"), (F.length("text") > TEXT_CHARS).alias("long"))
    languages = sized.groupBy("lang").agg(F.min("long").alias("long")).limit(LANGUAGES + 1).collect()
    if not languages:
        return None
    if len(languages) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages are labelled; none may be left out")
    rows = max(KEPT_OUT, min(rows, rows * FULL_LANGUAGES // len(languages)))
    usable = sized.where(~F.col("long") | F.col("lang").isin([r.lang for r in languages if r.long]))
    # the distinct texts of the least hash: of each language's ranges of hashes first, so that no task gathers a language
    least = lambda d, *by: d.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).where(F.col("rank") <= rows).drop("rank")
    ranged = usable.select("lang", "h", F.shiftright("h", 58).alias("range")).distinct()
    chosen = least(least(ranged, "lang", "range"), "lang").select("lang", "h")
    letters = F.substring(F.trim(F.regexp_replace("text", r"\P{L}+", " ")), 1, TEXT_CHARS)
    sample = usable.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.max(F.when(F.col("long"), letters).otherwise(F.col("text"))).alias("text"))

    def learn(group):
        import pyarrow as pa

        name = group.column("lang")[0].as_py()
        texts = [t for _, t in sorted(zip(group.column("h").to_pylist(), group.column("text").to_pylist(), strict=True))]
        kept_out = texts[::KEPT_OUT] if len(texts) >= KEPT_OUT else []
        out = {"lang": [], "k": [], "part": [], "data": [], "text": []}
        for k, level in enumerate(count_language([t for i, t in enumerate(texts) if i % KEPT_OUT or not kept_out])):
            for part, x in level.items():
                out["lang"].append(name), out["k"].append(k), out["part"].append(part), out["text"].append(None)
                out["data"].append((x.astype(np.int64) if part == "count" else x).tobytes())
        for t in kept_out:
            out["lang"].append(name), out["k"].append(-1), out["part"].append("text"), out["text"].append(t), out["data"].append(None)
        return pa.table({"lang": pa.array(out["lang"], pa.string()), "k": pa.array(out["k"], pa.int32()), "part": pa.array(out["part"], pa.string()), "data": pa.array(out["data"], pa.binary()), "text": pa.array(out["text"], pa.string())})

    levels: dict[str, list[dict]] = {}
    kept: list[tuple[str, str]] = []
    for r in sample.groupBy("lang").applyInArrow(learn, "lang string, k int, part string, data binary, text string").collect():
        if r.k < 0:
            kept.append((r.text, r.lang))
        else:
            levels.setdefault(r.lang, [{} for _ in range(ORDER)])[r.k][r.part] = np.frombuffer(r.data, dtype=np.int64 if r.part == "count" else U)
    if not levels:
        return None
    model = Model(levels)
    kept = sorted((t, x) for t, x in kept if x in levels)
    model.calibrate([t for t, _ in kept], [x for _, x in kept])
    return model


RESULTS = "lang_pred string, score double, cross_entropy double, accepted boolean"


def identify(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` with lang_pred, score, cross_entropy and accepted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        known = Known()
        for batch in batches:
            column = batch.column("text").fill_null("").cast(pa.large_string())
            for i, j in slices(column, SLICE_BYTES):
                texts = column.slice(i, j - i).to_pylist()
                got = shared.value.predict(texts, known) if shared.value else [("und", 0.0, None, False)] * len(texts)
                p, s, c, a = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(i, j - i), pa.array(p, pa.string()), pa.array(s, pa.float64()), pa.array(c, pa.float64()), pa.array(a, pa.bool_())], names=["row", "lang_pred", "score", "cross_entropy", "accepted"])

    return with_results(docs, docs.columns if keep is None else keep, text, run, RESULTS)


def remainder(column: Column, divisor: int) -> Column:
    """crc32 of the value as text, modulo the divisor."""
    return F.crc32(F.encode(column.cast("string"), "UTF-8")) % divisor
