"""Benchmark decontamination with DataFrame functions only (operator 4).

Words are runs of ASCII letters and digits and of all non-ASCII characters after lower-casing A-Z. A
window is ``width`` consecutive words of a benchmark item, or all words of a shorter one. The windows'
64-bit hashes are a broadcast hash set of ``SET_ROWS`` at most; a larger benchmark is dealt by hash into
several such sets, and the documents are scanned once for each. A document's words are scanned in its
row: where a word is some window's anchor (its longest word), the windows that could hold it there are
hashed, and only those of a known hash leave the row and meet the set. What is found is verified word by word against the windows' text, then items and covered words
are counted.

Null, empty and wordless texts have no words, no hits and no items; so have null, empty and wordless
items, and all documents where the benchmark is empty. A text of any length is scanned whole. Rows
that repeat a document give a row each. Items of a null item_id count as hits but not as items.
Extra columns of either table are ignored, whatever their names; those of the documents are kept
where documents are returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, Scratch, hot_keys, salted_join

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEPARATORS_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD_CHARACTERS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WIDTH = 10
SET_ROWS = 100_000
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_LOWER))
    return F.coalesce(F.filter(F.split(lowered, SEPARATORS), lambda w: w != ""), F.array().cast("array<string>"))


def _hash(words: Column, start: Column, n: int) -> Column:
    """Word by word, as a slice would copy the whole array each time."""
    return F.xxhash64(F.lit(n), *[F.get(words, start + k) for k in range(n)])


def windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id, n, window text, hash, anchor) of every distinct window of every item; the anchor is hashed."""
    w = benchmark.select(F.col("item_id"), words(F.col("text")).alias("w")).where("size(w) > 0")
    n = F.least(F.size("w"), F.lit(width))
    w = w.select("item_id", n.alias("n"), "w", F.explode(F.sequence(F.lit(0), F.size("w") - n)).alias("s"))
    w = w.select("item_id", "n", F.slice("w", F.col("s") + 1, F.col("n")).alias("w"))
    anchor = F.array_max(F.transform("w", lambda x: F.struct(F.length(x).alias("l"), x.alias("x"))))["x"]
    return w.select("item_id", "n", F.array_join("w", " ").alias("window"), F.coalesce(*[F.when(F.col("n") == k, _hash(F.col("w"), F.lit(0), k)) for k in range(1, width + 1)]).alias("hash"), F.xxhash64(anchor).alias("anchor")).distinct()


def _member(hashes: DataFrame, column: str):
    """A test whether a hash is one of ``hashes`` (SET_ROWS at most), by a hash set within the plan."""
    values = [r[0] for r in hashes.select(column).distinct().collect()]
    return lambda h: h.isin(values)


def scan(rows: DataFrame, found: DataFrame, lengths: list[int], scratch: Scratch) -> DataFrame:
    """(key, n_words, s, n, hash, window): the windows of ``rows`` (key, w) whose hash is that of one of
    ``found``, and one row with s = -1 for every row."""
    hashes = found.select("hash").distinct()
    anchor, known = _member(found, "anchor"), _member(found, "hash")
    at = F.array_compact(F.transform("w", lambda x, i: F.when(anchor(F.xxhash64(x)), i)))

    def of(n):
        starts = lambda p: F.filter(F.sequence(p - (n - 1), p), lambda s: (s >= 0) & (s + n <= F.size("w")) & known(_hash(F.col("w"), s, n)))
        return F.transform(F.array_distinct(F.flatten(F.transform(F.col("at"), starts))), lambda s: F.struct(s.alias("s"), F.lit(n).alias("n"), _hash(F.col("w"), s, n).alias("hash")))

    one = F.array(F.struct(F.lit(-1).alias("s"), F.lit(0).alias("n"), F.lit(None).cast("long").alias("hash"), F.lit(None).cast("string").alias("window")))
    windows = F.transform(F.concat(*[of(n) for n in lengths]), lambda x: F.struct(x["s"].alias("s"), x["n"].alias("n"), x["hash"].alias("hash"), F.array_join(F.slice("w", x["s"] + 1, x["n"]), " ").alias("window")))
    # only what may be a hit leaves the row
    c = rows.withColumn("at", at).withColumn("c", F.when(F.size("at") > 0, F.concat(one, windows)).otherwise(one))
    # written as arrays: were they exploded at once, the words would be split anew for each element
    c = scratch.cut(c.select("key", F.size("w").alias("n_words"), "c")).select("key", "n_words", F.inline("c"))
    return c.join(F.broadcast(hashes.withColumn("is_hash", F.lit(True))), "hash", "left").where("is_hash or s = -1").select("key", "n_words", "s", "n", "hash", "window")


def _key(docs: DataFrame) -> Column:
    """What tells the rows of a table of documents apart: the id and two 64-bit hashes of id and text."""
    return F.struct(docs["doc_id"].alias("doc_id"), F.xxhash64(docs["doc_id"], docs["text"]).alias("h1"), F.xxhash64(F.lit(1), docs["text"], docs["doc_id"]).alias("h2"))


def _contamination(docs: DataFrame, benchmark: DataFrame, width: int) -> DataFrame:
    """(key, n_words, hit_words, items) of each distinct key, and k, how many rows have it."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    found = scratch.cut(windows(benchmark.select("item_id", "text"), width))
    sets = max(1, -(-found.select("n", "hash").distinct().count() // SET_ROWS))
    lengths = sorted(r[0] for r in found.select("n").distinct().collect())
    rows = docs.select(_key(docs).alias("key"), words(docs["text"]).alias("w"))
    if lengths:
        scans = [scan(rows, found.where(F.pmod("hash", F.lit(sets)) == i), lengths, scratch) for i in range(sets)]
        seen = scratch.cut(scans[0])
        hits = seen.where("s >= 0")
        for more in scans[1:]:
            hits = hits.unionByName(scratch.cut(more.where("s >= 0")))
    else:
        seen = scratch.cut(rows.select("key", F.size("w").alias("n_words"), F.lit(-1).alias("s"), F.lit(0).alias("n"), F.lit(None).cast("long").alias("hash"), F.lit(None).cast("string").alias("window")))
        hits = seen.where("s >= 0")
    every = seen.where("s = -1").groupBy("key").agg(F.max("n_words").alias("n_words"), F.count("*").alias("k"))
    hits = scratch.cut(hits.select("key", "s", "n", "hash", "window").distinct())
    counts = hits.groupBy("hash").agg(F.count("*").alias("k"))
    hot = hot_keys(counts, ["hash"], hits.count())
    text = found.select("hash", F.col("n").alias("n_"), F.col("window").alias("window_"), "item_id")
    hits = salted_join(hits, text, hot, ["hash"], "key").where("n = n_ and window = window_")
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("s", "n")), lambda x: F.sequence(x["s"], x["s"] + x["n"] - 1)))))
    of = hits.groupBy("key").agg(covered.alias("hit_words"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    return every.join(of.withColumnRenamed("key", "hit_key"), F.expr("key.h1 = hit_key.h1 and key.h2 = hit_key.h2 and key.doc_id <=> hit_key.doc_id"), "left").drop("hit_key")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hit_words) per document row."""
    out = _contamination(docs, benchmark, width).withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k"))))
    size = lambda c: F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.size(c)).cast("long")
    return out.select(
        "key.doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        size("hit_words").alias("n_hit"),
        size("items").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        F.col("hit_words").isNotNull().alias("contaminated"),
        "hit_words",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", width: int = WIDTH) -> DataFrame:
    """``docs`` without contaminated documents, or with the hit words and what follows them cut out.

    Cutting repeats no scan: a span's removal can join words that a benchmark window holds, which is
    left, as it was not there before. The contaminated documents' keys are broadcast up to
    ``BROADCAST_ROWS``, joined by a shuffle beyond.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove must be 'documents' or 'spans'")
    scratch = Scratch(docs.sparkSession, "decontaminate")
    hit = scratch.cut(_contamination(docs, benchmark, width).where("hit_words is not null").select(F.col("key.h1").alias("h1"), F.col("key.h2").alias("h2"), "hit_words"))
    # a row travels as one column, so that no name of its can clash with ours
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), _key(docs).alias("key")).select("row", "key.h1", "key.h2")
    few = F.broadcast if hit.count() <= BROADCAST_ROWS else lambda d: d
    if remove == "documents":
        return keyed.join(few(hit.select("h1", "h2")), ["h1", "h2"], "left_anti").select("row.*")
    text = F.col("row.text")
    out = keyed.join(hit, ["h1", "h2"], "left").withColumns({"word": F.filter(F.split(text, SEPARATORS_ANY_CASE), lambda w: w != ""), "gap": F.split(text, WORD_CHARACTERS)})
    left = F.array_except(F.sequence(F.lit(0), F.size("word") - 1), "hit_words")
    kept = F.transform(left, lambda i: F.concat(F.get("word", i), F.get("gap", i + 1)))
    out = out.withColumn("cut", F.when(F.col("hit_words").isNull(), text).otherwise(F.concat(F.get("gap", F.lit(0)), F.array_join(kept, ""))))
    return out.select(*[F.col("cut").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
