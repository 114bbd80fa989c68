"""Packing of token streams into windows by minimum bin slack (operator 12).

A document is its ids by a byte-level BPE and an end id. It is cut at multiples of the capacity; what
is left over is shorter. Windows are planned on the histogram of lengths alone, which has no more
rows than the capacity whatever the input: a window takes the longest length there is and the multiset
of remaining lengths that comes closest to the capacity, found by subset sums in a bitset (bit s: sum s
can be reached) and read off by backtracking the counts. A multiset is repeated as often as the counts
allow. Where no multiset fills the window, the head of a further piece does and its rest returns to the
histogram as a shorter piece. What is less than a window at the end fills windows of powers of two, so
that no window is padded.

Pieces meet their windows by rank: every piece has a number among those of its length (its task's
offset plus its place within the task), and the plan says which ranks of a length go where, as sorted
intervals that each task searches.

Ids are those of the ``tokenizers`` library. Texts of plain characters go through ``tiktoken`` with the
same vocabulary as ranks, which gives the same ids some four times faster; texts with other characters
or the end token's own spelling go through ``tokenizers`` itself.

Nulls and edges: null and empty texts are the end id alone. Rows that repeat an id, or have none, are
documents of their own. Texts of any length are cut whole; an empty table gives no pieces. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

CAPACITY = 1024
END_ID = 0
#: Offsets (one a task and length) are broadcast up to so many rows, of 24 bytes each.
BROADCAST_ROWS = 1_000_000
_PLAIN = re.compile("[\x00-ɏ]*")
SPECIAL = "<|endoftext|>"
#: Rows of a plan: the ranks of ``length`` from ``lo``, ``each`` to a window, go to windows from ``window``
#: on at ``offset``; of a length above ``head`` the rest is of rank ``rest`` and on among the shorter ones.
FIELDS = ("length", "lo", "each", "window", "offset", "head", "rest")


def encoder(json_path: str, rank_path: str):
    """text -> ids without the end id, as unsigned 32-bit integers."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(json_path)
    with open(rank_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if _PLAIN.fullmatch(text) and SPECIAL not in text:
            return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), dtype=np.uint32)
        return np.array(whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    return encode


def pieces(docs: DataFrame, json_path: str, rank_path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, length, ids, doc_tokens, part, nth): documents cut at multiples of ``capacity``.

    ``ids`` are little-endian unsigned 32-bit integers; ``nth`` counts the pieces of a length within the
    task ``part``.
    """

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode, part = encoder(json_path, rank_path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            which, start, length, ids, total, nth = [], [], [], [], [], []
            for i, t in enumerate(batch.column("_text")):
                coded = np.append(encode(t.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                for at in range(0, len(coded), capacity):
                    own = coded[at : at + capacity]
                    which.append(i)
                    start.append(at)
                    length.append(len(own))
                    ids.append(own.tobytes())
                    total.append(len(coded))
                    nth.append(int(seen[len(own)]))
                    seen[len(own)] += 1
            columns = [batch.column("_key").take(pa.array(which, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(ids, pa.binary()), pa.array(total, pa.int64()), pa.array([part] * len(which), pa.int32()), pa.array(nth, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["_key", "start", "length", "ids", "doc_tokens", "part", "nth"])

    kind = docs.schema[key].dataType.simpleString()
    given = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    return given.mapInArrow(run, f"_key {kind}, start long, length int, ids binary, doc_tokens long, part int, nth long")


def closest(have: dict[int, int], target: int) -> dict[int, int]:
    """The multiset of ``have`` (length -> count) whose sum is nearest to ``target`` and not above it, as
    length -> count. Longer lengths are preferred, so that short ones are left to fill gaps."""
    mask = (1 << (target + 1)) - 1
    lengths, reached = [], [1]
    for length in sorted((x for x, n in have.items() if n and x <= target), reverse=True):
        bits, left, step = reached[-1], min(have[length], target // length), 1
        while left:  # counts by doubling: 1, 2, 4, ... and the rest
            take = min(step, left)
            bits |= (bits << (take * length)) & mask
            left, step = left - take, step * 2
        lengths.append(length)
        reached.append(bits)
        if bits >> target & 1:
            break
    out, at = {}, reached[-1].bit_length() - 1
    for i in range(len(lengths) - 1, -1, -1):
        n = 0
        while not reached[i] >> (at - n * lengths[i]) & 1:
            n += 1
        if n:
            out[lengths[i]] = n
            at -= n * lengths[i]
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows of ``FIELDS`` that place every rank of every length, for a histogram length -> count."""
    have = {x: n for x, n in counts.items() if n}
    taken = dict.fromkeys(have, 0)
    total, rows, window = sum(x * n for x, n in have.items()), [], 0

    def fill(size: int, most: int | None) -> None:
        nonlocal window, total
        first = max((x for x in have if x <= size), default=None)
        picked: dict[int, int] = {}
        if first:
            picked = closest(have | {first: have[first] - 1}, size - first)
            picked[first] = picked.get(first, 0) + 1
        gap = size - sum(x * n for x, n in picked.items())
        times = min((have[x] // n for x, n in picked.items()), default=None)
        cut = None
        if gap:  # whatever is not picked is longer than the gap
            fits = lambda x: min([times or have[x], have[x] // (picked.get(x, 0) + 1)])
            cut = max((x for x in have if x > gap and have[x] > picked.get(x, 0)), key=lambda x: (fits(x), x))
            times = fits(cut)
        times = min(times, most or times)
        offset = 0
        for x, n in sorted(picked.items(), reverse=True):
            rows.append((x, taken[x], n, window, offset, x, -1))
            taken[x] += n * times
            have[x] -= n * times
            offset += x * n
        if cut:
            rest = cut - gap
            end = taken.setdefault(rest, 0) + have.get(rest, 0)
            rows.append((cut, taken[cut], 1, window, offset, gap, end))
            taken[cut] += times
            have[cut] -= times
            have[rest] = have.get(rest, 0) + times
        for x in [x for x, n in have.items() if not n]:
            del have[x]
        window += times
        total -= times * size

    while total >= capacity:
        fill(capacity, None)
    for power in range(capacity.bit_length(), -1, -1):
        if total >> power & 1:
            fill(1 << power, 1)
    return np.array(rows, dtype=np.int64).reshape(-1, len(FIELDS))


def places(rows: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, cut, length, window, offset) of every part of the given pieces, by row and cut."""
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    shift = 1 << 48  # ranks are below 2^48
    lo = rows[:, 0] * shift + rows[:, 1]
    row, cut, out = np.arange(len(length)), np.zeros(len(length), dtype=np.int64), []
    while len(row):
        at = rows[np.searchsorted(lo, length * shift + rank, side="right") - 1]
        times, slot = np.divmod(rank - at[:, 1], at[:, 2])
        out.append((row, cut, at[:, 5], at[:, 3] + times, at[:, 4] + slot * length))
        more = at[:, 5] < length
        row, cut, length, rank = row[more], (cut + at[:, 5])[more], (length - at[:, 5])[more], (at[:, 6] + times)[more]
    found = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, dtype=np.int64)] * 5
    order = np.lexsort((found[1], found[0]))
    return tuple(x[order] for x in found)


def pack(docs: DataFrame, json_path: str, rank_path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, length, ids, doc_tokens, sequence_id, offset): each row a piece of a document in its window.

    ``ids`` are little-endian unsigned 32-bit integers; windows are filled without gaps, ``capacity`` long
    but for the last few, whose lengths are smaller powers of two.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    scratch = Scratch(docs.sparkSession, "packing")
    cut = scratch.cut(pieces(docs, json_path, rank_path, capacity, key, text))
    counts = scratch.cut(cut.groupBy("length", "part").agg(F.count("*").alias("n")))
    # a length has one row a task here
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if counts.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    rows = plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)

    @F.arrow_udf("array<struct<cut:long,length:long,sequence_id:long,offset:long>>")
    def placed(length, rank):
        import pyarrow as pa

        row, *found = places(rows, length.to_numpy(zero_copy_only=False).astype(np.int64), rank.to_numpy(zero_copy_only=False).astype(np.int64))
        ends = np.searchsorted(row, np.arange(len(length) + 1))
        each = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in found], names=["cut", "length", "sequence_id", "offset"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)

    ranked = cut.join(offsets, ["length", "part"]).withColumn("p", F.explode(placed("length", F.col("base") + F.col("nth"))))
    ids = F.when(F.col("length") == F.col("p.length"), F.col("ids")).otherwise(F.substring("ids", (F.col("p.cut") * 4 + 1).cast("int"), (F.col("p.length") * 4).cast("int")))
    return ranked.select(F.col("_key").alias(key), (F.col("start") + F.col("p.cut")).alias("start"), F.col("p.length").alias("length"), ids.alias("ids"), "doc_tokens", "p.sequence_id", "p.offset")
