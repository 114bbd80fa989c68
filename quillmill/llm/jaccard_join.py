"""N-gram Jaccard self-join by multiple-global-order prefix filtering (operator 3).

Documents link when their sets of distinct 5-word shingles have a Jaccard similarity of 0.8 or
more, tested exactly in integers. Similar sets lack at most ``n // 5`` of each other's shingles, so
under any global order of the shingles their prefixes of ``n // 5 + 1`` shingles share one. Four
orders are used:

* order A, by hash, with longer prefixes that must share more: it leaves only documents of which
  enough prefix shingles occur in another document. One pass over the texts; shingles travel packed
  by hash bucket, counted within a task first, so a hot shingle costs a task one record.
* order 1, rarest first by a count sketch of fixed size, makes candidates.
* orders 2 (coarse rarity, then a second hash) and 3 (a third hash) must agree: candidates whose
  prefixes share nothing under either are dropped before whole sets are compared.

Equal sets are one class from the start: they count as one in every order, and only one of them is
read again. Candidates of a shingle's list are never all pairs at once: each round compares the members
with a few pivots, which then leave the list, and what is linked already is not compared again. Once
the pairs still open are at most ``OPEN`` times the members, or pivots settle less than a fifth of them,
all of them are compared, so no link between components is lost. Lists of many sets without links
cost most: the filters see each of their pairs, in the join, dealt over tasks; few become rows.

Keys of over 20,000 rows and over one row in 10,000 (shingles, pivots, classes, hubs) are dealt over
several tasks; there are at most 10,000 of them, so what is broadcast for it is bounded. Full sets are read by a
broadcast of the ids wanted up to ``BROADCAST_ROWS``, by a shuffle join beyond: the plan changes, the
rows do not.

The links within a component are counted on request (``jaccard_links``): a link joins its ends, so
all links lie within components, and every pair of a component's classes whose sizes allow a link is
compared. A small component is compared at one place; a large one is cut into bands of size and
blocks, and each pair of blocks of the same or neighbouring bands is compared at one place, by
products of incidence matrices, so pairs never become rows.

Nulls and edges: a null or wordless text has no shingles, links with nothing and is its own
component. Rows that repeat a doc_id are one document (the largest set's size is told). A row whose
doc_id is null is returned with a null component_id. Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, copied, hot_keys, released, salted, salted_join, slices, tasks_for
from .shingles import U, mix, shingle_sets

WIDTH = 5
SKETCH_BITS = 22
PARITY_BITS = 512
FLUSH = 400_000
BROADCAST_ROWS = 1_000_000
OPEN = 2
MULTI = np.iinfo(np.int64).min
CELL_SETS = 1_024  # sets of a block, and their shingles
CELL_SHINGLES = 400_000
CELL_COLUMNS = 4_096
BAND = 1.26  # over 1 / 0.8: sets that link lie in the same band of size or in neighbouring ones


def _batches(rows, ids="doc_id"):
    import pyarrow as pa

    for batch in rows:
        text = batch.column("text").cast(pa.large_string())
        for i, j in slices(text.fill_null("")):
            yield batch.column(ids).slice(i, j - i), shingle_sets(text.slice(i, j - i), WIDTH)


def _longer(n: int) -> tuple[int, int]:
    """Order A's prefix length and how many of its shingles another document must hold.

    With prefixes of n // 5 + k shingles two similar sets share k; k is n // 10 + 1 for the one and
    for the other, whose size is 0.8 n at least, no less than 8 n // 100 + 1.
    """
    return min(n, n // 5 + 1 + n // 10), 1 + 8 * n // 100


def _digests(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a set; equal sets, equal digests."""
    return (int(np.bitwise_xor.reduce(mix(s, 21)).view(np.int64)), int(np.add.reduce(mix(s, 22)).view(np.int64))) if len(s) else (0, 0)


def _from_texts(rows):
    for doc, sets in _batches(rows):
        for d, s in zip(doc.to_pylist(), sets, strict=True):
            yield d, len(s), _digests(s), s[: _longer(len(s))[0]]


def _from_sets(rows):
    for batch in rows:
        for d, s1, s in zip(batch.column("rep").to_pylist(), batch.column("s1").to_pylist(), batch.column("tokens"), strict=True):
            s = np.frombuffer(s.as_buffer(), dtype=U)
            yield d, len(s), (s1, 0), s


def _packed(parts: int, source):
    """Packs shingles, tagged by their set's first digest, by hash bucket, and what is told of the
    documents beside them. Equal sets are sent once a flush; what different ones share within it is
    counted there."""
    import pyarrow as pa

    def flush(ids, sizes, digests, tokens):
        ids, sizes, digests = np.array(ids, dtype=np.int64), np.array(sizes, dtype=np.int64), np.array(digests, dtype=np.int64).reshape(-1, 2)
        _, once = np.unique(digests[:, 0], return_index=True)
        token = np.concatenate([tokens[i] for i in once]) if len(once) else np.zeros(0, dtype=U)
        row = np.repeat(once, [len(tokens[i]) for i in once])
        o = np.argsort(token, kind="stable")
        token, row = token[o], row[o]
        at = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))) if len(token) else np.zeros(0, dtype=np.int64)
        count = np.diff(np.append(at, len(token)))
        local = np.bincount(row[np.repeat(count > 1, count)], minlength=len(ids)).astype(np.int64)
        out_token, out_tag = token[at], np.where(count > 1, MULTI, digests[row[at], 0] if len(at) else 0)
        bucket = (mix(out_token, 11) % U(parts)).astype(np.int64)
        home = (mix(ids.astype(U), 12) % U(parts)).astype(np.int64)
        o, h = np.argsort(bucket, kind="stable"), np.argsort(home, kind="stable")
        cut = np.searchsorted(bucket[o], np.arange(parts + 1))
        cut_h = np.searchsorted(home[h], np.arange(parts + 1))
        used = np.flatnonzero((np.diff(cut) > 0) | (np.diff(cut_h) > 0))
        pick = lambda x, order, c: pa.array([x[order[c[k] : c[k + 1]]].tobytes() for k in used], pa.binary())
        told = {k: pick(v, h, cut_h) for k, v in (("id", ids), ("n", sizes), ("s1", digests[:, 0]), ("s2", digests[:, 1]), ("shared", local))}
        return pa.RecordBatch.from_pydict({"bucket": pa.array(used), "token": pick(out_token, o, cut), "tag": pick(out_tag, o, cut), **told})

    def run(rows):
        ids, sizes, digests, tokens, held = [], [], [], [], 0
        for d, n, both, s in source(rows):
            ids.append(d)
            sizes.append(n)
            digests.append(both)
            tokens.append(s)
            held += len(s) + 8
            if held >= FLUSH:
                yield flush(ids, sizes, digests, tokens)
                ids, sizes, digests, tokens, held = [], [], [], [], 0
        if ids:
            yield flush(ids, sizes, digests, tokens)

    return run


PACKED = "bucket long, token binary, tag binary, id binary, n binary, s1 binary, s2 binary, shared binary"
COUNTED = "doc_id long, n long, s1 long, s2 long, shared long"


def _count_bucket(group):
    import pyarrow as pa

    def whole(name, kind):
        return np.concatenate([np.frombuffer(x, dtype=kind) for x in group.column(name).to_pylist()])

    token, tag = whole("token", U), whole("tag", np.int64)
    o = np.lexsort((tag, token))
    token, tag = token[o], tag[o]
    out = np.zeros(0, dtype=np.int64)
    if len(token):
        # a set that several flushes sent is one
        new = np.concatenate(([True], (token[1:] != token[:-1]) | (tag[1:] != tag[:-1])))
        token, tag = token[new], tag[new]
        at = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        count = np.diff(np.append(at, len(token)))
        out = tag[np.repeat((count > 1) | (tag[at] == MULTI), count) & (tag != MULTI)]
    found, count = np.unique(out, return_counts=True)
    told = {k: pa.array(whole(k, np.int64)) for k in ("id", "n", "s1", "s2", "shared")}
    none = lambda: pa.nulls(len(found), pa.int64())
    rest = {"id": none(), "n": none(), "s1": pa.array(found), "s2": none(), "shared": pa.array(count.astype(np.int64))}
    return pa.table([pa.concat_arrays([told[k], rest[k]]) for k in told], names=["doc_id", "n", "s1", "s2", "shared"])


def _shared_counts(rows: DataFrame, source, tasks: int) -> DataFrame:
    """(doc_id, n, s1, s2, shared) of every document, and rows without doc_id: by s1, the sum of
    ``shared`` is how many of the shingles that ``source`` gives a set another set gives too, or more."""
    parts = 8 * tasks
    return rows.mapInArrow(released(_packed(parts, source)), PACKED).repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_count_bucket, COUNTED)


def _full_sets(rows):
    """The sets of texts; where the digests asked for are given, only sets of these."""
    import pyarrow as pa

    for batch in rows:
        asked = [batch.column(k).to_numpy() if k in batch.schema.names else None for k in ("s1", "s2")]
        at = 0
        for doc, sets in _batches([batch]):
            pairs = np.array([_digests(s) for s in sets], dtype=np.int64).reshape(-1, 2)
            keep = np.ones(len(sets), dtype=bool)
            if asked[0] is not None:
                keep = (pairs[:, 0] == asked[0][at : at + len(sets)]) & (pairs[:, 1] == asked[1][at : at + len(sets)])
            at += len(sets)
            out = pa.RecordBatch.from_pydict({"rep": doc, "n": pa.array([len(s) for s in sets], pa.int64()), "s1": pa.array(pairs[:, 0]), "tokens": pa.array([s.tobytes() for s in sets], pa.binary())})
            yield out.filter(pa.array(keep))


def _sketch(sets: DataFrame) -> np.ndarray:
    """How many sets hold a shingle of each hash bucket: 2 ** SKETCH_BITS counters, whatever the input."""
    chunk = 1 << 16

    def count(rows):
        import pyarrow as pa
        from pyspark import TaskContext

        total = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        for batch in rows:
            for x in batch.column("tokens"):
                total[(np.frombuffer(x.as_buffer(), dtype=U) >> U(64 - SKETCH_BITS)).astype(np.int64)] += 1
        part = total.reshape(-1, chunk)
        salt = TaskContext.get().partitionId() % 64
        for k in np.flatnonzero(part.any(axis=1)):
            yield pa.RecordBatch.from_pydict({"part": pa.array([int(k)]), "salt": pa.array([salt]), "counts": pa.array([zlib.compress(part[k].tobytes(), 1)], pa.binary())})

    def add(group):
        import pyarrow as pa

        total = np.zeros(chunk, dtype=np.uint32)
        for x in group.column("counts"):
            total += np.frombuffer(zlib.decompress(x.as_buffer()), dtype=np.uint32)
        return pa.table({"part": group.column("part").slice(0, 1), "salt": group.column("salt").slice(0, 1), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    # many tasks' counts are added in two rounds, so that no task holds them all
    schema = "part long, salt long, counts binary"
    counted = sets.select("tokens").mapInArrow(released(count), schema).groupBy("part", "salt").applyInArrow(add, schema).groupBy("part").applyInArrow(add, schema)
    out = np.zeros((1 << SKETCH_BITS) // chunk * chunk, dtype=np.uint32).reshape(-1, chunk)
    for r in counted.collect():
        out[r.part] = np.frombuffer(zlib.decompress(r.counts), dtype=np.uint32)
    return out.reshape(-1)


def _prefixes(shared):
    def run(rows):
        import pyarrow as pa

        sketch = shared.value
        for batch in rows:
            out = {"rep": batch.column("rep"), "n": batch.column("n"), "shared": batch.column("shared"), "bits": [], "p1": [], "p2": [], "p3": []}
            for x in batch.column("tokens"):
                s = np.frombuffer(x.as_buffer(), dtype=U)
                p = len(s) // 5 + 1
                parity = np.bincount((mix(s, 4) % U(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
                out["bits"].append(np.packbits(parity.astype(np.uint8)).view(np.int64))
                count = sketch[(s >> U(64 - SKETCH_BITS)).astype(np.int64)]
                out["p1"].append(s[np.lexsort((s, count))[:p]].view(np.int64))
                coarse = np.floor(np.log2(np.maximum(count, 1)) / 2)
                h2, h3 = mix(s, 2), mix(s, 3)
                short = lambda h, o: np.unique(h[o[:p]] >> U(32)).astype(np.uint32).tobytes()
                out["p2"].append(short(h2, np.lexsort((h2, coarse))))
                out["p3"].append(short(h3, np.argsort(h3)))
            out |= {k: pa.array(out[k], pa.list_(pa.int64())) for k in ("p1", "bits")}
            out |= {k: pa.array(out[k], pa.binary()) for k in ("p2", "p3")}
            yield pa.RecordBatch.from_pydict(out)

    return run


def _share(rows):
    import pyarrow as pa

    for batch in rows:
        c = {k: batch.column(k).to_pylist() for k in ("p2_a", "p3_a", "p2_b", "p3_b")}
        meet = lambda x, y: len(np.intersect1d(np.frombuffer(x, dtype=np.uint32), np.frombuffer(y, dtype=np.uint32), assume_unique=True)) > 0
        keep = [meet(p, r) and meet(q, s) for p, q, r, s in zip(c["p2_a"], c["p3_a"], c["p2_b"], c["p3_b"], strict=True)]
        yield pa.RecordBatch.from_pydict({k: batch.column(k) for k in ("a", "b")}).filter(pa.array(keep, pa.bool_()))


def _verify(rows):
    import pyarrow as pa

    for batch in rows:
        keep = []
        for x, y in zip(batch.column("tokens_a"), batch.column("tokens_b"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), dtype=U), np.frombuffer(y.as_buffer(), dtype=U)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= 80 * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_pydict({k: batch.column(k) for k in ("a", "b")}).filter(pa.array(keep, pa.bool_()))


def _with_both(pairs: DataFrame, n: int, side: DataFrame, columns: list[str], scratch: Scratch) -> DataFrame:
    """``pairs`` (n of them) with the columns of both ends; a pivot of many pairs is dealt over several tasks."""
    out = pairs
    for end, other in ("ab", "ba"):
        hot = hot_keys(pairs.groupBy(end).agg(F.count("*").alias("k")), [end], n)
        out = salted_join(out, side.select(F.col("rep").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns]), hot, [end], other)
    return out


def _links(pairs: DataFrame, sets: DataFrame, prefixes: DataFrame, scratch: Scratch) -> DataFrame:
    pairs = scratch.cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    near = _with_both(pairs, pairs.count(), prefixes, ["p2", "p3"], scratch)
    near = scratch.cut(near.mapInArrow(released(_share), "a long, b long").distinct())
    out = scratch.cut(_with_both(near, near.count(), sets, ["tokens"], scratch).mapInArrow(released(_verify), "a long, b long"))
    scratch.drop(pairs, near)
    return out


def _postings(prefixes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """(token, salt, MEMBER) of the prefix shingles that make candidates, and the hot ones' parts;
    ``at`` is how many shingles of the set come before in order 1."""
    every = prefixes.select("rep", "n", "shared", "bits", F.posexplode("p1").alias("at", "token"))
    counts = every.groupBy("token").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("rep")).alias("x1"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("x2"), F.min("at").alias("first"))
    counts = scratch.cut(counts.where("k > 1"))
    hot = hot_keys(counts, ["token"], counts.agg(F.sum("k")).first()[0] or 0)
    # shingles held by the same sets make the same candidates: the one that is first in all of them is enough
    lists = counts.groupBy("k", "x1", "x2").agg(F.min_by("token", "first").alias("token")).select("token")
    post = salted(every, hot, ["token"], "rep").join(copied(lists, hot, ["token"]), ["token", "salt"]).select("token", "salt", *MEMBER)
    return scratch.cut(post), hot


#: Like sizes; were this shingle the first that both prefixes hold, no more than what comes from it on is shared; the
#: intersection is at most the smaller count of shingles that are not a document's own; every bin of unlike parity holds
#: a shingle that one of the two lacks, and (n + n2) / 9 may.
MAY = "c <> c2 and 5 * least(n, n2) >= 4 * greatest(n, n2) and 9 * least(n - at, n2 - at2) >= 4 * (n + n2) and 180 * least(shared, shared2) >= 80 * (n + n2) and 9 * (" + " + ".join(f"bit_count(bits[{i}] ^ bits2[{i}])" for i in range(PARITY_BITS // 64)) + ") <= n + n2"
MEMBER = ["rep", "n", "at", "shared", "bits"]


def _link_all(sets: DataFrame, prefixes: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) that connect all sets that links connect.

    Each round compares the members of each shingle's list with pivots of theirs: in turn the one with
    the fewest shingles of its own, and 4 ** k (in round k) by a hash of the id. Pivots then leave the list, as all their pairs in it are decided; members of one component are not compared.
    Once the pairs still open are at most ``OPEN`` times the members, or a round settles less than a
    fifth of them, so that pivots save nothing more, they are all compared.
    """
    post, hot = _postings(prefixes, scratch)
    links, component = sets.select(F.col("rep").alias("a"), F.col("rep").alias("b")).where("false"), None
    key = ["token", "salt"]
    k, before = 0, None
    while True:
        now = post.withColumn("c", F.col("rep"))
        if component is not None:
            now = post.join(component.withColumnRenamed("node", "rep"), "rep", "left").select(*key, *MEMBER, F.coalesce("component", "rep").alias("c"))
        # the set with the fewest shingles of its own is most like the text that the others were made from
        first = k % 2 == 0
        own = (F.col("n") - F.col("shared")) * F.lit(1 << 32) + F.pmod(F.xxhash64("rep"), F.lit(1 << 32))
        now = scratch.cut(now.withColumn("h", own if first else F.xxhash64("rep", F.lit(k))))
        # the largest component of each list that holds several
        sizes = now.groupBy("token", "c").agg(F.count("*").alias("k"), F.min("h").alias("h"))
        heads = sizes.groupBy("token").agg(F.sum("k").alias("m"), F.max("k").alias("top"), F.max_by("c", "k").alias("c_top"), F.min("h").alias("h_least"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
        heads = scratch.cut(heads)
        cost = heads.agg(F.sum((F.col("m") - F.col("top")) * F.col("m")).alias("x"), F.sum("m").alias("m")).first()
        if not cost.x:
            break
        heads_ = copied(heads, hot, ["token"])
        last, before = cost.x <= OPEN * cost.m or before is not None and cost.x > 0.8 * before, cost.x
        as_other = [F.col("rep").alias("a"), *(F.col(x).alias(x + "2") for x in ("c", *MEMBER[1:]))]
        if last:
            outside = now.join(heads_.select(*key, "c_top"), key).where("c <> c_top").select("token", *as_other)
            pairs = now.join(copied(outside, hot, ["token"]), key)
        else:
            share = F.lit(float(4**k)) / F.col("m")
            bound = F.col("h_least") if first else F.greatest("h_least", F.when(share >= 1, F.lit(2**63 - 1)).otherwise((share * 2.0**64 - 2.0**63).cast("long")))
            open_ = scratch.cut(now.join(heads_.select(*key, bound.alias("bound")), key).withColumn("pivot", F.col("h") <= F.col("bound")).drop("bound", "h"))
            pivots = open_.where("pivot").select("token", *as_other)
            pairs = open_.join(copied(pivots, hot, ["token"]), key)
        found = _links(pairs.where(MAY).select("a", F.col("rep").alias("b")), sets, prefixes, scratch)
        links = links.unionByName(found)
        scratch.drop(now, heads)
        if last:
            break
        post = open_.where("not pivot").select(*key, *MEMBER)
        if component is not None:
            scratch.drop(component)
        # what is linked must not be compared again, so the components are whole
        component = connected_components(links, scratch)
        k += 1
    return links


def _nameless(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is null").select(F.lit(0).cast("long").alias("doc_id"), "text").mapInArrow(released(_full_sets), "rep long, n long, s1 long, tokens binary").select(F.lit(None).cast("long").alias("doc_id"), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) per document; see the module's text."""
    out, _, _, _ = _joined(docs, Scratch(docs.sparkSession, "jaccard"))
    return out.unionByName(_nameless(docs))


def _joined(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The documents with their components; (rep, doc_id) of the classes' documents; (rep, n, tokens) of
    the classes that may link with others; (node, component) of whatever links."""
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tasks = tasks_for(docs)
    counted = scratch.cut(_shared_counts(texts, _from_texts, tasks))
    told = counted.where("doc_id is not null").select("doc_id", "n", "s1", "s2")
    # sets are one class if size and two 64-bit digests agree
    key = ["n", "s1", "s2"]
    classes = scratch.cut(told.where("n > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("k")))
    total = counted.groupBy("s1").agg(F.sum("shared").alias("shared")).where("shared > 0")
    # order A does not rule out a link
    open_ = scratch.cut(classes.join(total, "s1").where("shared >= 1 + n * 8 div 100").select(F.col("rep").alias("doc_id"), "s1", "s2"))
    if open_.count() <= BROADCAST_ROWS:
        open_ = F.broadcast(open_)
    sets = scratch.cut(texts.join(open_, "doc_id").mapInArrow(released(_full_sets), "rep long, n long, s1 long, tokens binary"))
    # rows that repeat both id and text
    again = sets.groupBy("rep", "s1").agg(F.count("*").alias("k")).where("k > 1").select("rep", "s1")
    if not again.isEmpty():
        sets = scratch.cut(sets.join(again, ["rep", "s1"], "left_anti").unionByName(sets.join(again, ["rep", "s1"], "left_semi").dropDuplicates(["rep", "s1"]).select(*sets.columns)))
    # the same count over whole sets: who has over a fifth to itself links with nothing
    common = _shared_counts(sets, _from_sets, tasks).groupBy("s1").agg(F.max("n").alias("n"), F.sum("shared").alias("shared")).where("n - shared <= n div 5")
    common = scratch.cut(common.select("s1", F.least("shared", "n").alias("shared")))
    sets = scratch.cut(sets.join(F.broadcast(common) if common.count() <= BROADCAST_ROWS else common, "s1"))
    shared = docs.sparkSession.sparkContext.broadcast(_sketch(sets))
    prefixes = scratch.cut(sets.mapInArrow(released(_prefixes(shared)), "rep long, n long, shared long, bits array<long>, p1 array<long>, p2 binary, p3 binary"))
    links = _link_all(sets, prefixes, scratch)
    # an id that stands in several classes (it was repeated with other texts) joins them
    twice = told.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id")
    hot = hot_keys(classes, key, told.count())
    member = salted_join(told.where("n > 0"), classes.select(*key, "rep"), hot, key, "doc_id")
    repeated = not twice.isEmpty()
    joins = links
    if repeated:
        joins = links.unionByName(member.join(twice, "doc_id", "left_semi").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    whole = connected_components(joins, scratch)
    placed = classes.select(*key, "rep").join(whole.withColumnRenamed("node", "rep"), "rep", "left").select(*key, F.coalesce("component", "rep").alias("component"))
    out = salted_join(told, placed, hot, key, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    if repeated:
        out = out.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id"))
    return out, member.select("rep", "doc_id").distinct(), sets, whole


def _intersections(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``x`` shares with each of ``y``."""
    sizes = [len(s) for s in x] + [len(s) for s in y]
    _, column, held = np.unique(np.concatenate([*x, *y]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    # a shingle of one set alone is in no intersection
    several = held > 1
    row, column = row[several[column]], (np.cumsum(several) - 1)[column[several[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(x), len(y)), dtype=np.int64)
    for low in range(0, int(several.sum()), CELL_COLUMNS):
        i, j = np.searchsorted(column, [low, low + CELL_COLUMNS])
        part = np.zeros((len(sizes), min(CELL_COLUMNS, int(several.sum()) - low)), dtype=np.float32)
        part[row[i:j], column[i:j] - low] = 1
        out += (part[: len(x)] @ part[len(x) :].T).astype(np.int64)
    return out


def _linked(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    both = _intersections(x, y)
    return 100 * both >= 80 * (np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y]) - both)


def _cell_links(group):
    import pyarrow as pa

    rep, copies = group.column("rep").to_numpy(), group.column("copies").to_numpy()
    home, side = group.column("component").to_numpy(), group.column("side").to_numpy()
    tokens = [np.frombuffer(s.as_buffer(), dtype=U) for s in group.column("tokens")]
    total = np.zeros(len(rep), dtype=np.int64)
    order = np.argsort(home, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(home[order])) + 1):
        x, y = at[side[at] != 1], at[side[at] == 1]
        if not len(x) or not len(y) and (side[x] == 0).any():
            continue  # nothing fell into the other block
        if len(y):
            found = _linked([tokens[i] for i in x], [tokens[i] for i in y])
            total[x] += found @ copies[y]
            total[y] += found.T @ copies[x]
        else:
            found = _linked([tokens[i] for i in x], [tokens[i] for i in x])
            np.fill_diagonal(found, False)
            total[x] += found @ copies[x]
    return pa.table({"rep": rep, "links": total})


def _links_between_classes(sets: DataFrame, whole: DataFrame, copies: DataFrame) -> DataFrame:
    """(rep, links): with how many documents of other classes each class links."""
    node = whole.select(F.col("node").alias("rep"), "component")
    small = sets.select("rep", "n").join(node, "rep").withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(BAND))).cast("int"))
    bands = small.groupBy("component", "band").agg(F.count("*").alias("k"), F.sum("n").alias("shingles"), F.max("n").alias("longest"))
    # blocks of CELL_SETS sets or CELL_SHINGLES shingles, one set at least
    blocks = F.ceil(F.col("k") / F.greatest(F.lit(1), F.least(F.lit(CELL_SETS), F.floor(F.lit(CELL_SHINGLES) / F.col("longest"))))).cast("int")
    shape = bands.groupBy("component").agg(F.sum("k").alias("k"), F.sum("shingles").alias("shingles"), F.map_from_entries(F.collect_list(F.struct("band", blocks.alias("blocks")))).alias("blocks")).where("k > 1")
    whole_at_once = f"k <= {CELL_SETS} and shingles <= {CELL_SHINGLES}"
    shape = shape.withColumn("once", F.expr(whole_at_once))
    tasks = 1 + (shape.where("once").agg(F.sum("shingles")).first()[0] or 0) // CELL_SHINGLES
    rows = small.join(shape.select("component", "once", "blocks"), "component").join(copies, "rep")
    rows = rows.withColumn("own", F.expr("cast(pmod(xxhash64(rep), blocks[band]) as int)"))
    cell = "named_struct('key', {}, 'b1', {}, 'i1', {}, 'b2', {}, 'i2', {}, 'side', {})"
    alone = cell.format(f"pmod(xxhash64(component), {tasks})", "-1", "-1", "-1", "-1", "2")
    within = cell.format("component", "band", "least(own, j)", "band", "greatest(own, j)", "case when j = own then 2 when own < j then 0 else 1 end")
    above, below = cell.format("component", "band", "own", "band + 1", "j", "0"), cell.format("component", "band - 1", "j", "band", "own", "1")
    each = lambda band, one: f"case when blocks[{band}] is null then array() else transform(sequence(0, blocks[{band}] - 1), j -> {one}) end"
    cells = f"case when once then array({alone}) else concat({each('band', within)}, {each('band + 1', above)}, {each('band - 1', below)}) end"
    rows = rows.select("rep", "component", "copies", F.expr(f"explode({cells})").alias("cell")).select("rep", "component", "copies", "cell.*")
    placed = rows.join(sets.select("rep", "tokens"), "rep")
    return placed.groupBy("key", "b1", "i1", "b2", "i2").applyInArrow(_cell_links, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))


def jaccard_links(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links): with how many other documents each one links.

    Every pair is verified, those within one component too. Where an id is repeated with other texts,
    each of its distinct shingle sets counts as one document. A row whose doc_id is null has none.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    out, ids, sets, whole = _joined(docs, scratch)
    ids = scratch.cut(ids.select("rep", "doc_id"))
    copies = scratch.cut(ids.groupBy("rep").agg(F.count("*").alias("copies")))
    between = scratch.cut(_links_between_classes(sets, whole, copies))
    # one number a class, then one a document
    total = copies.join(between, "rep", "left").select("rep", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links")).where("links > 0")
    links = ids.join(total, "rep").groupBy("doc_id").agg(F.sum("links").alias("n_links"))
    named = out.join(links, "doc_id", "left").select("doc_id", "n_shingles", "component_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return named.unionByName(_nameless(docs).withColumn("n_links", F.lit(None).cast("long")))
