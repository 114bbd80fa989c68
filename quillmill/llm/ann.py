"""Nearest neighbours by randomly rotated one-bit codes in coarse cells (operator 6).

Vectors are dealt into at most ``CELLS`` cells, each to its nearest centre; the centres come from a
few rounds of k-means on a bounded sample over all rows (``SAMPLE`` vectors, or 16 MB of them). A
vector's residual from its centre is scaled to unit length and turned by a seeded random rotation P;
its code is the packed signs of P'(o - c), made once and kept with its norm and the correction scalar
<o', o>, where o' is the code's unit vector. A query's turned residual is quantised to ``LEVELS`` bits a
component; bit counts of the codes with its bit planes give <o', q>, and <o', q> / <o', o> estimates
<o, q> without bias, off by at most ``EPSILON`` * sqrt((1 - <o', o>^2) / (D - 1)) / <o', o> but for a tiny
share of cases, and by what the quantising lost. From it and the norms follow bounds on each
distance. Only vectors whose lower bound is not above the k-th smallest upper bound, nor above the
k-th distance known, are reranked by the exact distance on the original vectors, in double precision.

A query searches its own cell first. What it finds bounds its k-th distance, and of the other cells it
searches all that can hold a nearer vector, by the triangle inequality on the cells' radii: no vector
is left out by the cells, and where the data have no clusters all cells are searched. Vectors are
packed into blocks of one cell and ``BLOCK`` rows, queries into blocks of ``QUERY_BLOCK``; a cell's blocks
are dealt over shards of ``SHARD`` blocks, so no task holds a cell, however large. A pair of blocks
gives at most k rows per query; a window keeps the k best. Ties go to the smaller vec_id, in a block
and over blocks.

Vectors that are null, empty, zero or hold null or non-finite components, or whose vec_id is null, take
no part; so do vectors of another length than most have (the shorter, if as many). Repeated rows are
candidates each, but for the query's own id; a query id that repeats is asked once, by its least
vector. Extra columns are ignored. An empty side gives no rows; fewer candidates than k give all.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, copied, salted

K = 10
BLOCK = 4096
QUERY_BLOCK = 512
SHARD = 32
CELLS = 256
CELL_ROWS = 4096
SAMPLE = 10_000
EPSILON = 3.5
LEVELS = 6
SEED = 20_240_501


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix: the Q of a Gaussian matrix, signs fixed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    wide = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), dtype=bool)
    wide[:, : bits.shape[1]] = bits
    return np.packbits(wide, axis=1).view(np.uint64)


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> dict[str, np.ndarray]:
    """Packed sign bits, norms of o - c, and the correction scalars <o', o>."""
    r = vectors - centre
    norm = np.sqrt((r * r).sum(axis=1))
    unit = r / np.where(norm > 0, norm, 1)[:, None] @ turn
    return {"bits": _words(unit > 0), "norm": norm, "fit": np.abs(unit).sum(axis=1) / np.sqrt(vectors.shape[1])}


def quantise(queries: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> dict[str, np.ndarray]:
    """The queries' norms, and their turned unit residuals as ``low + step * level`` with bit planes of
    the levels; ``lost`` is the length of what that leaves out."""
    r = queries - centre
    norm = np.sqrt((r * r).sum(axis=1))
    unit = r / np.where(norm > 0, norm, 1)[:, None] @ turn
    low = unit.min(axis=1)
    step = np.maximum((unit.max(axis=1) - low) / (2**LEVELS - 1), 1e-12)
    level = np.rint((unit - low[:, None]) / step[:, None]).astype(np.int64)
    lost = np.sqrt(((unit - low[:, None] - step[:, None] * level) ** 2).sum(axis=1))
    return {"norm": norm, "low": low, "step": step, "sum": low * unit.shape[1] + step * level.sum(axis=1), "lost": lost, "planes": np.stack([_words((level >> j) & 1 > 0) for j in range(LEVELS)])}


def bounds(code: dict[str, np.ndarray], q: dict[str, np.ndarray], d: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared distances, queries x vectors, from bit counts."""
    held = np.zeros((len(q["norm"]), len(code["norm"])), dtype=np.int32)
    for j in range(LEVELS):
        for w in range(code["bits"].shape[1]):
            held += np.bitwise_count(code["bits"][None, :, w] & q["planes"][j][:, None, w]).astype(np.int32) << j
    ones = np.bitwise_count(code["bits"]).sum(axis=1)
    # <o', q>: what the set bits hold counts twice
    dot = (2 * (q["low"][:, None] * ones + q["step"][:, None] * held) - q["sum"][:, None]) / np.sqrt(d)
    fit = np.where(code["fit"] > 0, code["fit"], 1)
    cosine = dot / fit
    error = EPSILON * np.sqrt(np.maximum(1 - fit**2, 0) / fit**2 / max(d - 1, 1)) + q["lost"][:, None] / fit + 1e-6
    base = code["norm"] ** 2 + q["norm"][:, None] ** 2
    scale = 2 * code["norm"] * q["norm"][:, None]
    return base - scale * np.minimum(cosine + error, 1), base - scale * np.maximum(cosine - error, -1)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, squares summed in order of the components."""
    return np.sqrt(np.cumsum((a - b) ** 2, axis=1)[:, -1])


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T, 0)


def centres_of(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """k-means; the first centres are spread by their distance from those before."""
    g = np.random.default_rng(SEED)
    out = sample[[0]]
    while len(out) < min(cells, len(sample)):
        far = _squares(sample, out).min(axis=1)
        if far.sum() <= 0:
            break
        out = np.concatenate([out, sample[[g.choice(len(sample), p=far / far.sum())]]])
    for _ in range(rounds):
        own = _squares(sample, out).argmin(axis=1)
        out = np.stack([sample[own == i].mean(axis=0) if (own == i).any() else out[i] for i in range(len(out))])
    return out


def _usable(vectors: DataFrame) -> DataFrame:
    ok = "vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(embedding, x -> x <> 0)"
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(ok)


def _by_cell(d: int, block: int, place, make):
    """Deals a task's rows into cells and gives blocks of one cell, at most ``block`` rows each, and
    holds no more than 16 blocks. ``place(ids, vectors, batch)`` yields (cell, row numbers)."""

    def run(batches):
        held: dict[int, list] = {}
        rows = 0

        def flush(cell):
            parts = held.pop(cell)
            whole = [np.concatenate(x) for x in zip(*parts, strict=True)]
            for i in range(0, len(whole[0]), block):
                yield make(cell, *(x[i : i + block] for x in whole))

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, v = batch.column("vec_id").to_numpy(), batch.column("embedding").flatten().to_numpy().reshape(-1, d)
            limit = batch.column("bound").to_numpy(zero_copy_only=False) if "bound" in batch.schema.names else np.full(len(ids), np.inf)
            for cell, at in place(ids, v, limit):
                held.setdefault(cell, []).append((ids[at], v[at], limit[at]))
                rows += len(at)
            while rows > 16 * block:
                most = max(held, key=lambda c: sum(len(p[0]) for p in held[c]))
                rows -= sum(len(p[0]) for p in held[most])
                yield from flush(most)
        for cell in sorted(held):
            yield from flush(cell)

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of ``vectors`` to each row of ``queries``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    usable, asked = _usable(vectors), _usable(queries)
    sizes = usable.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, n = int(sizes.d), int(sizes.n)
    usable, asked = usable.where(F.size("embedding") == d), asked.where(F.size("embedding") == d)
    asked = asked.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    most = max(1, min(SAMPLE, 16_000_000 // (8 * d)))
    sample = usable.select("embedding")
    sample = (sample if n <= most else sample.sample(False, most / n, SEED)).limit(2 * most).collect() or usable.select("embedding").limit(1).collect()
    centres = centres_of(np.array([r.embedding for r in sample], dtype=np.float64), max(1, min(CELLS, n // CELL_ROWS)))
    turn = rotation(d)

    def own(ids, v, limit):
        cell = _squares(v, centres).argmin(axis=1)
        for c in np.unique(cell):
            yield int(c), np.flatnonzero(cell == c)

    def coded(cell, ids, v, limit):
        import pyarrow as pa

        code = encode(v, centres[cell], turn)
        radius = float(np.sqrt(((v - centres[cell]) ** 2).sum(axis=1)).max())
        return pa.RecordBatch.from_pydict({"cell": pa.array([cell], pa.int32()), "radius": [radius], "ids": pa.array([ids.tobytes()], pa.binary()), "vectors": pa.array([v.tobytes()], pa.binary()), **{x: pa.array([code[x].tobytes()], pa.binary()) for x in ("bits", "norm", "fit")}})

    data = scratch.cut(usable.mapInArrow(_by_cell(d, BLOCK, own, coded), "cell int, radius double, ids binary, vectors binary, bits binary, norm binary, fit binary"))
    # one row a cell: CELLS at most
    cells = data.groupBy("cell").agg(F.max("radius").alias("radius"), F.count("*").alias("k"))
    parts = scratch.cut(cells.select("cell", F.ceil(F.col("k") / SHARD).cast("int").alias("parts"), "radius"))
    radius = np.full(len(centres), -np.inf)
    for r in parts.collect():
        radius[r.cell] = r.radius
    shards = parts.select("cell", "parts")
    dealt = salted(data.drop("radius"), shards, ["cell"], "ids")

    def elsewhere(ids, v, limit):
        far = np.sqrt(_squares(v, centres))
        may = far - radius <= limit[:, None] * (1 + 1e-9) + 1e-9
        may[np.arange(len(v)), _squares(v, centres).argmin(axis=1)] = False
        for c in np.flatnonzero(may.any(axis=0)):
            yield int(c), np.flatnonzero(may[:, c])

    def bare(cell, ids, v, limit):
        import pyarrow as pa

        return pa.RecordBatch.from_pydict({"cell": pa.array([cell], pa.int32()), "q_ids": pa.array([ids.tobytes()], pa.binary()), "q_vectors": pa.array([v.tobytes()], pa.binary()), "q_bound": pa.array([limit.astype(np.float64).tobytes()], pa.binary())})

    def search(batches):
        import pyarrow as pa

        columns = ("cell", "ids", "vectors", "bits", "norm", "fit", "q_ids", "q_vectors", "q_bound")
        for batch in batches:
            for cell, ids, v, bits, norm, fit, q_ids, q, limit in zip(*[batch.column(c).to_pylist() for c in columns], strict=True):
                ids, q_ids, limit = np.frombuffer(ids, dtype=np.int64), np.frombuffer(q_ids, dtype=np.int64), np.frombuffer(limit)
                v, q = np.frombuffer(v).reshape(-1, d), np.frombuffer(q).reshape(-1, d)
                code = {"bits": np.frombuffer(bits, dtype=np.uint64).reshape(len(ids), -1), "norm": np.frombuffer(norm), "fit": np.frombuffer(fit)}
                found = []
                for i in range(0, len(q_ids), 64):
                    low, high = bounds(code, quantise(q[i : i + 64], centres[cell], turn), d)
                    same = ids[None, :] == q_ids[i : i + 64, None]
                    high[same] = np.inf
                    m = min(k, len(ids)) - 1
                    kth = np.minimum(np.partition(high, m, axis=1)[:, m], limit[i : i + 64] ** 2 * (1 + 1e-9) + 1e-9)
                    for j in range(len(low)):
                        at = np.flatnonzero((low[j] <= kth[j]) & ~same[j])
                        score = exact(v[at], q[i + j][None, :])
                        best = np.lexsort((ids[at], score))[:k]
                        best = best[score[best] <= limit[i + j]]
                        found.append((np.full(len(best), q_ids[i + j]), ids[at][best], score[best]))
                if found:
                    yield pa.RecordBatch.from_pydict(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    def met(rows: DataFrame, place) -> DataFrame:
        asks = scratch.cut(rows.mapInArrow(_by_cell(d, QUERY_BLOCK, place, bare), "cell int, q_ids binary, q_vectors binary, q_bound binary"))
        pairs = dealt.join(copied(asks, shards, ["cell"]), ["cell", "salt"]).select("cell", "ids", "vectors", "bits", "norm", "fit", "q_ids", "q_vectors", "q_bound")
        return pairs.mapInArrow(search, "query_id long, vec_id long, score double")

    def best(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    # few rows make few blocks
    asked = asked.coalesce(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4))
    first = scratch.cut(best(met(asked, own)))
    if len(centres) == 1:
        return first
    bound = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    bounded = asked.join(bound, "vec_id", "left").select("vec_id", "embedding", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    return best(first.select("query_id", "vec_id", "score").unionByName(met(bounded, elsewhere)))
