"""Helpers that several operators share: scratch tables, skewed joins, components, text batches."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
#: A key is hot if it holds more than ONE_TASK rows and more than one row in SHARE; no more keys than SHARE can be.
SHARE = 10_000
ONE_TASK = 20_000
TASK_BYTES = 128_000_000
_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset a local master gets a temporary one of
    its own; a cluster is an error, as its executors would not see the driver's folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = spark.sparkContext.applicationId
        path = _OWN[own] = _OWN.get(own) or "file://" + tempfile.mkdtemp(prefix="quillmill-")
    return path.rstrip("/")


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for the jobs inside; what was set before holds again afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Scratch:
    """Tables written to the shared folder to cut lineage, so that a lost executor costs one stage.

    While a table is written, Arrow batches hold 8 MB at most, whatever the length of a row's text or
    sets; the shuffle files behind it are deleted once it stands.
    """

    WRITING = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        with settings(self.spark, self.WRITING):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that ``cut`` wrote, once nothing lazy depends on them."""
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def tasks_for(df: DataFrame, growth: float = 3.0) -> int:
    """Tasks for a shuffle of ``growth`` times the bytes that the plan expects of ``df``; the session's
    number of shuffle partitions at least."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, int(size * growth / TASK_BYTES)) if size < 1 << 60 else least


def hot_keys(counts: DataFrame, key: list[str], rows: int) -> DataFrame | None:
    """(key, parts): the keys of ``counts`` (key, k) with more rows than one task should take of them;
    None without any. That is ONE_TASK rows, or 1 / SHARE of all ``rows`` where that is more.

    There are at most SHARE of them, and 2 * SHARE parts, whatever the input.
    """
    most = max(ONE_TASK, -(-rows // SHARE))
    if rows <= most:
        return None
    found = counts.where(F.col("k") > most).select(*key, F.ceil(F.col("k") / most).cast("int").alias("parts"))
    values = found.collect()
    if not values:
        return None
    names = [f.name for f in found.schema]
    lines = ", ".join("(" + ", ".join(repr(v) for v in r) + ")" for r in values)
    table = counts.sparkSession.sql(f"SELECT * FROM VALUES {lines} AS t({', '.join(names)})")
    return table.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in found.schema])


def salted(rows: DataFrame, hot: DataFrame | None, key: list[str], spread: str) -> DataFrame:
    """Adds ``salt``: a hot key's rows are dealt over its parts by a hash of ``spread``."""
    if hot is None:
        return rows.withColumn("salt", F.lit(0))
    dealt = F.pmod(F.xxhash64(spread), F.coalesce("parts", F.lit(1))).cast("int")
    return rows.join(F.broadcast(hot), key, "left").withColumn("salt", dealt).drop("parts")


def copied(rows: DataFrame, hot: DataFrame | None, key: list[str]) -> DataFrame:
    """The other side of ``salted``: a hot key's row once for each of its parts."""
    if hot is None:
        return rows.withColumn("salt", F.lit(0))
    each = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    return rows.join(F.broadcast(hot), key, "left").withColumn("salt", each).drop("parts")


def salted_join(left: DataFrame, right: DataFrame, hot: DataFrame | None, key: list[str], spread: str, how: str = "inner") -> DataFrame:
    """An equi join whose hot keys on the left are dealt over several tasks."""
    if hot is None:
        return left.join(right, key, how)
    return salted(left, hot, key, spread).join(copied(right, hot, key), [*key, "salt"], how).drop("salt")


def connected_components(edges: DataFrame, scratch: Scratch, steps: int | None = None) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is the smallest node reachable.

    With ``steps``, at most so many step pairs are made: equal components are then connected, but
    connected nodes may still differ.

    Alternates large-star and small-star steps: each is one aggregation with map-side combine and
    one equi join, whose hubs are dealt over several tasks; the number of edges never grows. Ends
    when a step pair changes nothing.
    """
    e = scratch.cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())

    def star(rows: DataFrame, n: int, least, of: str) -> DataFrame:
        """(neighbour, m) of the neighbours ``of`` names, and (node, m), with each node's least neighbour m."""
        low = rows.groupBy("a").agg(least.alias("m"), F.count("*").alias("k"))
        if n > ONE_TASK:
            low = scratch.cut(low)
            done.append(low)
        hubs = hot_keys(low.select("a", "k"), ["a"], n)
        return salted_join(rows.where(of), low.select("a", "m"), hubs, ["a"], "b").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))

    check = (F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    state = e.agg(*check).first()
    while True:
        done = [e]
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = scratch.cut(star(both, 2 * state[0], F.least(F.min("b"), F.col("a")), "b > a").where("a <> b").distinct())
        e = scratch.cut(star(large, 2 * state[0], F.min("b"), "true").where("a <> b").distinct())
        scratch.drop(*done, large)
        now = e.agg(*check).first()
        steps = steps and steps - 1
        if now == state or steps == 0:
            break
        state = now
    ends = e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")))
    out = scratch.cut(ends.groupBy("node").agg(F.min("component").alias("component")))
    scratch.drop(e)
    return out


def released(run):
    """A function for mapInArrow that gives its memory back when a task ends, since workers are used again
    by later stages, which else hold what the largest task ever took."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def give_back() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # of the GNU C library only
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def with_results(docs: DataFrame, keep: list[str], text: str, run, results: str) -> DataFrame:
    """The columns ``keep`` of ``docs`` and those of ``results`` (a schema), by an Arrow function.

    ``run`` gets batches (row, text), row being the kept columns as one struct so that no name can
    clash, and yields batches of row and the results. A kept column named as a result is replaced.
    """
    from pyspark.sql import types as T

    fields = T.StructType.fromDDL(results).fields
    keep = [c for c in keep if c not in [f.name for f in fields]]
    row = T.StructType([docs.schema[c] for c in keep])
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row") if keep else F.struct(F.lit(0).alias("none")).alias("row"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([T.StructField("row", row if keep else given.schema["row"].dataType), *fields])
    out = given.mapInArrow(released(run), schema)
    return out.select(*[F.col("row").getField(c).alias(c) for c in keep], *[f.name for f in fields])


def slices(column, most_bytes: int = 2_000_000):
    """(start, stop) runs of an Arrow string column of at most that many bytes each, one row at least."""
    import numpy as np

    ends = np.cumsum(np.diff(np.frombuffer(column.buffers()[1], dtype=np.int32 if column.type == "string" else np.int64)[column.offset : column.offset + len(column) + 1].astype(np.int64)))
    i, base = 0, 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
        yield i, j
        base, i = int(ends[j - 1]), j
