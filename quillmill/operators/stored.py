"""Tables written once to the shared folder, so that what several parts of a plan read is made once."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a local master's own folder, and on a cluster an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = spark.sparkContext.applicationId
        path = _OWN[own] = _OWN.get(own) or "file://" + tempfile.mkdtemp(prefix="quillmill-")
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df``, written as Parquet and read back; a lost executor costs no more than what reads it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` wrote, once nothing lazy depends on them."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def small_batches(spark: SparkSession, most: str = "8m"):
    """Arrow batches of the jobs inside hold ``most`` bytes, whatever the length of a row's terms."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deals rows by ``key`` where the scan has fewer splits than the session has cores, so that a small
    file of one row group keeps them all busy. Larger tables have more splits and stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
