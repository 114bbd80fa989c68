"""Rows of conversations in order, for operators 11 and 13: numbers, running sums and digests by key.

A key may hold any share of the rows. Rows are therefore ordered by ranges of (key, order), which cut
through a key, and numbered across the cut; what is summed along a key is summed in blocks first.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, tasks_for

#: Rows of a block: 2 ** BLOCK_BITS.
BLOCK_BITS = 12


def ordered(rows: DataFrame, key: str, order: list[str], scratch: Scratch) -> DataFrame:
    """``rows`` with ``id``: ascending by key and ``order``, nulls first, and consecutive within a key and
    task. Rows that are equal so far keep the order in which they are read, so that copies spread too."""
    by = [key, *order, "_read"]
    read = rows.withColumn("_read", F.monotonically_increasing_id())
    dealt = read.repartitionByRange(tasks_for(rows), *by).sortWithinPartitions(*by).drop("_read")
    return scratch.cut(dealt.withColumn("id", F.monotonically_increasing_id()))


def block(order: str = "id"):
    return F.shiftright(F.col(order).cast("long"), BLOCK_BITS)


def before(rows: DataFrame, key: str, order: str, value, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the same key that come before in ``order``, a
    whole number that is unique within a key. Keys are not null."""
    rows = rows.withColumn("_block", block(order)).withColumn("_value", value)
    sums = rows.groupBy(key, "_block").agg(F.sum("_value").alias("_sum"))
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(key, "_block", F.coalesce(F.sum("_sum").over(earlier(key).orderBy("_block")), F.lit(0)).alias("_base"))
    within = F.coalesce(F.sum("_value").over(earlier(key, "_block").orderBy(order)), F.lit(0))
    return rows.withColumn("_within", within).join(base, [key, "_block"]).withColumn(name, F.col("_base") + F.col("_within")).drop("_block", "_value", "_base", "_within")


def digests(rows: DataFrame, key: str, order: list[str], value: str, joiner: str, name: str) -> DataFrame:
    """(key, name): the SHA-256, in lowercase hex, of each key's values joined in order.

    A digest is made in sequence, so a key's values pass through one task; they stream through it and
    are never held together.
    """
    glue = joiner.encode()

    def run(batches):
        import pyarrow as pa

        last, digest = None, None
        for batch in batches:
            keys, values, out = batch.column(0).to_pylist(), batch.column(1), []
            for i, k in enumerate(keys):
                if digest is None or k != last:
                    if digest is not None:
                        out.append((last, digest.hexdigest()))
                    last, digest = k, hashlib.sha256()
                else:
                    digest.update(glue)
                digest.update(values[i].as_py().encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], batch.schema.field(0).type), pa.array([x[1] for x in out], pa.string())], names=[key, name])
            kind = batch.schema.field(0).type
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], kind), pa.array([digest.hexdigest()], pa.string())], names=[key, name])

    kind = rows.schema[key].dataType.simpleString()
    dealt = rows.repartition(tasks_for(rows), key).sortWithinPartitions(key, *order).select(key, value)
    return dealt.mapInArrow(run, f"{key} {kind}, {name} string")
