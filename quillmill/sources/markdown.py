"""Markdown files of a directory tree, and atomic writes beside them.

The listing is made on the driver, as its order and its exceptions are the contract: entries by name
within each directory, no symbolic links, no dot directories (dot files count), names that end in
``.md`` exactly, unreadable entries left out. Spark's own listing drops names with an underscore and
follows links. The files are read by the executors, so the root must be a path that all of them see.
"""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import FILE_BUDGET
from ..operators.stored import stored

SCHEMA = "path string, name string, text string, bytes long, walk_no long"


def walk(root: str) -> Iterator[str]:
    """Relative paths in walk order."""

    def go(folder: str, prefix: str) -> Iterator[str]:
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return
        for e in entries:
            if e.is_symlink():
                continue
            if e.is_dir():
                if not e.name.startswith("."):
                    yield from go(e.path, f"{prefix}{e.name}/")
            elif e.is_file() and e.name.endswith(".md"):
                yield prefix + e.name

    return go(root, "")


def scan_markdown(spark: SparkSession, root: str, budget: int = FILE_BUDGET) -> tuple[DataFrame, bool]:
    """(files, exhausted): the first ``budget`` files; exhausted as soon as the budget is used up."""
    paths = []
    for p in walk(root):
        if len(paths) == budget:
            break
        paths.append((len(paths), p))
    listed = spark.createDataFrame(paths, "walk_no long, path string").repartition(max(1, min(len(paths) // 256, 512)))

    def read(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for no, path in zip(pdf.walk_no, pdf.path, strict=True):
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        data = f.read()
                except OSError:
                    continue
                rows.append((path, os.path.basename(path)[:-3], data.decode("utf-8", "replace"), len(data), no))
            yield pd.DataFrame(rows, columns=["path", "name", "text", "bytes", "walk_no"])

    return listed.mapInPandas(read, SCHEMA), len(paths) >= budget


def within_budget(files: DataFrame, budget: int) -> DataFrame:
    """The first rows in walk order of a table of paths: directory by directory, not by the plain path."""
    from pyspark.sql.window import Window

    first = files.orderBy(F.split("path", "/")).limit(budget)  # a top-k of each task; only those meet to be numbered
    return first.withColumn("walk_no", F.row_number().over(Window.orderBy(F.split("path", "/"))))


def in_walk_order(files: DataFrame) -> DataFrame:
    """All rows of a table of paths with their number in walk order: dealt by ranges, sorted and numbered in
    each task, and moved on by the rows of the tasks before."""
    from pyspark.sql.window import Window

    spark = files.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    by = F.split("path", "/")
    at = stored(files.repartitionByRange(tasks, by).sortWithinPartitions(by).withColumn("_at", F.monotonically_increasing_id()), "walk").withColumn("_task", F.shiftright("_at", 33))
    counts = at.groupBy("_task").agg(F.count("*").alias("n"))
    # one row a task
    before = counts.select("_task", F.coalesce(F.sum("n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    number = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return at.join(F.broadcast(before), "_task").withColumn("walk_no", number).drop("_task", "_before", "_at")


def replace_file(path: str, text: str, exclusive: bool = False) -> None:
    """Writes a file in one step: by rename over an old one, or only if there is none."""
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(path) or ".", prefix=".new-")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
            f.write(text)
        if exclusive:
            os.link(temporary, path)
        else:
            os.replace(temporary, path)
    finally:
        if os.path.exists(temporary):
            os.unlink(temporary)


def write_manifest(path: str, manifest: dict, first: bool = False) -> None:
    replace_file(path, json.dumps(manifest, indent=2, ensure_ascii=False) + "\n", exclusive=first)
