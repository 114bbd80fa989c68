"""Starting or adopting a collection: an additive plan, its commit, and the drift of what is owned."""

from __future__ import annotations

import datetime
import hashlib
import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import MANIFEST_VERSION
from ..sources.markdown import write_manifest
from .capture import inside
from .manifest import drift

MANIFEST = ".quillmill/manifest.json"


def plan_init(starter: DataFrame, existing: DataFrame, manifest: DataFrame) -> DataFrame:
    """starter(path, text) to (path, text, action): write, occupied, outside or owned.

    ``existing`` is (path, outside boolean) of what is there; outside marks a path whose links lead out
    of the root. What the manifest owns already is left alone, present or not.
    """
    own = manifest.select("path", F.lit(True).alias("_own"))
    seen = existing.select("path", F.coalesce("outside", F.lit(False)).alias("_outside"))
    d = starter.join(own, "path", "left").join(seen, "path", "left")
    action = F.when(F.col("_outside"), "outside").when(F.col("_own"), "owned").when(F.col("_outside").isNotNull(), "occupied").otherwise("write")
    return d.select("path", "text", action.alias("action"))


def observe(spark, root: str, paths: list[str]) -> DataFrame:
    """(path, sha256, unreadable) of owned paths on disk; a null hash where the file is gone or cannot be read."""
    rows = []
    for p in paths:
        full = os.path.join(root, p)
        try:
            with open(full, "rb") as f:
                rows.append((p, hashlib.sha256(f.read()).hexdigest(), False))
        except FileNotFoundError:
            rows.append((p, None, False))
        except OSError:
            rows.append((p, None, True))
    return spark.createDataFrame(rows, "path string, sha256 string, unreadable boolean")


def drift_report(manifest: DataFrame, observed: DataFrame) -> DataFrame:
    """(path, state): unchanged, modified, missing or unreadable."""
    bad = observed.where("unreadable").select("path", F.lit("unreadable").alias("_bad"))
    return drift(manifest, observed).join(bad, "path", "left").select("path", F.coalesce("_bad", "state").alias("state"))


def commit_init(plan: DataFrame, root: str, version: str, now: datetime.datetime) -> list[str]:
    """Writes the planned files and claims them in the manifest; returns what was written."""
    written = []
    for r in plan.where("action = 'write'").orderBy("path").toLocalIterator():
        full = os.path.join(root, r.path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        if not inside(os.path.dirname(full), root):
            continue
        with open(full, "x", encoding="utf-8", newline="") as f:
            f.write(r.text)
        written.append({"path": r.path, "sha256": hashlib.sha256(r.text.encode()).hexdigest()})
    target = os.path.join(root, MANIFEST)
    os.makedirs(os.path.dirname(target), exist_ok=True)
    held, created, first = [], now.isoformat(), not os.path.exists(target)
    if not first:
        with open(target, encoding="utf-8") as f:
            old = json.load(f)
        held, created = old["files"], old["createdAt"]
    new = {x["path"] for x in written}
    files = sorted([x for x in held if x["path"] not in new] + written, key=lambda x: x["path"])
    write_manifest(target, {"manifestVersion": MANIFEST_VERSION, "toolkitVersion": version, "createdAt": created, "files": files}, first)
    return [x["path"] for x in written]
