"""Ownership manifests: checks, building, parsing, merging, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import MANIFEST_VERSION
from ..functions.text import trim

ENTRIES = "array<struct<path:string,sha256:string>>"


def path_refusal(path: Column) -> Column:
    """The code of the first check that a path fails, or null."""
    segments = F.split(path, "/", -1)
    return (
        F.when(path == "", "path-empty")
        .when(path.startswith("/") | path.rlike("^[A-Za-z]:"), "path-absolute")
        .when(F.array_contains(segments, ".."), "path-escapes-brain")
        .when(F.contains(path, F.lit("\\")) | F.array_contains(segments, ".") | F.array_contains(segments, "") | (path != trim(path)), "path-not-normalized")
    )


def entry_refusals(entries: DataFrame) -> DataFrame:
    """entries(entry_no, path, sha256) with the code each is refused by, null if it is sound."""
    w = Window.partitionBy("path").orderBy("entry_no")
    again = F.when(F.row_number().over(w) > 1, "path-duplicated")
    return entries.withColumn("code", F.coalesce(path_refusal(F.col("path")), again, F.when(~F.col("sha256").rlike(r"\A[0-9a-f]{64}\z"), "hash-malformed")))


def manifest_rows(entries: DataFrame, tasks: int | None = None) -> DataFrame:
    """(ok, code, path, sha256): all entries in the order of their paths, a row each, or, if any is refused,
    one row with the first refusal. Entries are dealt by ranges of paths and never gathered."""
    checked = entry_refusals(entries)
    first = checked.where("code is not null").agg(F.min(F.struct("entry_no", "code", "path")).alias("bad"))
    tasks = tasks or int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the other side is one row
    sound = checked.join(F.broadcast(first.where("bad is null"))).select(F.lit(True).alias("ok"), F.lit(None).cast("string").alias("code"), "path", "sha256")
    refused = first.where("bad is not null").select(F.lit(False).alias("ok"), "bad.code", "bad.path", F.lit(None).cast("string").alias("sha256"))
    return sound.unionByName(refused).repartitionByRange(tasks, "path").sortWithinPartitions("path")


def build_manifest(entries: DataFrame) -> DataFrame:
    """For a manifest that is one file: one row (ok, code, path, files): the first refusal in entry order, or the entries sorted by path."""
    checked = entry_refusals(entries)
    first = F.min(F.when(F.col("code").isNotNull(), F.struct("entry_no", "code", "path")))
    files = F.array_sort(F.collect_list(F.struct("path", "sha256")))
    out = checked.agg(first.alias("bad"), files.alias("files"))
    ok = F.col("bad").isNull()
    return out.select(ok.alias("ok"), F.col("bad.code").alias("code"), F.col("bad.path").alias("path"), F.when(ok, F.col("files")).alias("files"))


def manifest_json(built: DataFrame, toolkit_version: str, created_at: str) -> DataFrame:
    whole = F.struct(F.lit(MANIFEST_VERSION).alias("manifestVersion"), F.lit(toolkit_version).alias("toolkitVersion"), F.lit(created_at).alias("createdAt"), "files")
    return built.where("ok").select(F.concat(F.to_json(whole, {"pretty": "true"}), F.lit("\n")).alias("text"))


def parse_manifest(texts: DataFrame) -> DataFrame:
    """texts(text) with code (null if sound), toolkit_version, created_at and files.

    Every failure is a code; the checks go from the outside in, as each needs the one before.
    """
    v = F.try_parse_json("text")
    kind = lambda p: F.schema_of_variant(F.try_variant_get(v, p, "variant"))
    text = lambda p: F.try_variant_get(v, p, "string")
    is_text = lambda p: kind(p) == "STRING"
    raw = F.try_variant_get(v, "$.files", "array<variant>")
    item_ok = F.forall(raw, lambda x: F.coalesce((F.schema_of_variant(F.try_variant_get(x, "$.path", "variant")) == "STRING") & (F.schema_of_variant(F.try_variant_get(x, "$.sha256", "variant")) == "STRING"), F.lit(False)))
    files = F.transform(raw, lambda x: F.struct(F.try_variant_get(x, "$.path", "string").alias("path"), F.try_variant_get(x, "$.sha256", "string").alias("sha256")))
    missing = lambda p: kind(p).isNull()
    code = F.when(v.isNull(), "not-json").when(~F.schema_of_variant(v).startswith("OBJECT"), "not-an-object")
    code = code.when(~F.coalesce((kind("$.manifestVersion") == "BIGINT") & (F.try_variant_get(v, "$.manifestVersion", "long") == MANIFEST_VERSION), F.lit(False)), "version-unsupported")
    for p in ("$.toolkitVersion", "$.createdAt"):
        code = code.when(missing(p), "field-missing").when(~is_text(p), "field-malformed")
    code = code.when(missing("$.files"), "field-missing").when(raw.isNull() | ~item_ok, "field-malformed")
    parsed = texts.select("*", code.alias("shape"), text("$.toolkitVersion").alias("toolkit_version"), text("$.createdAt").alias("created_at"), files.alias("files"))
    # entries are looked up among each other only where some path stands twice
    parsed = parsed.withColumn("_twice", F.size(F.array_distinct("files.path")) < F.size("files"))
    bad = F.filter(F.transform("files", lambda e, i: F.coalesce(path_refusal(e["path"]), F.when(F.col("_twice") & (F.array_position("files.path", e["path"]) <= i), "path-duplicated"), F.when(~e["sha256"].rlike(r"\A[0-9a-f]{64}\z"), "hash-malformed"))), lambda c: c.isNotNull())
    return parsed.withColumn("code", F.coalesce("shape", F.when(F.col("shape").isNull(), F.get(bad, F.lit(0))))).drop("shape", "_twice")


def drift(manifest: DataFrame, observed: DataFrame) -> DataFrame:
    """(path, state) of every owned path: unchanged, modified or missing; other observed paths are ignored."""
    seen = observed.select("path", F.col("sha256").alias("now"))
    state = F.when(F.col("now").isNull(), "missing").when(F.col("now") == F.col("sha256"), "unchanged").otherwise("modified")
    return manifest.join(seen, "path", "left").select("path", state.alias("state"))


def owned(paths: DataFrame, manifest: DataFrame) -> DataFrame:
    return paths.join(manifest.select("path"), "path", "left_semi")


def merge_manifest(existing: DataFrame, written: DataFrame) -> DataFrame:
    """New entries replace those of the same path; the rest stay."""
    new = written.select("path", F.col("sha256").alias("new"))
    return existing.join(new, "path", "full_outer").select("path", F.coalesce("new", "sha256").alias("sha256"))


def classify_update(manifest: DataFrame, observed: DataFrame, shipped: DataFrame) -> DataFrame:
    """(path, state) of a dry update run: drift states of owned paths, and ``new`` for what only is shipped."""
    added = shipped.join(manifest.select("path"), "path", "left_anti").select("path", F.lit("new").alias("state"))
    return drift(manifest, observed).unionByName(added)
