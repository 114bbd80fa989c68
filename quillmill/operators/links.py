"""Names, ids and provenance: link parsing, tiered resolution, backlinks, duplicate ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import id_key, name_key, trim

TIERS = ("name", "h1", "alias")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` reads it."""
    return F.transform(F.array(value), body)[0]


def link_target(c: Column) -> Column:
    """struct(name, fragment, display) of ``[[folder/Name.md#part|shown]]`` or the same without brackets."""

    def of(t: Column) -> Column:
        inner = F.when(t.rlike(r"(?s)\A\[\[.*\]\]\z"), F.substr(t, F.lit(3), F.length(t) - 4)).otherwise(t)
        return _let(inner, parts)

    def parts(inner: Column) -> Column:
        pipe = F.instr(inner, "|")
        shown = F.when(pipe > 0, trim(F.substr(inner, pipe + 1, F.length(inner))))
        target = F.when(pipe > 0, F.substring_index(inner, "|", 1)).otherwise(inner)
        return _let(F.struct(shown.alias("shown"), target.alias("target")), lambda x: whole(x["target"], x["shown"]))

    def whole(target: Column, shown: Column) -> Column:
        mark = F.instr(target, "#")
        part = F.when(mark > 0, trim(F.substr(target, mark + 1, F.length(target))))
        name = F.substring_index(trim(F.when(mark > 0, F.substring_index(target, "#", 1)).otherwise(target)), "/", -1)
        ends = lambda n: trim(F.when(F.lower(n).endswith(".md"), F.substr(n, F.lit(1), F.length(n) - 3)).otherwise(n))
        none = F.lit(None).cast("string")
        return F.struct(_let(name, ends).alias("name"), _let(part, lambda x: F.when(x != "", x).otherwise(none)).alias("fragment"), F.when(shown != "", shown).otherwise(none).alias("display"))

    return _let(trim(c), of)


def claims(documents: DataFrame) -> DataFrame:
    """(id_key, written, n): every id claimed, as first written in document order, and by how many."""
    d = documents.where("id is not null").select(id_key(F.col("id")).alias("id_key"), trim(F.col("id")).alias("written"), "doc_no").where("id_key <> ''")
    return d.groupBy("id_key").agg(F.min_by("written", "doc_no").alias("written"), F.count("*").alias("n"), F.min("doc_no").alias("doc_no"))


def duplicate_ids(documents: DataFrame) -> DataFrame:
    return claims(documents).where("n > 1").select("id_key", "written", "n")


def resolve_ids(edges: DataFrame, documents: DataFrame) -> DataFrame:
    """Adds target (doc_no, null unless exactly one document claims the id) to edges(…, target_id)."""
    found = claims(documents).where("n = 1").select("id_key", F.col("doc_no").alias("target"))
    return edges.withColumn("id_key", id_key(F.col("target_id"))).join(found, "id_key", "left").drop("id_key")


def names(documents: DataFrame) -> DataFrame:
    """(key, tier, n, doc_no): how many documents answer to a key in each tier."""
    keyed = (
        documents.select(F.lit(0).alias("tier"), name_key(F.col("name")).alias("key"), "doc_no")
        .unionByName(documents.where("h1 is not null").select(F.lit(1).alias("tier"), name_key(F.col("h1")).alias("key"), "doc_no"))
        .unionByName(documents.select(F.lit(2).alias("tier"), F.explode("aliases").alias("key"), "doc_no").withColumn("key", name_key(F.col("key"))).where("key <> ''"))
    )
    return keyed.groupBy("key", "tier").agg(F.count("*").alias("n"), F.min("doc_no").alias("doc_no"))


def resolve_names(edges: DataFrame, documents: DataFrame) -> DataFrame:
    """Adds status, matched_by, n and target to edges(…, link): the first tier with a match decides."""
    best = names(documents).groupBy("key").agg(F.min(F.struct("tier", "n", "doc_no")).alias("hit"))
    out = edges.withColumn("key", name_key(link_target(F.col("link"))["name"])).join(best, "key", "left")
    hit = (F.col("key") != "") & F.col("hit").isNotNull()
    status = F.when(~hit | F.col("hit").isNull(), "unresolved").when(F.col("hit.n") > 1, "ambiguous").otherwise("resolved")
    matched = F.when(hit, F.element_at(F.array(*map(F.lit, TIERS)), F.col("hit.tier") + 1))
    return out.select(*edges.columns, status.alias("status"), matched.alias("matched_by"), F.when(hit, F.col("hit.n")).alias("n"), F.when(hit & (F.col("hit.n") == 1), F.col("hit.doc_no")).alias("target"))


def edges_of(documents: DataFrame) -> DataFrame:
    """(doc_no, item_no, target_id): each document's provenance edges."""
    return documents.select("doc_no", F.posexplode("derived_from").alias("item_no", "target_id"))


def backlinks(documents: DataFrame) -> DataFrame:
    """(doc_no, derived): for each source, the documents derived from it, in order; computed, never stored."""
    found = resolve_ids(edges_of(documents), documents).where("target is not null")
    return found.groupBy(F.col("target").alias("doc_no")).agg(F.array_sort(F.collect_set("doc_no")).alias("derived"))


def find_sources(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """ids(source_id) with the path of the first document, in walk order, whose id is exactly that text."""
    first = documents.where("id is not null").groupBy(F.col("id").alias("source_id")).agg(F.min_by("path", F.split("path", "/")).alias("path"))
    return ids.join(first, "source_id", "left")
