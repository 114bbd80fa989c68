"""Findings about a set of documents: a union of rules, in a stable order.

Documents carry doc_no, path, id, derived_from, about, name, h1, aliases, and from reading the
frontmatter parse_error, duplicate_keys, unread_scalars, unread_lists and dropped (field, n, of).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import id_key, trim
from .links import claims, edges_of, link_target, resolve_names

SEVERITIES = ("error", "warning", "info")


def _finding(rows: DataFrame, field, code: str, severity: str, reason, phase: int, rule: int, item=None) -> DataFrame:
    return rows.select("doc_no", "path", (F.lit(field) if field is None or isinstance(field, str) else field).cast("string").alias("field"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), reason.alias("reason"), F.lit(phase).alias("phase"), F.lit(rule).alias("rule"), (F.lit(0) if item is None else item).alias("item"))


RULE = "array<struct<field:string,code:string,severity:string,reason:string,rule:int,item:int>>"


def document_findings(documents: DataFrame) -> DataFrame:
    """Rules that need one document only; an unreadable frontmatter stands alone.

    A document's findings are one array, which is exploded once.
    """
    q = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    text = lambda c: F.lit(c).cast("string") if c is None or isinstance(c, str) else c

    def one(field, code: str, severity: str, reason, rule: int, item=None):
        return F.struct(text(field).alias("field"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), reason.alias("reason"), F.lit(rule).alias("rule"), (F.lit(0) if item is None else item).alias("item"))

    none = F.array().cast(RULE)
    own = id_key(F.col("id"))
    each = lambda c, f: F.coalesce(F.transform(c, f).cast(RULE), none)
    when = lambda test, found: F.when(F.coalesce(test, F.lit(False)), F.array(found).cast(RULE)).otherwise(none)
    keys = F.transform("derived_from", lambda e: id_key(e))
    read = F.concat(
        each("duplicate_keys", lambda k, i: one(k, "duplicate-key", "warning", F.concat(q(k), F.lit(" occurs more than once; its last value holds")), 1, i)),
        each("unread_scalars", lambda k, i: one(k, "field-not-text", "warning", F.concat(q(k), F.lit(" is no single text value and was left out")), 2, i)),
        each("unread_lists", lambda k, i: one(k, "field-not-list", "warning", F.concat(q(k), F.lit(" is neither text nor a list and was left out")), 3, i)),
        each("dropped", lambda x, i: one(x["field"], "list-item-unreadable", "warning", F.format_string("%d of %d items of `%s` are no text and were left out", x["n"], x["of"], x["field"]), 3, i)),
        when(trim(F.col("id")) == "", one("id", "id-blank", "error", F.lit("`id` is blank, so nothing can refer to this file"), 4)),
        when(F.array_contains(keys, ""), one("derived_from", "derived-from-blank", "error", F.lit("`derived_from` has a blank item"), 5)),
        when((own != "") & F.array_contains(keys, own), one("derived_from", "derived-from-self", "error", F.concat(F.lit("`derived_from` refers to the file's own id "), q(trim(F.col("id")))), 6)),
    )
    unread = F.array(one(None, "frontmatter-unreadable", "error", F.concat(F.lit("the frontmatter is no readable mapping: "), "parse_error"), 0)).cast(RULE)
    found = documents.select("doc_no", "path", F.explode(F.when(F.col("parse_error").isNotNull(), unread).otherwise(read)).alias("x"))
    return found.select("doc_no", "path", "x.field", "x.code", "x.severity", "x.reason", F.lit(0).alias("phase"), "x.rule", "x.item")


def cross_findings(documents: DataFrame) -> DataFrame:
    """Rules over the whole set: duplicate ids, and edges and names that resolve to nothing or to several."""
    known = claims(documents).select("id_key", "n")
    own = documents.select("doc_no", "path", "id", id_key(F.col("id")).alias("id_key"))
    twice = own.join(known.where("n > 1"), "id_key")
    edges = edges_of(documents).join(own.select("doc_no", "path", F.col("id_key").alias("own")), "doc_no").withColumn("id_key", id_key(F.col("target_id")))
    lost = edges.where("id_key <> '' and not (id_key <=> own)").join(known, "id_key", "left_anti")
    about = documents.select("doc_no", "path", F.posexplode("about").alias("item_no", "link"))
    named = resolve_names(about.withColumn("_name", link_target(F.col("link"))["name"]).where("_name <> ''").drop("link").withColumnRenamed("_name", "link"), documents)
    q = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    rules = [
        _finding(twice, "id", "duplicate-id", "error", F.concat(F.lit("several files claim the id "), q(trim(F.col("id")))), 1, 0),
        _finding(lost, "derived_from", "derived-from-unresolved", "warning", F.concat(F.lit("no file claims the id "), q(F.col("target_id"))), 1, 1, F.col("item_no")),
        _finding(named.where("status = 'unresolved'"), "about", "about-unresolved", "info", F.concat(F.lit("no file answers to "), q(F.col("link"))), 1, 2, F.col("item_no")),
        _finding(named.where("status = 'ambiguous'"), "about", "about-ambiguous", "info", F.format_string("%d files answer to `%s` by %s", "n", "link", "matched_by"), 1, 2, F.col("item_no")),
    ]
    return reduce(DataFrame.unionByName, rules)


def findings(documents: DataFrame) -> DataFrame:
    """All findings; order by phase, doc_no, rule, item for the report's order."""
    return document_findings(documents).unionByName(cross_findings(documents))


def severity_counts(found: DataFrame) -> DataFrame:
    return found.agg(*[F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in SEVERITIES])
