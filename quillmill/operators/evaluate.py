"""Measurement: context cost, retrieval quality, field usage, url variants, edges after a rename."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import normalize_url
from .links import link_target, resolve_ids, resolve_names


def context_cost(results: DataFrame, sizes: DataFrame, payloads: DataFrame | None = None) -> DataFrame:
    """(query_id, results, files, text_bytes, whole_note_bytes[, payload_bytes]); a file's size counts once."""
    texts = results.groupBy("query_id").agg(F.count("*").alias("results"), F.countDistinct("path").alias("files"), F.sum(F.octet_length("text")).alias("text_bytes"))
    whole = results.select("query_id", "path").distinct().join(sizes, "path").groupBy("query_id").agg(F.sum("bytes").alias("whole_note_bytes"))
    out = texts.join(whole, "query_id", "left")
    if payloads is not None:
        out = out.join(payloads.select("query_id", F.octet_length("payload").alias("payload_bytes")), "query_id", "left")
    return out


def context_economy(cost: DataFrame) -> DataFrame:
    """One row (questions, text_bytes, whole_note_bytes, saving): what results hold against their whole files,
    summed over questions; a saving of 2 means half the bytes, cut to two decimals."""
    out = cost.agg(F.count("*").alias("questions"), F.sum("text_bytes").alias("text_bytes"), F.sum("whole_note_bytes").alias("whole_note_bytes"))
    return out.withColumn("saving", F.floor(F.col("whole_note_bytes") * 100 / F.col("text_bytes")) / 100)


def first_hits(results: DataFrame, relevant: DataFrame) -> DataFrame:
    """(query_id, first_rank): the best rank of a relevant result; ``relevant`` is (query_id, path)."""
    return results.join(relevant.select("query_id", "path").distinct(), ["query_id", "path"]).groupBy("query_id").agg(F.min("rank").alias("first_rank"))


def relevant_by_rule(results: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, path): results that a rule (query_id, file, anchor, pattern) calls relevant.

    The rules of a question are few; they meet its results by an equi join on the question.
    """
    norm = lambda c: F.lower(F.replace(c, F.lit("\\"), F.lit("/")))
    by_file = F.contains(norm(F.col("path")), norm(F.col("file"))) & (F.col("want").isNull() | F.contains(norm(F.concat_ws(" ", "anchor", "trail")), norm(F.col("want"))))
    by_text = F.rlike("text", F.concat(F.lit("(?i)"), F.col("pattern")))
    rules = expected.withColumnRenamed("anchor", "want")
    return results.join(rules, "query_id").where(F.coalesce(by_file, F.lit(False)) | F.coalesce(by_text, F.lit(False))).select("query_id", "path").distinct()


def retrieval_quality(questions: DataFrame, single: DataFrame, fused: DataFrame, relevant: DataFrame) -> DataFrame:
    """Per kind of question: how many have evidence, are hit at 1, 3 and 5, missed, and rescued by fusion."""
    has = relevant.select("query_id").distinct().withColumn("has", F.lit(1))
    d = questions.join(has, "query_id").join(first_hits(single, relevant), "query_id", "left")
    d = d.join(first_hits(fused, relevant).withColumnRenamed("first_rank", "fused_rank"), "query_id", "left")
    n = lambda c: F.count(F.when(c, 1))
    r, f = F.col("first_rank"), F.col("fused_rank")
    return d.groupBy("kind").agg(F.count("*").alias("answerable"), n(r == 1).alias("top1"), n(r <= 3).alias("top3"), n(r <= 5).alias("top5"), n(r.isNull()).alias("missed"), n(r.isNull() & f.isNotNull()).alias("rescued"))


def median(df: DataFrame, value: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.percentile(value, 0.5).alias("median"))


def field_usage(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(field, files) and one row (least, median, most) of fields per file; ``fields`` is array<string>."""
    used = documents.select(F.explode("fields").alias("field")).groupBy("field").agg(F.count("*").alias("files"))
    n = documents.select(F.size("fields").alias("n"))
    ranks = n.groupBy("n").agg(F.count("*").alias("k"))
    # the upper median, from counts of counts
    total = ranks.agg(F.sum("k").alias("total"))
    from pyspark.sql.window import Window

    run = ranks.withColumn("upto", F.sum("k").over(Window.orderBy("n"))).crossJoin(F.broadcast(total))
    spread = run.agg(F.min("n").alias("least"), F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("n"))).alias("median"), F.max("n").alias("most"))
    return used, spread


def url_groups(urls: DataFrame) -> DataFrame:
    """(norm_url, variants, n): the distinct spellings of each normalised url."""
    u = urls.withColumn("u", normalize_url(F.col("url"))).where("u.ok").select(F.col("u.url").alias("norm_url"), "url")
    return u.groupBy("norm_url").agg(F.array_sort(F.collect_set("url")).alias("variants"), F.count("*").alias("n"))


def about_usage(documents: DataFrame) -> DataFrame:
    """(path, added, mirrored): declared ``about`` names that the body's wikilinks lack, and share."""
    names = lambda xs: F.array_distinct(F.filter(F.transform(xs, lambda x: F.lower(link_target(x)["name"])), lambda x: x != ""))
    linked = names(F.regexp_extract_all("body", F.lit(r"(\[\[[^\]\r\n]+\]\])"), F.lit(1)))
    return documents.select("path", F.size(F.array_except(names(F.col("about")), linked)).alias("added"), F.size(F.array_intersect(names(F.col("about")), linked)).alias("mirrored"))


def edge_survival(documents: DataFrame, edges: DataFrame, renamed: DataFrame) -> DataFrame:
    """One row: edges by id and by name that resolve before and after files get new names.

    edges(target_id, link); renamed(doc_no, new_name).
    """
    after = documents.join(renamed, "doc_no", "left").withColumn("name", F.coalesce("new_name", "name")).drop("new_name")

    def count(docs: DataFrame, tag: str) -> DataFrame:
        ids = resolve_ids(edges, docs).agg(F.count("target").alias(f"ids_{tag}"))
        return ids.crossJoin(resolve_names(edges, docs).agg(F.count("target").alias(f"names_{tag}")))

    return count(documents, "before").crossJoin(count(after, "after"))
