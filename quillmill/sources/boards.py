"""Tickets, modules, citations and JSON documents made of the tables, one for each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE = "array<string>"


def _size() -> Column:
    return F.length(F.coalesce("text", F.lit("")))


def ticket_key(n: Column) -> Column:
    return F.format_string("%d.%d", F.floor(n / 50) + 1, n % 50 + 1)


def tickets_of_documents(documents: DataFrame) -> DataFrame:
    """(key, title, body): a Markdown ticket for each document, fifty to a feature.

    Its status, blockers, relevant areas and changes follow from the document's number and length; some
    tickets lack a status, block on none that exists, name a blocker twice, or write headings in another case.
    """
    i, n = F.col("doc_id"), _size()
    text = lambda c: c.cast("string")
    words = ("Complete", "Complete", "In Progress", "cancelled", "Superseded", "Proposed", "Ready", " READY ", "Ready", "Complete", "", "Blocked?")
    word = F.element_at(F.array(*map(F.lit, words)), ((n * 7 + i) % 12 + 1).cast("int"))
    status = F.when(word == "", "").otherwise(F.concat(F.lit("## Status\n\n"), word, F.lit("\n\n")))
    first = i - 1 - n % 9
    second = i - 17 - n % 5
    on = lambda when, key, mark, rest: F.when(when, F.concat(F.lit(f"{mark} `"), key, F.lit(f"`{rest}\n"))).otherwise("")
    blocked = F.concat(on(first >= 0, ticket_key(first), "-", " as `1.1` says"), on((i % 13 == 0) & (first >= 0), ticket_key(first), " *", ""), on((i % 3 == 0) & (second >= 0), ticket_key(second), "-", ""), on(i % 29 == 0, F.lit("999999.1"), "-", ""))
    part = F.concat(F.coalesce("source", F.lit("none")), F.lit("/part"), text(n % 97))
    dir_ = F.when(i % 5 == 0, F.concat(F.lit("`src/"), part, F.lit("/`"))).otherwise(F.concat(F.lit("`lib/"), text(i % 7), F.lit("/*.x`")))
    nested = F.when(i % 4 == 0, F.concat(F.lit("  - `docs/{a,b}"), text(i % 1000), F.lit(".md`\n"))).otherwise("")
    context = F.concat(F.lit("## Context\n\n- Relevant area: `./src/"), part, F.lit("/file"), text(i * 17 % 41), F.lit(".mjs`, "), dir_, F.lit("\n"), nested, F.lit("- See `README.md`, `v1.2.3`, `https://x.example/y` and `a.b/c`\n\n"))
    changes = F.concat(F.lit("## Changes\n"), F.repeat(F.lit("\n- change\n  - part of it"), (1 + n % 10).cast("int")))
    heading = F.when(i % 2 == 0, "## Blocked by\n\n").otherwise("## BLOCKED BY \n\n")
    title = F.array_join(F.slice(F.split(F.coalesce("text", F.lit("")), " "), 1, 3), " ")
    return documents.where("doc_id is not null").select(ticket_key(i).alias("key"), title.alias("title"), F.concat(F.lit("# "), title, F.lit("\n\n"), status, heading, blocked, F.lit("\n"), context, changes).alias("body"))


def claim_sources(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(worktrees, branches, refs, live): which tickets are claimed, and how that shows."""
    i, key = F.col("doc_id"), ticket_key(F.col("doc_id"))
    state = F.element_at(F.array(*map(F.lit, ("working", "review", "human-gate", "invalid:lost", None, "failed"))), (i % 6 + 1).cast("int"))
    d = documents.where("doc_id is not null")
    branch = F.concat(F.lit("ticket/"), key)
    trees = d.where("doc_id % 19 = 1").select(key.alias("key"), branch.alias("branch"), F.concat(F.lit(".work/"), key).alias("worktree"), state.alias("state"), F.when(i % 6 == 2, "a person decides").alias("gate"))
    branches = d.where("doc_id % 23 = 2").select(key.alias("key"), branch.alias("branch"), F.when(i % 2 == 0, F.concat(F.lit("/other/"), key)).alias("elsewhere"))
    refs = d.where("doc_id % 31 = 3 or doc_id % 101 = 0").select(F.when(i % 101 == 0, F.concat(F.lit("888888."), i.cast("string"))).otherwise(key).alias("key"))
    return trees, branches, refs, d.where("doc_id % 38 = 1").select(key.alias("key"))


def modules_of_documents(documents: DataFrame, lessons: int = 40) -> DataFrame:
    """(lesson, module_no, id, requires): a module for each document; some lessons hold cycles, others orphans."""
    i = F.col("doc_id")
    lesson, k, n = i % lessons, F.floor(i / lessons), _size()
    name = lambda c: F.concat(F.lit("m"), c.cast("string"))
    also = lambda when, what: F.when(when, F.array(what)).otherwise(F.array().cast(NONE))
    lost = F.lit("m-none")
    asked = F.concat(
        F.array(F.when(k % 13 == 12, lost).otherwise(name(F.floor(k / 4)))), also(k % 5 == 2, name(F.floor(k / 3))), also(k % 11 == 7, lost),
        also((lesson % 3 == 0) & (k % 6 == 1), name(k * 4 + 1)), also(k % 17 == 9, name(k)), also(n % 7 == 3, name(F.floor(k / 2))),
    )
    return documents.where("doc_id is not null").select(lesson.alias("lesson"), i.alias("module_no"), name(k).alias("id"), F.when(k > 0, asked).otherwise(F.array().cast(NONE)).alias("requires"))


def citations_of_conversations(conversations: DataFrame) -> DataFrame:
    """(citation_no, commit, path, first_line, last_line): each turn cites lines of a document."""
    c, t, n = F.col("conv_id"), F.col("turn"), _size()
    first = 1 + t % 5 * 2
    return conversations.where("conv_id is not null and turn is not null").select((c * 1000 + t).alias("citation_no"), F.concat(F.lit("c"), (c % 3).cast("string")).alias("commit"), F.format_string("doc/%d.md", c * 9 + t).alias("path"), first.alias("first_line"), (first + n % 7 - 1).alias("last_line"))


def files_of_documents(documents: DataFrame) -> DataFrame:
    """(commit, path, n_lines)"""
    i = F.col("doc_id")
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long")
    return documents.where("doc_id is not null").select(F.concat(F.lit("c"), (i % 2).cast("string")).alias("commit"), F.format_string("doc/%d.md", i).alias("path"), lines.alias("n_lines"))


NOTE_SCHEMA = {
    "$id": "note",
    "type": "object",
    "required": ["kind", "id", "title", "tags", "body"],
    "additionalProperties": False,
    "properties": {
        "kind": {"const": "note"},
        "id": {"type": "integer", "minimum": 10},
        "title": {"type": "string", "minLength": 3, "maxLength": 12, "pattern": "^[A-Z]"},
        "lang": {"enum": ["de", "en", "fr", None]},
        "tags": {"type": "array", "minItems": 2, "maxItems": 3, "uniqueItems": True, "items": {"type": "string", "minLength": 3}},
        "score": {"type": "number", "maximum": 250},
        "source": {"type": "string"},
        "body": {"oneOf": [{"$ref": "#/$defs/text"}, {"$ref": "#/$defs/list"}]},
    },
    "if": {"required": ["lang"], "properties": {"lang": {"const": "en"}}},
    "then": {"required": ["source"]},
    "$defs": {
        "text": {"type": "object", "required": ["type", "text"], "properties": {"type": {"const": "text"}, "text": {"type": "string", "maxLength": 1000}}},
        "list": {"type": "object", "additionalProperties": False, "properties": {"type": {"const": "list"}, "items": {"type": "array", "items": {"type": "integer", "maximum": 900}}}},
    },
}


def json_of_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, value): a JSON text for each document, many of which ``NOTE_SCHEMA`` refuses somewhere."""
    i, n = F.col("doc_id"), _size()
    word = F.get(F.split(F.coalesce("text", F.lit("")), " "), F.lit(0))
    none = lambda kind: F.lit(None).cast(kind)
    tags = F.concat(F.array(F.coalesce("lang", F.lit("??")), F.coalesce("source", F.lit("none"))), F.when(i % 7 == 0, F.array(F.coalesce("source", F.lit("none")), F.lit("more"))).otherwise(F.array().cast(NONE)))
    items = F.when(i % 5 == 1, F.array(n, i))
    body = F.struct(F.when(i % 5 == 1, "list").when(i % 5 == 2, "video").when(i % 5 != 3, "text").alias("type"), F.when(i % 5 != 1, F.col("text")).alias("text"), items.alias("items"), F.when(i % 25 == 1, 1).alias("more"))
    value = F.struct(
        F.when(i % 19 != 4, "note").otherwise("memo").alias("kind"), F.when(i % 17 != 5, i).alias("id"), F.when(i % 23 != 6, word).alias("title"), F.col("lang").alias("lang"), tags.alias("tags"), (n / 10).cast("double").alias("score"),
        F.when(i % 3 > 0, F.col("source")).alias("source"), F.when(i % 5 < 4, body).otherwise(none("struct<type:string,text:string,items:array<bigint>,more:int>")).alias("body"), F.when(i % 29 == 7, 1).alias("extra"),
    )
    return documents.where("doc_id is not null").select("doc_id", F.when(i % 31 == 8, "no json").otherwise(F.to_json(value)).alias("value"))
