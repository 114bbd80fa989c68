"""Documents to line-addressed passages, in each document's own row (no shuffle).

``split_spans`` takes documents(path, name, text, body, body_line, title, tags, aliases, about) and
explodes once, at the end. A section opens at an ATX heading of level 1 to 6; the fold over the
headings keeps the open ones, the fold over a long section's blank lines finds the cuts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import SPAN_LINES
from ..functions.text import is_blank, trim

HEADING = r"\A {0,3}(#{1,6})[\s\x{A0}\x{FEFF}]+([^\r\n\x{2028}\x{2029}]*)\z"
ENTRY = "array<struct<depth:int,text:string>>"
SECTION = "array<struct<anchor:string,start:int,trail:array<string>>>"


def lines_of(c: Column) -> Column:
    return F.split(c, "\n", -1)


def sections(lines: Column) -> Column:
    """array<struct(anchor, start, trail)>: the preamble and each heading's section, empty ones too."""
    heads = F.filter(
        F.transform(lines, lambda x, i: F.when(x.rlike(HEADING), F.struct((i + 1).alias("start"), F.length(F.regexp_extract(x, HEADING, 1)).alias("depth"), trim(F.regexp_extract(x, HEADING, 2)).alias("text")))),
        lambda h: h.isNotNull(),
    )
    first = F.struct(F.lit(None).cast("string").alias("anchor"), F.lit(0).alias("start"), F.array().cast("array<string>").alias("trail"))
    state = F.struct(F.array().cast(ENTRY).alias("open"), F.array(first).cast(SECTION).alias("out"))

    def step(s, h):
        above = F.filter(s["open"], lambda o: o["depth"] < h["depth"])
        trail = F.filter(F.transform(above, lambda o: o["text"]), lambda t: t != "")
        return F.struct(
            F.concat(above, F.array(F.struct(h["depth"].alias("depth"), h["text"].alias("text"))).cast(ENTRY)).alias("open"),
            F.concat(s["out"], F.array(F.struct(h["text"].alias("anchor"), h["start"].alias("start"), trail.alias("trail"))).cast(SECTION)).alias("out"),
        )

    return F.aggregate(heads, state, step, lambda s: s["out"])


def _cuts(lines: Column, start: Column, end: Column) -> Column:
    """Starts of a section's parts: after a blank line once SPAN_LINES lines are held, if it is longer."""
    blank = F.filter(F.when(end > start, F.sequence(start, end - 1)).otherwise(F.array().cast("array<int>")), lambda i: is_blank(F.get(lines, i)))
    cut = F.aggregate(blank, F.array(start), lambda s, i: F.when((i - F.element_at(s, -1) + 1 >= SPAN_LINES) & (i + 1 < end), F.concat(s, F.array(i + 1))).otherwise(s))
    return F.when(end - start > SPAN_LINES, cut).otherwise(F.array(start))


def parts(lines: Column) -> Column:
    """array<struct(anchor, trail, first, last)>: line numbers of every part, blank edges trimmed."""
    n = F.size(lines)

    def of(found: Column) -> Column:
        def section(s, k):
            nxt = F.get(found, k + 1)
            # the heading line of the next section is not content
            end = F.when(nxt.isNull(), n).otherwise(nxt["start"] - 1)

            def by_cuts(cuts):
                def part(a, j):
                    b = F.coalesce(F.get(cuts, j + 1), end)
                    full = F.filter(F.when(b > a, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>")), lambda i: ~is_blank(F.get(lines, i)))
                    return F.struct(s["anchor"].alias("anchor"), s["trail"].alias("trail"), F.array_min(full).alias("first"), F.array_max(full).alias("last"))

                return F.transform(cuts, part)

            return F.transform(F.array(_cuts(lines, s["start"], end)), by_cuts)[0]

        return F.filter(F.flatten(F.transform(found, section)), lambda p: p["first"].isNotNull())

    return F.transform(F.array(sections(lines)), of)[0]


def folder(path: Column) -> Column:
    names = F.split(path, "/", -1)
    return F.filter(F.slice(names, 1, F.size(names) - 1), lambda s: s != "")


def split_spans(documents: DataFrame) -> DataFrame:
    """(path, anchor, start_line, end_line, text, title, trail, tags, aliases, about, folder) per passage."""
    d = documents.withColumn("_lines", lines_of(F.col("body"))).withColumn("_part", F.explode(parts(F.col("_lines"))))
    return d.select(
        "path",
        F.col("_part.anchor").alias("anchor"),
        (F.col("_part.first") + F.col("body_line") + 1).alias("start_line"),
        (F.col("_part.last") + F.col("body_line") + 1).alias("end_line"),
        F.array_join(F.slice("_lines", F.col("_part.first") + 1, F.col("_part.last") - F.col("_part.first") + 1), "\n").alias("text"),
        "title",
        F.col("_part.trail").alias("trail"),
        "tags",
        "aliases",
        "about",
        folder(F.col("path")).alias("folder"),
    )


def first_h1(body: Column) -> Column:
    """The first level-1 heading, ATX or underlined, outside code fences; null without one."""
    lines = F.transform(lines_of(body), lambda x: F.regexp_replace(x, r"\r\z", ""))
    none = F.lit(None).cast("string")
    state = F.struct(none.alias("fence"), none.alias("before"), none.alias("found"))
    atx = r"\A#[ \t]+([^\r\n\x{2028}\x{2029}]*)\z"

    def step(s, x):
        marker = F.regexp_extract(x, r"\A[ \t]{0,3}(`{3,}|~{3,})", 1)
        sign = F.substring(marker, 1, 1)
        underlined = F.when(s["before"].isNotNull() & x.rlike(r"\A[ \t]{0,3}=+[ \t]*\z"), trim(s["before"]))
        title = F.when(x.rlike(atx), trim(F.regexp_replace(F.regexp_extract(x, atx, 1), r"[ \t]+#+[ \t]*\z", "")))
        found = F.coalesce(F.when(underlined != "", underlined), F.when(title != "", title))
        paragraph = ~is_blank(x) & ~x.rlike(r"\A[ \t]{0,3}([#>*+-]|\d+[.)])([ \t]|\z)")
        fence = F.when(s["fence"].isNull(), sign).when(s["fence"] == sign, none).otherwise(s["fence"])
        return (
            F.when(s["found"].isNotNull(), s)
            .when(marker != "", F.struct(fence.alias("fence"), none.alias("before"), none.alias("found")))
            .when(s["fence"].isNotNull(), s)
            .otherwise(F.struct(none.alias("fence"), F.when(paragraph, x).alias("before"), found.alias("found")))
        )

    return F.aggregate(lines, state, step, lambda s: s["found"])


def page_sections(text: Column) -> Column:
    """array<struct(heading, slug, body)>: a text cut at its ``## `` lines outside code fences.

    What stands before the first heading is left out; bodies are trimmed of white space. Only lines that
    open a fence or a section are folded over; bodies are slices between them.
    """

    def cut(lines: Column) -> Column:
        marked = F.filter(F.transform(lines, lambda x, i: F.when(x.startswith("```") | x.rlike(r"\A## .+\z"), F.struct((i + 1).alias("at"), x.startswith("```").alias("fence")))), lambda m: m.isNotNull())
        start = F.struct(F.lit(False).alias("fenced"), F.array().cast("array<int>").alias("heads"))
        step = lambda s, m: F.struct((s["fenced"] != m["fence"]).alias("fenced"), F.when(m["fence"] | s["fenced"], s["heads"]).otherwise(F.concat(s["heads"], F.array(m["at"]))).alias("heads"))
        return F.transform(F.array(F.aggregate(marked, start, step, lambda s: s["heads"])), lambda heads: F.transform(heads, lambda h, k: one(lines, h, F.coalesce(F.get(heads, k + 1), F.size(lines) + 1))))[0]

    def one(lines: Column, at: Column, end: Column) -> Column:
        heading = F.substr(F.element_at(lines, at), F.lit(4))
        slug = F.regexp_replace(F.regexp_replace(F.lower(heading), "[^a-z0-9]+", "-"), "^-|-$", "")
        return F.struct(heading.alias("heading"), slug.alias("slug"), trim(F.array_join(F.slice(lines, at + 1, end - at - 1), "\n")).alias("body"))

    return F.transform(F.array(lines_of(F.coalesce(text, F.lit("")))), cut)[0]
