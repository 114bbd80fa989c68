"""Markdown files with frontmatter in eight shapes, and manifest texts, made of the tables' rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def files_of_documents(documents: DataFrame) -> DataFrame:
    """(path, name, text, doc_no): a file for each document, by its number: without a block, with flow and
    block lists, with line feeds or CRLF, with repeated and unreadable fields, unreadable, unterminated, with
    a byte order mark, with a single value for a list."""
    i = F.col("doc_id")
    n, half = i.cast("string"), F.floor(i / 2).cast("string")
    c = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    body = F.coalesce("text", F.lit(""))
    shapes = [
        body,
        c("---\nid: n", n, "\ntags: [", F.coalesce("lang", F.lit("none")), ", two words]\nderived_from: [id-", half, ", 'x y']\n---\n", body),
        c('---\r\nid: "n', n, '"\r\nderived_from:\r\n  - id-', half, "\r\n  - other # why\r\n---\r\n", body),
        c("---\nid: first\nid: m", n, "\nkind: [a]\nabout: {a: b}\naliases: [x, [y], z]\n---\n", body),
        c("---\nbad: [\n---\n", body),
        c("---\nopen: ", n, "\n", body),
        c("﻿---\nid: ", n, "\ncreated: 2024-05-06T07:08:09+02:00\nscore: 1.0\n---\n", body),
        c("---\nderived_from: id-", n, "\ntitle: '  Of ", n, "'\n---\n", body),
    ]
    text = F.element_at(F.array(*shapes), (i % 8 + 1).cast("int"))
    return documents.where("doc_id is not null").select(F.format_string("notes/%d.md", i).alias("path"), n.alias("name"), text.alias("text"), i.alias("doc_no"))


def manifests_of_documents(documents: DataFrame) -> DataFrame:
    """(doc_no, text): a manifest for each document, sound or with one of thirteen faults."""
    i = F.col("doc_id")
    n, sha = i.cast("string"), F.sha2(F.coalesce("text", F.lit("")), 256)
    c = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    entry = lambda path, digest: c('{"path": "', path, '", "sha256": "', digest, '"}')
    good = entry(c("a/", n, ".md"), sha)

    def whole(version='1', toolkit='"t"', created='"c"', files=None):
        return c('{"manifestVersion": ', version, ', "toolkitVersion": ', toolkit, ', "createdAt": ', created, ', "files": ', c("[", good, "]") if files is None else files, "}")

    with_path = lambda path: whole(files=c("[", good, ", ", entry(path, sha), "]"))
    texts = [
        whole(), whole(files=c("[", good, ", ", entry(c("b/", n), sha), "]")), c("{", n), F.lit("[1]"), whole(version="2"), whole(toolkit="3"), c('{"manifestVersion": 1, "toolkitVersion": "t", "files": []}'), whole(files=F.lit("{}")),
        whole(files=F.lit('[{"path": 1, "sha256": "x"}]')), with_path(F.lit("")), with_path(F.lit("/x")), with_path(F.lit("a/../b")), with_path(F.lit("a//b")), with_path(c("a/", n, ".md")), whole(files=c("[", entry(F.lit("p"), F.upper(sha)), "]")),
    ]
    return documents.where("doc_id is not null").select(i.alias("doc_no"), F.element_at(F.array(*texts), (i % len(texts) + 1).cast("int")).alias("text"))
