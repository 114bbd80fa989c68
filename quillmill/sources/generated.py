"""A synthetic corpus of Markdown notes for measurements: the same notes for the same seed."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

FOLDERS = ("inbox", "journal", "notes", "projects", "sources")
SCHEMA = "path string, name string, text string, bytes long, walk_no long"
SYLLABLES = ("ar", "bel", "cor", "dan", "el", "fir", "gon", "hul", "im", "jas", "kel", "lor", "mun", "nev", "or", "pas", "quil", "ren", "sol", "tur", "um", "vas", "wen", "xel", "yor", "zan")


def note(no: int, seed: int, sections: list[str]) -> str:
    """A note's text: 30 in 100 have frontmatter, 3 in 100 a broken one, 12 in 100 sections are copies."""
    r = random.Random(f"{seed}/{no}")
    words = lambda n: " ".join("".join(r.choices(SYLLABLES, k=r.randint(1, 3))) for _ in range(n))
    kind = r.random()
    head = f"---\nid: n-{no}\ntags: [{words(1)}, {words(1)}]\n---\n\n" if kind < 0.30 else "---\nid: [broken\n---\n\n" if kind < 0.33 else ""
    body = [f"# {words(3).capitalize()}\n"]
    for _ in range(r.randint(1, 4)):
        text = r.choice(sections) if sections and r.random() < 0.12 else "\n".join(words(r.randint(8, 14)).capitalize() + "." for _ in range(r.randint(2, 9)))
        sections.append(text)
        body.append(f"## {words(2).capitalize()}\n\n{text}\n")
    return head + "\n".join(body)


def generate_corpus(spark: SparkSession, count: int, seed: int) -> DataFrame:
    """``count`` notes as a table of files. The generator goes on from note to note, so it runs on the driver."""
    sections: list[str] = []
    rows = []
    for no in range(count):
        text = note(no, seed, sections)
        rows.append((f"{FOLDERS[no % len(FOLDERS)]}/note-{no:05d}.md", f"note-{no:05d}", text, len(text.encode()), no))
    return spark.createDataFrame(rows, SCHEMA)
