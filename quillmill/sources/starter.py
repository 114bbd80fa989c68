"""The files that a new collection starts with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FOLDERS = {
    "inbox": "What was captured and not yet sorted. Everything here may be moved or thrown away.",
    "journal": "One note a day, or whenever something is worth a date.",
    "notes": "One subject to a note, under a name that others would look for.",
    "projects": "Work with an end: what is wanted, what was decided, what is left.",
    "sources": "Where things come from. A source has an id, and notes name it under `derived_from`.",
}


def starter_files() -> dict[str, str]:
    """Path to text: a readme, a file for agents, and a readme for each folder."""
    listing = "\n".join(f"- `{name}/`: {text}" for name, text in FOLDERS.items())
    out = {
        "README.md": f"# A collection of notes\n\nPlain Markdown files, searched by passages.\n\n{listing}\n",
        "AGENTS.md": "# For agents\n\nSearch with several wordings of a question and cite passages by file and lines.\nAdd files; do not change those of others without being asked.\n",
    }
    return out | {f"{name}/README.md": f"# {name.capitalize()}\n\n{text}\n" for name, text in FOLDERS.items()}


def starter_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(starter_files().items()), "path string, text string")
