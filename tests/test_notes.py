import os
import random

import pytest
from pyspark.sql import functions as F

from quillmill.operators import edit, spans
from quillmill.plans import queries
from quillmill.sources import frontmatter as M
from quillmill.sources.markdown import scan_markdown, within_budget


def files(spark, texts):
    return spark.createDataFrame([(f"d/n{i}.md", f"n{i}", t, i) for i, t in enumerate(texts)], "path string, name string, text string, walk_no long")


def model_spans(text):
    """A plain version of the splitter for bodies without frontmatter."""
    import re

    lines, out = text.split("\n"), []
    sections, anchor, start, held, open_, trail = [], None, 0, [], {}, []
    for i, line in enumerate(lines):
        m = re.match(r"^ {0,3}(#{1,6})\s+([^\r\n  ]*)\Z", line)
        if not m:
            held.append(line)
            continue
        sections.append((anchor, start, held, trail))
        depth, title = len(m[1]), m[2].strip()
        open_ = {d: t for d, t in open_.items() if d < depth}
        trail = [open_[d] for d in sorted(open_) if open_[d]]
        open_[depth] = title
        anchor, start, held = title, i + 1, []
    sections.append((anchor, start, held, trail))
    for anchor, start, held, trail in sections:
        parts = [(start, held)]
        if len(held) > 40:
            parts, part, at = [], [], start
            for i, line in enumerate(held):
                part.append(line)
                if not line.strip() and len(part) >= 40:
                    parts.append((at, part))
                    part, at = [], start + i + 1
            if part:
                parts.append((at, part))
        for at, part in parts:
            full = [i for i, x in enumerate(part) if x.strip()]
            if full:
                out.append((anchor, at + full[0] + 1, at + full[-1] + 1, "\n".join(part[full[0] : full[-1] + 1]), trail))
    return out


def test_spans_match_model_and_addresses(spark):
    r = random.Random(5)
    texts = ["", "\n\n", "# A\n\ntext\n## B\n#### D\nx\n## \ny\n# E\r\nz\n```\n# in fence\n```", None]
    for _ in range(40):
        texts.append("\n".join(r.choice(["", "", "w", "word word", "# T", "## U", "### V " + str(r.random()), " ## X", "    # no", "#no", "  "]) for _ in range(r.randint(1, 160))))
    d = M.read_documents(files(spark, texts))
    got = {}
    for s in spans.split_spans(d).collect():
        got.setdefault(s.path, []).append((s.anchor, s.start_line, s.end_line, s.text, s.trail))
    for i, t in enumerate(texts):
        want = model_spans(t or "")
        assert sorted(got.get(f"d/n{i}.md", []), key=lambda x: x[1]) == want
        for _, a, b, text, _ in want:
            assert "\n".join((t or "").split("\n")[a - 1 : b]) == text


@pytest.mark.parametrize(
    "text, want",
    [("# One ##\n", "One"), ("Title\n===\n", "Title"), ("```\n# no\n```\n# yes", "yes"), ("~~~\n# no\n```\n~~~\n# y", "y"), ("- item\n===\n# T", "T"), ("nothing", None), ("# A\r\nx", "A"), (" # no\n#\tTab", "Tab")],
)
def test_first_h1(spark, text, want):
    assert spark.createDataFrame([(text,)], "b string").select(spans.first_h1(F.col("b")).alias("x")).first().x == want


def test_frontmatter_shapes(spark):
    texts = [
        "﻿---\nid: 1\n---\nb",
        "---\nbad: [\n---\nbody",
        "---\r\nid: x\r\n---\r\n# H\r\n",
        "---\n---\nb",
        "---\nid: a\n--- \nno newline",
        "plain",
        "---\nopen",
        "---\nid: 20260817\ncreated: 2024-05-06T07:08:09+02:00\nscore: 1.0\nyes: yes\ntags: one\nabout: {a: b}\naliases: [x, [y]]\nkind: [k]\nid: again\n---\n",
    ]
    got = {r.walk_no: r for r in M.read_documents(files(spark, texts)).collect()}
    assert got[0].block_start == 1 and got[0].id == "1" and got[0].body == "b"
    assert got[1].parse_error and got[1].body == "body" and got[1].id is None
    assert got[2].eol == "\r\n" and got[2].h1 == "H"
    assert got[3].parse_error is None and got[3].fields == []
    assert got[4].body == "no newline"
    assert got[5].block_start is None and got[5].title == "n5"
    assert got[6].body == "---\nopen"
    last = got[7]
    assert (last.id, last.created, last.tags, last.aliases) == ("again", "2024-05-06T07:08:09+02:00", ["one"], ["x"])
    assert last.duplicate_keys == ["id"] and last.unread_scalars == ["kind"] and last.unread_lists == ["about"]
    assert [tuple(x) for x in last.dropped] == [("aliases", 1, 2)] and last.body_line == 11


BLOCKS = ["id: a\nderived_from: [x, 'y z']\n", "derived_from:\n  - x # why\n  - y\ntags: [a]\n", "derived_from: x\n", "k: 1\n", "derived_from: [\n  x,\n  y\n]\nz: 2\n", "derived_from:\n- x\n- 'y'\n", ""]


@pytest.mark.parametrize("block", BLOCKS)
@pytest.mark.parametrize("eol", ["\n", "\r\n"])
def test_add_then_remove(block, eol):
    text = ("---\n" + block + "---\nbody\n").replace("\n", eol)
    new, changed, edits, code = edit.edit_one(text, "new id", True)
    assert changed and code is None
    assert edit.edit_one(new, " new id ", True)[1] is False
    back, changed, _, code = edit.edit_one(new, "new id", False)
    assert changed and code is None
    assert M.list_text(M.read_block(M.locate(back)["raw"])[0].get("derived_from")) == M.list_text(M.read_block(M.locate(text)["raw"])[0].get("derived_from"))
    assert back.endswith("body" + eol)


@pytest.mark.parametrize(
    "text, code",
    [("---\nbad: [\n---\n", "frontmatter-unreadable"), ("---\nderived_from: a\nderived_from: b\n---\n", "duplicate-key"), ("---\nderived_from: {a: 1}\n---\n", "field-not-list"), ("---\nderived_from: |\n  x\n---\n", "field-not-list"), ("---\nderived_from: &q [x]\na: *q\n---\n", "anchor-aliased")],
)
def test_refused_edits(text, code):
    assert edit.edit_one(text, "n", True) == (text, False, [], code)


def test_edit_frames(spark):
    d = spark.createDataFrame([("no block", "s"), (None, "s"), ("x", " ")], "text string, source_id string")
    got = [r.result for r in edit.add_edges(d).collect()]
    assert got[0].text == "---\nderived_from: [s]\n---\nno block" and got[2].code == "value-blank"
    e = spark.createDataFrame([("abcdef", [(1, 2, "X"), (4, 4, "--")])], "t string, e array<struct<start:int,end:int,text:string>>")
    assert e.select(edit.apply_edits(F.col("t"), F.col("e")).alias("x")).first().x == "aXcd--ef"


def test_scan(spark, tmp_path):
    for p in ("b/x.md", "b-c/y.md", "_d/_z.md", ".hid/n.md", ".dot.md", "a.MD", "a.md"):
        os.makedirs(tmp_path / os.path.dirname(p), exist_ok=True)
        (tmp_path / p).write_bytes(b"\xff# T\n")
    os.symlink(tmp_path / "b", tmp_path / "link")
    d, exhausted = scan_markdown(spark, str(tmp_path))
    rows = sorted(d.collect(), key=lambda r: r.walk_no)
    assert [r.path for r in rows] == [".dot.md", "_d/_z.md", "a.md", "b/x.md", "b-c/y.md"] and not exhausted
    assert rows[0].text == "�# T\n" and rows[0].bytes == 5
    d, exhausted = scan_markdown(spark, str(tmp_path), 2)
    assert d.count() == 2 and exhausted
    w = within_budget(spark.createDataFrame([("b-c/y.md",), ("b/x.md",), ("b/a/z.md",)], "path string"), 2)
    assert [r.path for r in w.orderBy("walk_no").collect()] == ["b/a/z.md", "b/x.md"]


def test_walk_order_numbers_every_path(spark, tmp_path):
    n = 50_010
    d = spark.range(n).selectExpr("id AS doc_id", "'t' AS text", "'en' AS lang", "IF(id % 2 = 0, 'b', 'b-c') AS source", "1 AS n_chars")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    got = [r.path for r in queries.walk_order(spark, str(tmp_path)).orderBy("walk_no").collect()]
    assert got == [f"{s}/{x}" for s, first in (("b", 0), ("b-c", 1)) for x in sorted(f"{i}.md" for i in range(first, n, 2))]
    assert [r.walk_no for r in queries.walk_order(spark, str(tmp_path)).orderBy("walk_no").collect()] == list(range(1, n + 1))
