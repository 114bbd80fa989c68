"""Tickets, graphs, citations, schemas and widths against plain versions, and on odd rows."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillmill.functions.width import cell_width
from quillmill.operators import evidence, graphs, schema, tickets
from quillmill.sources.boards import NOTE_SCHEMA


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# --- tickets ---


def plain_section(text, heading):
    m = re.search(rf"^## {heading}[ \t]*\r?\n([\s\S]*?)(?=^## |\Z)", text, re.M | re.I)
    return m and m.group(1)


def test_extraction(spark):
    bodies = [
        "# T\n\n## STATUS\n\n\n in progress \n\n## Blocked By\n- `1.2` and `9.9`\n * `3.4`\n- `1.2`\n`5.6`\n- 7.8\n## Changes\n- a\n  - b\n1. c\n2) d\n+ e\n-f\n",
        "## Status\r\nready\r\n## Context\r\n- Relevant area: `./a/b/`, `x{1,2}.md`, `v1.2`, `http://h/p`, `a.b/c`, `.github/w`\r\n  - `src/*/t.js`, `**/*.md`\r\n- other `README.md`\r\n## End\r\n",
        "## Status\n\n", "no sections", "", None, "## Context\n- Relevant area: `a`\n- relevant AREA : `lib/{p,q}/{r,s}.c`\n\n  - `late/x`\ntext\n  - `no/y`\n## Blocked by\nNone",
        "text ## Status\n## Statuses\nReady\n## Status \nComplete\nReady\n## Status\nReady",
    ]
    d = spark.createDataFrame([(str(i), b) for i, b in enumerate(bodies)], "n string, body string")
    b = F.col("body")
    out = {int(r.n): r for r in d.select("n", tickets.section(b, "Status").alias("s"), tickets.local_status(b).alias("status"), tickets.blockers(b).alias("on"), tickets.count_changes(b).alias("k"), tickets.context_paths(b).alias("paths"), tickets.relevant_areas(b).alias("areas")).collect()}
    for i, body in enumerate(bodies):
        if body is not None:
            assert out[i].s == plain_section(body, "Status"), i
    assert [out[i].status for i in range(8)] == ["In Progress", "Ready", tickets.UNREAD, tickets.UNREAD, tickets.UNREAD, tickets.UNREAD, tickets.UNREAD, "Complete"]
    assert out[0].on == ["1.2", "3.4"] and out[0].k == 4 and out[6].on == [] and out[5].k == 0
    assert out[1].paths == [".github/w", "README.md", "a/b", "src", "x1.md", "x2.md"] and out[1].areas == [".github/w", "a/b", "src", "x1.md", "x2.md"]
    assert out[6].areas == ["lib/p/r.c", "lib/p/s.c", "lib/q/r.c", "lib/q/s.c"]


def test_key_order(spark):
    keys = ["53.10", "53.2", "7.100", "100.1", "7.9", "053.2", "12", "12.0.1", "x", "1.", None, "", "1" * 40 + ".5", "2" * 39 + ".5"]
    d = spark.createDataFrame([(k, "t") for k in keys], "key string, title string")
    got = [r.key for r in d.withColumn("o", tickets.key_order(F.col("key"))).where("o is not null").orderBy("o", "key").collect()]
    good = [k for k in keys if k and re.fullmatch(r"\d+(\.\d+)*", k)]
    assert got == sorted(good, key=lambda k: ([int(x) for x in k.split(".")], k))
    ordered = tickets.in_key_order(d.where(tickets.key_order(F.col("key")).isNotNull()), 3)
    assert [r.key.lstrip("0") for r in ordered.collect()] == [k.lstrip("0") for k in got]


def ticket_rows(spark, rows_):
    return spark.createDataFrame(rows_, "key string, title string, status string, blockers array<string>, n_changes long, paths array<string>, areas array<string>")


def test_board_and_status(spark):
    t = ticket_rows(spark, [("1.1", "a", "Complete", [], 0, [], []), ("1.2", "b", "Ready", ["1.1"], 0, [], []), ("1.3", "c", "Proposed", ["1.2", "9.9", "1.4", "1.1"], 0, [], []), ("1.4", "d", "Cancelled", ["1.2"], 0, [], []), ("1.5", "e", "In Progress", [], 0, [], []), ("1.6", "f", "Ready", ["1.7", "1.5", "1.2"], 0, [], []), ("1.7", None, "Ready", [], 0, [], []), ("1.8", "h", tickets.UNREAD, [], 0, [], [])])
    got = {r.key: r for r in tickets.board(t).collect()}
    assert [k for k in sorted(got) if got[k].eligible] == ["1.2", "1.7"]
    assert got["1.3"].reason == "blocker 9.9 does not exist; blocker 1.4 is Cancelled — a planning question" and got["1.3"].waiting == ["1.2"] and got["1.3"].missing == ["9.9"]
    assert got["1.6"].reason == "blocked by 1.7, 1.5, 1.2" and got["1.4"].reason == "cancelled" and got["1.4"].waiting == []
    assert tickets.board(t.where("false")).count() == 0
    trees = spark.createDataFrame([("1.2", "b2", "w2", "working", None), ("1.4", "b4", "w4", "review", "g"), ("1.7", "b7", "w7", None, None), ("no", "b", "w", None, None)], "key string, branch string, worktree string, state string, gate string")
    branches = spark.createDataFrame([("1.2", "x", None), ("1.3", "b3", "/e")], "key string, branch string, elsewhere string")
    refs = spark.createDataFrame([("1.3",), ("5.5",), ("5.5",)], "key string")
    claims = tickets.merge_claims(trees, branches, refs)
    assert rows(claims.select("key", "source", "orphan")) == [("1.2", "worktree", False), ("1.3", "branch", True), ("1.4", "worktree", False), ("1.7", "worktree", False), ("5.5", "ref", True)]
    live = spark.createDataFrame([("1.7",), ("1.7",)], "key string")
    view = {r.key: (r.lifecycle, r.state, r.place) for r in tickets.status_view(t, claims, live).collect()}
    assert view == {"1.1": ("Complete", "integrated", "—"), "1.2": ("Ready", "stale", "b2 @ w2"), "1.3": ("Proposed", "stale", "b3 @ /e (elsewhere)"), "1.4": ("Cancelled", "stale", "b4 @ w4"), "1.5": ("In Progress", "working", "no claim"), "1.6": ("Ready", "blocked", "—"), "1.7": ("Ready", "working", "b7 @ w7"), "1.8": (tickets.UNREAD, "blocked", "—"), "5.5": ("—", "stale", "claim ref only")}


def inside(a, b):
    return not re.search(r"\.[a-z0-9]+$", a, re.I) and b.startswith(a + "/")


def test_overlaps_and_safety(spark):
    r = random.Random(5)
    pool = ["a", "a/b", "a/b/c.x", "a/b/d.x", "e/f.y", "e", "e/f.y/g", "h.z", "a.q/b", "k/l/m/n"]
    named = {f"{i // 7}.{i % 7}": sorted(set(r.sample(pool, r.randrange(0, 4)))) for i in range(30)}
    t = ticket_rows(spark, [(k, "t", "Ready", [], 0, [], v) for k, v in named.items()])
    pairs = rows(tickets.path_overlaps(t.select("key", F.explode("areas").alias("path"))))
    count = {p: sum(p in v for v in named.values()) for p in pool}
    want = [(p, p, "equal", count[p], count[p]) for p in pool if count[p] > 1] + [(a, b, "contains", count[a], count[b]) for a in pool for b in pool if count[a] and count[b] and inside(a, b)]
    assert pairs == sorted(want)
    order = lambda k: [int(x) for x in k.split(".")]
    flight = r.sample(sorted(named), 6)
    got = {x.key: (x.safety, x.reason) for x in tickets.parallel_safety(t, t.where(F.col("key").isin(flight)).select("key", "areas")).collect()}
    for k, mine in named.items():
        others = sorted((o for o in flight if o != k), key=order)
        want = ("isolated", "the ticket names no Relevant area" if not mine else "no Relevant area overlaps an in-flight ticket")
        soft = [(o, p, m) for o in others for p in named[o] for m in mine if m == p or inside(m, p) or inside(p, m)]
        hard = [(o, p, m) for o, p, m in soft if m == p and re.search(r"\.[a-z0-9]+$", p, re.I)]
        if hard:
            want = ("serialize", f"names {hard[0][2]}, which {hard[0][0]} also names")
        elif soft:
            want = ("shared-surface", f"{soft[0][2]} overlaps {soft[0][1]} in {soft[0][0]}")
        assert got[k] == want, k
    alone = tickets.parallel_safety(t, t.where("false").select("key", "areas")).collect()
    assert {x.reason for x in alone} == {"no other ticket is in flight"}


@pytest.mark.parametrize("seed", [1, 2])
def test_independent(spark, seed):
    r = random.Random(seed)
    own = {f"{i}": [f"p{r.randrange(40)}" for _ in range(r.randrange(0, 4))] for i in range(120)}
    d = spark.createDataFrame([(k, int(k), p) for k, ps in own.items() for p in ps or [None]], "key string, rank long, path string")
    taken, want = set(), []
    for k in sorted(own, key=int):
        if not taken & set(own[k]):
            want.append(k)
            taken |= set(own[k])
    assert sorted(x.key for x in tickets.first_independent(d).collect()) == sorted(want)
    assert tickets.first_independent(d.where("false")).count() == 0


# --- graphs ---


def closure(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    reach = {}
    for a in {x for e in edges for x in e}:
        seen, stack = set(), list(out.get(a, ()))
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack += out.get(x, ())
        reach[a] = seen
    return reach


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_and_layers(spark, seed):
    r = random.Random(seed)
    n = 40
    edges = [(r.randrange(n), r.randrange(n)) for _ in range(r.choice([30, 45]))] + [(0, 1), (1, 0), (2, 2), (3, 4), (4, 5), (5, 3), (5, 0)]
    e = spark.createDataFrame([*edges, (None, 1), (1, None), edges[0]], "src long, dst long")
    reach = closure(edges)
    want = {a: min({a} | {b for b in reach[a] if a in reach.get(b, ())}) for a in reach if a in reach[a]}
    assert dict(rows(graphs.strong_components(e))) == want
    nodes = spark.createDataFrame([(i,) for i in range(n)], "node long")
    keep = {(a, b) for a, b in edges if not (a >= b and a in want and want.get(a) == want.get(b))}
    layer = dict.fromkeys(range(n), 0)
    for _ in range(n):
        for a, b in keep:
            layer[b] = max(layer[b], layer[a] + 1)
    assert dict(rows(graphs.layers(nodes, e))) == layer
    start = spark.createDataFrame([(0,), (0,), (None,)], "node long")
    assert {x for (x,) in rows(graphs.reach(start, e))} == reach[0] | {0}


def test_nodes_between_cycles_have_no_component(spark):
    # 1 and 2 lead from one cycle to another, and no lesser node reaches 1
    between = spark.createDataFrame([(5, 6), (6, 5), (6, 1), (1, 2), (2, 8), (8, 7), (7, 8), (6, 9), (9, 9), (9, 8)], "src long, dst long")
    assert dict(rows(graphs.strong_components(between))) == {5: 5, 6: 5, 7: 7, 8: 7, 9: 9}


def test_deep_and_empty_graphs(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in range(21)], "node long")
    assert rows(graphs.layers(nodes, chain)) == [(i, i) for i in range(21)]
    assert graphs.reach(nodes.limit(1), chain).count() == 21
    none = chain.where("false")
    assert graphs.strong_components(none).count() == 0 and rows(graphs.layers(nodes, none)) == [(i, 0) for i in range(21)]


def test_modules(spark):
    m = spark.createDataFrame([(1, 1, "a", []), (1, 2, "b", ["a", "zz"]), (1, 3, "c", ["zz"]), (1, 4, "d", ["c"]), (1, 5, "e", ["e", "a"]), (2, 6, "a", ["b"]), (2, 7, "b", ["a"]), (2, 8, "c", ["nn"]), (3, 9, "a", None), (3, 10, None, ["a", None])], "lesson int, module_no long, id string, requires array<string>")
    got = sorted(map(str, ((x.lesson, x.module_no, x.item, x.code, x.reference) for x in graphs.module_findings(m).collect())))
    want = [(1, 2, 1, "unresolved_reference", "zz"), (1, 3, 0, "unresolved_reference", "zz"), (1, 5, 0, "graph_cycle", "e"), (1, 3, None, "orphan_module", None), (1, 4, None, "orphan_module", None), (2, None, None, "graph_cycle", None), (2, 8, 0, "unresolved_reference", "nn"), (3, 10, 1, "unresolved_reference", None)]
    assert got == sorted(map(str, want))


# --- evidence ---


def test_evidence(spark):
    files = spark.createDataFrame([("c", "p", 10), ("c", "p", 10), ("d", "q", 3)], "commit string, path string, n_lines long")
    cites = spark.createDataFrame([(1, "c", "p", 1, 10), (2, "c", "p", 1, 11), (3, "c", "q", 1, 1), (4, "x", "p", 1, 1), (5, "c", "p", 3, 2), (6, "c", "p", None, None), (7, None, "p", 1, 1)], "citation_no long, commit string, path string, first_line long, last_line long")
    assert rows(evidence.check_citations(cites, files)) == [(1, None), (2, "evidence_range_invalid"), (3, "evidence_path_absent"), (4, "source_commit_unavailable"), (5, "evidence_range_invalid"), (6, None), (7, "source_commit_unavailable")]
    r = random.Random(2)
    a = [(i, "p" if i % 3 else "q", x, x + r.randrange(300)) for i in range(60) for x in [r.randrange(900)]]
    b = [("p" if i % 2 else "q", x, x + r.randrange(300)) for i in range(60) for x in [r.randrange(900)]]
    got = rows(evidence.cited_passages(spark.createDataFrame(a, "citation_no long, path string, first_line long, last_line long"), spark.createDataFrame(b, "path string, start_line long, end_line long")))
    assert got == sorted((n, p, s, e, min(l, e) - max(f, s) + 1) for n, p, f, l in a for q, s, e in b if p == q and f <= e and s <= l)


# --- schema ---


def plain(value, s, path, out, root):
    def kind(x):
        return "null" if x is None else "boolean" if isinstance(x, bool) else "string" if isinstance(x, str) else "array" if isinstance(x, list) else "object" if isinstance(x, dict) else "integer" if x == int(x) else "number"

    def add(p, k, name=None):
        out.append((p or "(root)", k, name))

    same = lambda x, y: kind(x) == kind(y) and x == y
    while "$ref" in s:
        s = root["$defs"][s["$ref"].rsplit("/", 1)[1]]
    if "oneOf" in s:
        branches = [root["$defs"][b["$ref"].rsplit("/", 1)[1]] for b in s["oneOf"]]
        if kind(value) != "object":
            return add(path, "oneOf")
        for b in branches:
            if same(value.get("type"), b["properties"]["type"]["const"]):
                return plain(value, b, path, out, root)
        return add(f"{path}.type", "oneOf", "type")
    if "const" in s and not same(value, s["const"]):
        return add(path, "const")
    if "enum" in s and not any(same(value, x) for x in s["enum"]):
        return add(path, "enum")
    t = kind(value)
    if "type" in s and t != s["type"] and not (s["type"] == "number" and t == "integer"):
        return add(path, "type")
    if t == "string":
        for k, bad in (("minLength", len(value) < s.get("minLength", 0)), ("maxLength", len(value) > s.get("maxLength", 1 << 40)), ("pattern", not re.search(s.get("pattern", ""), value))):
            if bad:
                add(path, k)
    if t in ("integer", "number"):
        for k, bad in (("minimum", value < s.get("minimum", value)), ("maximum", value > s.get("maximum", value))):
            if bad:
                add(path, k)
    if t == "array":
        for k, bad in (("minItems", len(value) < s.get("minItems", 0)), ("maxItems", len(value) > s.get("maxItems", 1 << 40))):
            if bad:
                add(path, k)
        if s.get("uniqueItems"):
            for i, x in enumerate(value):
                if any(same(x, y) for y in value[:i]):
                    add(f"{path}[{i}]", "uniqueItems")
        for i, x in enumerate(value if "items" in s else []):
            plain(x, s["items"], f"{path}[{i}]", out, root)
    if t == "object":
        below = lambda k: f"{path}.{k}" if path else k
        for k in s.get("required", []):
            if k not in value:
                add(below(k), "required", k)
        if s.get("additionalProperties") is False:
            for k in sorted(set(value) - set(s["properties"])):
                add(below(k), "additionalProperties", k)
        for k, own in s.get("properties", {}).items():
            if k in value:
                plain(value[k], own, below(k), out, root)
    if "if" in s:
        probe = []
        plain(value, s["if"], path, probe, root)
        if not probe:
            plain(value, s["then"], path, out, root)


def test_schema(spark):
    import json

    r = random.Random(4)
    some = [None, True, 0, 3, 12, 12.0, 2.5, 400, "", "ab", "Abc", "Abcdefghijklmn", "en", "note", [], ["aaa", "aaa"], ["aaa", 1, 1.5, None], {}, {"type": "text"}, {"type": "text", "text": "x" * 1001}, {"type": "list", "items": [1, 1000, "a", 2.5], "more": 1}, {"type": "other"}, {"type": 3}]
    names = [*NOTE_SCHEMA["properties"], "odd", "b c"]
    docs = [{k: r.choice(some) for k in names if r.random() < 0.7} for _ in range(250)] + [[], 3, "x", None, {"kind": "note", "id": 10, "title": "Abc", "tags": ["abc", "abd"], "body": {"type": "text", "text": ""}}]
    d = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(docs)], "i int, value string")
    got = {x.i: [(f.path, f.keyword, f.property) for f in x.f] for x in d.select("i", schema.schema_findings(F.col("value"), NOTE_SCHEMA).alias("f")).collect()}
    for i, x in enumerate(docs):
        want: list = []
        plain(x, NOTE_SCHEMA, "", want, NOTE_SCHEMA)
        assert got[i] == want, x
    bad = spark.createDataFrame([(None,), ("{",), ("",)], "value string").select(schema.schema_findings(F.col("value"), NOTE_SCHEMA)[0]["keyword"])
    assert rows(bad) == [("json",)] * 3
    with pytest.raises(ValueError):
        schema.schema_findings(F.col("value"), {"anyOf": []})
    with pytest.raises(ValueError):
        schema.schema_findings(F.col("value"), {"$ref": "#/$defs/a", "$defs": {"a": {"properties": {"b": {"$ref": "#/$defs/a"}}}}})


# --- width ---


def test_width(spark):
    r = random.Random(6)
    points = [chr(c) for c in (*range(32, 0x3000), *range(0x3000, 0x11000, 7), *range(0x1F000, 0x20000, 3), *range(0xE0000, 0xE0200)) if not 0xD800 <= c < 0xE000]
    texts = ["", "plain", "漢字", "é", "\xad", "a\nb", "x" * 100_000 + "漢"] + ["".join(r.choices(points, k=40)) for _ in range(200)]
    plain_width = lambda t: sum(0 if unicodedata.category(c) in ("Mn", "Me", "Cf") else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in t)
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string")
    got = dict(rows(d.select("i", cell_width(F.col("t")))))
    assert got.pop(-1) is None and got == {i: plain_width(t) for i, t in enumerate(texts)}
