"""Operators 11 to 13, and the links of operator 7, against plain versions."""

import hashlib
import heapq
import random
import re
import time
import zlib

import numpy as np
import pytest

from quillmill.llm import packing, prefix_trie, queries, repair, turns, url_filter
from quillmill.llm.common import Scratch

WHITE = " \t\n\x0b\x0c\r"


# --- 7 ---


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<link REL='alternate  Canonical' href=/x>", ["http://h.org/x"]),
        ("<!-- <link rel=canonical href=/no> --><link rel=canonical href='/a>b'>", []),
        ("<!-- open <link rel=canonical href=/no>", []),
        ("<link rel=canonicals href=/no><link title=\"rel=canonical href='/no'\"><link data-rel=canonical href=/no>", []),
        ('<link title="x" rel = "canonical" data-href=/no href = "/a?b=1&amp;c=2">', ["http://h.org/a?b=1&c=2"]),
        ("<base href='http://o.org/d/'><link rel=canonical href=e><META http-equiv=Refresh content='3; URL=\"f\"'>", ["http://o.org/d/e", "http://o.org/d/f"]),
        ("<link rel=canonical href=/a><link rel=canonical href=/b>", ["http://h.org/a"]),
        ("<link rel=canonical href=''>", []),
        (None, []),
    ],
)
def test_page_links(spark, html, want):
    d = spark.createDataFrame([("http://h.org/p", html)], "url string, html string")
    assert sorted(r.to_url for r in url_filter.page_links(d).collect()) == want


def test_open_tags_are_linear(spark):
    odd = ["<link " * 170_000, "<!-- canonical" * 70_000, "<link rel='canonical" * 50_000, "<meta http-equiv=refresh " * 40_000, "<link rel=" + " " * 500_000 + "canonical"]
    d = spark.createDataFrame([("http://h.org/p", x + " canonical") for x in odd], "url string, html string").coalesce(1)
    url_filter.page_links(d.limit(1)).count()
    began = time.time()
    url_filter.page_links(d).count()
    assert time.time() - began < 10


def test_percent_signs(spark):
    from pyspark.sql import functions as F

    cases = {"http://a/%7Eb%2f%zz%": "http://a/~b%2F%zz%", "http://a/%41%c3%a9": "http://a/A%C3%A9", "http://a/%": "http://a/%"}
    d = spark.createDataFrame(list(cases.items()), "u string, w string")
    assert all(r.n == r.w for r in d.select("w", url_filter.node(F.col("u")).alias("n")).collect())


# --- 11 ---


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        word = lambda x: " " if x is None else str(x)
        fate, role, text = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20, word(role), word(text)
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def plain_repair(rows):
    """Cheapest edits by uniform-cost search over every edit sequence whose roles can still be completed."""
    faults, seen = [], set()
    for _, _, role, text in rows:
        shown = text.rstrip(WHITE)
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    queue, best, found = [(0, "", 0, "", ())], None, []
    while queue:
        cost, audit, i, roles, kept = heapq.heappop(queue)
        if best is not None and cost > best:
            break
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            best = cost
            found.append((audit, kept))
        go = lambda c, letter, j, r, line: heapq.heappush(queue, (cost + c, audit + letter, j, roles + r, (*kept, line) if r else kept)) if re.fullmatch("s?(ua)*u?", roles + r) else None
        for role in ("user", "assistant"):
            go(2, "I", i, role[0], f"{role}:")
        if i < len(rows):
            go(3, "D", i + 1, "", None)
            if faults[i] in ("", "truncated"):
                more = faults[i] == "truncated"
                if rows[i][2][:1] in ("s", "u", "a"):
                    go(more, "K", i + 1, rows[i][2][0], f"{rows[i][2]}:{rows[i][3]}")
                for role in ("user", "assistant"):
                    go(2 + more, "R", i + 1, role[0], f"{role}:{rows[i][3]}")
    audit, kept = min(found)
    assert len({k for a, k in found if a == audit}) == 1
    numbers = [r[1] for r in rows if r[1] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, best, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()


def conversations(seed, n, most):
    r = random.Random(seed)
    rows = []
    for c in [None, *range(n)]:
        for t in range(r.randrange(0, most)):
            role = r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "User"]) if r.random() < 0.4 else ["user", "assistant"][t % 2]
            rows.append((c, r.choice([t, t, t, t + 1, None]), role, r.choice(["Yes.", "No!", "cut", "Why? ", " ", "", None, "é…", "a.\nb"])))
    return rows + rows[:3]


@pytest.mark.parametrize("bits", [12, 1])
def test_repair(spark, monkeypatch, tmp_path, bits):
    monkeypatch.setattr(turns, "BLOCK_BITS", bits)
    rows = conversations(bits, 60, 6)
    spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, audit string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: tuple(r)[1:] for r in queries.op11_conversation_repair(spark, str(tmp_path)).collect()}
    broken = damaged(rows)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert set(got) == {r[0] for r in rows}
    for c in got:
        own = [r for r in broken if r[0] == c]
        assert got[c] == (plain_repair(own) if own else nothing), own


def test_long_and_empty_conversations(spark, monkeypatch):
    monkeypatch.setattr(turns, "BLOCK_BITS", 4)
    long = [(1, t, ["user", "assistant"][t % 2], f"Turn {t}." if t % 50 else "") for t in range(500)] + [(1, 600, "user", "x" * 300_000 + ".")]
    d = spark.createDataFrame(long, "conv_id long, turn long, role string, text string")
    done = repair.repair(d)
    a = done.audits.first()
    assert a.blank == 10 and len(a.audit.replace("I", "")) == 501 and a.gaps == 100
    kept = sorted((r.id, r.sub, r.role, r.text) for r in done.turns.collect())
    assert [r[2] for r in kept] == ["user", "assistant"] * (len(kept) // 2) and kept[-2][3] == "x" * 300_000 + "."
    none = repair.repair(d.where("false"))
    assert none.audits.count() == 0 and none.turns.count() == 0


# --- 12 ---


def test_closest():
    r = random.Random(1)
    for _ in range(200):
        have = {r.randrange(1, 30): r.randrange(1, 4) for _ in range(5)}
        target = r.randrange(1, 80)
        sums = {0}
        for x, n in have.items():
            sums = {s + x * k for s in sums for k in range(n + 1)}
        got = packing.closest(have, target)
        assert sum(x * n for x, n in got.items()) == max(s for s in sums if s <= target) and all(n <= have[x] for x, n in got.items())


@pytest.mark.parametrize("counts", [{}, {1: 1}, {1024: 3}, {600: 1001}, {600: 1}, {513: 5000}, {x: 1 for x in range(500, 1025)}, {x: x % 37 for x in range(1, 1025)}])
def test_plans_leave_no_padding(counts):
    rows = packing.plan(counts)
    length = np.concatenate([np.full(n, x) for x, n in counts.items()] or [np.zeros(0)]).astype(np.int64)
    rank = np.concatenate([np.arange(n) for n in counts.values()] or [np.zeros(0)]).astype(np.int64)
    row, cut, got, window, offset = packing.places(rows, length, rank)
    assert (np.bincount(row, weights=got, minlength=len(length)) == length).all()
    order = np.lexsort((offset, window))
    end = 0
    for w, o, n, last in zip(window[order], offset[order], got[order], [*window[order][1:], -1][: len(window)], strict=True):
        assert o == end
        end = 0 if last != w else o + n
        assert last == w or o + n == 1024 or (o + n) & (o + n - 1) == 0
    assert len(rows) < 8000


def test_packing(spark):
    from tokenizers import Tokenizer

    texts = ["", None, "short text", "<|endoftext|> in a text", "漢字 и כ 👍🏽 mixed", "word " * 3000, "x" * 20_000, "same words here", "same words here", *[f"text {i} " * (i % 90) for i in range(150)]]
    ids = [7 if i < 3 else None if i == 3 else i for i in range(len(texts))]
    d = spark.createDataFrame([(i, t, "clash", 1) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, length string, offset int").repartition(3)
    files = queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("byte_bpe_50k.tiktoken")
    got = packing.pack(d, *files).collect()
    whole = Tokenizer.from_file(files[0])
    want = sorted((str(i), tuple(whole.encode(t or "", add_special_tokens=False).ids) + (0,)) for i, t in zip(ids, texts, strict=True))
    docs, size = {}, {}
    for r in got:
        assert len(r.ids) == 4 * r.length
        docs.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
        size.setdefault(r.sequence_id, []).append((r.offset, r.length))
    # rows of one id and size are told apart by where their pieces start
    rebuilt = []
    for (i, total), parts in docs.items():
        starts: dict[int, list] = {}
        for start, own in parts:
            starts.setdefault(start, []).append(own)
        assert sum(len(own) for _, own in parts) % total == 0
        if sum(len(own) for _, own in parts) == total:
            rebuilt.append((str(i), tuple(x for s in sorted(starts) for x in starts[s][0])))
        else:
            rebuilt += [w for w in want if w[0] == str(i) and len(w[1]) == total]
    assert sorted(rebuilt) == want
    for parts in size.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == 1024 or end & (end - 1) == 0
    assert packing.pack(d.where("false"), *files).count() == 0
    with pytest.raises(ValueError):
        packing.pack(d, *files, capacity=1000)


# --- 13 ---


def plain_trie(rows):
    own: dict[int, list] = {}
    for c, t, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", hashlib.md5(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest())):
        own.setdefault(c, []).append((role or "", text or ""))
    whole = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(own.get(c - c % 5, [])[:h] + mine[h:])
    nodes: dict[tuple, list] = {}
    for c, t in whole.items():
        for d in range(len(t) + 1):
            nodes.setdefault(t[:d], []).append(c)
    children: dict[tuple, list] = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[b] for b in below) or 1
        saved[p] = (len(nodes[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(saved[b] for b in below)
    ends = {p: ",".join(str(c) for c in sorted(c for c in nodes[p] if whole[c] == p)) for p in nodes}
    return sorted((min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else -1, len(nodes[p]), len(children.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p in nodes)


@pytest.mark.parametrize("trie_rows", [50_000, 5])
@pytest.mark.parametrize("seed", [1, 2])
def test_trie(spark, trie_rows, seed):
    r = random.Random(seed)
    rows = []
    for c in [None, *r.sample(range(120), 80), 1000]:
        for t in range(r.randrange(0, 14) if c != 1000 else 60):
            same = r.random() < 0.9
            rows.append((c, r.choice([t, t, None]) if seed == 2 else t, "user" if same else r.choice(["assistant", None]), f"é{t}" if same else r.choice(["x", "y", None, ""])))
    d = spark.createDataFrame([(*x, "clash") for x in rows], "conv_id long, turn long, role string, text string, depth string")
    scratch = Scratch(spark, "t")
    own = prefix_trie.numbered_turns(d, scratch)
    nodes = prefix_trie.trie(prefix_trie.shared_heads(own, scratch), scratch.cut(own.select("conv_id").distinct()), scratch, trie_rows)
    assert sorted(tuple(-1 if v is None else v for v in x) for x in nodes.collect()) == plain_trie(rows)


def test_trie_of_nothing(spark, tmp_path):
    d = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    d.write.parquet(str(tmp_path / "conversations.parquet"))
    assert queries.op13_prefix_trie(spark, str(tmp_path)).count() == 0
    assert queries.op11_conversation_repair(spark, str(tmp_path)).count() == 0
