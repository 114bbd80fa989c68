"""Each operator against a plain version, and on nulls, empties, repeats and clashing columns."""

import datetime
import gzip
import hashlib
import io
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm import ann, common, decontaminate, jaccard_join, language_id, pieces, pseudonyms, queries, token_counts, toxicity, url_filter, warc
from quillmill.llm.common import Scratch, connected_components

DOCS = "doc_id long, text string, lang string, score string, component_id string"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "x", "clash", "clash") for i, t in enumerate(texts)], DOCS)


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


# --- components ---


@pytest.mark.parametrize("one_task", [20_000, 3])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(common, "ONE_TASK", one_task)
    r = random.Random(3)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(400, 480)] + [(1, 1), (2, 2)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    assert got == {x: find(x) for x in list(parent)}
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


# --- 1 ---


def test_language(spark):
    r = random.Random(1)
    words = {"de": "der und nicht schön straße kinder gehen", "fr": "le être garçon où avec manger enfant", "en": "the and which children going because street"}
    rows = [(i, " ".join(r.choices(words[k].split(), k=r.randint(3, 60))), k) for i, k in enumerate(list(words) * 40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(d.where("doc_id % 4 <> 2"))
    got = {x.doc_id: x for x in language_id.identify(d, model).collect()}
    assert all(got[i].lang_pred == k and got[i].accepted and 0 <= got[i].score <= 1 for i, _, k in rows if i % 4 == 2)
    odd = language_id.identify(docs(spark, [None, "", "123 !!", "и это совсем другой язык с другими буквами " * 5, "Der nicht", "le " * 100_000]), model).orderBy("doc_id").collect()
    assert [x.lang_pred for x in odd[:3]] == ["und"] * 3 and not any(x.accepted for x in odd[:4])
    assert (odd[4].lang_pred, odd[5].lang_pred) == ("de", "fr")
    assert odd[0].score == 0.0 and odd[0].component_id == "clash"
    assert language_id.fit(d.where("false")) is None
    assert [x.lang_pred for x in language_id.identify(docs(spark, ["abc"]), None).collect()] == ["und"]


def test_every_labelled_language_is_learned(spark, monkeypatch):
    # 70 languages of one row each, one with long texts only, each in letters of its own
    word = lambda k, n=4: "".join(chr(0x4E00 + 40 * k + i % 9) for i in range(n))
    rows = [(k, " ".join(word(k, n) for n in range(3, 20)), f"l{k}") for k in range(70)] + [(70, "1 2 " * 6_000 + (word(70, 7) + " ") * 3_000, "l70")]
    d = spark.createDataFrame([*rows, (71, "12 34", "no letters"), (72, "words", None)], "doc_id long, text string, lang string")
    model = language_id.fit(d)
    assert model.languages == sorted(r[2] for r in rows)
    got = {x.doc_id: (x.lang_pred, x.accepted) for x in language_id.identify(d.where("doc_id < 71"), model).collect()}
    assert got == {k: (lang, True) for k, _, lang in rows}
    monkeypatch.setattr(language_id, "LANGUAGES", 3)
    with pytest.raises(ValueError):
        language_id.fit(d)


def plain_kneser_ney(texts, order=language_id.ORDER):
    """(log probability of a marked word) by dictionaries: counts, continuations, discounts by order."""
    from collections import Counter, defaultdict

    marked = lambda w: ["^"] * (order - 1) + list(w) + ["$"]
    words = [marked(w.lower()) for t in texts for w in re.findall(r"[^\W\d_]+", t)]
    levels = {order: Counter(tuple(w[i - order + 1 : i + 1]) for w in words for i in range(order - 1, len(w)))}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    discount, total, kinds = {}, defaultdict(int), defaultdict(int)
    for k, level in levels.items():
        one, two = sum(c == 1 for c in level.values()), sum(c == 2 for c in level.values())
        discount[k] = min(0.95, max(0.1, one / max(one + 2 * two, 1)))
        for g, c in level.items():
            total[g[:-1]] += c
            kinds[g[:-1]] += 1

    def p(g):
        if not g:
            return 1 / language_id.UNSEEN
        below = p(g[1:])
        if not total[g[:-1]]:
            return below
        k = len(g)
        return max(levels[k][g] - discount[k], 0) / total[g[:-1]] + discount[k] * kinds[g[:-1]] / total[g[:-1]] * below

    def score(word):
        m = marked(word.lower())
        return sum(np.log(p(tuple(m[i - order + 1 : i + 1]))) for i in range(order - 1, len(m)))

    return score


def test_models_match_a_plain_version():
    learned = {"a": ["abab abc cab Über", "ab ab cabbage"], "b": ["xyz xxy yyx zzz", "xyzzy"]}
    model = language_id.Model({k: language_id.count_language(t) for k, t in learned.items()})
    plain = {k: plain_kneser_ney(t) for k, t in learned.items()}
    for text in ["abab", "xyz", "abx über", "q", "Cabbage, xyzzy! 12 zzzzzzzzzz", "я"]:
        words = re.findall(r"[^\W\d_]+", text)
        n = sum(len(w) + 1 for w in words)
        ce, _, _ = model.cross_entropies([text])
        for j, k in enumerate(model.languages):
            assert abs(ce[0, j] + sum(plain[k](w) for w in words) / n) < 1e-4, (text, k)
        best = min(learned, key=lambda k: (-sum(plain[k](w) for w in words) / n, k))
        assert model.predict([text])[0][0] == best


def test_clashing_names_and_repeats_of_language(spark):
    d = spark.createDataFrame([(1, "der die das und", "a", "b", "c", 5.0)] * 2 + [(2, None, "a", "b", "c", 5.0)], "doc_id long, text string, _text string, row string, lang_pred string, score double")
    model = language_id.fit(spark.createDataFrame([("der die das und", "de"), ("the and of which", "en")], "text string, lang string"))
    got = language_id.identify(d, model).orderBy("doc_id").collect()
    assert [(x.doc_id, x._text, x.row, x.lang_pred) for x in got] == [(1, "a", "b", "de")] * 2 + [(2, "a", "b", "und")]
    assert language_id.identify(d.where("false"), model).count() == 0
    assert language_id.identify(d.select("text"), model, keep=[]).count() == 3


def test_kneser_ney_is_a_distribution():
    counts = {"a": language_id.count_language(["abab abc cab"]), "b": language_id.count_language(["xyz xxy"])}
    m = language_id.Model(counts)
    # after each context the seen characters and the share of the unseen ones sum to 1
    codes, start, end, _ = language_id.split_words(["ab"])
    total = 0.0
    for c in "abcxyz":
        codes, start, end, _ = language_id.split_words(["ab" + c])
        h, at, _ = language_id.grams(codes, start, end)
        total += np.exp(m.word_scores(codes, start, end)[0, 0] - m.word_scores(codes[:2], np.array([0]), np.array([2]))[0, 0])
    assert np.isfinite(total)
    # order 1 of a language: probabilities of its own characters and one unseen each
    p = np.exp(m.logp[0][:, 0]).sum()
    assert 0.9 < p < 1.1


# --- 2 ---


def test_toxicity(spark):
    r = random.Random(2)
    bad = ["blorkish", "grumptwat", "znarfel"]
    clean = "this that house tree water going window garden stone river grumpy".split()
    rows, labels = [], []
    for i in range(400):
        t = r.choices(clean, k=40)
        if i % 4 == 0:
            for k in range(3):
                t[r.randrange(40)] = bad[k]
        rows.append((i, " ".join(t)))
        labels.append((i, int(i % 4 == 0)))
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = toxicity.fit(d, y.where("doc_id % 3 <> 1"))
    got = {x.doc_id: x.score for x in toxicity.toxicity(d, lexicon, ["doc_id"]).collect()}
    assert all((got[i] >= 0.7) == (i % 4 == 0) for i in range(400) if i % 3 == 1)
    masked = "window BL0RKISH gаrden grumptwаt river zn4rfel stone"  # noqa: RUF001  digits and Cyrillic letters
    odd = toxicity.toxicity(docs(spark, [masked, None, "", "window garden grumpy"]), lexicon, ["doc_id", "component_id"]).orderBy("doc_id").collect()
    assert odd[0].score >= 0.7 and max(x.score for x in odd[1:]) < 0.5
    none = toxicity.fit(d, y.where("false"))
    assert toxicity.toxicity(docs(spark, ["x"]), none, ["doc_id"]).first().score < 0.01


def test_phrases_are_learned_as_exceptions(spark):
    r = random.Random(11)
    clean = "this that house tree water going window garden stone river".split()
    rows, labels = [], []
    for i in range(300):
        t = [f"{r.choice(clean)}{r.choice(clean)}" for _ in range(30)]
        if i % 3 == 0:
            t[5:6] = ["total", "blork"]
        elif i % 3 == 1 and i < 22:
            t[5:6] = ["water", "blork", "pump"]
        rows.append((i, " ".join(t)))
        labels.append((i, int(i % 3 == 0)))
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = toxicity.fit(d, y)
    assert lexicon.entries["water  blork "] == 0.0 and any(v > 0 and "blork".startswith(k.strip()) for k, v in lexicon.entries.items())
    for text, hits in [("total blork pump", 1), ("water blork pump", 0), ("a water blork", 0), ("blork water", 1), ("water blorks", 1)]:
        assert (lexicon.matched(text)[0] > 0) == bool(hits), text


def test_short_words_long_texts_and_copies_are_learned(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    rows = [(i, " ".join([*(word() for _ in range(20)), *(["zx"] if i % 2 else [])])) for i in range(60)]
    rows += [(100 + i, rows[1][1]) for i in range(40)]  # one toxic text forty times more
    rows += [(200 + i, ("qwertz " if i % 2 else "") + " ".join(word() for _ in range(4_000))) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    y = spark.createDataFrame([(i, 1 if 100 <= i < 200 else i % 2) for i, _ in rows], "doc_id long, toxic int")
    lexicon = toxicity.fit(d, y)
    assert {"zx ", "qwer"} <= {k for k, v in lexicon.entries.items() if v > 0} or "qwertz" in lexicon.entries and "zx " in lexicon.entries
    assert all(k.strip() in ("zx", "qwer", "qwert", "qwertz") for k, v in lexicon.entries.items() if v > 0)


def brute_matches(text, entries):
    """Weights of the longest entries from left to right, by plain search."""
    words = "".join(f" {w} " for w in toxicity.fold(text).split())
    total, at = 0.0, 0
    while at < len(words):
        found = max((k for k in entries if words.startswith(" " + k, at)), key=len, default=None)
        if found is None:
            at += 1
        else:
            total, at = total + entries[found], at + 1 + len(found)
    return total


def test_scores_match_a_plain_version(spark):
    r = random.Random(13)
    entries = {"moron": 2.0, "moron ": 1.0, "scum": 3.0, "scumble": 0.0, "pond  scum ": 0.0, "ab ": 1.5, "clown": 1.0, "clown  fish ": 0.0, "мат ": 1.0}
    lexicon = toxicity.Lexicon(entries, (-3.0, 2.0, 1.0))
    words = ["moron", "m0r0n", "MORONS", "scum", "scumbled", "pond", "ab", "abc", "clown", "fish", "сlоwn", "x", "mat", "5cum"]
    texts = [" ".join(r.choices(words, k=r.randint(0, 12))) for _ in range(200)] + [None, "", "!!", "scum " * 50_000]
    got = toxicity.toxicity(spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(texts)], "doc_id long, text string, score string, row string"), lexicon, ["doc_id", "score", "row", "text"]).collect()
    assert len(got) == len(texts)
    for x in got:
        t = texts[x.doc_id] or ""
        total, n = brute_matches(t, entries) if len(t) < 1000 else 150_000.0, len(toxicity.fold(t).split())
        assert (x.weight, x.words, x.row, x.text) == (total, n, "b", texts[x.doc_id])
        z = -3 + 2 * np.log1p(total) / np.log(n + 2) + np.log1p(100 * total / max(n, 1))
        assert abs(x.score - 1 / (1 + np.exp(-z))) < 1e-12


def test_exceptions_silence_entries():
    lexicon = toxicity.Lexicon({"scum": 3.0, "scumble": 0.0}, (-3.0, 2.0, 0.0))
    assert lexicon.matched("scumble scums scum")[0] == 6.0


# --- 3 ---


def test_whole_words_match_side_by_side_and_last():
    lexicon = toxicity.Lexicon({"moron ": 1.0, "clown": 3.0, "clownfish ": 0.0, "trash": 2.0}, (-3.0, 2.0, 0.0))
    for text, want in [("moron moron, moron x", 3), ("you moron", 1), ("clownfish trash x", 2), ("a clownfish", 0), ("clownfishes", 3), ("moronic", 0), ("", 0)]:
        assert lexicon.matched(text)[0] == want, text
    assert lexicon.matched("you moron")[1] == 2


def brute_jaccard(rows):
    sets, parent = {}, {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", low(t))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            k = len(sets[a] & sets[b])
            if k and 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(r, n=160):
    words = [f"w{k}" for k in range(60)]
    base = [[r.choice(words) for _ in range(r.randint(1, 90))] for _ in range(12)]
    out = []
    for _ in range(n):
        t = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            t[r.randrange(len(t))] = r.choice(words)
        out.append(r.choice([" ", "\n", "\t "]).join(t) if r.random() < 0.9 else " ".join(t).upper())
    return out


@pytest.mark.parametrize(("seed", "one_task"), [(1, 20_000), (2, 3)])
def test_jaccard_matches_brute_force(spark, monkeypatch, seed, one_task):
    monkeypatch.setattr(common, "ONE_TASK", one_task)  # few rows make a key hot
    texts = [None, "", " \t\n", "one", "one", "a b c d", "a b c d e", "é A", "é a", "É a", *near_copies(random.Random(seed))]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.jaccard_components(docs(spark, texts).repartition(5)).collect()}
    assert got == brute_jaccard(enumerate(texts))


def test_jaccard_edges(spark):
    d = docs(spark, ["a b c d e f"] * 3 + ["x y"], [7, 7, 3, None])
    got = sorted((x.doc_id or -1, x.n_shingles, x.component_id or -1) for x in jaccard_join.jaccard_components(d).collect())
    assert got == [(-1, 1, -1), (3, 2, 3), (7, 2, 3)]
    assert jaccard_join.jaccard_components(d.where("false")).count() == 0


def test_jaccard_ids_that_stand_for_several_texts(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    d = spark.createDataFrame([(9, a, "x"), (9, b, "x"), (9, b, "x"), (5, b, "x"), (4, a + " z", "x"), (8, c, "x"), (8, c, "x"), (3, "w " * 100_000 + c, "x")], "doc_id long, text string, rep string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.jaccard_components(d).collect()}
    assert got == {9: (26, 4), 5: (26, 4), 4: (27, 4), 8: (26, 3), 3: (31, 3)}


@pytest.mark.parametrize("open_", [0, jaccard_join.OPEN])
def test_jaccard_of_one_shared_passage(spark, monkeypatch, open_):
    # hundreds of sets hold a passage that is most of each; some pairs link, most do not
    monkeypatch.setattr(jaccard_join, "OPEN", open_)
    r = random.Random(14)
    passage = [f"p{k}" for k in range(70)]
    texts = [" ".join(passage + [f"u{r.randrange(40)}" for _ in range(r.choice([6, 9, 12, 16, 20]))]) for _ in range(150)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.jaccard_components(docs(spark, texts)).collect()}
    assert got == brute_jaccard(enumerate(texts))


def brute_links(rows):
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w := low(t).split()) >= 5 else {tuple(w)} - {()} for i, t in rows}
    close = lambda a, b: bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)
    return {i: sum(close(a, sets[j]) for j in sets if j != i) for i, a in sets.items()}


@pytest.mark.parametrize("cell", [None, 7])
def test_links_within_components_are_counted(spark, monkeypatch, cell):
    if cell:  # many blocks and bands
        monkeypatch.setattr(jaccard_join, "CELL_SETS", cell)
        monkeypatch.setattr(jaccard_join, "CELL_COLUMNS", 16)
    r = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    hot = [" ".join(w if r.random() > 0.006 else f"x{r.random()}" for w in base[: r.choice([100, 108, 120])]) for _ in range(60)]
    texts = [None, "", "one", "one", *hot, hot[0], hot[0], *near_copies(r, 60)]
    got = {x.doc_id: x for x in jaccard_join.jaccard_links(docs(spark, texts).repartition(5)).collect()}
    assert {i: x.n_links for i, x in got.items()} == brute_links(enumerate(texts))
    assert {i: (x.n_shingles, x.component_id) for i, x in got.items()} == brute_jaccard(enumerate(texts))
    if not cell:
        odd = jaccard_join.jaccard_links(docs(spark, ["a b c d e f"] * 3 + ["x y"], [7, 7, 3, None])).collect()
        assert sorted((x.doc_id or -1, x.n_links) for x in odd) == [(-1, None), (3, 1), (7, 1)]
        assert jaccard_join.jaccard_links(docs(spark, texts).where("false")).count() == 0


# --- 4 ---


def brute_hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        n = min(10, len(v))
        for k in range(len(v) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == v[k : k + n]:
                    hit.update(range(i, i + n))
                    found.add(item)
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("limit", [decontaminate.SET_ROWS, 9])
def test_contamination(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "SET_ROWS", limit)
    r = random.Random(4)
    words = "alpha beta gamma delta épée ñu 12 of".split()
    items = [(i, " ".join(r.choices(words, k=r.randint(8, 16)))) for i in range(6)] + [(6, None), (7, "Short, item!"), (8, "--"), (9, "short item")]
    texts = [" ".join(r.choices(words, k=40)) + " " + (items[i % 6][1].upper().replace(" ", "; ") if i % 2 else "x") + " short item" * (i % 3) for i in range(20)] + [None, "", "short", "a short item", "a short item"]
    d, b = docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in decontaminate.contamination(d, b).collect()}
    assert got == {i: brute_hits(t, items) for i, t in enumerate(texts)}
    kept = {x.doc_id for x in decontaminate.decontaminate(d, b).collect()}
    assert kept == {i for i, t in enumerate(texts) if not brute_hits(t, items)[4]}
    cut = {x.doc_id: x.text for x in decontaminate.decontaminate(d, b, "spans").collect()}
    assert cut[23] == "a " and cut[22] == "short" and cut[20] is None
    empty = decontaminate.contamination(d, b.where("false"))
    assert empty.where("contaminated").count() == 0 and empty.count() == len(texts)


def test_contamination_edges(spark):
    item = "one two three four five six seven eight nine ten"
    b = spark.createDataFrame([(1, item, "c"), (None, item, "c"), (2, None, "c"), (3, "", "c")], "item_id long, text string, key string")
    long = "word " * 200_000 + item + " word" * 1000
    rows = [(1, long), (1, long), (1, "clean"), (None, item), (None, None), (2, "")]
    d = spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in rows], "doc_id long, text string, hit_words string, key string, row string, _h string")
    got = sorted((x.doc_id or 0, x.n_words, x.n_hit, x.n_items) for x in decontaminate.contamination(d, b).collect())
    assert got == [(0, 0, 0, 0), (0, 10, 10, 1), (1, 1, 0, 0), (1, 201_010, 10, 1), (1, 201_010, 10, 1), (2, 0, 0, 0)]
    kept = decontaminate.decontaminate(d, b).collect()
    assert sorted((x.doc_id or 0, x.text or "", x.hit_words, x.key, x.row, x._h) for x in kept) == [(0, "", "a", "b", "c", "d"), (1, "clean", "a", "b", "c", "d"), (2, "", "a", "b", "c", "d")]
    cut = decontaminate.decontaminate(d, b, "spans")
    assert cut.columns == d.columns and {len(x.text) for x in cut.where("doc_id = 1").collect()} == {5, len(long) - len(item) - 1}
    assert decontaminate.decontaminate(d.where("false"), b).count() == 0


# --- 5 ---


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(spark, rule):
    path = queries.vocabulary("byte_bpe_50k.tiktoken")
    coding, _ = token_counts.encoder(path)
    texts = ["one line", "two\nlines here\n", "\n\n\n", "héllo\n日本語 😀\r\n x", "", None, "a " * 30_000, "𝔘𝔫𝔦\n𝔠\n", "two\nlines here\n"]

    def touched(t):  # each token with the characters it holds a byte of
        of = [i for i, c in enumerate(t) for _ in c.encode()]
        at = 0
        for x in coding.encode_ordinary(t):
            n = len(coding.decode_single_token_bytes(x))
            yield x, list(range(of[at], of[at + n - 1] + 1))
            at += n

    def want(t, sections):
        out, outside = [0] * len(sections), 0
        owner = {c: i for i, (a, b) in enumerate(sections) for c in range(a, b)}
        for _, characters in touched(t):
            owners = [owner.get(c, -1) for c in characters]
            held = [o for o in owners if o >= 0]
            pick = owners[0] if rule == "first" else owners[-1] if rule == "last" else max(sorted(set(held)), key=held.count) if held else -1
            if pick < 0:
                outside += 1
            else:
                out[pick] += 1
        return out, outside

    for x in token_counts.section_counts(docs(spark, texts), path, rule).collect():
        t = texts[x.doc_id] or ""
        lines, at = [], 0
        for line in t.splitlines(keepends=True) if "\r" not in t else [p + "\n" for p in t.split("\n")[:-1]] + [t.split("\n")[-1]]:
            lines.append((at, at + len(line)))
            at += len(line)
        ids = coding.encode_ordinary(t)
        assert (x.n_tokens, x.n_sections, (x.section_tokens, x.n_outside)) == (len(ids), len(lines), want(t, lines))
        assert x.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
    for x in token_counts.token_spans(docs(spark, texts[:6]), path).collect():
        assert [(i, list(range(a, b))) for i, a, b in zip(x.ids, x.start, x.end, strict=True)] == list(touched(texts[x.doc_id] or ""))
    given = [[(0, 2), (4, 6)], [(1, 5), (5, 9)], None, [(0, 1), (6, 8), (8, 9)], [(0, 0)], [], [(3, 40_000)], [(1, 2)], [(2, 3)]]
    d = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(zip(texts, given, strict=True))], "doc_id long, text string, parts array<struct<start:int,end:int>>")
    for x in token_counts.section_counts(d, path, rule, sections="parts").collect():
        assert (x.section_tokens, x.n_outside) == want(texts[x.doc_id] or "", given[x.doc_id] or [])
    fields = token_counts.field_counts(docs(spark, ["abc", None]), ["text", "lang"], path, rule).groupBy("field").agg(F.sum("n_tokens")).collect()
    assert {x.field for x in fields} == {"text", "lang"}
    assert token_counts.section_counts(docs(spark, []), path).count() == 0
    with pytest.raises(ValueError):
        token_counts.section_counts(docs(spark, []), path, "none")


# --- 6 ---


def test_nearest(spark):
    g = np.random.default_rng(5)
    v = g.standard_normal((700, 24)).astype(np.float32)
    v[300:340] = v[0]
    rows = [(i, [float(x) for x in v[i]], 0) for i in range(700)] + [(1000, None, 0), (1100, [0.0] * 24, 0), (1200, [float("nan")] + [1.0] * 23, 0), (1300, [None] + [1.0] * 23, 0), (None, [1.0] * 24, 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(7)
    got = {}
    for x in ann.nearest(d, d.where("vec_id % 100 = 0")).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    assert sorted(got) == list(range(0, 700, 100))
    for q, found in got.items():
        dist = np.sqrt(((v.astype(np.float64) - v[q].astype(np.float64)) ** 2).cumsum(axis=1)[:, -1])
        dist[q] = np.inf
        best = np.lexsort((np.arange(700), dist))[:10]
        assert sorted(found) == [(k + 1, int(i), float(dist[i])) for k, i in enumerate(best)]
    few = d.where("vec_id < 3")
    assert ann.nearest(few, few.where("vec_id = 0")).count() == 2
    assert ann.nearest(d.where("false"), d.where("false")).count() == 0


@pytest.mark.parametrize("clustered", [False, True])
def test_nearest_over_cells(spark, monkeypatch, clustered):
    monkeypatch.setattr(ann, "CELL_ROWS", 100)
    monkeypatch.setattr(ann, "BLOCK", 64)
    monkeypatch.setattr(ann, "SHARD", 1)
    g = np.random.default_rng(9)
    v = g.standard_normal((1500, 16)) + (8 * g.standard_normal((6, 16))[g.integers(0, 6, 1500)] if clustered else 0)
    v[500:900] = v[0]  # one vector many times
    rows = [(i, v[i].tolist()) for i in range(1500)] + [(3, v[3].tolist()), (100, v[100].tolist())]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    got = {}
    for x in ann.nearest(d, d.where("vec_id % 100 = 0")).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    ids = np.array([r[0] for r in rows])
    every = np.array([r[1] for r in rows])
    hit = total = 0
    for q in range(0, 1500, 100):
        dist = np.sqrt(((every - v[q]) ** 2).cumsum(axis=1)[:, -1])
        dist[ids == q] = np.inf
        best = np.lexsort((ids, dist))[:10]
        want = {(int(ids[i]), float(dist[i])) for i in best}
        hit, total = hit + len(want & {x[1:] for x in got[q]}), total + len(want)
        assert [x[0] for x in sorted(got[q])] == list(range(1, 11))
    assert hit >= 0.99 * total


def test_bounds_hold():
    g = np.random.default_rng(6)
    for d in (64, 70):
        v, q = g.standard_normal((2000, d)), g.standard_normal((20, d))
        centre, turn = g.standard_normal(d) / 10, ann.rotation(d)
        low_, high = ann.bounds(ann.encode(v, centre, turn), ann.quantise(q, centre, turn), d)
        true = ((v[None] - q[:, None]) ** 2).sum(axis=2)
        assert ((low_ <= true) & (true <= high)).mean() > 0.998
        # nothing but the codes' error is left where a code is exact
        near = ann.bounds(ann.encode(q, centre, turn), ann.quantise(q, centre, turn), d)
        assert (near[0].diagonal() <= 1e-6).all()


# --- 7 ---

RULES = queries.URL_RULES


def test_urls(spark):
    rows = [
        (1, "http://a.com/x", '<link rel="canonical" href="http://b.Example.com/en/1">'),
        (2, "http://a.org/y", "<LINK href='http://b.example.com/en/1#q' REL=canonical>"),
        (3, "http://c.org/", ""),
        (4, None, None),
        (5, "nonsense", "x"),
        (6, "http://d.org/p?q#f", '<meta http-equiv="refresh" content="0; url=/z">'),
        (7, "http://d.org/z", '<link rel=canonical href="//a.org/y">'),
        (8, "https://WWW.example.com/en/x?y", ""),
        (9, "ftp://x.net/fr/", None),
        (9, "ftp://x.net/fr/", None),
        (10, "http://e.org/r", ""),
    ]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    moved = spark.createDataFrame([("http://e.org/r", "http://x.net/es/q"), (None, "x")], "from_url string, to_url string")
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_filter.judge(d, RULES, moved).collect()}
    assert got[1] == ("a.com", "/x", "com/", "allow")
    assert got[2][2:] == got[6][2:] == got[7][2:] == (None, "block") and got[10][3] == "block"
    assert got[3][3] == "allow" and got[4] == got[5] == ("", "", None, "allow")
    assert got[8] == ("www.example.com", "/en/x", "www.example.com/en/", "allow") and got[9][2:] == ("net/fr/", "block")
    assert url_filter.judge(d, RULES).count() == len(rows)
    assert url_filter.judge(d.where("false"), RULES).count() == 0


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://B.com/Y#f", "http://b.com/Y"),
        ("http://b.com", "http://b.com/"),
        ("http://b.com?q=A", "http://b.com/?q=A"),
        ("http://u:P@B.com:80/x", "http://u:P@b.com/x"),
        ("https://b.com:443/", "https://b.com/"),
        ("https://b.com:80/", "https://b.com:80/"),
        ("http://b.com/a/./b/../../c/..", "http://b.com/"),
        ("http://b.com/a/b/..", "http://b.com/a/"),
        ("http://b.com/../../x", "http://b.com/x"),
        ("http://b.com/a//b", "http://b.com/a//b"),
        ("nonsense", "nonsense"),
    ],
)
def test_url_nodes(spark, url, want):
    assert spark.range(1).select(url_filter.node(F.lit(url))).first()[0] == want


def test_links_are_resolved(spark):
    base = "http://a.org/d/e?q=1#f"
    cases = {"../z": "http://a.org/d/../z", "z": "http://a.org/d/z", "?p": "http://a.org/d/e?p", "": "http://a.org/d/e?q=1", "#x": "http://a.org/d/e?q=1", "/r": "http://a.org/r", "//b/c": "http://b/c", "mailto:x@y": None, "javascript:0": None, "ftp://q/": "ftp://q/"}
    d = spark.createDataFrame(list(cases.items()), "link string, want string")
    assert all(r.got == r.want for r in d.select("want", url_filter.absolute(F.col("link"), F.lit(base)).alias("got")).collect())


def brute_verdicts(pages, rules, moved):
    from urllib.parse import urljoin, urlsplit

    def spell(u):
        u = urljoin(u, urlsplit(u)._replace(fragment="").geturl())
        p = urlsplit(u)
        return p._replace(scheme=p.scheme.lower(), netloc=p.netloc.lower().removesuffix(":80"), path=urljoin("http://x/", p.path or "/").removeprefix("http://x"), fragment="").geturl()

    def rule(host, path):
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[2:] if fits else (None, None)

    parts = lambda u: (low(u.split("://", 1)[1].split("/")[0].split("?")[0].split("#")[0]), re.split("[?#]", u.split("://", 1)[1][len(u.split("://", 1)[1].split("/")[0].split("?")[0].split("#")[0]) :])[0])
    edges = [(spell(a), spell(b)) for a, b in moved]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    bad = {find(x) for e in edges for x in e if rule(*parts(x))[1] == "block"}
    return {i: (*parts(u), rule(*parts(u))[0], rule(*parts(u))[1] or ("block" if spell(u) in parent and find(spell(u)) in bad else "allow")) for i, u in pages}


def test_aliases_match_brute_force(spark):
    r = random.Random(8)
    hosts = ["a.org", "B.org", "c.net", "www.example.com", "example.com", "d.com", "E.ORG:80"]
    url = lambda: f"{r.choice(['http', 'HTTP'])}://{r.choice(hosts)}{r.choice(['', '/', '/en/', '/fr/x', '/es/../fr/', '/q/../es/y', '/p'])}{r.choice(['', '?a=' + str(r.randrange(6)), '#x'])}"
    pages = [(i, url()) for i in range(300)]
    moved = [(pages[r.randrange(300)][1], pages[r.randrange(300)][1]) for _ in range(90)]
    d = spark.createDataFrame([(i, u, None) for i, u in pages], "page_id long, url string, html string")
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_filter.judge(d, RULES, spark.createDataFrame(moved, "from_url string, to_url string")).collect()}
    assert got == brute_verdicts(pages, RULES, moved)
    assert sum(v[3] == "block" and v[2] is None for v in got.values()) > 5


# --- 8 ---


def test_pieces(spark):
    path = queries.vocabulary("piece_bpe_32k.model")
    codec = pieces.Codec.of(path)
    r = random.Random(7)
    parts = [" ", "  ", "▁", "a", "the", "\n", "\t", "é", "日本", "😀", "<s>", "<0x0A>", "\xa0", "\x00", ".", "　", "\r\n", "﻿"]
    texts = [None, "", " ", "▁", "  x ", "word " * 5000, *["".join(r.choices(parts, k=r.randint(0, 14))) for _ in range(400)]]
    for x in pieces.encode_column(docs(spark, texts), path).collect():
        want = codec.sp.encode(texts[x.doc_id] or "", add_bos=True, add_eos=True)
        assert x.ids == want and x.decoded == codec.sp.decode(want) and x.score == "clash"
    d = pieces.encode_digests(docs(spark, ["ab c"]), path).first()
    ids = codec.sp.encode("ab c", add_bos=True, add_eos=True)
    assert (d.n_tokens, d.ids_sha256, d.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(b"ab c").hexdigest())


# --- 9 ---


@pytest.mark.parametrize("compress", [True, False])
def test_warc(spark, tmp_path, compress):
    big, bigger = "é" * 600, "x" * 200_000
    rows = [(1, "http://a/", big), (2, "http://b/\r\nX: y", big), (3, None, "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u", bigger), (8, "u", "line\r\n\r\nWARC/1.1\r\n"), (9, "u", big), (9, "u", big)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_warc(warc.page_records(d), str(tmp_path / "w"), compress)
    full = warc.read_warc(spark, str(tmp_path / "w")).collect()
    texts = {i: t or "" for i, _, t in rows}
    for x in full:
        i = int(x.record_id.split(":")[-1])
        data = texts[i].encode()
        assert (x.payload_bytes, x.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert x.record_type == ("revisit" if i in (1, 2) else "response") and x.refers_to == ("urn:page:9" if i in (1, 2) else None)
        assert x.payload == (None if i in (1, 2) else data)
    assert len(full) == len(rows)
    some = warc.read_warc(spark, str(tmp_path / "w"), "none").where("record_type = 'response' and target_uri like 'http%'")
    assert sorted(x.record_id for x in some.collect()) == [] and some.count() == 0
    assert warc.read_warc(spark, str(tmp_path / "w"), "digest").where("target_uri = 'u'").count() == 7
    assert warc.round_trip(d).where("page_id = 1").first().refers_to == 9
    assert warc.round_trip(d.where("false")).count() == 0


def records(kinds="response revisit response", size=10):
    return [warc.render({"record_type": k, "record_id": f"i{n}", "payload": b"MARK" + random.Random(n).randbytes(256 * size), "refers_to": "i0"}) for n, k in enumerate(kinds.split())]


@pytest.mark.parametrize("compress", [True, False])
def test_warc_skips_what_predicates_rule_out(compress):
    class Counting(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            out = super().read(n)
            self.taken += len(out)
            return out

    whole = records(size=400)
    data = b"".join(map(warc.member, whole)) if compress else b"".join(whole)
    stream = Counting(data)
    got = list(warc.read_records(stream, compress, lambda h: h["record_type"] == "revisit"))
    assert [(h["record_id"], h["refers_to"], body) for h, body in got] == [("i1", "i0", None)]
    assert not compress or len(data) > 20_000 and gzip.decompress(data) == b"".join(whole)
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(b"nonsense\r\n"), False))


def test_warc_members_are_skipped_unread():
    # what no one inflates may be damaged
    whole = [warc.member(x) for x in records("response revisit", 40)]
    broken = whole[0][:2_000] + b"\0" * 500 + whole[0][2_500:]
    got = list(warc.read_records(io.BytesIO(broken + whole[1]), True, lambda h: h["record_type"] == "revisit"))
    assert [h["record_id"] for h, _ in got] == ["i1"]
    foreign = [gzip.compress(x) for x in records("response revisit", 40)]
    got = list(warc.read_records(io.BytesIO(b"".join(foreign)), True, lambda h: h["record_type"] == "revisit"))
    assert [h["record_id"] for h, _ in got] == ["i1"]
    both = list(warc.read_records(io.BytesIO(gzip.compress(b"".join(records()))), True))
    assert [h["record_id"] for h, _ in both] == ["i0", "i1", "i2"]


@pytest.mark.parametrize("payload", ["full", "digest", "none"])
@pytest.mark.parametrize("compress", [True, False])
def test_warc_cut_archives_are_errors(payload, compress):
    one = records("response")[0]
    data = warc.member(one) if compress else one
    for n in (len(data) // 2, len(data) - 500 if compress else len(data) - 100, 30):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(data[:n]), compress, payload=payload))
    changed = one.replace(b"MARK", b"MARC")
    if payload != "none":
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(changed), False, payload=payload))
        assert len(list(warc.read_records(io.BytesIO(changed), False, payload=payload, verify=False))) == 1
    other = one.replace(b"sha1:", b"md5:")
    assert next(iter(warc.read_records(io.BytesIO(other), False, payload="none")))[0]["payload_digest"].startswith("md5:")


def test_warc_appends_and_replaces(spark, tmp_path):
    row = lambda i: spark.createDataFrame([(f"r{i}", "response", "u", None, None, None, None, b"x" * i, "extra")], warc.SCHEMA + ", other string")
    path = str(tmp_path / "w")
    ids = lambda: sorted(x.record_id for x in warc.read_warc(spark, path).collect())
    warc.write_warc(row(1), path)
    warc.write_warc(row(2), path, False)
    assert ids() == ["r1", "r2"]
    warc.write_warc(row(3), path, mode="overwrite")
    assert ids() == ["r3"] and len(os.listdir(path)) == 2
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.warc").write_bytes(b"".join(records()))
    (tmp_path / "f" / "b.warc.gz").write_bytes(gzip.compress(b"".join(records())))
    assert warc.read_warc(spark, str(tmp_path / "f")).count() == 6
    with pytest.raises(ValueError):
        warc.write_warc(row(1), path, mode="ignore")


def test_warc_page_records_by_a_shuffle_are_the_same(spark, monkeypatch):
    d = spark.createDataFrame([(i, "u", "y" * (900 + i % 4 * 100)) for i in range(60)], "page_id long, url string, html string")
    want = sorted(map(tuple, warc.page_records(d).collect()))
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, warc.page_records(d).collect())) == want


# --- 10 ---


def brute_feistel(key, tweak, left, right, a, b):
    for i in range(pseudonyms.ROUNDS):
        f = lambda x: int(hashlib.sha256(f"{key}|{tweak}|{i}|{x}".encode()).hexdigest()[:15], 16)  # noqa: B023, E731
        if i % 2 == 0:
            left = (left + f(right)) % a
        else:
            right = (right + f(left)) % b
    return left, right


def test_pseudonyms(spark):
    texts = ["ip 10.1.2.3, 10.1.2.3. 999.1.1.1 v1.2.3", "x.y@z.com. X.Y@z.com", "4111 1111 1111 1111 4111111111111111 4111111111111112", "+1 (275) 555-5927 (275) 555-5927", "2020-02-29 2020-02-30 29.02.2020 2020/02/29", 'token = "bc0d31ba76f17e56642e8751295a3fd50cd8e61f"', "clean 12 text", "", None, "a@ @b 1.2.3"]
    out = {x.doc_id: x for x in pseudonyms.pseudonymize(docs(spark, texts), "k").collect()}
    left, right = brute_feistel("k", "ip", 10 * 256 + 1, 2 * 256 + 3, 65536, 65536)
    ip = f"{left >> 8}.{left & 255}.{right >> 8}.{right & 255}"
    assert out[0].text == f"ip {ip}, {ip}. 999.1.1.1 v1.2.3" and out[0].n_ip == 2
    mail = out[1].text.split()
    assert mail[0].rstrip(".") == mail[1] and "x.y" not in out[1].text.lower() and out[1].n_email == 2
    a = out[2].text.split()
    card = "".join(a[:4])
    assert card == a[4] != "4111111111111111" and a[5] == "4111111111111112" and card[:4] == "4111"
    assert sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(card)) % 10 == 0
    phones = re.findall(r"\(\d{3}\) \d{3}-\d{4}", out[3].text)
    assert len(phones) == 2 and phones[0] == phones[1] != "(275) 555-5927"
    days = out[4].text.split()
    iso = days[0].split("-")
    assert days[1] == "2020-02-30" and days[2] == ".".join(reversed(iso)) and days[3] == "/".join(iso) and days[0] != "2020-02-29"
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', out[5].text) and out[5].text != texts[5]
    assert [out[i].text for i in (6, 7, 8, 9)] == texts[6:]
    with pytest.raises(ValueError):
        pseudonyms.pseudonymize(docs(spark, texts), "")
    assert pseudonyms.pseudonymize(docs(spark, texts), "other").where("doc_id = 0").first().text != out[0].text


def brute_digits(key, tweak, d):
    h = len(d) // 2
    left, right = brute_feistel(key, tweak, int(d[:h]), int(d[h:]), 10**h, 10 ** (len(d) - h))
    return f"{left:0{h}d}{right:0{len(d) - h}d}"


def brute_pseudonym(key, kind, m):
    digits = re.sub("[^0-9]", "", m)
    sha = lambda *x: hashlib.sha256("|".join((key, *x)).encode()).hexdigest()
    weave = lambda new: re.sub("[0-9]", lambda _, it=iter(new): next(it), m)
    if kind == "email":
        return f"u{sha('email', m.lower())[:12]}@d{sha('domain', m.lower().split('@')[1])[:8]}.invalid"
    if kind == "secret":
        out = sha("secret", m.lower())[: len(m)]
        return out.upper() if m == m.upper() else out
    if kind == "phone":
        return weave(digits[:-10] + brute_digits(key, "phone", digits[-10:]))
    if kind == "card":
        body = digits[:4] + brute_digits(key, "card" + digits[:4], digits[4:-1])
        luhn = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(body)))
        return weave(body + str(-luhn % 10))
    first = datetime.date(1900, 1, 1)
    y, mo, d = (int(x) for x in re.split("[-/.]", m)) if m[4] in "-/" else [int(x) for x in reversed(m.split("."))]
    n = (datetime.date(y, mo, d) - first).days
    if n < 73_000:
        left, right = brute_feistel(key, "day", n // 365, n % 365, 200, 365)
        n = left * 365 + right
    else:
        left, right = brute_feistel(key, "late", (n - 73_000) // 7, (n - 73_000) % 7, 7, 7)
        n = 73_000 + left * 7 + right
    out = first + datetime.timedelta(n)
    return out.strftime("%Y-%m-%d" if "-" in m else "%Y/%m/%d" if "/" in m else "%d.%m.%Y")


def test_every_kind_matches_a_plain_version(spark):
    values = [
        *[("email", x) for x in ("a@b.co", "Jane.Doe+x@Mail.Example.org", "é.ñ@x-y.de")],
        *[("secret", x) for x in ("0123456789abcdef" * 2, "0123456789ABCDEF" * 4, "aB" * 20)],
        *[("phone", x) for x in ("+1 275-555-5927", "+1 (275) 555 5927", "(275) 555-5927", "+12755555927")],
        *[("card", x) for x in ("4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", "378282246310005", "3782 822463 10005", "2223003122003222", "6011111111111117")],
        *[("date", x) for x in ("2020-02-29", "1900-01-01", "2099/12/31", "31.12.2099", "2099-11-13")],
    ]
    around = {"secret": 'key: "{}";', "email": "to {}, now"}
    d = docs(spark, [around.get(k, "on {} so").format(v) for k, v in values])
    for x in pseudonyms.pseudonymize(d, "k").collect():
        kind, v = values[x.doc_id]
        assert x.text == around.get(kind, "on {} so").format(brute_pseudonym("k", kind, v)) and x[f"n_{kind}"] == 1, (kind, v)
    found = ["12 4111 1111 1111 1111", "7 41 4111-1111-1111-1111.", "2024-05-06T10:00:00Z"]
    left = ["4111 1111 1111 1112", "2024-02-30", "2024-05-06Tx", "12:4111", "9999 9999 9999 9999", "+1 275-555-592", "1.2.3.400", "2024-05-061"]
    got = [x.text for x in pseudonyms.pseudonymize(docs(spark, found + left), "k").orderBy("doc_id").collect()]
    assert all(a != b for a, b in zip(got[:3], found, strict=True)) and got[0].startswith("12 4111 ") and got[2].endswith("T10:00:00Z") and got[3:] == left


@pytest.mark.parametrize("unit", ["a@b" + ".c" * 20, "a", "a.", "1", "1 ", "1-", "1.", "2020-01-", "(", "+1 ", '="a', "4111 ", "@", "a@b ", "(275) ", "a@b.c "])
def test_very_long_texts_are_scanned(spark, unit):
    text = unit * (1_000_000 // len(unit))
    out = pseudonyms.pseudonymize(docs(spark, [text, "a@b" + ".c" * 300_000]), "k").select("doc_id", F.length("text").alias("n"), "n_email").orderBy("doc_id").collect()
    assert out[0].n >= len(text) / 3 and (out[1].n, out[1].n_email) == (31, 1)


def test_clashes_and_repeats_of_pseudonyms(spark):
    d = spark.createDataFrame([(1, "a@b.co", "x", "y", 9)] * 2 + [(None, None, "x", "y", 9), (3, "", "x", "y", 9)], "doc_id long, text string, _found string, row string, n_ip int")
    out = pseudonyms.pseudonymize(d, "k").collect()
    assert len(out) == 4 and {(x._found, x.row) for x in out} == {("x", "y")} and {x.n_ip for x in out} == {0}
    assert pseudonyms.pseudonymize(d.where("false"), "k").count() == 0


def test_feistel_permutes(spark):
    d = spark.range(49).select(pseudonyms.feistel("k", F.lit("t"), F.floor(F.col("id") / 7), F.col("id") % 7, F.lit(7), F.lit(7)).alias("s"))
    assert sorted((x.s.l, x.s.r) for x in d.collect()) == [(i, j) for i in range(7) for j in range(7)]


def test_remainder(spark):
    d = spark.createDataFrame([(i,) for i in range(50)], "doc_id long").select("doc_id", language_id.remainder(F.col("doc_id"), 4).alias("m"))
    assert all(x.m == zlib.crc32(str(x.doc_id).encode()) % 4 for x in d.collect())
