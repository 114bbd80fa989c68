import datetime
import math
import os

import pytest
from pyspark.sql import functions as F

from quillmill.functions import colour
from quillmill.operators import capture, evaluate, init, links, manifest, search, spans, validate
from quillmill.sources import frontmatter as M
from quillmill.sources.generated import generate_corpus
from quillmill.sources.starter import starter_table


def notes(spark, texts):
    rows = [(p, p.split("/")[-1][:-3], t, i) for i, (p, t) in enumerate(texts.items())]
    return M.read_documents(spark.createDataFrame(rows, "path string, name string, text string, walk_no long"))


def asked(spark, *wordings):
    return spark.createDataFrame([(1, i, w) for i, w in enumerate(wordings)], "query_id int, wording_no int, wording string")


VAULT = {
    "a/lease.md": "---\ntitle: Lease renewal\ntags: [contract]\n---\n# Terms\n\nThe tenant renews yearly.\n\n## Fees\n\nFees rise with inflation.\n",
    "b/plain.md": "Tenants and owners talk about fees and fees again.\n",
    "c/copy1.md": "Same words here.\n",
    "c/copy2.md": "SAME words, here!\n",
    "d/broken.md": "---\nx: [\n---\nInflation text.\n",
}


def test_search_ranks_fuses_and_dedups(spark):
    p = spans.split_spans(notes(spark, VAULT)).cache()
    got = search.search(p, asked(spark, "fees", "inflation fees", "   ")).orderBy("rank").collect()
    assert [(r.path, r.anchor) for r in got][0] == ("a/lease.md", "Fees")
    assert got[0].score == pytest.approx(1 / 62 + 1 / 61) or got[0].score == pytest.approx(2 / 61)
    same = search.search(p, asked(spark, "same words")).collect()
    assert [r.path for r in same] == ["c/copy1.md"]
    assert search.search(p, asked(spark, "zebra the")).count() == 0
    text = search.text_results(search.search(p, asked(spark, "yearly")), "/v/").first().block
    assert text.startswith("a/lease.md#Terms:7-7  score 0.0164\n/v/a/lease.md\n    The tenant")
    payload = search.json_results(search.search(p, asked(spark, "owners")), asked(spark, "owners", "zebra")).first().payload
    assert '"query" : "owners | zebra"' in payload and '"anchor" : null' in payload
    with pytest.raises(ValueError):
        search.top(same, 0)


def test_bm25_arithmetic(spark):
    p = spans.split_spans(notes(spark, {"x.md": "alpha beta beta\n", "y.md": "alpha gamma\n"}))
    got = {r.path: r.score for r in search.scores(search.build_index(p), asked(spark, "beta beta"), 0.0).collect()}
    idf = math.log(1 + (2 - 1 + 0.5) / 1.5)
    assert got == {"x.md": pytest.approx(2 * idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / 2.5)))}


def test_partitions_do_not_matter(spark):
    p = spans.split_spans(notes(spark, VAULT))
    q = asked(spark, "fees tenant", "words inflation")
    key = lambda d: sorted((r.rank, r.path, r.start_line, round(r.score, 9)) for r in search.search(d, q).collect())
    assert key(p.repartition(1)) == key(p.repartition(8))


def graph(spark):
    texts = {
        "n/One.md": "---\nid: a\nderived_from: [b, ' ', gone]\nabout: ['[[Two#x|y]]', nobody, Alias]\n---\n# First\n",
        "n/Two.md": "---\nid: b\naliases: [Alias]\n---\n# Shared\n",
        "n/Three.md": "---\nid: b\nderived_from: b\nabout: Shared\naliases: [Alias]\n---\n# Shared\n",
        "n/Four.md": "---\nid: ' '\nkind: [x]\nderived_from: a\n---\n",
        "n/Bad.md": "---\n- x\n---\n",
    }
    return notes(spark, texts)


def test_links_and_findings(spark):
    d = graph(spark).cache()
    assert [(r.written, r.n) for r in links.duplicate_ids(d).collect()] == [("b", 2)]
    assert [(r.doc_no, r.derived) for r in links.backlinks(d).collect()] == [(0, [3])]
    got = {(r.path[2:-3], r.code, r.field) for r in validate.findings(d).collect()}
    assert got == {
        ("One", "derived-from-blank", "derived_from"), ("One", "derived-from-unresolved", "derived_from"), ("One", "about-unresolved", "about"), ("One", "about-ambiguous", "about"),
        ("Two", "duplicate-id", "id"), ("Three", "duplicate-id", "id"), ("Three", "derived-from-self", "derived_from"), ("Three", "about-ambiguous", "about"),
        ("Four", "id-blank", "id"), ("Four", "field-not-text", "kind"), ("Bad", "frontmatter-unreadable", None),
    }
    counts = validate.severity_counts(validate.findings(d)).first()
    assert (counts.error, counts.warning, counts.info) == (6, 2, 3)
    found = links.find_sources(d, spark.createDataFrame([("b",), ("zz",)], "source_id string"))
    assert {r.source_id: r.path for r in found.collect()} == {"b": "n/Three.md", "zz": None}


def test_manifest(spark):
    h = "0" * 64
    entries = spark.createDataFrame([(0, "b.md", h), (1, "a.md", h)], "entry_no int, path string, sha256 string")
    built = manifest.build_manifest(entries)
    assert [tuple(r) for r in manifest.manifest_rows(entries).collect()] == [(True, None, "a.md", h), (True, None, "b.md", h)]
    refused = entries.unionByName(spark.createDataFrame([(3, "/c", h), (2, "a.md", h), (4, "", h)], entries.schema))
    assert [tuple(r) for r in manifest.manifest_rows(refused).collect()] == [(False, "path-duplicated", "a.md", None)] and manifest.manifest_rows(entries.where("false")).count() == 0
    text = manifest.manifest_json(built, "1.0", "2024-01-01").first().text
    cases = [text, "{", "[]", '{"manifestVersion": 2}', '{"manifestVersion": 1, "createdAt": "x", "files": []}', '{"manifestVersion": 1, "toolkitVersion": 3, "createdAt": "x", "files": []}', '{"manifestVersion": 1, "toolkitVersion": "1", "createdAt": "x", "files": [{"path": 1, "sha256": "a"}]}', text.replace("a.md", "b.md"), text.replace("a.md", "../a"), text.replace(h, "zz", 1)]
    got = manifest.parse_manifest(spark.createDataFrame(list(enumerate(cases)), "i int, text string")).orderBy("i").collect()
    assert [r.code for r in got] == [None, "not-json", "not-an-object", "version-unsupported", "field-missing", "field-malformed", "field-malformed", "path-duplicated", "path-escapes-brain", "hash-malformed"]
    assert [f.path for f in got[0].files] == ["a.md", "b.md"]
    seen = spark.createDataFrame([("a.md", "1" * 64), ("c.md", h)], "path string, sha256 string")
    assert {r.path: r.state for r in manifest.drift(entries, seen).collect()} == {"a.md": "modified", "b.md": "missing"}
    assert {r.path: r.sha256 for r in manifest.merge_manifest(entries, seen).collect()} == {"a.md": "1" * 64, "b.md": h, "c.md": h}


def test_capture(spark, tmp_path):
    at = datetime.datetime(2024, 5, 6, 7, 8, 9)
    items = ["A thought, kept", "https://example.com/page", "https://example.com/page/", "ftp://x.y/z", "A thought, kept", "word"]
    d = spark.createDataFrame([(i, x, at) for i, x in enumerate(items)], "item_no int, item string, at timestamp")
    held, taken = spark.createDataFrame([], "source_id string"), spark.createDataFrame([("inbox", "20240506-070809-word")], "folder string, name string")
    plan = capture.plan_captures(d, held, taken).orderBy("item_no").collect()
    assert [r.action for r in plan] == ["write", "write", "duplicate", "refuse", "write", "write"]
    assert [r.name for r in plan] == ["20240506-070809-a-thought-kept", "url-3641c5f2274c", None, None, "20240506-070809-a-thought-kept-2", "20240506-070809-word-2"]
    assert plan[1].content == '---\nid: url-3641c5f2274c\ncreated: 2024-05-06T07:08:09+00:00\nurl: "https://example.com/page"\n---\n\nhttps://example.com/page\n'
    written = capture.commit_captures(capture.plan_captures(d, held, taken), str(tmp_path))
    assert len(written) == 4 and (tmp_path / written[0]).exists()
    # names that were taken since the plan give way to the next ones; an inbox file's id moves with its name
    again = capture.commit_captures(capture.plan_captures(d, held, taken), str(tmp_path))
    assert again == ["inbox/20240506-070809-a-thought-kept-3.md", "sources/url-3641c5f2274c-2.md", "inbox/20240506-070809-a-thought-kept-4.md", "inbox/20240506-070809-word-3.md"]
    assert "id: 20240506-070809-word-3\n" in (tmp_path / again[3]).read_text() and "id: url-3641c5f2274c\n" in (tmp_path / again[1]).read_text()
    (tmp_path / "out").mkdir()
    os.symlink(tmp_path, tmp_path / "out" / "inbox")
    with pytest.raises(FileExistsError):
        capture.commit_captures(capture.plan_captures(d.where("item_no = 0"), held, taken), str(tmp_path / "out"))


def test_many_captures_of_one_moment(spark):
    at = datetime.datetime(2024, 5, 6, 7, 8, 9)
    d = spark.createDataFrame([(i, ["same", "same", "", " "][i % 4], at) for i in range(240)], "item_no int, item string, at timestamp")
    taken = spark.createDataFrame([("inbox", "20240506-070809-same-7"), ("inbox", "20240506-070809-same-x")], "folder string, name string")
    plan = capture.plan_captures(d, spark.createDataFrame([], "source_id string"), taken).collect()
    names = [r.name for r in plan if r.action == "write"]
    assert len(names) == len(set(names)) and "20240506-070809-same-7" not in names
    assert sum(r.item_no % 4 < 2 and r.action == "refuse" for r in plan) == 120 - 99


def test_contrast_and_sections(spark):
    pairs = [("#000000", "#ffffff", "21.00"), ("#FFFFFF", "#ffffff", "1.00"), ("#777777", "#ffffff", "4.47"), ("#12345", "#ffffff", None), (None, "#ffffff", None)]
    d = spark.createDataFrame(pairs, "a string, b string, want string")
    ratio = colour.contrast(F.col("a"), F.col("b"))
    assert all(r.got == r.want for r in d.select("want", F.when(ratio.isNotNull(), colour.shown(ratio)).alias("got")).collect())
    texts = ["no\n## A b!\n\nx\n```\n## in\n```\n## C\n## \n##D\n## É", "", None, "```\n## never closed", "## A\n" + "line\n" * 20_000]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string")
    got = {r.i: [(s.heading, s.slug, s.body) for s in r.s] for r in t.select("i", spans.page_sections(F.col("t")).alias("s")).collect()}
    assert got[0] == [("A b!", "a-b", "x\n```\n## in\n```"), ("C", "c", "## \n##D"), ("É", "", "")] and got[1] == got[2] == got[3] == []
    assert len(got[4][0][2]) == 5 * 20_000 - 1


def test_stream(spark, tmp_path):
    from quillmill.streaming import captures

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"item_no": 1, "item": "https://e.com/a", "at": "2024-01-01T00:00:00Z"}\n{"item_no": 2, "item": "https://e.com/a#x", "at": "2024-01-01T00:00:01Z"}\n{"item_no": 3, "item": "two words", "at": "2024-01-01T00:00:02Z"}\n')
    q = captures.store_captures(captures.distinct_captures(captures.read_items(spark, str(tmp_path / "in"))).select("item_no", "item", "at"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert sorted(r.kind for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["source", "text"]


def test_init_is_additive(spark, tmp_path):
    none, own = spark.createDataFrame([("README.md", False)], "path string, outside boolean"), spark.createDataFrame([], "path string, sha256 string")
    plan = init.plan_init(starter_table(spark), none, own)
    written = init.commit_init(plan, str(tmp_path), "1", datetime.datetime(2024, 1, 1))
    assert "README.md" not in written and len(written) == 6
    held = spark.createDataFrame([(p, init.observe(spark, str(tmp_path), [p]).first().sha256) for p in written], "path string, sha256 string")
    (tmp_path / written[0]).write_text("changed")
    (tmp_path / written[1]).unlink()
    states = {r.path: r.state for r in init.drift_report(held, init.observe(spark, str(tmp_path), written)).collect()}
    assert states[written[0]] == "modified" and states[written[1]] == "missing" and list(states.values()).count("unchanged") == 4


def test_generated_corpus_and_cost(spark):
    a, b = (sorted(r.text for r in generate_corpus(spark, 30, 7).collect()) for _ in range(2))
    assert a == b
    d = M.read_documents(generate_corpus(spark, 60, 7))
    p = spans.split_spans(d).cache()
    word = p.first().text.split()[0]
    cost = evaluate.context_cost(search.search(p, asked(spark, word)), d.select("path", F.octet_length("text").alias("bytes"))).first()
    assert cost.results >= 1 and cost.whole_note_bytes >= cost.text_bytes


def test_relevance_finds_every_item_that_a_text_holds(spark, tmp_path):
    from quillmill.plans import queries

    texts = ["one two three four five", "xone two threex", "", None, "two  three four", "a b one\ttwo three four fivesome", "one two three four five"]
    items = ["two three four", "e two three f", "one", "ne two three four fi", "two three four five", "three  four", "wo th", "zebra", None, "one\ttwo three fo", ""]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = {(i, f"s/{d}.md") for i, x in enumerate(items) for d, t in enumerate(texts) if x is not None and t is not None and x in t}
    got = [tuple(r) for r in queries.relevance(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_plans_of_urls_and_captures_stay_small(spark):
    from quillmill.functions import urls as U

    d = spark.createDataFrame([("https://a.example/x?b=2&a=1", 1)], "item string, item_no int").withColumn("at", F.current_timestamp())
    size = lambda x: len(x._jdf.queryExecution().executedPlan().toString())
    assert size(d.select(U.normalize_url(F.col("item")).alias("u")).select("u.*")) < 50_000
    plan = capture.plan_captures(d, spark.createDataFrame([], "source_id string"), spark.createDataFrame([], "folder string, name string"))
    assert size(plan) < 50_000
    none = spark.createDataFrame([(None,)], "item string").select(U.normalize_url(F.col("item")).alias("u")).select("u.url", "u.code").first()
    assert tuple(none) == (None, None)


def test_best_shuffles_no_score_of_a_passage(spark, monkeypatch):
    from pyspark.sql.pandas.types import to_arrow_schema

    from quillmill.operators import scoring

    n, limit = 2000, 3
    # every passage shares words with every wording, and many passages are copies of one another
    words = F.concat(F.lit("common "), F.repeat(F.lit("often "), (F.col("id") % 4).cast("int")), F.lit("w"), (F.col("id") * 7 % 25).cast("string"))
    none = F.array().cast("array<string>")
    p = spark.range(0, n, 1, 4).select(F.format_string("p/%d.md", n - F.col("id")).alias("path"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), words.alias("text"), F.lit(None).cast("string").alias("anchor"), F.concat(F.lit("note w"), (F.col("id") % 30).cast("string")).alias("title"), none.alias("trail"), none.alias("tags"), none.alias("aliases"), none.alias("about"), none.alias("folder"))
    q = spark.createDataFrame([(i // 2, i % 2, f"common often w{i} w{i + 3} w{i} note") for i in range(20)] + [(99, 0, "zebra"), (99, 1, " ")], "query_id long, wording_no int, wording string")
    index = search.build_index(p).stored()
    sc = spark.sparkContext

    def sent():
        jvm = sc._jvm
        none = lambda: jvm.java.util.ArrayList()
        stages = sc._jsc.sc().statusStore().stageList(none(), False, False, sc._gateway.new_array(jvm.double, 0), none())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    key = lambda r: (r["query_id"], r["wording_no"], r["path"], round(r["score"], 7))
    for weight in (search.METADATA_WEIGHT, 0.0):
        want = {(*key(r), r.rank) for r in search.rank(search.scores(index, q, weight), limit).collect()}
        before = sent()
        got = {(*key(r), r.rank) for r in search.best(index, q, limit, weight).collect()}
        assert got == want and len(want) == 20 * limit
        assert sent() - before < n * 20 / 4
    # many small blocks in one task keep the same
    monkeypatch.setattr(scoring, "CELLS", 50)
    found = search.best(index, q, limit, 0.0)
    schema = to_arrow_schema(found.select("query_id", "wording_no", "score", *search.KEY).schema)
    fields = {"body": 1.0, "meta": 0.0}
    look = scoring.prepared(search.query_terms(q).toArrow(), index.term_counts().select("field", "term", "df").join(search.query_terms(q).select("term").distinct(), "term", "left_semi").select("field", "term", "df").toArrow(), {r.field: (r.n, r.average) for r in index.stats.collect()}, fields)
    batches = index.passages.select(*search.KEY, *fields, *[f"{f}_length" for f in fields]).toArrow().to_batches(max_chunksize=300)
    rows = [r for b in scoring.best_in_task(look, limit, search.DECIMALS, schema)(iter(batches)) for r in b.to_pylist()]
    assert {key(r) for r in rows} == {x[:-1] for x in want} and len(rows) == len(want)
