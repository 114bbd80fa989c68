"""The registered queries of the retrieval operators, on corpora made of the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import colour
from ..functions import text as T
from ..functions import urls as U
from ..operators import capture, evaluate, links, manifest, search, spans, validate
from ..operators.stored import spread, stored
from ..sources import corpus, markdown
from . import boards, files


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_notes(spark, sf_dir):
    return corpus.notes_of_documents(table(spark, sf_dir, "documents"))


def doc_passages(spark, sf_dir):
    return spans.split_spans(spread(doc_notes(spark, sf_dir), "path"))


def talk_passages(spark, sf_dir):
    return spans.split_spans(corpus.notes_of_conversations(table(spark, sf_dir, "conversations")))


def wordings(spark, sf_dir):
    return corpus.wordings_of_benchmark(table(spark, sf_dir, "benchmark"))


def graph_notes(spark, sf_dir):
    """Documents with derived ids, names, provenance and links, some of them faulty."""
    i = F.col("doc_id")
    text = lambda c: c.cast("string")
    ident = lambda c: F.concat(F.lit("id-"), text(c))
    none = F.array().cast("array<string>")
    # every 17th takes the id before its own, and each derives from one of half its number
    own = F.when(i % 17 == 5, ident(i - 1)).otherwise(ident(i))
    derived = F.concat(F.array(ident(F.floor(i / 2))), F.when(i % 50 == 0, F.array(F.lit(" "))).otherwise(none), F.when(i % 37 == 0, F.array(F.concat(F.lit(" "), ident(i), F.lit(" ")))).otherwise(none), F.when(i % 29 == 0, F.array(F.lit("id-none"))).otherwise(none))
    about = F.array(F.concat(F.lit("[[notes/"), text(i * 3 % 1100), F.lit(".md#part|shown]]")), F.concat(F.lit("Title  "), text(i % 400)), F.concat(F.lit("[["), F.upper("source"), F.lit("]]")))
    return table(spark, sf_dir, "documents").select(
        i.alias("doc_no"),
        F.format_string("%s/%s.md", "source", text(i)).alias("path"),
        text(i).alias("name"),
        F.when(i % 10 != 3, own).when(i % 20 == 3, " ").alias("id"),
        F.when(i % 4 == 0, F.concat(F.lit("Title "), text(i % 300))).alias("h1"),
        F.array("source").alias("aliases"),
        derived.alias("derived_from"),
        about.alias("about"),
        F.when(i % 101 == 0, "not a mapping").alias("parse_error"),
        F.when(i % 61 == 0, F.array(F.lit("tags"), F.lit("id"))).otherwise(none).alias("duplicate_keys"),
        F.when(i % 67 == 0, F.array(F.lit("kind"))).otherwise(none).alias("unread_scalars"),
        F.when(i % 71 == 0, F.array(F.lit("tags"))).otherwise(none).alias("unread_lists"),
        F.when(i % 73 == 0, F.array(F.struct(F.lit("about").alias("field"), F.lit(1).alias("n"), F.lit(4).alias("of")))).otherwise(F.array().cast("array<struct<field:string,n:int,of:int>>")).alias("dropped"),
    )


# --- text and index ---


def tokens_per_doc(spark, sf_dir):
    d = doc_passages(spark, sf_dir).select("path", T.tokens(F.col("text")).alias("t"))
    return d.select("path", F.size("t").cast("long").alias("n_terms"), F.md5(F.array_join("t", " ")).alias("digest"))


def term_stats(spark, sf_dir):
    return search.build_index(doc_passages(spark, sf_dir)).term_counts()


def corpus_stats(spark, sf_dir):
    return search.build_index(talk_passages(spark, sf_dir)).stats.select("field", "n", F.round("average", 6).alias("average"))


def metadata_documents(spark, sf_dir):
    p = talk_passages(spark, sf_dir)
    return p.select("path", "start_line", search.metadata_text(p).alias("metadata"))


# --- ranking ---


def _ranked(passages, asked, limit, weight):
    return search.best(search.build_index(passages), asked, limit, weight)


def bm25_single(spark, sf_dir):
    out = _ranked(doc_passages(spark, sf_dir), wordings(spark, sf_dir).where("wording_no = 0"), 10, 0.0)
    return out.select("query_id", "rank", "path", F.round("score", 6).alias("score"))


def bm25_two_field(spark, sf_dir):
    """The opening turns of the conversations whose id is divisible by 100, as whole wordings, against all passages."""
    asked = table(spark, sf_dir, "conversations").where("turn = 0 and conv_id % 100 = 0 and text is not null").select(F.col("conv_id").alias("query_id"), F.lit(0).alias("wording_no"), F.concat(F.lit("user conversation "), "text").alias("wording"))
    out = _ranked(talk_passages(spark, sf_dir), asked, 10, search.METADATA_WEIGHT)
    return out.select("query_id", "rank", "path", "start_line", F.round("score", 6).alias("score"))


def rrf_fused(spark, sf_dir):
    fused = search.fuse(_ranked(doc_passages(spark, sf_dir), wordings(spark, sf_dir), search.FUSION_DEPTH, search.METADATA_WEIGHT))
    return fused.select("query_id", "path", F.round("score", 9).alias("score"))


def suppress_duplicates(spark, sf_dir):
    p = doc_passages(spark, sf_dir)
    # one list that holds every passage, best first by its path
    all_ = p.select(F.lit(0).alias("query_id"), *search.KEY, F.lit(1.0).alias("score"))
    return search.suppress_duplicates(all_, search.build_index(p)).select("path", "start_line")


def fused_search(spark, sf_dir):
    """The flagship: three wordings a question, fused, duplicates out, five results each."""
    out = search.search(doc_passages(spark, sf_dir), wordings(spark, sf_dir))
    return out.select("query_id", "rank", "path", "start_line", "end_line", F.round("score", 9).alias("score"))


def search_text_sink(spark, sf_dir):
    out = search.search(doc_passages(spark, sf_dir), wordings(spark, sf_dir), 1)
    return search.text_results(out.withColumn("score", F.round("score", 9)), "/notes/")


def search_report(spark, sf_dir):
    """What a person reads for the questions and for as many that no passage shares a word with."""
    asked = wordings(spark, sf_dir).where("wording_no = 0")
    lost = asked.select((-F.col("query_id") - 1).alias("query_id"), "wording_no", F.concat(F.lit("zzq"), F.md5("wording")).alias("wording"))
    both = asked.unionByName(lost)
    found = search.search(doc_passages(spark, sf_dir), both, 1)
    report = search.text_report(found.withColumn("score", F.lit(0.5)), both, "/notes/", True)
    return report.select("query_id", F.md5("out").alias("digest"), F.length("err").cast("long").alias("err"))


def search_json_sink(spark, sf_dir):
    asked = wordings(spark, sf_dir)
    out = search.search(doc_passages(spark, sf_dir), asked)
    j = search.json_results(out, asked, "/notes")
    v = F.parse_json("payload")
    return j.select("query_id", F.variant_get(v, "$.query", "string").alias("query"), F.variant_get(v, "$.count", "long").alias("n"), F.variant_get(v, "$.results[0].path", "string").alias("first_path"), F.contains("payload", F.lit('"anchor" : null')).alias("keeps_null"))


# --- spans ---


def sections(spark, sf_dir):
    return talk_passages(spark, sf_dir).select("path", "anchor", "start_line", "end_line", F.md5("text").alias("digest"))


def heading_trail(spark, sf_dir):
    return talk_passages(spark, sf_dir).select("path", "start_line", F.array_join("trail", " > ").alias("trail"), "title", F.array_join("folder", "/").alias("folder"))


def spans_divided(spark, sf_dir):
    notes = doc_notes(spark, sf_dir)
    body = F.replace("body", F.lit("\n"), F.lit("\n\n"))
    return spans.split_spans(notes.withColumn("body", body)).select("path", "start_line", "end_line", F.md5("text").alias("digest"))


def span_addresses(spark, sf_dir):
    p = talk_passages(spark, sf_dir)
    return p.select(T.address(F.col("path"), F.col("anchor"), F.col("start_line"), F.col("end_line")).alias("address"))


def first_h1(spark, sf_dir):
    d = corpus.notes_of_conversations(table(spark, sf_dir, "conversations"))
    return d.select("path", spans.first_h1(F.col("body")).alias("h1"))


# --- urls ---


def _page_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url")


def url_identity(spark, sf_dir):
    d = _page_urls(spark, sf_dir).withColumn("u", U.normalize_url(F.col("url")))
    return d.select("page_id", F.col("u.url").alias("norm_url"), F.col("u.rule").alias("rule"), U.source_id(F.col("u")).alias("source_id"))


def url_groups(spark, sf_dir):
    cut = _page_urls(spark, sf_dir).select(F.regexp_replace("url", r"[?#].*$", "").alias("url"))
    both = cut.unionByName(_page_urls(spark, sf_dir).select("url"))
    return evaluate.url_groups(both).select("norm_url", F.size("variants").cast("long").alias("n_variants"), "n")


def url_youtube(spark, sf_dir):
    key = F.substring(F.md5(F.col("page_id").cast("string")), 1, 11)
    forms = [F.concat(F.lit("https://www.youtube.com/watch?t=5&v="), key), F.concat(F.lit("http://youtu.be/"), key, F.lit("?si=x")), F.concat(F.lit("https://m.youtube.com/shorts/"), key), F.concat(F.lit("HTTPS://Music.YouTube.com/embed/"), key, F.lit("/")), F.concat(F.lit("https://www.youtube.com/channel/"), key)]
    d = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.array(*forms)).alias("form", "url")).withColumn("u", U.normalize_url(F.col("url")))
    return d.select("page_id", "form", F.col("u.rule").alias("rule"), F.col("u.key").alias("key"), U.source_id(F.col("u")).alias("source_id"))


def redact_urls(spark, sf_dir):
    raw = F.replace("url", F.lit("://"), F.lit("://user:secret@"))
    return _page_urls(spark, sf_dir).select("page_id", T.redact(F.concat(raw, F.when(F.col("page_id") % 3 == 0, F.repeat(F.lit("/x"), 40)).otherwise(""))).alias("shown"))


def source_dedup(spark, sf_dir):
    """Pages whose source is not held: every third page's source is."""
    d = url_identity(spark, sf_dir)
    held = d.where("page_id % 3 = 0").select("source_id").distinct()
    return d.join(held, "source_id", "left_anti").select("page_id", "source_id")


def source_lookup(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").select(F.concat(F.lit("id-"), (F.col("doc_id") % 1000).cast("string")).alias("source_id")).distinct()
    return links.find_sources(graph_notes(spark, sf_dir), ids)


# --- links and validation ---


def link_parse(spark, sf_dir):
    d = graph_notes(spark, sf_dir).select("doc_no", F.posexplode("about").alias("item", "link")).withColumn("t", links.link_target(F.col("link")))
    return d.select("doc_no", "item", "t.*")


def resolve_names(spark, sf_dir):
    d = graph_notes(spark, sf_dir)
    return links.resolve_names(d.select("doc_no", F.posexplode("about").alias("item", "link")), d).drop("link")


def resolve_ids(spark, sf_dir):
    d = graph_notes(spark, sf_dir)
    return links.resolve_ids(links.edges_of(d), d).select("doc_no", "item_no", "target")


def duplicate_ids(spark, sf_dir):
    return links.duplicate_ids(graph_notes(spark, sf_dir))


def backlinks(spark, sf_dir):
    return links.backlinks(graph_notes(spark, sf_dir)).select("doc_no", F.array_join("derived", ",").alias("derived"))


def findings(spark, sf_dir):
    return validate.findings(graph_notes(spark, sf_dir)).select("path", "field", "code", "severity", "reason", "phase", "rule", "item")


def findings_by_severity(spark, sf_dir):
    return validate.severity_counts(validate.findings(graph_notes(spark, sf_dir)))


def edge_survival(spark, sf_dir):
    d = graph_notes(spark, sf_dir)
    edges = d.select(F.get("derived_from", F.lit(0)).alias("target_id"), F.get("about", F.lit(0)).alias("link"))
    renamed = d.where("doc_no % 5 = 0").select("doc_no", F.concat(F.lit("renamed-"), "name").alias("new_name"))
    return evaluate.edge_survival(d, edges, renamed)


# --- manifests ---


def _hashed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry_no"), F.format_string("%s/%s.md", "source", F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"))


def manifest_build(spark, sf_dir):
    return manifest.manifest_rows(_hashed(spark, sf_dir))


def manifest_refusals(spark, sf_dir):
    i = F.col("entry_no")
    path = F.when(i % 11 == 0, "").when(i % 11 == 1, F.concat(F.lit("/"), "path")).when(i % 11 == 2, F.concat(F.lit("../"), "path")).when(i % 11 == 3, F.concat(F.lit("./"), "path")).when(i % 11 == 4, F.concat("path", F.lit(" "))).when(i % 11 == 5, F.concat(F.lit("C:"), "path")).when(i % 11 == 6, F.lit("same.md")).otherwise(F.col("path"))
    sha = F.when(i % 11 == 7, F.upper("sha256")).otherwise(F.col("sha256"))
    return manifest.entry_refusals(_hashed(spark, sf_dir).select("entry_no", path.alias("path"), sha.alias("sha256"))).select("entry_no", "path", "code")


def _observed(spark, sf_dir):
    d = _hashed(spark, sf_dir)
    return d.where("entry_no % 9 <> 4").select("path", F.when(F.col("entry_no") % 9 == 2, F.sha2("path", 256)).when(F.col("entry_no") % 9 != 5, F.col("sha256")).alias("sha256"))


def manifest_drift(spark, sf_dir):
    return manifest.drift(_hashed(spark, sf_dir).where("entry_no % 10 <> 0"), _observed(spark, sf_dir))


def manifest_owned(spark, sf_dir):
    d = _hashed(spark, sf_dir)
    return manifest.owned(_observed(spark, sf_dir).select("path"), d.where("entry_no % 10 <> 0"))


def manifest_merge(spark, sf_dir):
    d = _hashed(spark, sf_dir)
    return manifest.merge_manifest(d.where("entry_no % 3 <> 0").select("path", "sha256"), d.where("entry_no % 2 = 0").select("path", F.sha2("path", 256).alias("sha256")))


def manifest_update(spark, sf_dir):
    d = _hashed(spark, sf_dir)
    return manifest.classify_update(d.where("entry_no % 10 <> 0"), _observed(spark, sf_dir), d.select("path", "sha256"))


# --- capture and walk ---


def _items(spark, sf_dir):
    at = F.make_timestamp(F.lit(2024), F.lit(5), F.lit(6), F.lit(7), F.lit(8), F.lit(9))
    a = table(spark, sf_dir, "benchmark").select((F.col("item_id") * 2).alias("item_no"), F.col("text").alias("item"))
    b = table(spark, sf_dir, "pages").select((F.col("page_id") * 2 + 1).alias("item_no"), F.when(F.col("page_id") % 17 == 0, F.replace("url", F.lit("http"), F.lit("ftp"))).when(F.col("page_id") % 13 == 0, "same-words").otherwise(F.regexp_replace("url", "#.*$", "")).alias("item"))
    return a.unionByName(b).withColumn("at", at)


def capture_plan(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    held = pages.where("page_id % 5 = 0").select(U.source_id(U.normalize_url(F.col("url"))).alias("source_id"))
    taken = spark.range(1).select(F.lit("inbox").alias("folder"), F.explode(F.array(F.lit("20240506-070809-same-words"), F.lit("20240506-070809-same-words-3"))).alias("name"))
    plan = capture.plan_captures(_items(spark, sf_dir), held, taken)
    return plan.select("item_no", "action", "kind", "folder", "name", "id", F.md5("content").alias("digest"))


def slugs(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.slug(F.col("text"), 48).alias("slug"))


def yaml_scalars(spark, sf_dir):
    i = F.col("doc_id")
    c = F.when(i % 6 == 0, i.cast("string")).when(i % 6 == 1, F.concat("source", F.lit("'s"))).when(i % 6 == 2, "yes").when(i % 6 == 3, F.concat("source", F.lit("/x.y"))).when(i % 6 == 4, F.concat(i.cast("string"), F.lit("e5"))).otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", T.yaml_scalar(c).alias("scalar"), T.yaml_quoted(F.concat(c, F.lit('\t"\\'))).alias("quoted"))


def walk_order(spark, sf_dir):
    paths = doc_notes(spark, sf_dir).select("path")
    return markdown.in_walk_order(paths).select("path", "walk_no")


def scan_budget(spark, sf_dir):
    paths = doc_notes(spark, sf_dir).select("path")
    kept = markdown.within_budget(paths, 300)
    return kept.agg(F.count("*").alias("n"), F.max("path").alias("most"), (F.count("*") >= 300).alias("exhausted"))


# --- evaluation ---


#: Items that are looked for one by one in a row at a time, and anchors that are broadcast.
SHORT_BLOCK = 500
BROADCAST_ANCHORS = 500_000


def _relevant(spark, sf_dir):
    """Documents that hold a benchmark item verbatim.

    An item's inner words stand in a document as whole words, so up to three of them are its anchor, and
    documents meet items by the anchors' equi join before the text is searched. Items without an inner
    word are looked for in every text, in blocks of the stated set.
    """
    d, b = table(spark, sf_dir, "documents").where("text is not null"), table(spark, sf_dir, "benchmark").where("text is not null")
    words = lambda c: F.split(c, r"\s+")
    gram = lambda w, i, n: F.xxhash64(F.lit(n), *[F.get(w, i + k) for k in range(n)])
    items = b.select(F.col("item_id").alias("query_id"), F.col("text").alias("wanted"), words(F.col("text")).alias("w")).withColumn("n", F.least(F.size("w") - 2, F.lit(3)))
    long = items.where("n > 0").select("query_id", "n", F.coalesce(*[F.when(F.col("n") == n, gram(F.col("w"), F.lit(1), n)) for n in (1, 2, 3)]).alias("gram"))
    few = lambda x: F.broadcast(x) if x.count() <= BROADCAST_ANCHORS else x
    sizes = [r.n for r in long.select("n").distinct().collect()]
    every = lambda w, n: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), lambda i: gram(w, i, n))
    path = F.format_string("%s/%s.md", "source", F.col("doc_id").cast("string")).alias("path")
    hits = [spark.createDataFrame([], "query_id long, path string")]
    if sizes:
        # only ids and hashes meet; texts are searched for the pairs that met
        grams = T.let(words(F.col("text")), lambda w: F.array_distinct(F.concat(*[every(w, n) for n in sizes])))
        met = spread(d.select("doc_id", "text"), "doc_id").select("doc_id", F.explode(grams).alias("gram")).join(few(long.select("query_id", "gram")), "gram")
        met = stored(met.select(F.col("doc_id").alias("met_id"), "query_id").distinct(), "met")
        pairs = few(met.join(items.select("query_id", "wanted"), "query_id"))
        hits.append(d.join(pairs, F.col("doc_id").eqNullSafe(F.col("met_id"))).where(F.contains("text", "wanted")).select("query_id", path))
    short = items.where("n <= 0").select("query_id", "wanted")
    # blocks of a bounded number of items, each one row that is broadcast
    blocks = short.withColumn("block", F.floor((F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64("query_id"), F.lit(64))).orderBy("query_id")) - 1) / SHORT_BLOCK))
    for r in blocks.select("block").distinct().orderBy("block").toLocalIterator():
        found = [F.struct(F.lit(x.query_id).alias("query_id"), F.lit(x.wanted).alias("wanted")) for x in blocks.where(F.col("block") == r.block).collect()]
        hits.append(d.select("doc_id", "source", F.explode(F.filter(F.array(*found), lambda x: F.contains(F.col("text"), x["wanted"]))).alias("x")).select("x.query_id", path))
    return reduce(DataFrame.unionByName, hits).distinct()


def relevance(spark, sf_dir):
    return _relevant(spark, sf_dir)


def retrieval_quality(spark, sf_dir):
    p, asked = doc_passages(spark, sf_dir), wordings(spark, sf_dir)
    index = search.build_index(p).stored()
    ranked = stored(search.best(index, asked, search.FUSION_DEPTH), "ranked")
    most = search.FUSION_DEPTH * asked.count()
    single = search.results(ranked.where("wording_no = 2"), index, most=most)
    fused = search.results(ranked, index, most=most)
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd").alias("kind"))
    return evaluate.retrieval_quality(questions, single, fused, _relevant(spark, sf_dir))


def context_cost(spark, sf_dir):
    out = search.search(doc_passages(spark, sf_dir), wordings(spark, sf_dir))
    sizes = doc_notes(spark, sf_dir).select("path", F.octet_length("text").alias("bytes"))
    return evaluate.context_cost(out, sizes)


def context_economy(spark, sf_dir):
    return evaluate.context_economy(context_cost(spark, sf_dir))


def relevance_rules(spark, sf_dir):
    """Results that rules call relevant: by their file's folder, or by a pattern in their text."""
    b = table(spark, sf_dir, "benchmark").where("text is not null")
    word = F.lower(F.regexp_extract("text", r"([A-Za-z]{4,})", 1))
    none = F.lit(None).cast("string")
    rules = b.select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("SRC"), (F.col("item_id") % 10).cast("string"), F.lit("\\"))).alias("file"), none.alias("anchor"), F.when(F.col("item_id") % 2 == 1, F.concat(word, F.lit(r"[ .,]"))).alias("pattern"))
    out = search.search(doc_passages(spark, sf_dir), wordings(spark, sf_dir)).withColumn("trail", F.lit(""))
    return evaluate.relevant_by_rule(out, rules)


def doc_sections(spark, sf_dir):
    """Sections of the documents, headings and code fences being written among their lines."""
    lines = F.split("text", "\n", -1)
    marked = F.transform(lines, lambda x, i: F.when((i + F.col("doc_id")) % 5 == 2, F.concat(F.lit("## Part "), i.cast("string"), F.lit(" - é!\n"), x)).when((i + F.col("doc_id")) % 7 == 3, F.concat(F.lit("```js\n"), x)).otherwise(x))
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.explode(spans.page_sections(F.array_join(marked, "\n"))).alias("s"))
    return d.select("doc_id", "s.heading", "s.slug", F.md5("s.body").alias("digest"))


def colour_contrast(spark, sf_dir):
    """Contrast of two colours that each document's digest gives."""
    h = F.md5("text")
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("#"), F.substring(h, 1, 6)).alias("a"), F.when(F.col("doc_id") % 9 != 4, F.concat(F.lit("#"), F.substring(h, 7, 6))).otherwise("#12345").alias("b"))
    ratio = colour.contrast(F.col("a"), F.col("b"))
    return d.select("doc_id", F.when(ratio.isNotNull(), colour.shown(ratio)).alias("ratio"), colour.meets(ratio, "text").alias("text"), colour.meets(ratio, "large").alias("large"))


def median_lengths(spark, sf_dir):
    return evaluate.median(table(spark, sf_dir, "documents").withColumn("n", F.length("text")), "n", "lang")


def field_usage(spark, sf_dir):
    i = F.col("doc_no")
    fields = F.array_compact(F.array(F.when(F.col("id").isNotNull(), "id"), F.when(F.col("h1").isNotNull(), "h1"), F.lit("aliases"), F.when(i % 3 == 0, "kind")))
    used, spread = evaluate.field_usage(graph_notes(spark, sf_dir).select(fields.alias("fields")))
    return used.unionByName(spread.select(F.explode(F.array(F.struct(F.lit("<least>").alias("field"), F.col("least").cast("long").alias("files")), F.struct(F.lit("<median>").alias("field"), F.col("median").cast("long").alias("files")), F.struct(F.lit("<most>").alias("field"), F.col("most").cast("long").alias("files")))).alias("x")).select("x.*"))


def about_usage(spark, sf_dir):
    d = graph_notes(spark, sf_dir).withColumn("body", F.concat(F.lit("See [["), F.element_at("aliases", 1), F.lit("]] and [[x/"), F.col("doc_no").cast("string"), F.lit(".md]].")))
    return evaluate.about_usage(d).select("path", F.col("added").cast("long").alias("added"), F.col("mirrored").cast("long").alias("mirrored"))


QUERIES = {
    f.__name__: f
    for f in (
        fused_search, tokens_per_doc, term_stats, corpus_stats, metadata_documents, bm25_single, bm25_two_field, rrf_fused, suppress_duplicates, search_text_sink, search_report, search_json_sink,
        sections, heading_trail, spans_divided, span_addresses, first_h1, url_identity, url_groups, url_youtube, redact_urls, source_dedup, source_lookup,
        link_parse, resolve_names, resolve_ids, duplicate_ids, backlinks, findings, findings_by_severity, edge_survival,
        manifest_build, manifest_refusals, manifest_drift, manifest_owned, manifest_merge, manifest_update, capture_plan, slugs, yaml_scalars, walk_order, scan_budget,
        relevance, relevance_rules, retrieval_quality, context_cost, context_economy, doc_sections, colour_contrast, median_lengths, field_usage, about_usage,
    )
} | boards.QUERIES | files.QUERIES
