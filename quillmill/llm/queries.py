"""The registered queries of the subpackage, and the SQL that gives the same rows."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, jaccard_join, language_id, packing, pieces, prefix_trie, pseudonyms, token_counts, toxicity, turns, url_filter, warc
from . import repair as repairs
from .common import Scratch, table

#: (host, path, verdict)
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


#: The setting that holds the pseudonyms' key.
KEY_SETTING = "spark.quillmill.pseudonyms.key"
_KEYS: dict[str, str] = {}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pseudonym_key(spark: SparkSession) -> str:
    """The key set for the session; where none is, a random one that lasts as long as the application."""
    app = spark.sparkContext.applicationId
    return spark.conf.get(KEY_SETTING, None) or _KEYS.setdefault(app, secrets.token_hex(32))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = language_id.remainder(F.col("doc_id"), 4) == 2
    model = language_id.fit(docs.where(~held_out))
    out = language_id.identify(docs, model, keep=["doc_id"])
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = language_id.remainder(F.col("doc_id"), 3) == 1
    lexicon = toxicity.fit(docs, labels.where(~held_out))
    out = toxicity.toxicity(docs, lexicon, ["doc_id"])
    return out.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "weight", "words")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op3_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_links(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rules where every third page redirects to the page of half its number."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    half = pages.where("page_id % 3 = 0").select(F.floor(F.col("page_id") / 2).alias("to_id"), F.col("url").alias("from_url"))
    redirects = half.join(pages.select(F.col("page_id").alias("to_id"), F.col("url").alias("to_url")), "to_id").select("from_url", "to_url")
    return url_filter.judge(pages, URL_RULES, redirects).select("page_id", "rule", "verdict", "aliased")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digests(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [f"n_{k}" for k in pseudonyms.KINDS]
    return pseudonyms.pseudonymize(table(spark, sf_dir, "documents"), pseudonym_key(spark)).select("doc_id", "text", *counts)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    scratch = Scratch(spark, "repaired")
    done = repairs.repair(repairs.damage(rows))
    lines = scratch.cut(done.turns.select("conv_id", "id", "sub", F.concat("role", F.lit(":"), "text").alias("line")))
    shas = turns.digests(lines, "conv_id", ["id", "sub"], "line", "\n", "repaired_sha256").withColumnRenamed("conv_id", "c")
    every = rows.select(F.col("conv_id").cast("long").alias("conv")).distinct()
    out = every.join(done.audits, every["conv"].eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    out = out.join(shas, out["conv"].eqNullSafe(F.col("c")), "left")
    numbers = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("conv").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    scratch = Scratch(spark, "trie")
    own = prefix_trie.numbered_turns(rows, scratch)
    convs = scratch.cut(own.select("conv_id").distinct())
    nodes = prefix_trie.trie(prefix_trie.shared_heads(own, scratch), convs, scratch)
    return nodes.withColumn("depth", F.col("depth").cast("long"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_toxicity, op3_jaccard_join, op3_jaccard_links, op4_decontamination, op5_token_counts, op6_nearest_neighbours, op7_url_filter, op7_url_aliases, op8_sentencepiece, op9_warc, op10_pseudonyms, op11_conversation_repair, op12_packing, op13_prefix_trie)}

_OP3 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
t AS (SELECT doc_id, unnest(s) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM t a JOIN t b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN s x ON x.doc_id = p.a JOIN s y ON y.doc_id = p.b WHERE 100 * k >= 80 * (len(x.s) + len(y.s) - k)),
r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.c) AS component_id FROM s JOIN r USING (doc_id) GROUP BY s.doc_id, len(s.s)
"""

_OP3_LINKS = (
    _OP3.rsplit("\nSELECT", 1)[0]
    + r""",
k AS (SELECT a AS doc_id, count(*) AS n FROM l GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.c) AS component_id, CAST(coalesce(any_value(k.n), 0) AS BIGINT) AS n_links
FROM s JOIN r USING (doc_id) LEFT JOIN k USING (doc_id) GROUP BY s.doc_id, len(s.s)
"""
)

_OP4 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
x AS (
  SELECT item_id, n, array_to_string(w[i:i+n-1], ' ') AS x
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM x),
s AS (
  SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS x
  FROM (SELECT doc_id, w, n.n, unnest(range(1, len(w) - n.n + 2)) AS i FROM d, n WHERE len(w) >= n.n)),
h AS (SELECT doc_id, i, s.n, item_id FROM s JOIN x ON s.x = x.x AND s.n = x.n),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(v, ',' ORDER BY v) AS v FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS v FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(m.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(m.v, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""

_OP6 = """
WITH e AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS r FROM p) WHERE r <= 10
"""

# the tables' pages name no aliases, so the rules decide alone; aliases are tested on fixtures
_OP7 = """
WITH u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
r(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (
  SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
  FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM h LEFT JOIN m USING (page_id)
"""

_OP7_ALIASES = (
    "WITH RECURSIVE"
    + _OP7.split("WITH", 1)[1].rsplit("\nSELECT", 1)[0]
    + r""",
y AS (
  SELECT page_id, url, regexp_replace(url, '#.*$', '') AS plain FROM pages WHERE position('://' IN url) > 0),
z AS (
  SELECT page_id, lower(regexp_extract(plain, '^[^:]*://[^/?]*')) || CASE WHEN regexp_extract(plain, '^[^:]*://[^/?]*(/?)', 1) = '' THEN '/' ELSE '' END || substr(plain, length(regexp_extract(plain, '^[^:]*://[^/?]*')) + 1) AS node FROM y),
e AS (SELECT a.node AS u, b.node AS v FROM z a JOIN z b ON a.page_id % 3 = 0 AND b.page_id = a.page_id // 2 AND a.node <> b.node),
s AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
c AS (SELECT u AS node, u AS other FROM s UNION SELECT c.node, s.v FROM c JOIN s ON s.u = c.other),
nh AS (SELECT DISTINCT node, translate(regexp_extract(node, '://([^/?]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(node, '://[^/?]*([^?]*)', 1) AS path FROM s JOIN z ON z.node = s.u),
nv AS (SELECT node, arg_max(v, length(rh || rp)) AS v FROM nh JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY node),
bad AS (SELECT c.node, bool_or(coalesce(nv.v, '') = 'block') AS bad FROM c LEFT JOIN nv ON nv.node = c.other GROUP BY c.node)
SELECT h.page_id, rule, coalesce(m.v, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict, bad IS NOT NULL AS aliased
FROM h LEFT JOIN m USING (page_id) LEFT JOIN z USING (page_id) LEFT JOIN bad ON bad.node = z.node
"""
)

_OP9 = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n, sha1(coalesce(html, '')) AS d FROM pages),
k AS (SELECT d, max(page_id) AS kept FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest, CASE WHEN kept <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN kept <> page_id THEN kept END AS refers_to
FROM p LEFT JOIN k ON k.d = p.d AND n >= 1000
"""



def _crc32(text: str) -> str:
    """crc32 of an ASCII text, bit by bit."""
    bytes_ = f"list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii(({text})[i]) AS BIGINT))"
    byte = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, (v & 1) * 3988292384))"
    return f"xor(list_reduce(list_concat([4294967295], {bytes_}), lambda c, b: {byte}), 4294967295)"


def _least(*options: str) -> str:
    return f"list_sort(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))[1]"


def _then(letter: str, cost: str, state: int, when: str = "true") -> str:
    """An edit before what is best from a state of the next layer."""
    return f"CASE WHEN {when} THEN {{'c': b{state}.c + {cost}, 's': '{letter}' || b{state}.s}} END"


def _consume(p: int) -> str:
    keeps = [_then("K", "(f = 1)::INT", q, f"f < 2 AND k = {role}") for role, q in repairs.MOVES[p].items()]
    return _least(_then("D", "3", p), _then("R", "2 + (f = 1)::INT", repairs.TURN[p], "f < 2"), *keeps)


_INSERT = lambda x: f"{{'c': {x}.c + 2, 's': 'I' || {x}.s}}"

_OP11 = rf"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
x AS (SELECT *, {_crc32("key")} % 20 AS fate FROM o),
d AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM x, LATERAL (SELECT unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END)) WHERE fate <> 0),
n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d)),
r AS (
  SELECT conv_id, turn, i, role, text, CASE left(role, 1) WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END AS k,
    CASE WHEN shown = '' THEN 2 WHEN seen > 1 THEN 3 WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS f FROM n),
s AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 2) AS blank, count(*) FILTER (f = 3) AS duplicate, count(*) FILTER (f = 1) AS truncated, max(i) AS n
  FROM r GROUP BY conv_id),
l AS (SELECT conv_id, count(*) FILTER (p IS NOT NULL AND (p, k) NOT IN ((0, 1), (1, 2), (2, 1))) AS illegal FROM (SELECT conv_id, k, lag(k) OVER (PARTITION BY conv_id ORDER BY i) AS p FROM r) GROUP BY conv_id),
b AS (
  SELECT conv_id, n AS i, {{'c': 0, 's': ''}} AS b0, {{'c': 4, 's': 'II'}} AS b1, {{'c': 2, 's': 'I'}} AS b2, {{'c': 0, 's': ''}} AS b3 FROM s
  UNION ALL
  SELECT conv_id, i, {_least("c0", _INSERT(_INSERT("c3")), _INSERT("c2"))}, {_least("c1", _INSERT(_INSERT("c3")), _INSERT("c2"))}, {_least("c2", _INSERT("c3"))}, {_least("c3", _INSERT("c2"))}
  FROM (SELECT b.conv_id, b.i - 1 AS i, {", ".join(f"{_consume(p)} AS c{p}" for p in range(4))} FROM b JOIN r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i)),
a AS (SELECT conv_id, b0.c AS cost, b0.s AS audit FROM b WHERE i = 0),
e AS (SELECT conv_id, j, audit[j] AS e, length(replace(audit, 'D', '')) % 2 AS odd FROM a, LATERAL (SELECT unnest(range(1, length(audit) + 1)) AS j)),
t AS (
  SELECT *, count(*) FILTER (e <> 'I') OVER w AS i, count(*) FILTER (e <> 'D') OVER w - 1 AS place
  FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
m AS (
  SELECT t.conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (place - odd) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS whole
  FROM t LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM t.conv_id AND r.i = t.i AND e <> 'I' WHERE e <> 'D' GROUP BY t.conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN l ON l.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM c.conv_id
"""

_OP13 = f"""
WITH o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS v, {_crc32("v")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM o)),
t AS (
  SELECT c.conv_id, 0 AS part, i, role, text FROM c JOIN o ON o.conv_id = c.conv_id - (c.conv_id % 5 + 5) % 5 AND i <= h
  UNION ALL SELECT c.conv_id, 1, i, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND i > h),
p AS (
  SELECT conv_id, row_number() OVER w AS depth, octet_length(encode(text)) AS bytes, md5(string_agg(md5(length(role) || ':' || role || text), '') OVER w) AS node
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY part, i ROWS UNBOUNDED PRECEDING)),
q AS (SELECT conv_id, depth, bytes, node, coalesce(lag(node) OVER (PARTITION BY conv_id ORDER BY depth), '') AS parent FROM p UNION ALL SELECT conv_id, 0, 0, '', NULL FROM c),
n AS (SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS own FROM q GROUP BY node),
k AS (SELECT parent AS node, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
a AS (SELECT DISTINCT x.node, y.node AS top FROM q x JOIN q y ON x.conv_id = y.conv_id AND y.depth <= x.depth),
u AS (SELECT top AS node, sum(own) AS saved, count(*) FILTER (k.node IS NULL) AS n_leaves FROM a JOIN n USING (node) LEFT JOIN k ON k.node = a.node GROUP BY top),
z AS (SELECT conv_id, max(depth) AS depth FROM q GROUP BY conv_id),
e AS (SELECT node, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM z JOIN q USING (conv_id, depth) GROUP BY node)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM n LEFT JOIN n p ON p.node = n.parent LEFT JOIN k ON k.node = n.node LEFT JOIN u ON u.node = n.node LEFT JOIN e ON e.node = n.node
"""

ORACLE_SQL = {"op11_conversation_repair": _OP11, "op13_prefix_trie": _OP13, "op3_jaccard_join": _OP3, "op3_jaccard_links": _OP3_LINKS, "op4_decontamination": _OP4, "op6_nearest_neighbours": _OP6, "op7_url_filter": _OP7, "op7_url_aliases": _OP7_ALIASES, "op9_warc": _OP9}
