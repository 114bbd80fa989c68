"""SQL for DuckDB that gives the registered queries' rows from the same tables."""

from __future__ import annotations

from ..constants import BM25_B, BM25_K1, METADATA_WEIGHT, STOP_WORDS, VIDEO_CANONICAL
from . import boards, files

STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def tok(c: str) -> str:
    return rf"list_filter(regexp_split_to_array(strip_accents(lower({c})), '[^\p{{L}}\p{{N}}]+'), lambda t: length(t) > 1 AND t NOT IN ({STOPS}))"


NOTES = """docs AS (
  SELECT doc_id AS doc_no, coalesce(source, 'none') || '/' || doc_id || '.md' AS path, CAST(doc_id AS VARCHAR) AS name, text, lang, coalesce(source, 'none') AS folder
  FROM documents WHERE text IS NOT NULL)"""


def spans_of(source: str, body: str = "text") -> str:
    """Notes without headings: one passage each, or parts of 40 lines where a blank line allows (see spans_divided)."""
    return rf"""lns AS (SELECT path, unnest(range(len(x))) AS i, unnest(x) AS line FROM (SELECT path, string_split({body}, chr(10)) AS x FROM {source})),
full_ AS (SELECT path, min(i) AS a, max(i) AS b FROM lns WHERE NOT regexp_full_match(line, '\s*') GROUP BY path),
pas AS (
  SELECT l.path, CAST(f.a + 1 AS INTEGER) AS start_line, CAST(f.b + 1 AS INTEGER) AS end_line, string_agg(line, chr(10) ORDER BY i) AS text
  FROM lns l JOIN full_ f ON f.path = l.path AND i BETWEEN a AND b GROUP BY ALL)"""


TALK = r"""talk AS (
  SELECT conv_id, 'conversations/' || conv_id || '.md' AS path,
    '# Conversation ' || conv_id || chr(10) || chr(10) || string_agg('## ' || role || ' ' || turn || chr(10) || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS body
  FROM conversations GROUP BY conv_id),
ln0 AS (SELECT path, conv_id, unnest(range(len(x))) AS i, unnest(x) AS line FROM (SELECT path, conv_id, string_split(body, chr(10)) AS x FROM talk)),
hd AS (SELECT path, i, length(regexp_extract(line, '^ {0,3}(#{1,6})\s+', 1)) AS depth, trim(regexp_extract(line, '^ {0,3}#{1,6}\s+([^\r\n]*)$', 1)) AS anchor FROM ln0 WHERE regexp_matches(line, '^ {0,3}#{1,6}\s+[^\r\n]*$')),
ln1 AS (SELECT l.path, l.conv_id, l.i, l.line, h.i IS NOT NULL AS head, max(h.i) OVER (PARTITION BY l.path ORDER BY l.i) AS hi FROM ln0 l LEFT JOIN hd h ON h.path = l.path AND h.i = l.i),
rng AS (SELECT path, conv_id, hi, min(i) AS a, max(i) AS b FROM ln1 WHERE NOT head AND NOT regexp_full_match(line, '\s*') GROUP BY ALL),
pas AS (
  SELECT l.path, l.conv_id, r.hi, CAST(r.a + 1 AS INTEGER) AS start_line, CAST(r.b + 1 AS INTEGER) AS end_line, string_agg(line, chr(10) ORDER BY i) AS text
  FROM ln1 l JOIN rng r ON r.path = l.path AND r.hi IS NOT DISTINCT FROM l.hi AND l.i BETWEEN r.a AND r.b AND NOT l.head GROUP BY ALL),
trl AS (
  SELECT h.path, h.i, coalesce(string_agg(u.anchor, ' > ' ORDER BY u.i) FILTER (WHERE u.anchor <> ''), '') AS trail
  FROM hd h LEFT JOIN hd u ON u.path = h.path AND u.i < h.i AND u.depth < h.depth
    AND NOT EXISTS (SELECT 1 FROM hd m WHERE m.path = h.path AND m.i > u.i AND m.i < h.i AND m.depth <= u.depth)
  GROUP BY h.path, h.i),
tp AS (
  SELECT p.*, h.anchor, coalesce(t.trail, '') AS trail, 'Conversation ' || conv_id AS title
  FROM pas p LEFT JOIN hd h ON h.path = p.path AND h.i = p.hi LEFT JOIN trl t ON t.path = p.path AND t.i = p.hi),
met AS (SELECT *, concat_ws(' ', title, nullif(replace(trail, ' > ', ' '), ''), anchor, 'conversations') AS metadata FROM tp)"""

DOC_MET = "met AS (SELECT p.*, concat_ws(' ', d.name, d.lang, d.folder) AS metadata FROM pas p JOIN docs d USING (path))"

WORDINGS = r"""w0 AS (SELECT item_id AS query_id, regexp_split_to_array(text, '\s+') AS w FROM benchmark WHERE text IS NOT NULL),
wd AS (
  SELECT query_id, 0 AS wording_no, array_to_string(w[1:8], ' ') AS wording FROM w0
  UNION ALL SELECT query_id, 1, array_to_string(w[5:14], ' ') FROM w0
  UNION ALL SELECT query_id, 2, array_to_string(list_transform(range(1, least(len(w), 30) + 1, 3), lambda i: w[i]), ' ') FROM w0)"""


def scoring(asked: str, weight: float) -> str:
    """From met (path, start_line, end_line, text, metadata) and wordings to ranked rk."""
    return f"""ft AS (SELECT path, start_line, end_line, 'body' AS field, {tok('text')} AS t FROM met UNION ALL SELECT path, start_line, end_line, 'meta', {tok('metadata')} FROM met),
st AS (SELECT field, count(*) AS n, avg(len(t)) AS average FROM ft GROUP BY field),
po AS (SELECT path, start_line, end_line, field, len, term, count(*) AS tf FROM (SELECT path, start_line, end_line, field, len(t) AS len, unnest(t) AS term FROM ft) GROUP BY ALL),
dfs AS (SELECT field, term, count(*) AS df FROM po GROUP BY ALL),
qt AS (SELECT query_id, wording_no, term, count(*) AS times FROM (SELECT query_id, wording_no, unnest({tok('wording')}) AS term FROM {asked}) GROUP BY ALL),
sc AS (
  SELECT query_id, wording_no, path, start_line, end_line,
    sum(CASE WHEN field = 'body' THEN 1.0::DOUBLE ELSE {weight}::DOUBLE END * times * (ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * ({BM25_K1}::DOUBLE + 1))) / (tf + {BM25_K1}::DOUBLE * (1 - {BM25_B}::DOUBLE + {BM25_B}::DOUBLE * len / average))) AS score
  FROM qt JOIN po USING (term) JOIN dfs USING (field, term) JOIN st USING (field) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, wording_no ORDER BY round(score, 9) DESC, path, start_line) AS rank FROM sc WHERE score > 0)"""


FUSED = f"""fu AS (SELECT query_id, path, start_line, end_line, sum(1.0::DOUBLE / (60 + rank)) AS score FROM rk WHERE rank <= 20 GROUP BY ALL),
dd AS (
  SELECT fu.*, p.text, row_number() OVER (PARTITION BY query_id, array_to_string({tok('p.text')}, ' ') ORDER BY round(score, 9) DESC, fu.path, fu.start_line) AS k
  FROM fu JOIN pas p ON p.path = fu.path AND p.start_line = fu.start_line),
tp5 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, path, start_line) AS rank FROM dd WHERE k = 1)"""

DOCS = f"{NOTES}, {spans_of('docs')}, {DOC_MET}"
SEARCH = f"WITH {DOCS}, {WORDINGS}, {scoring('wd', METADATA_WEIGHT)}, {FUSED}"

GRAPH = r"""g AS (
  SELECT doc_id AS doc_no, source || '/' || doc_id || '.md' AS path, CAST(doc_id AS VARCHAR) AS name, source,
    CASE WHEN doc_id % 10 <> 3 THEN 'id-' || (doc_id - (doc_id % 17 = 5)::INT) WHEN doc_id % 20 = 3 THEN ' ' END AS id,
    CASE WHEN doc_id % 4 = 0 THEN 'Title ' || (doc_id % 300) END AS h1,
    list_concat(['id-' || doc_id // 2], CASE WHEN doc_id % 50 = 0 THEN [' '] ELSE [] END, CASE WHEN doc_id % 37 = 0 THEN [' id-' || doc_id || ' '] ELSE [] END, CASE WHEN doc_id % 29 = 0 THEN ['id-none'] ELSE [] END) AS derived_from,
    ['[[notes/' || (doc_id * 3 % 1100) || '.md#part|shown]]', 'Title  ' || (doc_id % 400), '[[' || upper(source) || ']]'] AS about,
    [CAST(doc_id * 3 % 1100 AS VARCHAR), 'Title  ' || (doc_id % 400), upper(source)] AS about_names
  FROM documents),
cl AS (SELECT trim(id) AS key, count(*) AS n, min(doc_no) AS doc_no FROM g WHERE trim(id) <> '' GROUP BY 1),
nm AS (
  SELECT key, tier, count(*) AS n, min(doc_no) AS doc_no FROM (
    SELECT lower(name) AS key, 0 AS tier, doc_no FROM g UNION ALL SELECT lower(h1), 1, doc_no FROM g WHERE h1 IS NOT NULL UNION ALL SELECT lower(source), 2, doc_no FROM g) GROUP BY ALL),
bt AS (SELECT key, tier, n, doc_no FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY tier) AS k FROM nm) WHERE k = 1),
ed AS (SELECT doc_no, path, id, unnest(range(len(derived_from))) AS item_no, unnest(derived_from) AS target_id FROM g),
ab AS (SELECT doc_no, path, unnest(range(3)) AS item, unnest(about) AS link, unnest(about_names) AS nam FROM g),
rn AS (
  SELECT ab.*, bt.n, CASE WHEN bt.key IS NULL THEN 'unresolved' WHEN bt.n > 1 THEN 'ambiguous' ELSE 'resolved' END AS status,
    CASE bt.tier WHEN 0 THEN 'name' WHEN 1 THEN 'h1' WHEN 2 THEN 'alias' END AS matched_by, CASE WHEN bt.n = 1 THEN bt.doc_no END AS target
  FROM ab LEFT JOIN bt ON bt.key = lower(regexp_replace(nam, '\s+', ' ', 'g')))"""

FINDINGS = GRAPH + r""",
fi AS (
  SELECT doc_no, path, NULL AS field, 'frontmatter-unreadable' AS code, 'error' AS severity, 'the frontmatter is no readable mapping: not a mapping' AS reason, 0 AS phase, 0 AS rule, 0 AS item FROM g WHERE doc_no % 101 = 0
  UNION ALL SELECT doc_no, path, k, 'duplicate-key', 'warning', '`' || k || '` occurs more than once; its last value holds', 0, 1, i FROM g, (VALUES ('tags', 0), ('id', 1)) v(k, i) WHERE doc_no % 61 = 0 AND doc_no % 101 <> 0
  UNION ALL SELECT doc_no, path, 'kind', 'field-not-text', 'warning', '`kind` is no single text value and was left out', 0, 2, 0 FROM g WHERE doc_no % 67 = 0 AND doc_no % 101 <> 0
  UNION ALL SELECT doc_no, path, 'tags', 'field-not-list', 'warning', '`tags` is neither text nor a list and was left out', 0, 3, 0 FROM g WHERE doc_no % 71 = 0 AND doc_no % 101 <> 0
  UNION ALL SELECT doc_no, path, 'about', 'list-item-unreadable', 'warning', '1 of 4 items of `about` are no text and were left out', 0, 3, 0 FROM g WHERE doc_no % 73 = 0 AND doc_no % 101 <> 0
  UNION ALL SELECT doc_no, path, 'id', 'id-blank', 'error', '`id` is blank, so nothing can refer to this file', 0, 4, 0 FROM g WHERE trim(id) = '' AND doc_no % 101 <> 0
  UNION ALL SELECT DISTINCT doc_no, path, 'derived_from', 'derived-from-blank', 'error', '`derived_from` has a blank item', 0, 5, 0 FROM ed WHERE trim(target_id) = '' AND doc_no % 101 <> 0
  UNION ALL SELECT DISTINCT doc_no, path, 'derived_from', 'derived-from-self', 'error', '`derived_from` refers to the file''s own id `' || trim(id) || '`', 0, 6, 0 FROM ed WHERE trim(id) <> '' AND trim(target_id) = trim(id) AND doc_no % 101 <> 0
  UNION ALL SELECT g.doc_no, path, 'id', 'duplicate-id', 'error', 'several files claim the id `' || trim(id) || '`', 1, 0, 0 FROM g JOIN cl ON cl.key = trim(id) WHERE cl.n > 1
  UNION ALL SELECT doc_no, path, 'derived_from', 'derived-from-unresolved', 'warning', 'no file claims the id `' || target_id || '`', 1, 1, item_no FROM ed
    WHERE trim(target_id) <> '' AND trim(target_id) IS DISTINCT FROM trim(id) AND trim(target_id) NOT IN (SELECT key FROM cl)
  UNION ALL SELECT doc_no, path, 'about', 'about-unresolved', 'info', 'no file answers to `' || nam || '`', 1, 2, item FROM rn WHERE status = 'unresolved'
  UNION ALL SELECT doc_no, path, 'about', 'about-ambiguous', 'info', n || ' files answer to `' || nam || '` by ' || matched_by, 1, 2, item FROM rn WHERE status = 'ambiguous')"""

HASHED = "m AS (SELECT doc_id AS entry_no, source || '/' || doc_id || '.md' AS path, sha256(text) AS sha256 FROM documents)"
OBSERVED = HASHED + ", ob AS (SELECT path, CASE WHEN entry_no % 9 = 2 THEN sha256(path) WHEN entry_no % 9 <> 5 THEN sha256 END AS now FROM m WHERE entry_no % 9 <> 4)"
DRIFT = "SELECT m.path, CASE WHEN now IS NULL THEN 'missing' WHEN now = sha256 THEN 'unchanged' ELSE 'modified' END AS state FROM m LEFT JOIN ob USING (path) WHERE entry_no % 10 <> 0"

# pages hold http urls with plain hosts, at most one path slash to drop and queries of distinct keys
NORM = r"""nu AS (
  SELECT page_id, url, lower(regexp_extract(url, '^([^/?#]*://[^/?#]*)', 1)) AS origin, regexp_extract(url, '^[^/?#]*://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(url, '\?([^#]*)', 1) AS q, regexp_extract(url, '(#.*)$', 1) AS f FROM {src}),
no AS (
  SELECT page_id, url, origin || CASE WHEN p = '' THEN '/' WHEN length(p) > 1 AND ends_with(p, '/') THEN p[:-2] ELSE p END
    || CASE WHEN q = '' THEN '' ELSE '?' || array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '')), '&') END || CASE WHEN starts_with(f, '#/') THEN f ELSE '' END AS norm_url FROM nu)"""

ITEMS = r"""cap AS (
  SELECT item_id * 2 AS item_no, text AS item FROM benchmark
  UNION ALL SELECT page_id * 2 + 1, CASE WHEN page_id % 17 = 0 THEN replace(url, 'http', 'ftp') WHEN page_id % 13 = 0 THEN 'same-words' ELSE regexp_replace(url, '#.*$', '') END FROM pages)"""


def slug(c: str) -> str:
    words = rf"regexp_replace(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g')"
    return rf"CASE WHEN {words} = '' THEN 'capture' WHEN length({words}) <= 48 THEN {words} WHEN regexp_extract(substr({words}, 1, 48), '^(.+)-[^-]*$', 1) <> '' THEN regexp_extract(substr({words}, 1, 48), '^(.+)-[^-]*$', 1) ELSE substr({words}, 1, 48) END"


SQL = {
    "tokens_per_doc": f"WITH {DOCS} SELECT path, CAST(len({tok('text')}) AS BIGINT) AS n_terms, md5(array_to_string({tok('text')}, ' ')) AS digest FROM pas",
    "term_stats": f"WITH {DOCS}, {WORDINGS}, {scoring('wd', 0.0)} SELECT field, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM po GROUP BY ALL",
    "corpus_stats": f"WITH {TALK}, {WORDINGS}, {scoring('wd', 0.0)} SELECT field, n, round(average, 6) AS average FROM st",
    "metadata_documents": f"WITH {TALK} SELECT path, start_line, metadata FROM met",
    "bm25_single": f"WITH {DOCS}, {WORDINGS}, w1 AS (SELECT * FROM wd WHERE wording_no = 0), {scoring('w1', 0.0)} SELECT query_id, CAST(rank AS INTEGER) AS rank, path, round(score, 6) AS score FROM rk WHERE rank <= 10",
    "bm25_two_field": rf"WITH {TALK}, w1 AS (SELECT conv_id AS query_id, 0 AS wording_no, 'user conversation ' || text AS wording FROM conversations WHERE turn = 0 AND conv_id % 100 = 0 AND text IS NOT NULL), {scoring('w1', METADATA_WEIGHT)} SELECT query_id, CAST(rank AS INTEGER) AS rank, path, start_line, round(score, 6) AS score FROM rk WHERE rank <= 10",
    "rrf_fused": f"{SEARCH} SELECT query_id, path, round(score, 9) AS score FROM fu",
    "suppress_duplicates": f"WITH {DOCS} SELECT path, start_line FROM (SELECT path, start_line, row_number() OVER (PARTITION BY array_to_string({tok('text')}, ' ') ORDER BY path, start_line) AS k FROM pas) WHERE k = 1",
    "fused_search": f"{SEARCH} SELECT query_id, CAST(rank AS INTEGER) AS rank, path, start_line, end_line, round(score, 9) AS score FROM tp5 WHERE rank <= 5",
    "search_text_sink": f"{SEARCH} SELECT query_id, CAST(rank AS INTEGER) AS rank, path || ':' || start_line || '-' || end_line || '  score ' || printf('%.4f', round(score, 9)) || chr(10) || '/notes/' || path || chr(10) || array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN x = '' THEN '' ELSE '    ' || x END), chr(10)) || chr(10) AS block FROM tp5 WHERE rank = 1",
    "search_json_sink": f"{SEARCH}, q AS (SELECT query_id, string_agg(wording, ' | ' ORDER BY wording_no) AS query FROM wd GROUP BY query_id) SELECT query_id, query, count(path) AS n, min(path) FILTER (WHERE rank = 1) AS first_path, count(path) > 0 AS keeps_null FROM q LEFT JOIN (SELECT * FROM tp5 WHERE rank <= 5) USING (query_id) GROUP BY query_id, query",
    "sections": f"WITH {TALK} SELECT path, anchor, start_line, end_line, md5(text) AS digest FROM tp",
    "heading_trail": f"WITH {TALK} SELECT path, start_line, trail, title, 'conversations' AS folder FROM tp",
    # every other line is blank, so parts hold 40 lines
    "spans_divided": r"""WITH l AS (SELECT source || '/' || doc_id || '.md' AS path, unnest(range(len(x))) AS i, unnest(x) AS line, len(x) AS n FROM (SELECT doc_id, source, string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
p AS (SELECT *, CASE WHEN n > 40 THEN i // 40 ELSE 0 END AS part FROM l),
r AS (SELECT path, part, min(i) AS a, max(i) AS b FROM p WHERE NOT regexp_full_match(line, '\s*') GROUP BY ALL)
SELECT p.path, CAST(a + 1 AS INTEGER) AS start_line, CAST(b + 1 AS INTEGER) AS end_line, md5(string_agg(line, chr(10) ORDER BY i)) AS digest FROM p JOIN r ON r.path = p.path AND r.part = p.part AND i BETWEEN a AND b GROUP BY p.path, a, b""",
    "span_addresses": f"WITH {TALK} SELECT path || CASE WHEN anchor IS NULL THEN '' ELSE '#' || anchor END || ':' || start_line || '-' || end_line AS address FROM tp",
    "first_h1": "SELECT DISTINCT 'conversations/' || conv_id || '.md' AS path, 'Conversation ' || conv_id AS h1 FROM conversations",
    "url_identity": f"WITH {NORM.format(src='pages')} SELECT page_id, norm_url, 'generic' AS rule, 'url-' || substr(sha256(norm_url), 1, 12) AS source_id FROM no",
    "url_groups": rf"WITH b AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages UNION ALL SELECT page_id, url FROM pages), {NORM.format(src='b')} SELECT norm_url, count(DISTINCT url) AS n_variants, count(*) AS n FROM no GROUP BY norm_url",
    "url_youtube": f"""WITH k AS (SELECT page_id, substr(md5(CAST(page_id AS VARCHAR)), 1, 11) AS key FROM pages)
SELECT page_id, CAST(form AS INTEGER) AS form, CASE WHEN form < 4 THEN 'youtube' ELSE 'generic' END AS rule, CASE WHEN form < 4 THEN key END AS key, CASE WHEN form < 4 THEN 'yt-' || key ELSE 'url-' || substr(sha256('https://www.youtube.com/channel/' || key), 1, 12) END AS source_id
FROM k, (SELECT unnest(range(5)) AS form)  -- canonical: {VIDEO_CANONICAL}
""",
    "redact_urls": "SELECT page_id, '\"' || CASE WHEN length(s) > 80 THEN substr(s, 1, 77) || '...' ELSE s END || '\"' AS shown FROM (SELECT page_id, regexp_replace(replace(url, '://', '://user:secret@'), '//[^/?#@\\s]*@', '//<redacted>@') || CASE WHEN page_id % 3 = 0 THEN repeat('/x', 40) ELSE '' END AS s FROM pages)",
    "source_dedup": f"WITH {NORM.format(src='pages')}, i AS (SELECT page_id, 'url-' || substr(sha256(norm_url), 1, 12) AS source_id FROM no) SELECT page_id, source_id FROM i WHERE source_id NOT IN (SELECT source_id FROM i WHERE page_id % 3 = 0)",
    "source_lookup": f"WITH {GRAPH} SELECT s.source_id, arg_min(path, string_split(path, '/')) AS path FROM (SELECT DISTINCT 'id-' || (doc_id % 1000) AS source_id FROM documents) s LEFT JOIN g ON g.id = s.source_id GROUP BY s.source_id",
    "link_parse": f"WITH {GRAPH} SELECT doc_no, CAST(item AS INTEGER) AS item, nam AS name, CASE WHEN item = 0 THEN 'part' END AS fragment, CASE WHEN item = 0 THEN 'shown' END AS display FROM ab",
    "resolve_names": f"WITH {GRAPH} SELECT doc_no, CAST(item AS INTEGER) AS item, status, matched_by, n, target FROM rn",
    "resolve_ids": f"WITH {GRAPH} SELECT ed.doc_no, CAST(item_no AS INTEGER) AS item_no, cl.doc_no AS target FROM ed LEFT JOIN cl ON cl.key = trim(target_id) AND cl.n = 1",
    "duplicate_ids": f"WITH {GRAPH} SELECT key AS id_key, key AS written, n FROM cl WHERE n > 1",
    "backlinks": f"WITH {GRAPH} SELECT cl.doc_no, array_to_string(list_sort(list(DISTINCT ed.doc_no)), ',') AS derived FROM ed JOIN cl ON cl.key = trim(target_id) AND cl.n = 1 GROUP BY cl.doc_no",
    "findings": f"WITH {FINDINGS} SELECT path, field, code, severity, reason, phase, rule, CAST(item AS INTEGER) AS item FROM fi",
    "findings_by_severity": f"WITH {FINDINGS} SELECT count(*) FILTER (WHERE severity = 'error') AS error, count(*) FILTER (WHERE severity = 'warning') AS warning, count(*) FILTER (WHERE severity = 'info') AS info FROM fi",
    "edge_survival": f"""WITH {GRAPH}, n2 AS (
  SELECT key, tier, count(*) AS n, min(doc_no) AS doc_no FROM (
    SELECT CASE WHEN doc_no % 5 = 0 THEN 'renamed-' || name ELSE name END AS key, 0 AS tier, doc_no FROM g UNION ALL SELECT lower(h1), 1, doc_no FROM g WHERE h1 IS NOT NULL UNION ALL SELECT lower(source), 2, doc_no FROM g) GROUP BY ALL),
b2 AS (SELECT key, n FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY tier) AS k FROM n2) WHERE k = 1),
i AS (SELECT count(*) AS x FROM ed JOIN cl ON cl.key = trim(target_id) AND cl.n = 1 WHERE item_no = 0)
SELECT (SELECT x FROM i) AS ids_before, (SELECT count(target) FROM rn WHERE item = 0) AS names_before, (SELECT x FROM i) AS ids_after, (SELECT count(*) FROM ab JOIN b2 ON b2.key = lower(nam) AND b2.n = 1 WHERE item = 0) AS names_after""",
    "manifest_build": f"WITH {HASHED} SELECT true AS ok, CAST(NULL AS VARCHAR) AS code, path, sha256 FROM m",
    "manifest_refusals": f"""WITH {HASHED}, p AS (
  SELECT entry_no, CASE entry_no % 11 WHEN 0 THEN '' WHEN 1 THEN '/' || path WHEN 2 THEN '../' || path WHEN 3 THEN './' || path WHEN 4 THEN path || ' ' WHEN 5 THEN 'C:' || path WHEN 6 THEN 'same.md' ELSE path END AS path FROM m)
SELECT entry_no, path, CASE entry_no % 11 WHEN 0 THEN 'path-empty' WHEN 1 THEN 'path-absolute' WHEN 2 THEN 'path-escapes-brain' WHEN 3 THEN 'path-not-normalized' WHEN 4 THEN 'path-not-normalized' WHEN 5 THEN 'path-absolute'
  WHEN 6 THEN CASE WHEN entry_no > 6 THEN 'path-duplicated' END WHEN 7 THEN 'hash-malformed' END AS code FROM p""",
    "manifest_drift": f"WITH {OBSERVED} {DRIFT}",
    "manifest_owned": f"WITH {OBSERVED} SELECT ob.path FROM ob JOIN m USING (path) WHERE entry_no % 10 <> 0",
    "manifest_merge": f"WITH {HASHED} SELECT path, CASE WHEN entry_no % 2 = 0 THEN sha256(path) ELSE sha256 END AS sha256 FROM m WHERE entry_no % 3 <> 0 OR entry_no % 2 = 0",
    "manifest_update": f"WITH {OBSERVED} {DRIFT} UNION ALL SELECT path, 'new' FROM m WHERE entry_no % 10 = 0",
    "capture_plan": f"""WITH {NORM.format(src='(SELECT item_no AS page_id, item AS url FROM cap)')}, hn AS (SELECT page_id, url AS u0 FROM pages WHERE page_id % 5 = 0),
hs AS (SELECT DISTINCT 'url-' || substr(sha256(x), 1, 12) AS sid FROM (
  SELECT lower(regexp_extract(u0, '^([^/?#]*://[^/?#]*)', 1)) || CASE WHEN p = '' THEN '/' WHEN length(p) > 1 AND ends_with(p, '/') THEN p[:-2] ELSE p END || CASE WHEN q = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(q, '&')), '&') END AS x
  FROM (SELECT u0, regexp_extract(u0, '^[^/?#]*://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(u0, '\\?([^#]*)', 1) AS q FROM hn))),
it AS (
  SELECT item_no, item, CASE WHEN regexp_matches(item, '\\s') OR item = 'same-words' THEN 'text' WHEN starts_with(item, 'ftp') THEN 'refused' ELSE 'source' END AS kind, 'url-' || substr(sha256(norm_url), 1, 12) AS sid
  FROM cap JOIN no ON no.page_id = cap.item_no),
st AS (SELECT *, CASE WHEN kind = 'refused' THEN 'refuse' WHEN kind = 'source' AND (sid IN (SELECT sid FROM hs) OR row_number() OVER (PARTITION BY kind, sid ORDER BY item_no) > 1) THEN 'duplicate' ELSE 'write' END AS action FROM it),
bs AS (SELECT *, CASE WHEN kind = 'source' THEN sid ELSE '20240506-070809-' || {slug('item')} END AS base FROM st),
tn AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY item_no) + CASE WHEN item <> 'same-words' THEN 0 ELSE 1 END AS t0 FROM bs WHERE action = 'write'),
nd AS (SELECT item_no, CASE WHEN item = 'same-words' AND t0 >= 3 THEN t0 + 1 ELSE t0 END AS t FROM tn),
fn AS (SELECT bs.*, CASE WHEN t IS NULL THEN NULL WHEN t > 100 THEN NULL WHEN t = 1 THEN base ELSE base || '-' || t END AS name, t FROM bs LEFT JOIN nd USING (item_no)),
ac AS (SELECT *, CASE WHEN action = 'write' AND name IS NULL THEN 'refuse' ELSE action END AS act FROM fn)
SELECT item_no, act AS action, kind, CASE WHEN act = 'write' THEN CASE WHEN kind = 'source' THEN 'sources' ELSE 'inbox' END END AS folder, name, CASE WHEN act <> 'refuse' THEN CASE WHEN kind = 'source' THEN sid ELSE name END END AS id,
  CASE WHEN act = 'write' THEN md5('---' || chr(10) || 'id: ' || CASE WHEN kind = 'source' THEN sid ELSE name END || chr(10) || 'created: 2024-05-06T07:08:09+00:00' || chr(10) || CASE WHEN kind = 'source' THEN 'url: "' || item || '"' || chr(10) ELSE '' END || '---' || chr(10) || chr(10) || trim(item) || chr(10)) END AS digest
FROM ac""".replace("WITH nu AS", f"WITH {ITEMS}, nu AS", 1),
    "slugs": f"SELECT doc_id, {slug('x')} AS slug FROM (SELECT doc_id, text AS x FROM documents)",
    "yaml_scalars": r"""WITH c AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN CAST(doc_id AS VARCHAR) WHEN 1 THEN source || '''s' WHEN 2 THEN 'yes' WHEN 3 THEN source || '/x.y' WHEN 4 THEN doc_id || 'e5' ELSE '' END AS c FROM documents)
SELECT doc_id, CASE WHEN doc_id % 6 = 3 THEN c ELSE '''' || replace(c, '''', '''''') || '''' END AS scalar, '"' || c || '\t\"\\"' AS quoted FROM c""",
    "walk_order": f"WITH {NOTES} SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) AS walk_no FROM docs",
    "scan_budget": f"WITH {NOTES}, k AS (SELECT path FROM docs ORDER BY string_split(path, '/') LIMIT 300) SELECT count(*) AS n, max(path) AS most, count(*) >= 300 AS exhausted FROM k",
    "relevance": "SELECT DISTINCT item_id AS query_id, source || '/' || doc_id || '.md' AS path FROM benchmark b JOIN documents d ON contains(d.text, b.text)",
    "retrieval_quality": f"""{SEARCH}, w1 AS (SELECT query_id, path, start_line, score FROM rk WHERE wording_no = 2 AND rank <= 20),
d1 AS (SELECT w1.*, row_number() OVER (PARTITION BY query_id, array_to_string({tok('p.text')}, ' ') ORDER BY round(1.0 / (60 + r), 9) DESC, w1.path, w1.start_line) AS k, r FROM (SELECT query_id, path, start_line, rank AS r, score FROM rk WHERE wording_no = 2 AND rank <= 20) w1 JOIN pas p ON p.path = w1.path AND p.start_line = w1.start_line),
s1 AS (SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY round(1.0 / (60 + r), 9) DESC, path, start_line) AS rank FROM d1 WHERE k = 1),
rel AS (SELECT DISTINCT item_id AS query_id, source || '/' || doc_id || '.md' AS path FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
h1 AS (SELECT query_id, min(rank) AS r FROM s1 JOIN rel USING (query_id, path) WHERE rank <= 5 GROUP BY query_id),
h2 AS (SELECT query_id, min(rank) AS f FROM tp5 JOIN rel USING (query_id, path) WHERE rank <= 5 GROUP BY query_id)
SELECT CASE WHEN query_id % 2 = 0 THEN 'even' ELSE 'odd' END AS kind, count(*) AS answerable, count(*) FILTER (WHERE r = 1) AS top1, count(*) FILTER (WHERE r <= 3) AS top3, count(*) FILTER (WHERE r <= 5) AS top5, count(*) FILTER (WHERE r IS NULL) AS missed, count(*) FILTER (WHERE r IS NULL AND f IS NOT NULL) AS rescued
FROM (SELECT DISTINCT query_id FROM rel) LEFT JOIN h1 USING (query_id) LEFT JOIN h2 USING (query_id) GROUP BY 1""",
    "context_cost": f"{SEARCH}, r5 AS (SELECT * FROM tp5 WHERE rank <= 5) SELECT r.query_id, count(*) AS results, count(DISTINCT r.path) AS files, CAST(sum(octet_length(encode(r.text))) AS BIGINT) AS text_bytes, CAST(any_value(w.b) AS BIGINT) AS whole_note_bytes FROM r5 r JOIN (SELECT query_id, sum(octet_length(encode(d.text))) AS b FROM (SELECT DISTINCT query_id, path FROM r5) JOIN docs d USING (path) GROUP BY query_id) w ON w.query_id = r.query_id GROUP BY r.query_id",
    "median_lengths": "SELECT lang, quantile_cont(length(text), 0.5) AS median FROM documents GROUP BY lang",
    "field_usage": f"""WITH {GRAPH}, f AS (SELECT doc_no, list_filter([CASE WHEN id IS NOT NULL THEN 'id' END, CASE WHEN h1 IS NOT NULL THEN 'h1' END, 'aliases', CASE WHEN doc_no % 3 = 0 THEN 'kind' END], lambda x: x IS NOT NULL) AS f FROM g),
n AS (SELECT len(f) AS n, row_number() OVER (ORDER BY len(f)) - 1 AS i, count(*) OVER () AS k FROM f)
SELECT field, count(*) AS files FROM (SELECT unnest(f) AS field FROM f) GROUP BY field
UNION ALL SELECT '<least>', min(n) FROM n UNION ALL SELECT '<median>', min(n) FROM n WHERE i = k // 2 UNION ALL SELECT '<most>', max(n) FROM n""",
    "about_usage": f"WITH {GRAPH}, a AS (SELECT path, list_distinct(list_transform(about_names, lambda x: lower(x))) AS a, [lower(source), CAST(doc_no AS VARCHAR)] AS b FROM g) SELECT path, CAST(len(list_filter(a, lambda x: NOT list_contains(b, x))) AS BIGINT) AS added, CAST(len(list_filter(a, lambda x: list_contains(b, x))) AS BIGINT) AS mirrored FROM a",
}

SQL |= boards.sql(NOTES, spans_of) | files.sql(spans_of)

_LOST = "No passage shares a word with that question.\nTry other wordings: that is what this kind of search works by.\n"
_UNREAD = "/notes/ holds more files than one search reads, so this ranking covers only a part of it.\n"


def _share(c: str, at: int) -> str:
    x = f"(CAST('0x' || substr({c}, {at}, 2) AS INTEGER) / 255.0::DOUBLE)"
    return f"(CASE WHEN {x} <= 0.03928 THEN {x} / 12.92 ELSE pow(({x} + 0.055) / 1.055, 2.4) END)"


def _light(c: str) -> str:
    return f"0.2126::DOUBLE * {_share(c, 2)} + 0.7152::DOUBLE * {_share(c, 4)} + 0.0722::DOUBLE * {_share(c, 6)}"


SQL |= {
    "search_report": f"""WITH {DOCS}, w1 AS (SELECT item_id AS query_id, regexp_split_to_array(text, '\\s+') AS w FROM benchmark WHERE text IS NOT NULL),
wd AS (SELECT query_id, 0 AS wording_no, array_to_string(w[1:8], ' ') AS wording FROM w1), {scoring('wd', METADATA_WEIGHT)}, {FUSED},
al AS (SELECT query_id FROM wd UNION ALL SELECT -query_id - 1 FROM wd)
SELECT al.query_id, md5(coalesce(path || ':' || start_line || '-' || end_line || '  score 0.5000' || chr(10) || '/notes/' || path || chr(10)
  || array_to_string(list_transform(string_split(t.text, chr(10)), lambda x: CASE WHEN x = '' THEN '' ELSE '    ' || x END), chr(10)) || chr(10), '{_LOST}')) AS digest, {len(_UNREAD)} AS err
FROM al LEFT JOIN tp5 t ON t.query_id = al.query_id AND rank = 1""",
    "context_economy": f"SELECT count(*) AS questions, CAST(sum(text_bytes) AS BIGINT) AS text_bytes, CAST(sum(whole_note_bytes) AS BIGINT) AS whole_note_bytes, floor(sum(whole_note_bytes)::DOUBLE * 100 / sum(text_bytes)) / 100 AS saving FROM ({SQL['context_cost']})",
    "relevance_rules": rf"""{SEARCH}, ru AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'src' || item_id % 10 || '/' END AS file, CASE WHEN item_id % 2 = 1 THEN '(?i)' || lower(regexp_extract(text, '([A-Za-z]{{4,}})', 1)) || '[ .,]' END AS pattern FROM benchmark WHERE text IS NOT NULL)
SELECT DISTINCT query_id, path FROM tp5 JOIN ru ON item_id = query_id WHERE rank <= 5 AND (coalesce(contains(lower(path), file), false) OR coalesce(regexp_matches(tp5.text, pattern), false))""",
    "doc_sections": r"""WITH l0 AS (SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
l1 AS (
  SELECT doc_id, i, 0 AS k, CASE WHEN (i + doc_id) % 5 = 2 THEN '## Part ' || i || ' - é!' WHEN (i + doc_id) % 7 = 3 THEN '```js' END AS line FROM l0
  UNION ALL SELECT doc_id, i, 1, line FROM l0),
l2 AS (SELECT *, count(*) FILTER (starts_with(line, '```')) OVER (PARTITION BY doc_id ORDER BY i, k) % 2 = 1 AS fenced FROM l1 WHERE line IS NOT NULL),
l3 AS (SELECT *, NOT fenced AND regexp_full_match(line, '## .+') AS head FROM l2),
l4 AS (SELECT *, count(*) FILTER (head) OVER (PARTITION BY doc_id ORDER BY i, k) AS part FROM l3),
p AS (SELECT doc_id, part, max(substr(line, 4)) FILTER (head) AS heading, coalesce(string_agg(line, chr(10) ORDER BY i, k) FILTER (NOT head), '') AS body FROM l4 WHERE part > 0 GROUP BY ALL)
SELECT doc_id, heading, regexp_replace(regexp_replace(lower(heading), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, md5(regexp_replace(regexp_replace(body, '^\s+', ''), '\s+$', '')) AS digest FROM p""",
    "colour_contrast": f"""WITH c AS (SELECT doc_id, '#' || substr(md5(text), 1, 6) AS a, '#' || substr(md5(text), 7, 6) AS b FROM documents),
l AS (SELECT doc_id, {_light("a")} AS x, {_light("b")} AS y FROM c),
r AS (SELECT doc_id, CASE WHEN doc_id % 9 <> 4 THEN floor((greatest(x, y) + 0.05) / (least(x, y) + 0.05) * 100) / 100 END AS r FROM l)
SELECT doc_id, printf('%.2f', r) AS ratio, r >= 4.5 AS text, r >= 3 AS large FROM r""",
}
