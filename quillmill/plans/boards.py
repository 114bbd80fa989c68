"""Registered queries over tickets, module graphs, citations and JSON documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.width import cell_width, character_class
from ..operators import evidence, graphs, schema, spans, tickets
from ..operators.stored import spread, stored
from ..sources import boards, corpus

WORKERS = 40


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark, sf_dir):
    return _table(spark, sf_dir, "documents")


def _tickets(spark, sf_dir):
    return stored(tickets.read_tickets(spread(boards.tickets_of_documents(_documents(spark, sf_dir)), "key")), "tickets")


def _claims(spark, sf_dir):
    trees, branches, refs, live = boards.claim_sources(_documents(spark, sf_dir))
    return tickets.merge_claims(trees, branches, refs), live


def _edges(spark, sf_dir):
    """(src, dst): from a required module to the one that requires it, in one graph of all lessons."""
    m = boards.modules_of_documents(_documents(spark, sf_dir))
    asked = m.select("lesson", F.col("module_no").alias("dst"), F.explode("requires").alias("id"))
    return m, asked.join(m.select("lesson", "id", F.col("module_no").alias("src")), ["lesson", "id"]).select("src", "dst")


# --- tickets ---


def ticket_extraction(spark, sf_dir):
    t = _tickets(spark, sf_dir)
    return t.select("key", "status", F.array_join("blockers", ",").alias("blockers"), "n_changes", F.array_join("paths", ",").alias("paths"), F.array_join("areas", ",").alias("areas"))


def ticket_order(spark, sf_dir):
    """Tickets numbered in the order of their keys, over all tasks."""
    t = stored(tickets.in_key_order(_tickets(spark, sf_dir), spark.sparkContext.defaultParallelism).withColumn("at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("at", 33)
    first = t.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    # one row a task
    from pyspark.sql.window import Window

    base = first.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return t.withColumn("part", part).join(F.broadcast(base), "part").select((F.col("base") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("place"), "key")


def ticket_board(spark, sf_dir):
    b = tickets.board(_tickets(spark, sf_dir))
    return b.select("key", "status", "eligible", F.array_join("waiting", ",").alias("waiting"), F.array_join("missing", ",").alias("missing"), "reason")


def path_overlap(spark, sf_dir):
    return tickets.path_overlaps(_tickets(spark, sf_dir).select("key", F.explode("areas").alias("path")))


def ticket_estimates(spark, sf_dir):
    t, (claims, _) = _tickets(spark, sf_dir), _claims(spark, sf_dir)
    return tickets.estimates(t, t.join(claims.where("not orphan").select("key"), "key", "left_semi").select("key", "areas"))


def dispatch_plan(spark, sf_dir):
    claims, live = _claims(spark, sf_dir)
    claims = claims.join(live.withColumn("live", F.lit(True)), "key", "left").withColumn("live", F.coalesce("live", F.lit(False)))
    return tickets.dispatch_plan(_tickets(spark, sf_dir), stored(claims, "claims"), WORKERS)


def claims_merged(spark, sf_dir):
    return _claims(spark, sf_dir)[0]


def status_view(spark, sf_dir):
    claims, live = _claims(spark, sf_dir)
    return tickets.status_view(_tickets(spark, sf_dir), claims, live).drop("title")


# --- graphs ---


def module_graph(spark, sf_dir):
    return graphs.module_findings(boards.modules_of_documents(_documents(spark, sf_dir)))


def strong_components(spark, sf_dir):
    return graphs.strong_components(_edges(spark, sf_dir)[1])


def graph_layers(spark, sf_dir):
    m, edges = _edges(spark, sf_dir)
    return graphs.layers(m.select(F.col("module_no").alias("node")), edges).withColumn("layer", F.col("layer").cast("long"))


# --- evidence, schema, width ---


def evidence_codes(spark, sf_dir):
    return evidence.check_citations(boards.citations_of_conversations(_table(spark, sf_dir, "conversations")), boards.files_of_documents(_documents(spark, sf_dir)))


def evidence_passages(spark, sf_dir):
    notes = corpus.notes_of_documents(_documents(spark, sf_dir)).withColumn("path", F.format_string("doc/%d.md", "doc_no"))
    cites = boards.citations_of_conversations(_table(spark, sf_dir, "conversations"))
    return evidence.cited_passages(cites, spans.split_spans(spread(notes, "path")))


def schema_findings(spark, sf_dir):
    d = boards.json_of_documents(_documents(spark, sf_dir))
    x = d.select("doc_id", F.explode(schema.schema_findings(F.col("value"), boards.NOTE_SCHEMA)).alias("x"))
    return x.select("doc_id", "x.path", "x.keyword", "x.property")


def display_width(spark, sf_dir):
    d = _documents(spark, sf_dir).where("text is not null")
    marked = F.concat("text", F.when(F.col("doc_id") % 3 == 0, F.lit("漢字 é 👍🏽")).otherwise(F.lit("")))
    return d.select("doc_id", cell_width(marked).alias("width"), F.array_max(F.transform(F.split(marked, "\n"), cell_width)).alias("widest"))


QUERIES = {f.__name__: f for f in (ticket_extraction, ticket_order, ticket_board, path_overlap, ticket_estimates, dispatch_plan, claims_merged, status_view, module_graph, strong_components, graph_layers, evidence_codes, evidence_passages, schema_findings, display_width)}

_KEY = "CAST({0} // 50 + 1 AS VARCHAR) || '.' || CAST({0} % 50 + 1 AS VARCHAR)"

# tickets' fields straight from the numbers that their texts are written from
_TICKETS = f"""d AS (SELECT doc_id AS i, length(coalesce(text, '')) AS n, coalesce(source, 'none') AS src FROM documents WHERE doc_id IS NOT NULL),
t AS (
  SELECT i, {_KEY.format("i")} AS key, i // 50 + 1 AS k1, i % 50 + 1 AS k2,
    ['Complete', 'Complete', 'In Progress', 'Cancelled', 'Superseded', 'Proposed', 'Ready', 'Ready', 'Ready', 'Complete', 'Unrecognised', 'Unrecognised'][(n * 7 + i) % 12 + 1] AS status,
    list_concat(CASE WHEN i - 1 - n % 9 >= 0 THEN [{_KEY.format("(i - 1 - n % 9)")}] ELSE [] END,
      CASE WHEN i % 3 = 0 AND i - 17 - n % 5 >= 0 THEN [{_KEY.format("(i - 17 - n % 5)")}] ELSE [] END, CASE WHEN i % 29 = 0 THEN ['999999.1'] ELSE [] END) AS blockers,
    1 + n % 10 AS n_changes,
    list_sort(list_concat(['src/' || src || '/part' || n % 97 || '/file' || i * 17 % 41 || '.mjs', CASE WHEN i % 5 = 0 THEN 'src/' || src || '/part' || n % 97 ELSE 'lib/' || i % 7 END],
      CASE WHEN i % 4 = 0 THEN ['docs/a' || i % 1000 || '.md', 'docs/b' || i % 1000 || '.md'] ELSE [] END)) AS areas
  FROM d),
tk AS (SELECT * REPLACE (list_distinct_(blockers) AS blockers) FROM t)""".replace("list_distinct_(blockers)", "list_filter(blockers, lambda x, j: list_position(blockers, x) = j)")

_CLAIMS = f"""w AS (
  SELECT {_KEY.format("i")} AS key, 'worktree' AS source, 'ticket/' || {_KEY.format("i")} AS branch, '.work/' || {_KEY.format("i")} AS worktree, CAST(NULL AS VARCHAR) AS elsewhere,
    ['working', 'review', 'human-gate', 'invalid:lost', NULL, 'failed'][i % 6 + 1] AS state, CASE WHEN i % 6 = 2 THEN 'a person decides' END AS gate, false AS orphan
  FROM d WHERE i % 19 = 1),
br AS (
  SELECT {_KEY.format("i")} AS key, 'branch', 'ticket/' || {_KEY.format("i")}, NULL, CASE WHEN i % 2 = 0 THEN '/other/' || {_KEY.format("i")} END, NULL, NULL, true
  FROM d WHERE i % 23 = 2 AND i % 19 <> 1),
rf AS (
  SELECT CASE WHEN i % 101 = 0 THEN '888888.' || i ELSE {_KEY.format("i")} END AS key, 'ref', NULL, NULL, NULL, NULL, NULL, true
  FROM d WHERE i % 101 = 0 OR i % 31 = 3 AND i % 19 <> 1 AND i % 23 <> 2),
cl AS (SELECT * FROM w UNION ALL SELECT * FROM br UNION ALL SELECT * FROM rf),
lv AS (SELECT {_KEY.format("i")} AS key FROM d WHERE i % 38 = 1)"""

_BOARD = """bl AS (SELECT key, j, blockers[j] AS b FROM tk, LATERAL (SELECT unnest(range(1, len(blockers) + 1)) AS j)),
bs AS (SELECT bl.*, s.status AS bst FROM bl LEFT JOIN tk s ON s.key = bl.b),
bm AS (
  SELECT key, count(*) FILTER (bst = 'Complete') AS complete, string_agg(b, ',' ORDER BY j) FILTER (bst IN ('Proposed', 'Ready', 'In Progress')) AS waiting, string_agg(b, ',' ORDER BY j) FILTER (bst IS NULL) AS missing,
    string_agg(CASE WHEN bst IS NULL THEN 'blocker ' || b || ' does not exist' WHEN bst = 'Unrecognised' THEN 'blocker ' || b || ' has an unrecognised status' ELSE 'blocker ' || b || ' is ' || bst || ' — a planning question' END, '; ' ORDER BY j)
      FILTER (bst IS NULL OR bst IN ('Unrecognised', 'Cancelled', 'Superseded')) AS problems
  FROM bs GROUP BY key),
bd AS (
  SELECT tk.key, i, status, areas, n_changes, k1, k2, status IN ('Proposed', 'Ready') AS may, may AND coalesce(complete, 0) = len(blockers) AS eligible,
    CASE WHEN may THEN coalesce(waiting, '') ELSE '' END AS waiting, CASE WHEN may THEN coalesce(missing, '') ELSE '' END AS missing,
    CASE WHEN status = 'Unrecognised' THEN 'status unrecognised' WHEN NOT may THEN lower(status) WHEN problems IS NOT NULL THEN problems WHEN waiting IS NOT NULL THEN 'blocked by ' || replace(waiting, ',', ', ') END AS reason
  FROM tk LEFT JOIN bm ON bm.key = tk.key)"""

_PATHS = r"""ar AS (SELECT key, k1, k2, unnest(areas) AS path FROM tk),
ap AS (SELECT key, k1, k2, path, regexp_matches(path, '(?i)\.[a-z0-9]+$') AS file FROM ar)"""

_SAFETY = """fl AS (SELECT ap.* FROM ap WHERE key IN (SELECT key FROM w)),
hit AS (
  SELECT m.key, m.path AS mine, o.path AS their, o.key AS other, NOT (m.path = o.path AND m.file) AS soft, row_number() OVER (PARTITION BY m.key ORDER BY NOT (m.path = o.path AND m.file), o.k1, o.k2, o.path, m.path) AS r
  FROM ap m JOIN fl o ON o.key <> m.key AND (m.path = o.path OR NOT m.file AND starts_with(o.path, m.path || '/') OR NOT o.file AND starts_with(m.path, o.path || '/'))),
sf AS (
  SELECT tk.key, CASE WHEN h.key IS NULL THEN 'isolated' WHEN soft THEN 'shared-surface' ELSE 'serialize' END AS safety,
    CASE WHEN (SELECT count(*) FROM tk x WHERE x.key IN (SELECT key FROM w) AND x.key <> tk.key) = 0 THEN 'no other ticket is in flight' WHEN h.key IS NULL THEN 'no Relevant area overlaps an in-flight ticket'
      WHEN soft THEN mine || ' overlaps ' || their || ' in ' || other ELSE 'names ' || mine || ', which ' || other || ' also names' END AS safety_reason
  FROM tk LEFT JOIN hit h ON h.key = tk.key AND h.r = 1)"""

_MODULES = """m AS (
  SELECT i % 40 AS lesson, i AS module_no, 'm' || i // 40 AS id, CASE WHEN i // 40 = 0 THEN [] ELSE list_concat([CASE WHEN k % 13 = 12 THEN 'm-none' ELSE 'm' || k // 4 END], CASE WHEN k % 5 = 2 THEN ['m' || k // 3] ELSE [] END,
    CASE WHEN k % 11 = 7 THEN ['m-none'] ELSE [] END, CASE WHEN i % 40 % 3 = 0 AND k % 6 = 1 THEN ['m' || k * 4 + 1] ELSE [] END, CASE WHEN k % 17 = 9 THEN ['m' || k] ELSE [] END, CASE WHEN n % 7 = 3 THEN ['m' || k // 2] ELSE [] END) END AS requires
  FROM (SELECT doc_id AS i, doc_id // 40 AS k, length(coalesce(text, '')) AS n FROM documents WHERE doc_id IS NOT NULL)),
rq AS (SELECT lesson, module_no, j - 1 AS item, requires[j] AS reference FROM m, LATERAL (SELECT unnest(range(1, len(requires) + 1)) AS j)),
mt AS (SELECT rq.*, x.module_no AS src FROM rq LEFT JOIN m x ON x.lesson = rq.lesson AND x.id = rq.reference),
ed AS (SELECT DISTINCT lesson, src, module_no AS dst FROM mt WHERE src IS NOT NULL),
rc AS (SELECT lesson, src, dst FROM ed WHERE src <> dst UNION SELECT rc.lesson, rc.src, ed.dst FROM rc JOIN ed ON ed.src = rc.dst),
sc AS (SELECT node, min(o) AS component FROM (SELECT a.src AS node, a.dst AS o FROM rc a JOIN rc b ON b.src = a.dst AND b.dst = a.src UNION ALL SELECT src, src FROM ed WHERE src = dst) GROUP BY node)"""

_WIDE, _NONE = character_class(2), character_class(0)
_WIDTH = lambda c: f"CAST(length({c}) + length(regexp_replace({c}, '[^{_WIDE}]+', '', 'g')) - length(regexp_replace({c}, '[^{_NONE}]+', '', 'g')) AS BIGINT)"

_CITES = """ct AS (
  SELECT conv_id * 1000 + turn AS citation_no, 'c' || conv_id % 3 AS commit, 'doc/' || (conv_id * 9 + turn) || '.md' AS path, 1 + turn % 5 * 2 AS first_line, 1 + turn % 5 * 2 + length(coalesce(text, '')) % 7 - 1 AS last_line
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)"""


def _schema_sql() -> str:
    """One branch for each rule of ``NOTE_SCHEMA``, on the columns that the documents' JSON is made of."""
    note, body = "ok", "ok AND i % 5 < 4"
    rules = [
        ("i % 31 = 8", "(root)", "json", None),
        (f"{note} AND i % 19 = 4", "kind", "const", None),
        (f"{note} AND i % 17 = 5", "id", "required", "id"),
        (f"{note} AND i % 17 <> 5 AND i < 10", "id", "minimum", None),
        (f"{note} AND (i % 23 = 6 OR word IS NULL)", "title", "required", "title"),
        (f"{note} AND i % 23 <> 6 AND length(word) < 3", "title", "minLength", None),
        (f"{note} AND i % 23 <> 6 AND length(word) > 12", "title", "maxLength", None),
        (f"{note} AND i % 23 <> 6 AND NOT regexp_matches(word, '^[A-Z]')", "title", "pattern", None),
        (f"{note} AND lang NOT IN ('de', 'en', 'fr')", "lang", "enum", None),
        (f"{note} AND i % 7 = 0", "tags", "maxItems", None),
        (f"{note} AND i % 7 = 0", "tags[2]", "uniqueItems", None),
        (f"{note} AND lang = src", "tags[1]", "uniqueItems", None),
        (f"{note} AND length(coalesce(lang, '??')) < 3", "tags[0]", "minLength", None),
        (f"{note} AND length(src) < 3", "tags[1]", "minLength", None),
        (f"{note} AND i % 7 = 0 AND length(src) < 3", "tags[2]", "minLength", None),
        (f"{note} AND n / 10 > 250", "score", "maximum", None),
        (f"{note} AND i % 5 = 4", "body", "required", "body"),
        (f"{body} AND i % 5 IN (2, 3)", "body.type", "oneOf", "type"),
        (f"{body} AND i % 5 = 0 AND text IS NULL", "body.text", "required", "text"),
        (f"{body} AND i % 5 = 0 AND length(text) > 1000", "body.text", "maxLength", None),
        (f"{body} AND i % 5 = 1 AND n > 900", "body.items[0]", "maximum", None),
        (f"{body} AND i % 5 = 1 AND i > 900", "body.items[1]", "maximum", None),
        (f"{body} AND i % 25 = 1", "body.more", "additionalProperties", "more"),
        (f"{note} AND i % 29 = 7", "extra", "additionalProperties", "extra"),
        (f"{note} AND lang = 'en' AND (i % 3 = 0 OR source IS NULL)", "source", "required", "source"),
    ]
    value = lambda x: "NULL" if x is None else f"'{x}'"
    return "WITH d AS (SELECT doc_id AS i, doc_id % 31 <> 8 AS ok, text, lang, source, coalesce(source, 'none') AS src, length(coalesce(text, '')) AS n, string_split(coalesce(text, ''), ' ')[1] AS word FROM documents WHERE doc_id IS NOT NULL)\n" + "\nUNION ALL ".join(f"SELECT i AS doc_id, '{p}' AS path, '{k}' AS keyword, CAST({value(name)} AS VARCHAR) AS property FROM d WHERE {when}" for when, p, k, name in rules)


def sql(notes: str, spans_of) -> dict[str, str]:
    docs = notes.replace("coalesce(source, 'none') || '/' || doc_id || '.md' AS path", "'doc/' || doc_id || '.md' AS path")
    return {
        "ticket_extraction": f"WITH {_TICKETS} SELECT key, status, array_to_string(blockers, ',') AS blockers, n_changes, array_to_string(list_sort(list_append(areas, 'README.md')), ',') AS paths, array_to_string(areas, ',') AS areas FROM tk",
        "ticket_order": f"WITH {_TICKETS} SELECT row_number() OVER (ORDER BY k1, k2) AS place, key FROM tk",
        "ticket_board": f"WITH {_TICKETS}, {_BOARD} SELECT key, status, eligible, waiting, missing, CASE WHEN NOT eligible THEN reason END AS reason FROM bd",
        "path_overlap": f"""WITH {_TICKETS}, {_PATHS}, n AS (SELECT path, any_value(file) AS file, count(DISTINCT key) AS n FROM ap GROUP BY path)
SELECT path, path AS inner, 'equal' AS kind, n AS n_path, n AS n_inner FROM n WHERE n > 1
UNION ALL SELECT a.path, b.path, 'contains', a.n, b.n FROM n a JOIN n b ON NOT a.file AND starts_with(b.path, a.path || '/')""",
        "ticket_estimates": f"""WITH {_TICKETS}, {_CLAIMS}, {_PATHS}, {_SAFETY},
e AS (SELECT tk.key, CASE WHEN n_changes <= 3 THEN 'low' WHEN n_changes <= 7 THEN 'medium' ELSE 'high' END AS complexity, CASE WHEN len(areas) + 1 <= 3 THEN 'small' WHEN len(areas) + 1 <= 8 THEN 'medium' ELSE 'large' END AS context, safety, safety_reason FROM tk JOIN sf ON sf.key = tk.key)
SELECT *, CASE WHEN complexity = 'low' AND context = 'small' AND safety = 'isolated' THEN 'low' WHEN complexity = 'high' AND context = 'large' THEN 'high' ELSE 'unassessed' END AS risk FROM e""",
        "dispatch_plan": f"""WITH RECURSIVE {_TICKETS}, {_CLAIMS}, {_BOARD}, {_PATHS},
busy AS (SELECT greatest(0, {WORKERS} - count(*)) AS slots FROM w WHERE key IN (SELECT key FROM lv) AND coalesce(state, 'working') IN ('working', 'review')),
held AS (SELECT DISTINCT path, key, k1, k2 FROM ap WHERE file AND key IN (SELECT key FROM w)),
cand AS (SELECT key, k1, k2, row_number() OVER (ORDER BY k1, k2) AS r, (SELECT coalesce(list(path), []) FROM ap WHERE ap.key = bd.key AND file) AS files FROM bd WHERE eligible AND key NOT IN (SELECT key FROM cl)),
walk AS (
  SELECT CAST(0 AS BIGINT) AS r, CAST([] AS VARCHAR[]) AS taken, CAST(0 AS BIGINT) AS used, CAST(NULL AS VARCHAR) AS key, false AS chosen
  UNION ALL SELECT c.r, CASE WHEN ok THEN list_concat(taken, files) ELSE taken END, used + CAST(ok AS BIGINT), c.key, ok
  FROM (SELECT c.*, taken, used, used < (SELECT slots FROM busy) AND NOT list_has_any(taken, files) AND NOT list_has_any((SELECT coalesce(list(path), []) FROM held), files) AS ok FROM walk JOIN cand c ON c.r = walk.r + 1) c),
pick AS (SELECT c.* FROM cand c JOIN walk ON walk.key = c.key AND chosen),
conf AS (
  SELECT c.key, x.path, x.key AS other, row_number() OVER (PARTITION BY c.key ORDER BY x.k1, x.k2, x.path) AS o
  FROM cand c JOIN ap m ON m.key = c.key AND m.file JOIN (SELECT path, key, k1, k2, 0 AS r FROM held UNION ALL SELECT ap.path, ap.key, ap.k1, ap.k2, p.r FROM ap JOIN pick p ON p.key = ap.key AND ap.file) x ON x.path = m.path AND x.r < c.r)
SELECT key, 'dispatch' AS decision, CAST(NULL AS VARCHAR) AS reason FROM pick
UNION ALL SELECT c.key, 'deferred', CASE WHEN f.key IS NOT NULL THEN 'serialize: names ' || f.path || ', which ' || f.other || ' also names' ELSE 'worker limit {WORKERS} reached' END FROM cand c LEFT JOIN conf f ON f.key = c.key AND o = 1 WHERE c.key NOT IN (SELECT key FROM pick)
UNION ALL SELECT key, 'blocked', reason FROM bd WHERE NOT eligible AND status NOT IN ('Complete', 'Cancelled', 'Superseded') AND key NOT IN (SELECT key FROM cl)""",
        "claims_merged": f"WITH {_TICKETS}, {_CLAIMS} SELECT * FROM cl",
        "status_view": f"""WITH {_TICKETS}, {_CLAIMS}, {_BOARD},
j AS (SELECT coalesce(bd.key, cl.key) AS key, coalesce(status, '—') AS st, cl.key IS NOT NULL AS claimed, coalesce(lv.key IS NOT NULL, false) AS live, eligible, reason, cl.* EXCLUDE (key) FROM bd FULL JOIN cl ON cl.key = bd.key LEFT JOIN lv ON lv.key = coalesce(bd.key, cl.key))
SELECT key, st AS lifecycle,
  CASE WHEN st = 'Complete' THEN 'integrated'
    WHEN claimed THEN CASE WHEN st IN ('Cancelled', 'Superseded') OR orphan THEN 'stale' WHEN state IS NULL THEN CASE WHEN live THEN 'working' ELSE 'stale' END WHEN starts_with(state, 'invalid:') OR state IN ('working', 'review') AND NOT live THEN 'stale' ELSE state END
    WHEN st = 'In Progress' THEN 'working' WHEN eligible THEN 'ready' ELSE 'blocked' END AS state,
  CASE WHEN claimed AND NOT orphan THEN branch || ' @ ' || worktree
    WHEN claimed AND st NOT IN ('Complete', 'Cancelled', 'Superseded') THEN CASE WHEN elsewhere IS NOT NULL THEN branch || ' @ ' || elsewhere || ' (elsewhere)' WHEN branch IS NOT NULL THEN branch || ' (branch only)' ELSE 'claim ref only' END
    WHEN NOT claimed AND st = 'In Progress' THEN 'no claim' ELSE '—' END AS place,
  CASE WHEN claimed AND st IN ('Cancelled', 'Superseded') THEN 'ticket is ' || st || ' but still claimed; release it'
    WHEN claimed AND st <> 'Complete' AND orphan THEN CASE WHEN elsewhere IS NOT NULL THEN 'checked out elsewhere; a person decides' ELSE 'worktree missing; resume or release' END
    WHEN claimed AND st <> 'Complete' AND starts_with(state, 'invalid:') THEN 'state file says ' || substr(state, 9)
    WHEN claimed THEN coalesce(gate, '—') WHEN NOT eligible AND st NOT IN ('Complete', 'In Progress') THEN coalesce(reason, '—') ELSE '—' END AS gate
FROM j WHERE claimed OR st NOT IN ('Cancelled', 'Superseded')""",
        "module_graph": f"""WITH RECURSIVE {_MODULES},
cy AS (SELECT DISTINCT lesson FROM rc WHERE src = dst AND EXISTS (SELECT 1 FROM rc o WHERE o.src = rc.src AND o.dst <> rc.src AND EXISTS (SELECT 1 FROM rc b WHERE b.src = o.dst AND b.dst = rc.src))),
up AS (SELECT lesson, module_no AS node FROM m WHERE len(requires) = 0 UNION SELECT ed.lesson, ed.dst FROM up JOIN ed ON ed.src = up.node)
SELECT lesson, module_no, CAST(item AS INTEGER) AS item, 'unresolved_reference' AS code, reference FROM mt WHERE src IS NULL
UNION ALL SELECT lesson, module_no, CAST(item AS INTEGER), 'graph_cycle', reference FROM mt WHERE src = module_no
UNION ALL SELECT lesson, NULL, NULL, 'graph_cycle', NULL FROM cy
UNION ALL SELECT lesson, module_no, NULL, 'orphan_module', NULL FROM m WHERE lesson NOT IN (SELECT lesson FROM cy) AND module_no NOT IN (SELECT node FROM up)""",
        "strong_components": f"WITH RECURSIVE {_MODULES} SELECT node, component FROM sc",
        "graph_layers": f"""WITH RECURSIVE {_MODULES},
fw AS (SELECT src, dst FROM ed LEFT JOIN sc a ON a.node = src LEFT JOIN sc b ON b.node = dst WHERE NOT (src >= dst AND a.component IS NOT NULL AND a.component IS NOT DISTINCT FROM b.component)),
lp AS (SELECT module_no AS node, CAST(0 AS BIGINT) AS layer FROM m UNION SELECT dst, layer + 1 FROM lp JOIN fw ON fw.src = lp.node)
SELECT node, max(layer) AS layer FROM lp GROUP BY node""",
        "evidence_codes": f"""WITH {_CITES}, f AS (SELECT 'c' || doc_id % 2 AS commit, 'doc/' || doc_id || '.md' AS path, max(len(string_split(coalesce(text, ''), chr(10)))) AS n FROM documents WHERE doc_id IS NOT NULL GROUP BY ALL)
SELECT citation_no, CASE WHEN ct.commit NOT IN (SELECT commit FROM f) THEN 'source_commit_unavailable' WHEN n IS NULL THEN 'evidence_path_absent' WHEN last_line < first_line OR last_line > n THEN 'evidence_range_invalid' END AS code
FROM ct LEFT JOIN f ON f.commit = ct.commit AND f.path = ct.path""",
        "evidence_passages": f"""WITH {docs}, {spans_of("docs")}, {_CITES}
SELECT citation_no, p.path, p.start_line, p.end_line, CAST(least(last_line, end_line) - greatest(first_line, start_line) + 1 AS BIGINT) AS lines FROM ct JOIN pas p ON p.path = ct.path AND first_line <= end_line AND start_line <= last_line WHERE first_line <= last_line""",
        "schema_findings": _schema_sql(),
        "display_width": f"""WITH d AS (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN '漢字 e' || chr(769) || ' 👍🏽' ELSE '' END AS t FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, t, unnest(string_split(t, chr(10))) AS line FROM d)
SELECT doc_id, any_value({_WIDTH("t")}) AS width, max({_WIDTH("line")}) AS widest FROM l GROUP BY doc_id""",
    }
