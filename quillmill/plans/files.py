"""Registered queries over files as they are written: frontmatter, findings, edits and manifests, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edit, manifest, spans, validate
from ..operators.stored import spread
from ..sources import frontmatter, written


def _documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _files(spark, sf_dir):
    return spread(written.files_of_documents(_documents(spark, sf_dir)), "path")


def frontmatter_fields(spark, sf_dir):
    """Every file's typed view, its block's place and what could not be read, by the reader."""
    d = frontmatter.read_documents(_files(spark, sf_dir))
    listed = lambda c: F.array_join(c, "|").alias(c)
    return d.select(
        "path", "id", "created", listed("tags"), listed("aliases"), listed("derived_from"), listed("duplicate_keys"), listed("unread_scalars"), listed("unread_lists"), F.array_join(F.transform("dropped", lambda x: F.format_string("%s %d %d", x["field"], x["n"], x["of"])), "|").alias("dropped"),
        listed("fields"), F.col("parse_error").isNotNull().alias("unread"), F.col("body_line").cast("long").alias("body_line"), F.col("block_start").cast("long").alias("block_start"), F.col("block_end").cast("long").alias("block_end"), "eol", "written_title", F.md5("body").alias("body"),
    )


def file_passages(spark, sf_dir):
    """Passages of whole files: lines are counted from the file's start, the block's included."""
    return spans.split_spans(frontmatter.read_documents(_files(spark, sf_dir))).select("path", F.col("start_line").cast("long").alias("start_line"), F.md5("text").alias("digest"))


def file_findings(spark, sf_dir):
    return validate.document_findings(frontmatter.read_documents(_files(spark, sf_dir))).select("path", "field", "code", "severity", "rule", "item")


def edits_added(spark, sf_dir):
    """The files after an id is added to their sources, byte for byte."""
    d = edit.add_edges(_files(spark, sf_dir).withColumn("source_id", F.concat(F.lit("src-"), F.col("doc_no").cast("string"))))
    return d.select("path", "result.changed", "result.code", F.size("result.edits").cast("long").alias("n_edits"), F.md5("result.text").alias("digest"))


def edits_removed(spark, sf_dir):
    """The files after the first of their sources is taken out."""
    half = F.concat(F.lit("id-"), F.when(F.col("doc_no") % 8 == 7, F.col("doc_no")).otherwise(F.floor(F.col("doc_no") / 2)).cast("string"))
    d = edit.remove_edges(_files(spark, sf_dir).withColumn("source_id", half))
    return d.select("path", "result.changed", "result.code", F.md5("result.text").alias("digest"))


def manifest_parse(spark, sf_dir):
    d = manifest.parse_manifest(written.manifests_of_documents(_documents(spark, sf_dir)))
    return d.select("doc_no", "code", F.when(F.col("code").isNull(), F.size("files")).cast("long").alias("n_files"))


QUERIES = {f.__name__: f for f in (frontmatter_fields, file_passages, file_findings, edits_added, edits_removed, manifest_parse)}

_FILES = r"""f AS (
  SELECT doc_id AS i, doc_id % 8 AS s, doc_id // 2 AS half, 'notes/' || doc_id || '.md' AS path, coalesce(text, '') AS body, coalesce(lang, 'none') AS lang, chr(10) AS n, chr(13) || chr(10) AS rn FROM documents WHERE doc_id IS NOT NULL),
b AS (
  SELECT *, CASE s WHEN 1 THEN 'id: n' || i || n || 'tags: [' || lang || ', two words]' || n || 'derived_from: [id-' || half || ', ''x y'']' || n WHEN 2 THEN 'id: "n' || i || '"' || rn || 'derived_from:' || rn || '  - id-' || half || rn || '  - other # why' || rn
    WHEN 3 THEN 'id: first' || n || 'id: m' || i || n || 'kind: [a]' || n || 'about: {a: b}' || n || 'aliases: [x, [y], z]' || n WHEN 4 THEN 'bad: [' || n WHEN 6 THEN 'id: ' || i || n || 'created: 2024-05-06T07:08:09+02:00' || n || 'score: 1.0' || n
    WHEN 7 THEN 'derived_from: id-' || i || n || 'title: ''  Of ' || i || '''' || n END AS raw,
    CASE WHEN s = 6 THEN chr(65279) ELSE '' END AS bom, CASE WHEN s = 2 THEN rn ELSE n END AS e FROM f),
x AS (SELECT *, CASE WHEN raw IS NULL THEN NULL ELSE bom || '---' || e || raw || '---' || e END AS head, CASE WHEN s = 5 THEN '---' || n || 'open: ' || i || n || body ELSE body END AS rest FROM b)"""


def sql(lines_sql) -> dict[str, str]:
    return {
        "frontmatter_fields": f"""WITH {_FILES}
SELECT path, CASE s WHEN 1 THEN 'n' || i WHEN 2 THEN 'n' || i WHEN 3 THEN 'm' || i WHEN 6 THEN CAST(i AS VARCHAR) END AS id, CASE WHEN s = 6 THEN '2024-05-06T07:08:09+02:00' END AS created,
  CASE WHEN s = 1 THEN lang || '|two words' ELSE '' END AS tags, CASE WHEN s = 3 THEN 'x|z' ELSE '' END AS aliases,
  CASE s WHEN 1 THEN 'id-' || half || '|x y' WHEN 2 THEN 'id-' || half || '|other' WHEN 7 THEN 'id-' || i ELSE '' END AS derived_from, CASE WHEN s = 3 THEN 'id' ELSE '' END AS duplicate_keys, CASE WHEN s = 3 THEN 'kind' ELSE '' END AS unread_scalars,
  CASE WHEN s = 3 THEN 'about' ELSE '' END AS unread_lists, CASE WHEN s = 3 THEN 'aliases 1 3' ELSE '' END AS dropped,
  CASE s WHEN 1 THEN 'id|tags|derived_from' WHEN 2 THEN 'id|derived_from' WHEN 3 THEN 'id|kind|about|aliases' WHEN 6 THEN 'id|created|score' WHEN 7 THEN 'derived_from|title' ELSE '' END AS fields, s = 4 AS unread,
  CASE WHEN raw IS NULL THEN 0 ELSE length(head) - length(replace(head, n, '')) END AS body_line, CASE WHEN raw IS NOT NULL THEN length(bom) END AS block_start, length(head) AS block_end, CASE WHEN raw IS NOT NULL THEN e END AS eol,
  CASE WHEN s = 7 THEN 'Of ' || i END AS written_title, md5(rest) AS body FROM x""",
        "file_passages": f"""WITH {_FILES}, k AS (SELECT path, CASE WHEN raw IS NULL THEN 0 ELSE length(head) - length(replace(head, n, '')) END AS skip, rest FROM x), {lines_sql("k", "rest")}
SELECT pas.path, pas.start_line + skip AS start_line, md5(pas.text) AS digest FROM pas JOIN k USING (path)""",
        "file_findings": f"""WITH {_FILES}
SELECT path, CAST(NULL AS VARCHAR) AS field, 'frontmatter-unreadable' AS code, 'error' AS severity, 0 AS rule, 0 AS item FROM x WHERE s = 4
UNION ALL SELECT path, field, code, 'warning', rule, 0 FROM x, (VALUES ('id', 'duplicate-key', 1), ('kind', 'field-not-text', 2), ('about', 'field-not-list', 3), ('aliases', 'list-item-unreadable', 3)) v(field, code, rule) WHERE s = 3""",
        "edits_added": f"""WITH {_FILES},
a AS (SELECT *, 'src-' || i AS new FROM x)
SELECT path, s <> 4 AS changed, CASE WHEN s = 4 THEN 'frontmatter-unreadable' END AS code, CASE WHEN s = 4 THEN 0 ELSE 1 END AS n_edits, md5(CASE
  WHEN s IN (0, 5) THEN '---' || n || 'derived_from: [' || new || ']' || n || '---' || n || rest WHEN s = 1 THEN replace(head, ', ''x y'']', ', ''x y'', ' || new || ']') || rest WHEN s = 2 THEN replace(head, '  - other # why' || rn, '  - other # why' || rn || '  - ' || new || rn) || rest
  WHEN s IN (3, 6) THEN left(head, length(head) - 4) || 'derived_from: [' || new || ']' || n || '---' || n || rest WHEN s = 7 THEN replace(head, 'derived_from: id-' || i || n, 'derived_from: [id-' || i || ', ' || new || ']' || n) || rest ELSE head || rest END) AS digest FROM a""",
        "edits_removed": f"""WITH {_FILES}
SELECT path, s IN (1, 2, 7) AS changed, CASE WHEN s = 4 THEN 'frontmatter-unreadable' END AS code, md5(CASE
  WHEN s = 1 THEN replace(head, '[id-' || half || ', ', '[') || rest WHEN s = 2 THEN replace(head, '  - id-' || half || rn, '') || rest WHEN s = 7 THEN replace(head, 'derived_from: id-' || i || n, '') || rest ELSE coalesce(head, '') || rest END) AS digest FROM x""",
        "manifest_parse": """SELECT doc_id AS doc_no, [NULL, NULL, 'not-json', 'not-an-object', 'version-unsupported', 'field-malformed', 'field-missing', 'field-malformed', 'field-malformed', 'path-empty', 'path-absolute', 'path-escapes-brain', 'path-not-normalized', 'path-duplicated', 'hash-malformed'][doc_id % 15 + 1] AS code,
  CAST(CASE doc_id % 15 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS BIGINT) AS n_files FROM documents WHERE doc_id IS NOT NULL""",
    }
