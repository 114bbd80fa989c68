"""Citations of lines in files: whether they resolve, and which passages they cover."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a bucket in which ranges meet.
BUCKET = 64


def check_citations(citations: DataFrame, files: DataFrame) -> DataFrame:
    """(citation_no, code): null where a citation (citation_no, commit, path, first_line, last_line) resolves.

    ``files`` are (commit, path, n_lines). ``source_commit_unavailable`` for a commit without files,
    ``evidence_path_absent`` for a path that the commit lacks, ``evidence_range_invalid`` for a range that
    ends before it begins or behind the file's end. A citation without a range cites the whole file; a
    null commit or path is never there.
    """
    commits = files.select("commit").distinct().withColumn("known", F.lit(True))
    sizes = files.groupBy("commit", "path").agg(F.max("n_lines").alias("n_lines"))
    d = citations.join(commits, "commit", "left").join(sizes, ["commit", "path"], "left")
    bad = (F.col("last_line") < F.col("first_line")) | (F.col("last_line") > F.col("n_lines"))
    code = F.when(F.col("known").isNull(), "source_commit_unavailable").when(F.col("n_lines").isNull(), "evidence_path_absent").when(bad, "evidence_range_invalid")
    return d.select("citation_no", code.alias("code"))


def cited_passages(citations: DataFrame, passages: DataFrame) -> DataFrame:
    """(citation_no, path, start_line, end_line, lines): the passages that a cited range meets, and in how
    many lines.

    A bucketed range join: both sides stand once in each bucket of lines that they touch and meet on (path,
    bucket); a pair counts in the first bucket that both touch. Long files are spread over their buckets.
    """
    in_buckets = lambda d, lo, hi: d.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(lo) / BUCKET), F.floor(F.col(hi) / BUCKET))))
    cites = in_buckets(citations.where("first_line <= last_line").select("citation_no", "path", "first_line", "last_line"), "first_line", "last_line")
    held = in_buckets(passages.where("start_line <= end_line").select("path", "start_line", "end_line"), "start_line", "end_line")
    lo, hi = F.greatest("first_line", "start_line"), F.least("last_line", "end_line")
    met = cites.join(held, ["path", "bucket"]).where((lo <= hi) & (F.col("bucket") == F.floor(lo / BUCKET)))
    return met.select("citation_no", "path", "start_line", "end_line", (hi - lo + 1).cast("long").alias("lines"))
