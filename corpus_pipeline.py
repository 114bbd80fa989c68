"""A training-data pipeline over ``documents``: five stages of the llm operators.

Counted as part of the subpackage llm. Each stage takes (spark, docs, sf_dir) and returns a
DataFrame; ``run`` writes each stage's result as Parquet in the shared folder and reads it back as
the next stage's documents. All stages but the last return the columns of ``documents``.

A null or empty text goes with the first stage, as it is in no language; an empty table stays empty
through all stages. Texts of any length are read whole. Extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import decontaminate, jaccard_join, language_id, pieces, pseudonyms
from quillmill.llm.common import Scratch, table
from quillmill.llm.queries import pseudonym_key, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Models from the documents' labels; what is rejected goes, the rest gets its predicted language."""
    model = language_id.fit(docs)
    out = language_id.identify(docs.select(*COLUMNS), model)
    return out.where("accepted").withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group stays.

    Rows that repeat an id are one document: equal rows become one, different texts under one id all
    stay or go together. A row without an id stays as it is.
    """
    scratch = Scratch(spark, "near_duplicates")
    docs = docs.select(*COLUMNS)
    gone = scratch.cut(jaccard_join.jaccard_components(docs).where("component_id <> doc_id").select("doc_id"))
    if gone.count() <= jaccard_join.BROADCAST_ROWS:
        gone = F.broadcast(gone)
    kept = docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    twice = scratch.cut(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id"))
    if twice.isEmpty():
        return kept
    once = kept.join(twice, "doc_id", "left_anti").select(*COLUMNS)
    return once.unionByName(kept.join(twice, "doc_id", "left_semi").select(*COLUMNS).distinct())


def drop_benchmark_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), "documents")


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced under the session's key (``pseudonym_key``)."""
    out = pseudonyms.pseudonymize(docs.select(*COLUMNS), pseudonym_key(spark))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, ids, decoded) of every document left."""
    return pieces.encode_column(docs.select("doc_id", "lang", "source", "text"), vocabulary("piece_bpe_32k.model")).drop("text")


STAGES = [("language", identify_language), ("near_duplicates", drop_near_duplicates), ("benchmark", drop_benchmark_texts), ("personal_data", hide_personal_data), ("pieces", encode_pieces)]

#: No SQL gives the first stage's decisions, so none gives the whole; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir))
    return docs
