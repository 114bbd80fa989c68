"""Tables read as corpora of notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EMPTY = "array<string>"


def notes_of_documents(documents: DataFrame) -> DataFrame:
    """A note per row: path source/doc_id.md, titled by its id, tagged by its language."""
    none = F.array().cast(EMPTY)
    return documents.where("text is not null").select(
        F.format_string("%s/%s.md", F.coalesce("source", F.lit("none")), F.col("doc_id").cast("string")).alias("path"),
        F.col("doc_id").cast("string").alias("name"),
        "text",
        F.col("text").alias("body"),
        F.lit(0).alias("body_line"),
        F.col("doc_id").cast("string").alias("title"),
        F.array_compact(F.array("lang")).alias("tags"),
        none.alias("aliases"),
        none.alias("about"),
        F.col("doc_id").alias("doc_no"),
    )


def notes_of_conversations(conversations: DataFrame) -> DataFrame:
    """A note per conversation: a level-1 heading with its id, a level-2 heading per turn."""
    turn = F.concat(F.lit("## "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("part")))), lambda x: x["part"]), "\n\n")
    name = F.concat(F.lit("Conversation "), F.col("conv_id").cast("string"))
    # dealt by a stated number, so that turns meet once and the passages' work keeps all cores busy
    spark = conversations.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    d = conversations.repartition(tasks, "conv_id").groupBy("conv_id").agg(whole.alias("parts")).withColumn("text", F.concat(F.lit("# "), name, F.lit("\n\n"), F.col("parts")))
    none = F.array().cast(EMPTY)
    return d.select(F.format_string("conversations/%s.md", F.col("conv_id").cast("string")).alias("path"), F.col("conv_id").cast("string").alias("name"), "text", F.col("text").alias("body"), F.lit(0).alias("body_line"), name.alias("title"), none.alias("tags"), none.alias("aliases"), none.alias("about"), F.col("conv_id").alias("doc_no"))


def wordings_of_benchmark(benchmark: DataFrame) -> DataFrame:
    """Three wordings a question: an item's words 1 to 8, 5 to 14, and every third of the first 30."""
    w = benchmark.where("text is not null").select(F.col("item_id").alias("query_id"), F.split("text", r"\s+").alias("w"))
    parts = [F.slice("w", 1, 8), F.slice("w", 5, 10), F.filter(F.slice("w", 1, 30), lambda x, i: i % 3 == 0)]
    return w.select("query_id", F.posexplode(F.array(*[F.array_join(p, " ") for p in parts])).alias("wording_no", "wording"))
