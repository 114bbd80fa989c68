"""An extension: captures as a stream. Files of items arrive in a folder; each source is stored once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.capture import identify, plan_captures

ITEMS = "item_no long, item string, at timestamp"


def read_items(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines of items, as a stream."""
    return spark.readStream.schema(ITEMS).json(folder)


def distinct_captures(items: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Items with kind and source_id; a source seen within the watermark's delay is dropped, texts never are."""
    known = identify(items).withWatermark("at", delay)
    key = F.coalesce("source_id", F.concat(F.lit("text-"), F.col("item_no").cast("string")))
    return known.withColumn("key", key).dropDuplicatesWithinWatermark(["key"])


def store_captures(items: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Plans each micro-batch against what the sink holds and appends it; a repeated batch replaces itself."""

    def store(batch: DataFrame, no: int) -> None:
        spark = batch.sparkSession
        try:
            held = spark.read.parquet(sink).where(F.col("batch") != no)
        except Exception as e:  # nothing is stored yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            held = spark.createDataFrame([], "kind string, id string, folder string, name string")
        plan = plan_captures(batch.select("item_no", "item", "at"), held.where("kind = 'source'").select(F.col("id").alias("source_id")), held.where("name is not null").select("folder", "name"))
        plan.where("action = 'write'").write.mode("overwrite").parquet(f"{sink}/batch={no}")

    return items.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
