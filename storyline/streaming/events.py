"""Incremental forms of the timeline and the catalog with Structured Streaming. They are an addition: the same results as
the batch operators, computed as data arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema: str, files_at_once: int = 4) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def sessions(stream: DataFrame, gap: str = "3 hours", late: str = "1 day") -> DataFrame:
    """W1 on a stream: sessions of each user; state is dropped once the watermark has passed a session's end. Rows exactly one
    gap apart stay together, as in the batch operator."""
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max("value").alias("best_value"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).drop("w")


def hourly_counts(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Rows and sums of each type and hour, complete once the watermark has passed."""
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def run_to_end(out: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Take in all that is there, then stop; a later call goes on from the checkpoint."""
    out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def ingest(stream: DataFrame, catalog: str, checkpoint: str) -> None:
    """New contents go to the catalog, each once: known ones are dropped by an anti join in every batch."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(["content_hash"])
        try:
            known = spark.read.parquet(catalog).select("content_hash")
        except Exception as e:  # the first batch finds no catalog yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = None
        (fresh if known is None else fresh.join(known, "content_hash", "left_anti")).write.mode("append").parquet(catalog)

    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
