"""The driver's tables as inputs of the operators: events as photo timelines (a user is a library), SimHash as image hash,
embeddings as faces, labels as the reference set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyline.functions.scalar import local_seconds, micros
from storyline.shared import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, event_id, t (whole seconds), us, event_type and value of the events."""
    return table(spark, sf_dir, "events").select("user_id", "event_id", local_seconds("ts").alias("t"), micros("ts").alias("us"), "event_type", "value")


def simhashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and simhash of the documents that have words."""
    from storyline.operators.dedup import simhash

    return simhash(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as photos: measures are fixed functions of value and id, so that any engine gets the same."""
    e = timeline(spark, sf_dir)
    part = lambda k, m: (F.col("event_id") * k % m) / float(m - 1)
    return e.select(
        F.col("user_id").cast("string").alias("library_id"), F.col("event_id").alias("content_hash"), "t",
        F.when(F.col("event_id") % 41 == 0, "png").otherwise("jpeg").alias("format"), F.when(F.col("event_id") % 3 != 0, "Cam").alias("camera_make"),
        part(7, 101).alias("q_sharp"), part(11, 97).alias("q_exposure"), part(13, 89).alias("q_color"), (part(17, 83) * 0.1).alias("q_skin"),
        part(19, 79).alias("q_motion"), part(23, 73).alias("q_noise"), (F.col("event_id") * 2654435761 % 4294967296).alias("phash"),
        (F.col("event_id") % 2 == 0).alias("faces_done"), "value",
    )
