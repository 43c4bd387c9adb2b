"""Cutting lineage in the folder that all executors share, and small literal tables."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or else of setCheckpointDir(). Where neither is set, a local session, as in tests, gets a
    folder of this process; a cluster has none that all can see, so there it is an error."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="storyline-"))
    return _own_dir[0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: later steps survive lost executors without redoing it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, few: int = 32) -> DataFrame:
    """Rows of a small table dealt to all cores: a file of one row group is one task, however much work its rows are. A table of
    as many splits as cores, or of ``few`` splits (some GB), stays as it is and is not shuffled."""
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(min(cores, few)) if splits < min(cores, few) else df


def dealt(df: DataFrame, by: list[str], rows: int, most: int = 25_000) -> DataFrame:
    """df dealt by its keys into parts of about ``most`` of its ``rows``, or as many as shuffles have: the sorts of the windows over these
    keys then hold so many rows each, however large the table. A count that is named is not merged again by the planner."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // most)), *by)


def literal_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small bounded table from the driver as a JVM-side literal."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))
