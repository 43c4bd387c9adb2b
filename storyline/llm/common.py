"""What the operators of this subpackage share: reading tables, and Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyline.shared import literal_rows, materialize, shared_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text with null as empty, and the further columns asked for; all others are left behind."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


#: Bounds of an Arrow batch, so that what a task holds at once rests on neither the number of rows nor their length. Spark
#: has them for a whole session only: in_arrow() lowers them there where they are higher (the README says so too).
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow() over bounded batches. A task first drops the tables that another operator's tasks left in its worker."""
    for name, most in BATCH.items():
        df.sparkSession.conf.set(name, most)
    owner = run.__module__

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if any(of != owner for of, _ in _tables):
            _tables.clear()
            pa.default_memory_pool().release_unused()
        yield from run(batches)

    return df.mapInArrow(task, schema)


#: Rows and bytes of text that a task works on at once.
SLICE_ROWS, SLICE_BYTES = 1024, 1 << 20


def in_slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice holds few rows and few bytes in the column; one longer text is a slice of its own."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right"))
            stop = min(max(stop, at + 1), at + SLICE_ROWS)
            yield b.slice(at, stop - at)
            at = stop


_tables: dict[tuple[str, object], object] = {}


def worker_table(owner: str, key: object, make: Callable[[], object]) -> object:
    """What a worker process keeps between the tasks of one operator, the module ``owner``; one table at a time."""
    if (owner, key) not in _tables:
        _tables.clear()
        _tables[owner, key] = make()
    return _tables[owner, key]


def unused(docs: DataFrame, name: str) -> str:
    """name, with as many underscores before it as set it apart from all columns of docs, in whatever case."""
    held = {c.lower() for c in docs.columns}
    while name.lower() in held:
        name = "_" + name
    return name


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
