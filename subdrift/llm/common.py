"""Helpers shared by the operators: folders all executors see, keys of rows, Arrow columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Text that one step of an Arrow function works on at a time, in bytes.
STEP_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``.

    The setting is made here only where it is unset and all executors are this process
    (tests); on a cluster it must be given.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: cuts the lineage."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Within it, jobs send record batches of so many rows at most to Python: a batch is cut
    by rows alone, and the usual 10,000 fill the memory of a task where each has long texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    spark.conf.set(name, str(min(before, rows) if before > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, str(before))


def text_column(name: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def steps(batches: Iterator[pa.RecordBatch], column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that each part holds about ``limit`` bytes of ``column``
    (at least one row: a single text is never divided)."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        first, total = 0, 0
        for row, size in enumerate(sizes):
            if row > first and total + size > limit:
                yield batch.slice(first, row - first)
                first, total = row, 0
            total += size
        if batch.num_rows > first:
            yield batch.slice(first)


def utf8(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The UTF-8 bytes of a text column."""
    return batch.column(column).cast(pa.binary()).to_pylist()
