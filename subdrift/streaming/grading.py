"""Latency grading over Structured Streaming.

The grading operators are stateless, so they take a streaming DataFrame as they are:
``end_to_end_latency(stream, parms)``. The parameter table is the static side of the
join. What is added here is reading sample files as a stream and grading all that
has arrived since the last run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def samples_from_files(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", **options
) -> DataFrame:
    """Sample files under ``path`` as a stream."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def grade_new_files(
    stream: DataFrame, grade: Callable[[DataFrame], DataFrame], out_path: str, checkpoint_path: str
) -> None:
    """Grade every sample not graded by an earlier run and append it to ``out_path``.

    The file sink and the checkpoint make a repeated or interrupted run write each
    sample once; both paths must be on storage all executors share.
    """
    query = (
        grade(stream)
        .writeStream.format("parquet")
        .option("path", out_path)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
