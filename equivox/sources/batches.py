"""Batches of rows on their way to Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

BATCH, DEFAULT, BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4194304b"


def small_batches(spark: SparkSession) -> None:
    """They hold at most 4 MiB (and a row), so that memory does not follow the length of texts; another setting than
    Spark's own stays."""
    if spark.conf.get(BATCH) == DEFAULT:
        spark.conf.set(BATCH, BYTES)
