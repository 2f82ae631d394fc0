"""Reading tables and cutting lineage, shared by the operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH, DEFAULT, BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4194304b"


def small_batches(spark: SparkSession) -> None:
    """Batches of rows on their way to Python hold at most 4 MiB (and a row), so that memory does not follow the
    length of texts; another setting than Spark's own stays."""
    if spark.conf.get(BATCH) == DEFAULT:
        spark.conf.set(BATCH, BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written to the cluster's shared checkpoint folder and read from there.

    The folder is the one of ``spark.checkpoint.dir``; where that is unset, a local session (tests) gets one of its
    own, and a cluster an error: a folder of the driver's machine would be missing on the others.
    """
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


def shared(spark: SparkSession) -> str:
    """The folder for checkpoints, set if it was not."""
    small_batches(spark)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it has at most so many rows (they are counted)."""
    return F.broadcast(df) if df.count() <= rows else df


def written(df: DataFrame) -> DataFrame:
    """The rows of df, written as Parquet beside the checkpoints and read again, so that later steps
    read the columns they need."""
    path = f"{shared(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
