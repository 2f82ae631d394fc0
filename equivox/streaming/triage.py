"""Triage of units as they arrive.  Signals need one row only, so the stream keeps no state; repeated
uids within the watermark go, and ranking stays a batch step over what the stream has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equivox.operators import triage
from equivox.schema import UNIT


def stream(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """JSON lines that appear in a folder, scored."""
    rows = spark.readStream.schema(UNIT).option("maxFilesPerTrigger", files_per_trigger).json(folder)
    return triage.score(rows)


def windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """events(ts, score) -> mean score and count of each window; later rows than `late` go."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.avg("score").alias("mean_score"), F.count("*").alias("n"))


def write(scored: DataFrame, path: str, checkpoint: str):
    return scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
