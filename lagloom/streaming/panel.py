"""An incremental panel: a stream of timestamped rows bucketed as they come.

Structured Streaming keeps the sums of the open buckets only: a bucket's state
goes when the watermark has passed it, and rows later than that are refused.
Every trigger writes the buckets it changed, with their sums so far, as one
batch of a Parquet table; a bucket's newest batch counts. A batch that is run
again after a failure replaces its own files, so nothing is counted twice. The
panel is read from that table: whole, or the trailing frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..sources.panel import dense

#: Lengths of a bucket, as durations of a window.
UNITS = {"SECOND": "1 second", "MINUTE": "1 minute", "HOUR": "1 hour", "DAY": "1 day"}


def bucketed(rows: DataFrame, ts: str, dim: str, value: str, unit: str, late: str, series: str | None = None) -> DataFrame:
    """series_id, name, start (of the bucket) and value of a stream; rows more
    than ``late`` behind the newest are refused. Rows without time or dimension
    are left out, as in ``panelize``."""
    key = F.col(series).cast("string") if series else F.lit("all")
    kept = rows.where(F.col(ts).isNotNull() & F.col(dim).isNotNull()).select(
        key.alias("series_id"), F.col(ts).cast("timestamp").alias("ts"), F.col(dim).cast("string").alias("name"), F.col(value).cast("double").alias("value")
    )
    sums = kept.withWatermark("ts", late).groupBy("series_id", "name", F.window("ts", UNITS[unit])).agg(F.sum("value").alias("value"))
    return sums.select("series_id", "name", F.col("window.start").alias("start"), "value")


def writer(buckets: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """To be given a trigger and started; folder and checkpoint lie where the
    driver and all executors reach them."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return buckets.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(keep)


def read(spark: SparkSession, folder: str, origin: str, unit: str, frames: int, first: int = 0) -> DataFrame:
    """The panel of frames first to first + frames - 1, counted from origin; the
    first of them is frame 0."""
    parts = spark.read.schema("series_id string, name string, start timestamp, value double, batch long").parquet(folder)
    newest = parts.groupBy("series_id", "name", "start").agg(F.max_by("value", "batch").alias("value"))
    t = F.timestamp_diff(unit, F.lit(origin).cast("timestamp"), F.col("start")) - first
    return dense(newest.select("series_id", "name", t.alias("t"), "value"), frames)


def trailing(spark: SparkSession, folder: str, origin: str, unit: str, frames: int) -> DataFrame:
    """The newest ``frames`` frames that any series has."""
    last = spark.read.schema("start timestamp").parquet(folder).agg(F.timestamp_diff(unit, F.lit(origin).cast("timestamp"), F.max("start"))).first()[0]
    return read(spark, folder, origin, unit, frames, max(0, (last or 0) - frames + 1))
