"""Hotspot counts over a stream of events; an addition to what a scan of a history gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(start, event_type, events) by windows of ts; for batch and streaming frames alike."""
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.groupBy(span.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events")).select(F.col("w.start").alias("start"), "event_type", "events")


def stream_counts(spark: SparkSession, folder: str, schema: str, checkpoint: str, out: str, width: str = "1 hour", late: str = "10 minutes") -> StreamingQuery:
    """Append finished windows of the Parquet files that arrive in folder to out; events later than late are left out."""
    events = spark.readStream.schema(schema).parquet(folder).withWatermark("ts", late)
    return windowed_counts(events, width).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)
