"""Streaming forms: windowed metrics with late data, arrivals without repeats, and the stream of catalog snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.metrics import named
from .state import sync_batch


def timed(events: DataFrame, time: str, late: str) -> DataFrame:
    """events with a watermark on a time column, which may lack a time zone."""
    return events.withColumn(time, named(time).cast("timestamp")).withWatermark(time, late)


def windowed(events: DataFrame, time: str, measure: str, keys: list[str], width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Sum, count and mean of a measure in tumbling (or with slide, sliding) windows, for streams and tables alike."""
    w = F.window(named(time), width, slide) if slide else F.window(named(time), width)
    g = timed(events, time, late).groupBy(w.alias("w"), *map(named, keys))
    return g.agg(F.sum(named(measure)).alias("total"), F.count(F.lit(1)).alias("n"), F.avg(named(measure)).alias("mean")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *map(named, keys), "total", "n", "mean")


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Runs of a key's events without a pause of `gap`."""
    g = timed(events, time, late).groupBy(F.session_window(named(time), gap).alias("w"), named(key))
    return g.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), named(key), "n")


def once_each(arrivals: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """Arrivals without the repeats that at-least-once delivery brings within `late`."""
    return timed(arrivals, time, late).dropDuplicatesWithinWatermark(keys)


def sync_stream(snapshots: DataFrame, root: str, checkpoint: str, mode: str = "full") -> StreamingQuery:
    """Items of one synced_at are a snapshot; a micro-batch may hold several. One writer for a state, all that has arrived."""
    return snapshots.writeStream.foreachBatch(lambda df, n: sync_batch(df, n, root, mode)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
