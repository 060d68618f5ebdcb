"""Streaming forms of the queue: idempotent requests, sessions, latest states and a foreachBatch worker."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def first_requests(stream: DataFrame, key: str, ts: str, ttl: str = "7 days") -> DataFrame:
    """The first request of each key within its time to live."""
    return stream.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, user: str, ts: str, gap: str = "12 hours", late: str = "1 hour") -> DataFrame:
    """Sliding sessions: each event prolongs its user's session by the gap."""
    table = events.withWatermark(ts, late) if events.isStreaming else events
    grouped = table.groupBy(user, F.session_window(ts, gap).alias("s")).agg(F.count(F.lit(1)).alias("n_events"))
    return grouped.select(user, F.col("s.start").alias("started_at"), F.col("s.end").alias("expires_at"), "n_events")


def counts_by_window(events: DataFrame, ts: str, key: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events of each key in tumbling windows."""
    table = events.withWatermark(ts, late) if events.isStreaming else events
    return table.groupBy(F.window(ts, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def worker(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Run handle on each micro-batch; with once it ends when all that is there is done, else it polls every 5 s."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def live_lease(leased_until: Column, version: Column, expected: Column, now: Column) -> Column:
    """Whether a result may commit: its lease still runs and nobody else has moved on."""
    return (leased_until >= now) & (version == expected)
