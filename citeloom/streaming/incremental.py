"""Streams (an extension): records resolved as they arrive, and windowed statistics of run events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from citeloom.sources.store import Store


def resolve_new(stream: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Each micro-batch's records are upserted by primary identifier; a batch that is run again changes nothing."""

    def batch(df: DataFrame, _: int) -> None:
        if df.limit(1).count():
            store.save_works(df.dropDuplicates(["ids"]))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """event_type counts and sums by event-time window; rows later than ``late`` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def run_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a user's events."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")
