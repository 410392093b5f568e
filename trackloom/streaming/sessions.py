"""Streams: sessions kept current batch by batch, hourly counts with a watermark, segments of trips as state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trackloom.functions.times import usable_trips
from trackloom.operators.sessions import SessionTable


def sessions_into(stream: DataFrame, table: SessionTable, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Every micro-batch of trips (as delivered) is merged into the session table. The table takes a batch whole or not at
    all, and remembers the number of the last: one repeated after a failure is passed over."""

    def merge(batch: DataFrame, number: int) -> None:
        extra = [F.col("trip_id").alias("id")] if table.once_by_id else []
        table.merge(usable_trips(batch, *extra).withColumnRenamed("participantId", "key"), number)

    w = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def hourly_counts(stream: DataFrame, at: str, *keys: str, late: str = "2 hours") -> DataFrame:
    """Rows an hour and key; rows later than the watermark are left out, as the engine's windows do."""
    return stream.withWatermark(at, late).groupBy(F.window(at, "1 hour"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("hour"), *keys, "n")


def session_windows(stream: DataFrame, at: str, key: str, gap: str = "4 hours", late: str = "1 day") -> DataFrame:
    """Sessions of instants by the engine's own session window, for streams without stored state of ours."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")
