"""Structured Streaming: windowed counts of events, and predictions for a stream of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def windowed_counts(events: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(start, event_type, n, total) by tumbling event-time windows; in a stream, rows later than `late` are left out."""
    out = _timed(events, late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "5 minutes", late: str = "30 minutes") -> DataFrame:
    """(user_id, start, end, n): sessions end after a gap."""
    out = _timed(events, late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def serve_stream(requests: DataFrame, tables: dict[str, DataFrame], sink, checkpoint: str):
    """Predicts each micro-batch of requests against static tables and hands it to sink(batch, number)."""
    from ..operators.predict import predict

    return requests.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: sink(predict(df, **tables), n)).start()
