"""Monitoring of detection events and scoring of document streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed(events: DataFrame, size: str = "1 hour", late: str | None = None, slide: str | None = None) -> DataFrame:
    """Counts and mean value per window and event type; of a stream, rows later
    than `late` are dropped."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if late else e
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value")).select(F.col("w.start").alias("start"), "event_type", "n", "mean_value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Events of a user closer than `gap` are one session."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if late else e
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def usage(events: DataFrame, key: str = "event_type") -> DataFrame:
    """Running counters per key: uses, total and mean value, last use."""
    return events.groupBy(key).agg(F.count("*").alias("uses"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.max("ts").alias("last_used"))


def score_stream(docs: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Score each micro-batch of a document stream and append it to a table."""
    return docs.writeStream.foreachBatch(lambda batch, _: score(batch).write.mode("append").parquet(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latency(events: DataFrame, size: str, value: str, bounds: tuple[float, float]) -> DataFrame:
    """size_class (short, medium, long by bounds), n, p50, p95, p99 of value."""
    kind = F.when(F.col(size) < bounds[0], "short").when(F.col(size) < bounds[1], "medium").otherwise("long")
    at = lambda p: F.round(F.percentile(value, p), 6).alias(f"p{round(100 * p)}")
    return events.groupBy(kind.alias("size_class")).agg(F.count("*").alias("n"), at(0.5), at(0.95), at(0.99))


def severity(status: Column) -> Column:
    """Level of a request's log record: info under 400, warning under 500, else error; null without a status."""
    return F.when(status < 400, "info").when(status < 500, "warning").when(status >= 500, "error")


def request_log(requests: DataFrame) -> DataFrame:
    """ts, method, path, status, duration as log records: level, message, duration of 4 digits."""
    s = F.col("status")
    kind = F.when(s < 400, "API Request").when(s < 500, "API Client Error").when(s >= 500, "API Server Error").otherwise("API Request")
    return requests.select("ts", severity(s).alias("level"), F.concat(kind, F.lit(": "), F.coalesce("method", F.lit("")), F.lit(" "), F.coalesce("path", F.lit("")), F.lit(" -> "), F.coalesce(s.cast("string"), F.lit("none"))).alias("message"), F.round("duration", 4).alias("duration"))
