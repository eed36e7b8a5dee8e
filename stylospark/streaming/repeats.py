"""Streams with state: repeats of a text, shares of verdicts, scores by the newest model.

Times are event times. Rows later than the watermark are left out, and counted by
late_rows(). All three go on from their checkpoint after a restart."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: Store that state with timers needs; set on the session before a stream of repeats is started.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
REPEATS = "text_key string, first_id long, new long, total long, expired boolean"


class _Repeats(StatefulProcessor):
    """One row a text and batch: how often it came now and so far. A timer forgets a
    text that hasn't come for `keep` milliseconds of event time, with a last row."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "first_id long, total long, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first, new, last = None, 0, 0
        for part in rows:  # partial counts of a batch: few rows, also of a text that fills it
            least = int(part["first_id"].min())
            first, new = least if first is None else min(first, least), new + int(part["n"].sum())
            last = max(last, int(part["last"].max()))
        total = new
        if self.seen.exists():
            old = self.seen.get()
            first, total, last = min(first, old[0]), total + old[1], max(last, old[2])
        self.seen.update((first, total, last))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(last + self.keep)
        yield pd.DataFrame({"text_key": [key[0]], "first_id": [first], "new": [new], "total": [total], "expired": [False]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first, total, _ = self.seen.get()
        self.seen.clear()
        yield pd.DataFrame({"text_key": [key[0]], "first_id": [first], "new": [0], "total": [total], "expired": [True]})

    def close(self) -> None:
        pass


def _partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.groupby(["text_key", "ts"], as_index=False).agg(first_id=("first_id", "min"), n=("n", "sum"), last=("last", "max"))[["text_key", "ts", "first_id", "n", "last"]]


def repeats(docs: DataFrame, late: str = "10 minutes", keep: str = "1 day", grain: str = "1 minute") -> DataFrame:
    """Of a stream of doc_id, ts, text: a row for each text of a batch, with the
    smallest doc_id that had it (first_id), how often it came in the batch (new) and
    since it was last forgotten (total). A text that doesn't come for `keep` is
    forgotten, which gives a row with `expired`. Null texts count as empty, null
    doc_ids as the largest number; rows without a time are left out.

    A text's copies are counted by task, Arrow batch and grain of time before they are
    shuffled, so a text that makes up a third of the stream sends a row for each of
    these. A row is late when the end of its grain is behind the watermark."""
    span = int(pd.Timedelta(grain).total_seconds() * 1e6)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    end = F.timestamp_micros((F.floor(us / span) + 1).cast("long") * span)
    d = docs.where(F.col("ts").isNotNull()).observe("read", F.count(F.lit(1)).alias("n"))
    d = d.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_key"), end.alias("ts"), F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("first_id"), F.lit(1).cast("long").alias("n"), F.floor(us / 1000).cast("long").alias("last"))
    d = d.mapInPandas(_partial, "text_key string, ts timestamp, first_id long, n long, last long").withWatermark("ts", late)
    processor = _Repeats(int(pd.Timedelta(keep).total_seconds() * 1000))
    out = d.groupBy("text_key").transformWithStateInPandas(processor, REPEATS, "update", "eventTime")
    return out.observe("taken", F.coalesce(F.sum("new"), F.lit(0)).alias("n"))


def late_rows(query: StreamingQuery) -> int:
    """Rows of a stream of repeats that came too late, of the batches this run of the
    query still knows (spark.sql.streaming.numRecentProgressUpdates)."""
    read = taken = 0
    for p in query.recentProgress:
        if "read" in p.observedMetrics and "taken" in p.observedMetrics:
            read, taken = read + p.observedMetrics["read"].n, taken + p.observedMetrics["taken"].n
    return read - taken


def write_batches(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", score: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Write each batch, or its score(), to out/batch=<number>, in place of what an
    attempt that failed left there: every batch is in the table once."""

    def write(batch: DataFrame, number: int) -> None:
        (batch if score is None else score(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(rows: DataFrame) -> DataFrame:
    """text_key, first_id, total over all that a written stream of repeats saw, what was forgotten included."""
    return rows.where(~F.col("expired")).groupBy("text_key").agg(F.min("first_id").alias("first_id"), F.sum("new").alias("total"))


def publish(model: DataFrame, path: str, version: int) -> None:
    """Write a model's table as a version; readers see it when it is complete."""
    model.write.mode("overwrite").parquet(f"{path}/tables/version={version}")
    model.sparkSession.createDataFrame([(version,)], "version int").coalesce(1).write.mode("append").parquet(f"{path}/published")


def newest(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    version = spark.read.schema("version int").parquet(f"{path}/published").agg(F.max("version")).first()[0]
    return version, spark.read.parquet(f"{path}/tables/version={version}")


def score_by_newest(docs: DataFrame, models: str, score: Callable[[DataFrame, DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """score(batch, model) of each batch by the model published last when it starts, with
    its model_version."""

    def scored(batch: DataFrame) -> DataFrame:
        version, model = newest(batch.sparkSession, models)
        return score(batch, model).withColumn("model_version", F.lit(version))

    return write_batches(docs, out, checkpoint, score=scored)


def shares(verdicts: DataFrame, classes: list[str], size: str = "1 hour", late: str | None = None, key: str = "verdict") -> DataFrame:
    """start, n and the share of each class, by window of ts; the classes' columns are
    named share_<i> in the order given. One aggregation with partial sums, so it runs
    over a stream as over a table and no class is held by one task."""
    v = verdicts.withColumn("ts", F.col("ts").cast("timestamp"))
    v = v.withWatermark("ts", late) if late else v
    counts = [F.count_if(F.col(key) == c).alias(f"c{i}") for i, c in enumerate(classes)]
    g = v.groupBy(F.window("ts", size).alias("w")).agg(F.count(F.lit(1)).alias("n"), *counts)
    return g.select(F.col("w.start").alias("start"), "n", *[F.round(F.col(f"c{i}") / F.col("n"), 6).alias(f"share_{i}") for i in range(len(classes))])
