"""Structured Streaming jobs, and the batch twins of the stateful ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery


def first_seen(records: DataFrame, at: str = "retrieved_at", delay: str = "1 day") -> DataFrame:
    """The first record of each (source, source_id) within the watermark."""
    return records.withWatermark(at, delay).dropDuplicatesWithinWatermark(["source", "source_id"])


def window_counts(events: DataFrame, at: str = "ts", kind: str = "event_type", size: str = "24 hours", slide: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Events by sliding window and kind, with the sum of ``value``; later ones than the watermark are dropped."""
    marked = events.withWatermark(at, delay) if events.isStreaming else events
    counted = marked.groupBy(F.window(at, size, slide).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), kind, "n", "total")


def sessions(events: DataFrame, key: str, at: str = "ts", gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Runs of a key's events with no gap as long as ``gap``."""
    marked = events.withWatermark(at, delay) if events.isStreaming else events
    out = marked.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def allow(times: list[int], limit: int, window_us: int, hits: list[int] | None = None) -> tuple[list[bool], list[int]]:
    """Which of a key's requests (ascending microseconds) are allowed: one is, if fewer than ``limit`` allowed
    ones lie in the window before it. Returns the flags and the allowed hits that still count."""
    hits, flags = list(hits or []), []
    for t in times:
        hits = [h for h in hits if h > t - window_us]
        flags.append(len(hits) < limit)
        if flags[-1]:
            hits.append(t)
    return flags, hits


def budget_flags(requests: DataFrame, key: str, at: str, tie: str, limit: int, window_seconds: int) -> DataFrame:
    """requests (key, at, tie) with ``allowed``. Decisions depend on earlier ones, so each key's times are
    walked in order, in Arrow batches of a sorted partition: state is the last ``limit`` allowed hits, so a key
    of any size passes through one task without being held there."""
    window_us = window_seconds * 1_000_000
    source = requests.select(F.col(key).alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("us"), F.col(tie).alias("tie"))
    parts = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = source.repartition(parts, "key").sortWithinPartitions("key", "us", "tie")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[object, list[int]] = (None, [])
        for batch in batches:
            flags: list[bool] = []
            for k, group in batch.groupby("key", sort=False, dropna=False):
                before = held[1] if held[0] == k else []
                now, hits = allow(group["us"].tolist(), limit, window_us, before)
                flags += now
                held = (k, hits)
            yield batch.assign(allowed=flags)

    kind = dict(source.dtypes)
    return ordered.mapInPandas(run, f"key {kind['key']}, us long, tie {kind['tie']}, allowed boolean").select(
        F.col("key").alias(key), F.timestamp_micros("us").alias(at), F.col("tie").alias(tie), "allowed"
    )


class Budget(StatefulProcessor):
    """Stream twin of budget_flags: the allowed hits of a key are list state."""

    def __init__(self, limit: int, window_us: int):
        self.limit, self.window_us = limit, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hits = handle.getListState("hits", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["us", "tie"])
        before = [h[0] for h in self.hits.get()] if self.hits.exists() else []
        flags, hits = allow(batch["us"].tolist(), self.limit, self.window_us, before)
        self.hits.put([(h,) for h in hits])
        yield batch.assign(allowed=flags)[["key", "us", "tie", "allowed"]]

    def close(self) -> None:
        pass


def budget_stream(requests: DataFrame, limit: int, window_seconds: int) -> DataFrame:
    """A stream of (key string, us long, tie long) with ``allowed``; needs the RocksDB state store."""
    return requests.groupBy("key").transformWithStateInPandas(
        statefulProcessor=Budget(limit, window_seconds * 1_000_000),
        outputStructType="key string, us long, tie long, allowed boolean", outputMode="Append", timeMode="None",
    )


class StaleAlert(StatefulProcessor):
    """An alert for an entity whose last audit is older than so many days of event time."""

    def __init__(self, days: int):
        self.ms = days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = max(int(batch["ms"].max()) for batch in rows)
        if not self.last.exists() or self.last.get()[0] < newest:
            if self.last.exists():
                self.handle.deleteTimer(self.last.get()[0] + self.ms)
            self.last.update((newest,))
            self.handle.registerTimer(newest + self.ms)
        yield pd.DataFrame({"key": pd.Series(dtype=str), "last_ms": pd.Series(dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"key": [key[0]], "last_ms": [self.last.get()[0]]})
        self.last.clear()

    def close(self) -> None:
        pass


def stale_alerts(audits: DataFrame, days: int, delay: str = "1 hour") -> DataFrame:
    """A stream of audits (key string, at timestamp) to (key, last_ms) once an entity's last audit is too old."""
    marked = audits.withWatermark("at", delay).withColumn("ms", F.unix_millis("at"))
    return marked.groupBy("key").transformWithStateInPandas(
        statefulProcessor=StaleAlert(days), outputStructType="key string, last_ms long", outputMode="Append", timeMode="EventTime"
    )


def stale_now(audits: DataFrame, days: int, as_of: Column) -> DataFrame:
    """Batch twin of stale_alerts at one time: (key, last_ms) of entities whose last audit is ``days`` old or more."""
    last = audits.groupBy("key").agg(F.max(F.unix_millis(F.col("at").cast("timestamp"))).alias("last_ms"))
    return last.where(F.col("last_ms") + days * 86_400_000 <= F.unix_millis(as_of))


def ingest(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run ``apply(batch, batch_id)`` on each micro-batch; it writes to a place named by batch_id, so that a
    batch that comes again replaces its own result."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
