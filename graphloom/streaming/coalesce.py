"""Change events: latest-wins coalescing with overflow, in batch and as a keyed stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..schema import QUEUE_CAP


def latest_wins(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """``key`` with the value of its last event: one partially aggregated maximum, whatever the number of events."""
    return events.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value), F.count("*").alias("n_events"))


def overflow(events: DataFrame, window: str, path: str, cap: int = QUEUE_CAP) -> DataFrame:
    """Per window: the number of distinct paths, and whether it must reconcile instead."""
    paths = events.groupBy(window).agg(F.count_distinct(path).alias("depth"))
    return paths.select(window, F.when(F.col("depth") > cap, 1).otherwise(F.col("depth")).alias("depth"), (F.col("depth") > cap).alias("reconcile"))


class WatcherQueue:
    """Bounded latest-wins queue; a new path beyond the cap clears it and drops all offers until taken."""

    def __init__(self, cap: int = QUEUE_CAP):
        self.cap, self.events, self.overflowed = cap, {}, False

    def offer(self, path: str, kind: str) -> None:
        if self.overflowed:
            return
        if path not in self.events and len(self.events) >= self.cap:
            self.events, self.overflowed = {}, True
            return
        self.events.pop(path, None)
        self.events[path] = kind

    def depth(self) -> int:
        return 1 if self.overflowed else len(self.events)

    def take(self) -> tuple[dict[str, str], bool]:
        out = (self.events, self.overflowed)
        self.events, self.overflowed = {}, False
        return out


class Coalescer(StatefulProcessor):
    """Per repository: latest kind by path in a map state, flushed ``window_ms`` after its first event.

    Overflow clears the map and asks for a reconcile; events until the flush are then dropped, as in the queue.
    """

    def __init__(self, cap: int = QUEUE_CAP, window_ms: int = 500):
        self.cap, self.window_ms = cap, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.paths = handle.getMapState("paths", "path string", "kind string, seq bigint")
        self.size = handle.getValueState("size", "n int, overflowed boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, over = self.size.get() if self.size.exists() else (0, False)
        opened = not self.size.exists()
        for frame in rows:
            for r in frame.sort_values("seq").itertuples(index=False):
                if over:
                    continue
                known = self.paths.containsKey((r.path,))
                if not known and n >= self.cap:
                    self.paths.clear()
                    n, over = 0, True
                    continue
                n += not known
                self.paths.updateValue((r.path,), (r.kind, int(r.seq)))
        self.size.update((n, over))
        if opened:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.window_ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, over = self.size.get()
        rows = [(key[0], None, "reconcile")] if over else [(key[0], p[0], v[0]) for p, v in self.paths.iterator()]
        self.paths.clear()
        self.size.clear()
        yield pd.DataFrame(rows, columns=["repo", "path", "kind"])

    def close(self) -> None:
        pass


COALESCED = "repo string, path string, kind string"


def coalesce_stream(events: DataFrame, cap: int = QUEUE_CAP, window_ms: int = 500) -> DataFrame:
    """Stream of ``repo, path, kind, seq`` to batches of changes; needs the RocksDB state store provider."""
    return events.groupBy("repo").transformWithStateInPandas(Coalescer(cap, window_ms), COALESCED, "append", "processingTime")


def latest_by_microbatch(spark, source: str, schema: str, target: str, checkpoint: str) -> None:
    """Drain a folder of change-event files into a keyed latest-wins table, one merge a micro-batch (``availableNow``)."""

    def merge(batch: DataFrame, number: int) -> None:
        last = latest_wins(batch, "path", ["seq"], "kind").select("path", "kind")
        last.withColumn("batch", F.lit(number)).write.mode("append").parquet(target)

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, time_col: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Adapter for event-time data: watermarked tumbling counts (not an operator of the change stream itself)."""
    timed = events.withColumn("_t", F.col(time_col).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.window("_t", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "event_type", "n")
