"""Incremental work and state on streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..scratch import path_exists


def embed_incrementally(chunks: DataFrame, output: str, checkpoint: str, embed: Callable[[DataFrame], DataFrame], key: str = "id"):
    """Starts a query that embeds each key of a stream once, a micro-batch at a time.

    The keys that have been embedded are the query's state, looked up one by one, so a batch
    reads nothing of the output and its work doesn't grow with what was done before (with the
    RocksDB state store, spark.sql.streaming.stateStore.providerClass, they needn't fit in
    memory either). Every batch is a folder of output under its number: one that is delivered
    again after a failure finds the state as it was and replaces what it wrote. An output that
    another checkpoint has written is refused, for its batches would be replaced. Of rows that
    share a key one is embedded; null is a key like others.
    """
    spark = chunks.sparkSession
    if path_exists(spark, output) and not path_exists(spark, f"{checkpoint.rstrip('/')}/metadata"):
        raise ValueError(f"{output} was written under another checkpoint than {checkpoint}")

    def add(batch: DataFrame, number: int) -> None:
        embed(batch).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return chunks.dropDuplicates([key]).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_states(log: DataFrame) -> DataFrame:
    """The newest status of each key of a stream (key, at, status); output mode update."""
    return log.groupBy("key").agg(F.max_by("status", "at").alias("status"), F.max("at").alias("at"))


def _answers(key: str | None, times: np.ndarray, allowed) -> pd.DataFrame:
    return pd.DataFrame({"key": pd.Series([key] * len(times), dtype=object), "at": times.astype("datetime64[us]"), "allowed": pd.Series(allowed, dtype=object)})


class _Limiter(StatefulProcessor):
    """A key's window (its start in microseconds, its count), and a timer that drops it."""

    def __init__(self, limit: int, seconds: int):
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start long, n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = pd.concat([r["at"] for r in rows], ignore_index=True)
        timed = np.sort(times.dropna().to_numpy("datetime64[us]").astype("int64"))
        start, count = self.window.get() if self.window.exists() else (None, 0)
        allowed, i = np.zeros(len(timed), bool), 0
        while i < len(timed):
            if start is None or timed[i] - start >= self.seconds * 10**6:
                start, count = int(timed[i]), 0
            end = int(np.searchsorted(timed, start + self.seconds * 10**6))
            allowed[i:end] = count + 1 + np.arange(end - i) <= self.limit
            count, i = count + end - i, end
        if len(timed):
            self.window.update((start, count))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.seconds * 1000)
        yield _answers(key[0], timed, allowed)
        untimed = len(times) - len(timed)
        yield _answers(key[0], np.full(untimed, np.datetime64("NaT", "us")), [None] * untimed)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.window.clear()
        yield _answers(key[0], np.array([], "int64"), [])

    def close(self) -> None:
        pass


def rate_limited(requests: DataFrame, limit: int, seconds: int = 60) -> DataFrame:
    """key, at, allowed of each request (key, at) of a stream; the first limit of a key's window are allowed.

    A key's window has a fixed length and starts at the key's first request, or the first one
    after the window before. A window's state goes by a timer once so long has passed on the
    clock since the key was last seen, so what is kept is of the keys of the last seconds
    alone. No request is dropped: a request older than the window's start counts in it, and
    one that comes after its window has gone opens one of its own. A request without a time
    counts in no window and has null in allowed; a null key is a key like others. What a task
    holds is the times of one key in one micro-batch: the source's limits on a batch bound it.
    The timers need a trigger that goes on, such as processingTime; under availableNow the
    query would wait for them for ever. The session's state store must be the RocksDB one (spark.sql.streaming.stateStore.providerClass).
    """
    return requests.select("key", "at").groupBy("key").transformWithStateInPandas(_Limiter(limit, seconds), "key string, at timestamp, allowed boolean", "append", "ProcessingTime")


def windowed_counts(events: DataFrame, at: str, key: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window and key, for rows at most so late."""
    e = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return e.groupBy(F.window(at, size).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def sessions(events: DataFrame, at: str, key: str, gap: str = "30 minutes") -> DataFrame:
    """Counts by session: runs of a key's rows without a longer gap."""
    e = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, gap)
    return e.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
