"""Token buckets on a stream whose idle keys are swept by timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: State lies in RocksDB, on disk, so keys may be more than fit in memory.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Seconds after which an idle bucket is swept, if it is full again by then.
IDLE_SECONDS = 600


class _Bucket(StatefulProcessor):
    """A key's level and the time it was last changed; a timer at the time it may be forgotten."""

    def __init__(self, per_second: float, burst: float, idle_seconds: float):
        self.per_second, self.burst = per_second, burst
        # A bucket that is full again is like one never used: nothing is lost with it.
        self.forget_ms = int(max(idle_seconds, burst / per_second) * 1000) + 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bucket", "level double, last bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        level, last = self.state.get() if self.state.exists() else (self.burst, None)
        events = pd.concat(list(rows)).sort_values(["us", "o"], kind="stable")
        allowed, wait = [], []
        for us in events["us"].tolist():
            if last is not None:
                level = min(self.burst, level + max(0, us - last) / 1e6 * self.per_second)
            last = us if last is None else max(last, us)
            allowed.append(level >= 1)
            wait.append(0.0 if level >= 1 else max(1.0, (1 - level) / self.per_second))
            level -= level >= 1
        self.state.update((level, last))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(last // 1000 + self.forget_ms)
        yield events.assign(k=key[0], allowed=allowed, wait=wait)[["k", "us", "o", "allowed", "wait"]]

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        # A timer of an earlier event must not end a bucket that was used since.
        if self.state.exists() and self.state.get()[1] // 1000 + self.forget_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        yield pd.DataFrame({"k": pd.Series(dtype="int64"), "us": pd.Series(dtype="int64"), "o": pd.Series(dtype="int64"), "allowed": pd.Series(dtype="bool"), "wait": pd.Series(dtype="float64")})

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """States of streams that start from now on lie in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def swept_token_bucket(events: DataFrame, key: str, time: str, order: str, per_second: float, burst: float, late: str = "1 minute", idle_seconds: float = IDLE_SECONDS) -> DataFrame:
    """k, us, o, allowed and wait of a stream's events, as :func:`quarry.streaming.limits.token_bucket`.

    Keys are numbers. Events of a micro-batch are folded in order of time;
    those later than the watermark's ``late`` are dropped. A key's state ends
    by event time once it has been idle for ``idle_seconds`` and its bucket is
    full, so the store holds the keys of about that span and no more. The
    session needs :func:`use_rocksdb`.
    """
    marked = events.where(F.col(key).isNotNull()).withColumn("__time", F.col(time).cast("timestamp")).withWatermark("__time", late)
    rows = marked.select(F.col(key).cast("bigint").alias("k"), F.unix_micros("__time").alias("us"), F.col(order).cast("bigint").alias("o"), "__time")
    processor = _Bucket(per_second, burst, idle_seconds)
    return rows.groupBy("k").transformWithStateInPandas(statefulProcessor=processor, outputStructType="k bigint, us bigint, o bigint, allowed boolean, wait double", outputMode="Append", timeMode="EventTime")
