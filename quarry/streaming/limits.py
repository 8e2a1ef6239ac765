"""Token buckets per key: as a fold over a batch, and as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def token_bucket(events: DataFrame, key: str, time: str, order: str, per_second: float, burst: float) -> DataFrame:
    """key, time, order, allowed and wait (seconds, 0 if allowed) of every event.

    A bucket starts full, refills at ``per_second`` up to ``burst`` and gives
    one token an event; a refused event waits for the missing part, 1 s at
    least. Events of a key are folded in order of time, one after the other,
    as each level hangs on the one before; rows stream past in sorted order,
    so a key may have any number of events. Idle keys keep their level.
    """
    rows = events.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.unix_micros(F.col(time).cast("timestamp")).alias("us"), F.col(order).alias("o"))
    schema = "k bigint, us bigint, o bigint, allowed boolean, wait double"

    def fold(_, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        level, last = burst, None
        for batch in batches:
            allowed, wait = [], []
            for us in batch["us"].tolist():
                if last is not None:
                    level = min(burst, level + (us - last) / 1e6 * per_second)
                last = us
                allowed.append(level >= 1)
                wait.append(0.0 if level >= 1 else max(1.0, (1 - level) / per_second))
                level -= level >= 1
            yield batch.assign(allowed=allowed, wait=wait)

    return rows.repartition("k").sortWithinPartitions("k", "us", "o").mapInPandas(_by_key(fold), schema).select(F.col("k").alias(key), F.timestamp_micros("us").alias(time), F.col("o").alias(order), "allowed", "wait")


def _by_key(fold):
    """Runs ``fold`` over keys of sorted batches without gathering a key's rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict = {}
        for batch in batches:
            for k, part in batch.groupby("k", sort=False):
                if k not in states:
                    states.clear()
                    states[k] = _Feed(fold)
                yield states[k].give(part)

    return run


class _Feed:
    """A generator fed batch by batch."""

    def __init__(self, fold):
        self.next: list[pd.DataFrame] = []
        self.out = fold(None, self._batches())

    def _batches(self) -> Iterator[pd.DataFrame]:
        while True:
            yield self.next.pop()

    def give(self, batch: pd.DataFrame) -> pd.DataFrame:
        self.next.append(batch)
        return next(self.out)


def token_bucket_stream(events: DataFrame, key: str, time: str, per_second: float, burst: float, late: str = "1 minute") -> DataFrame:
    """The same on a stream: key, time (microseconds), allowed.

    Events of a batch are folded in order of time; those later than the
    watermark's ``late`` are dropped. A key's state ends by event time, when
    its bucket would be full again anyway, so nothing is lost with it.
    """
    marked = events.withColumn("__time", F.col(time).cast("timestamp")).withWatermark("__time", late)
    rows = marked.select(F.col(key).cast("string").alias("k"), F.unix_micros("__time").alias("us"), "__time")
    full_after = int(burst / per_second * 1000) + 1

    def step(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        level, last = state.get if state.exists else (burst, -1)
        us = sorted(x for b in batches for x in b["us"].tolist())
        allowed = []
        for t in us:
            level = min(burst, level + max(0, t - last) / 1e6 * per_second) if last >= 0 else level
            last = max(last, t)
            allowed.append(level >= 1)
            level -= level >= 1
        state.update((level, last))
        state.setTimeoutTimestamp(max(last // 1000 + full_after, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"k": [k[0]] * len(us), "us": us, "allowed": allowed})

    return rows.groupBy("k").applyInPandasWithState(step, "k string, us bigint, allowed boolean", "level double, last bigint", "append", "EventTimeTimeout")


def windowed_counts_stream(events: DataFrame, time: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Counts of each window on a stream; windows close when the watermark has passed them."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")
