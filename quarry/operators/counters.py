"""Counters over time: increases and rates on a grid of evaluation times, and alerts that hold.

A series may be as long as the table. No window runs over a whole series of
samples: rows are numbered and compared within bins of time, and only one row
a bin carries over to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a bin in which samples are compared, and steps of a bin of evaluations.
BIN_SECONDS, BIN_STEPS = 6 * 3600, 1024
_MICROS = 1_000_000


def adjusted(samples: DataFrame, keys: list[str], time: str, value: str, bin_seconds: int = BIN_SECONDS) -> DataFrame:
    """keys, us, v and total: a counter's value and the value it would have had it never been reset.

    A sample below the one before it is a reset: the lost value is added from
    there on. Null times and values are left out; equal times count in order of
    their values.
    """
    rows = samples.select(*keys, F.unix_micros(F.col(time).cast("timestamp")).alias("us"), F.col(value).cast("double").alias("v")).where("us is not null and v is not null")
    rows = rows.withColumn("bin", F.floor(F.col("us") / (bin_seconds * _MICROS)))
    own = Window.partitionBy(*keys, "bin").orderBy("us", "v")
    lost = lambda now, before: F.when(now < before, before).otherwise(0.0)
    rows = rows.withColumn("lost", lost(F.col("v"), F.lag("v").over(own)))
    rows = rows.withColumn("resets", F.sum("lost").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.struct("us", "v")
    bins = rows.groupBy(*keys, "bin").agg(F.min_by("v", place).alias("first"), F.max_by("v", place).alias("last"), F.sum("lost").alias("within"))
    order = Window.partitionBy(*keys).orderBy("bin")
    between = lost(F.col("first"), F.lag("last").over(order)) + F.lag("within", 1, 0.0).over(order)
    carry = bins.withColumn("between", between).select(*keys, "bin", F.sum("between").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("carry"))
    return rows.join(carry, [*keys, "bin"]).select(*keys, "us", "v", (F.col("v") + F.col("resets") + F.col("carry")).alias("total"))


def increases(samples: DataFrame, keys: list[str], time: str, value: str, range_seconds: int, step_seconds: int, bin_seconds: int = BIN_SECONDS) -> DataFrame:
    """keys, at (seconds), n, increase and rate at every multiple of the step whose range holds two samples or more.

    The range of an evaluation at t is (t - range, t], a multiple of the step.
    Samples are first folded into one row a step, and only those rows are
    dealt to the evaluations that see them. The increase between the first and
    the last sample is stretched to the range's edges: all the way where a
    sample lies within 1.1 mean distances of the edge, else by half a
    distance; never back beyond the point where the counter was zero.
    """
    if range_seconds % step_seconds:
        raise ValueError("the range must be a multiple of the step")
    many = range_seconds // step_seconds
    rows = adjusted(samples, keys, time, value, bin_seconds)
    step = F.ceil(F.col("us") / (step_seconds * _MICROS))
    at = F.struct("us", "total", "v")
    panes = rows.groupBy(*keys, step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))
    seen = panes.select(*keys, F.explode(F.sequence("step", F.col("step") + many - 1)).alias("step"), "n", "first", "last")
    whole = seen.groupBy(*keys, "step").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    end = F.col("step") * step_seconds
    seconds = lambda us: us / _MICROS
    first, last = F.col("first"), F.col("last")
    sampled = seconds(last["us"] - first["us"])
    gain = last["total"] - first["total"]
    mean = sampled / (F.col("n") - 1)
    edge = lambda d: F.when(d >= mean * 1.1, mean / 2).otherwise(d)
    before, after = edge(seconds(first["us"]) - (end - range_seconds)), edge(end - seconds(last["us"]))
    zero = F.when((gain > 0) & (first["v"] >= 0), sampled * (first["v"] / gain))
    before = F.when(zero < before, zero).otherwise(before)
    increase = gain * ((sampled + before + after) / sampled)
    return whole.where((F.col("n") > 1) & (first["us"] < last["us"])).select(*keys, end.alias("at"), "n", increase.alias("increase"), (increase / range_seconds).alias("rate"))


def alert_states(evaluations: DataFrame, keys: list[str], at: str, breach: Column, hold_seconds: int, step_seconds: int, bin_steps: int = BIN_STEPS) -> DataFrame:
    """``evaluations`` with state: inactive, pending, or firing once the breach has lasted ``hold_seconds``.

    ``at`` is a multiple of the step in seconds. A step without an evaluation
    ends a breach. Runs are found within bins; only runs that touch a bin's
    edge are compared with their neighbours.
    """
    rows = evaluations.withColumn("__step", (F.col(at) / step_seconds).cast("bigint")).withColumn("__breach", F.coalesce(breach, F.lit(False)))
    rows = rows.withColumn("__bin", F.floor(F.col("__step") / bin_steps))
    own = Window.partitionBy(*keys, "__bin").orderBy("__step")
    active = rows.where("__breach").select(*keys, "__bin", "__step").distinct().withColumn("__run", F.col("__step") - F.row_number().over(own))
    runs = active.groupBy(*keys, "__bin", "__run").agg(F.min("__step").alias("__since"), F.max("__step").alias("__until"))
    touches = (F.col("__since") == F.col("__bin") * bin_steps) | (F.col("__until") == (F.col("__bin") + 1) * bin_steps - 1)
    order = Window.partitionBy(*keys).orderBy("__since")
    chained = runs.where(touches).withColumn("__new", F.when(F.lag("__until").over(order) == F.col("__since") - 1, 0).otherwise(1))
    chained = chained.withColumn("__chain", F.sum("__new").over(order)).withColumn("__since", F.min("__since").over(Window.partitionBy(*keys, "__chain")))
    starts = runs.where(~touches).select(*keys, "__bin", "__run", "__since").unionByName(chained.select(*keys, "__bin", "__run", "__since"))
    since = active.join(starts, [*keys, "__bin", "__run"]).select(*keys, "__step", "__since")
    state = F.when(F.col("__since").isNull(), "inactive").when((F.col("__step") - F.col("__since")) * step_seconds >= hold_seconds, "firing").otherwise("pending")
    joined = rows.join(since, [*keys, "__step"], "left").withColumn("state", F.when(F.col("__breach"), state).otherwise("inactive"))
    return joined.drop("__step", "__breach", "__bin", "__since")
