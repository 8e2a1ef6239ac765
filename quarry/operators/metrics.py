"""Histograms, quantiles and rates over a table of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.scalars import status_label

#: Upper bounds of latency buckets in seconds.
LATENCY = (0.0001, 0.0002, 0.00025, 0.0005, 0.001, 0.0025, 0.003, 0.005, 0.01, 0.025, 0.1, 0.5, 1.0)
#: Upper bounds of size buckets in bytes, and of search result buckets.
SIZES = tuple(256 * 4**k for k in range(8))
RESULTS = (0, 1, 5, 10, 50, 100, 500, 1000, 5000)


def histogram(df: DataFrame, keys: list[str], value: str, bounds: tuple) -> DataFrame:
    """Cumulative count for each bound: le and n, with the total under infinity."""
    counts = [F.count_if(F.col(value) <= b).alias(f"__{i}") for i, b in enumerate(bounds)]
    wide = df.groupBy(*keys).agg(*counts, F.count(value).alias("__total"))
    pairs = [F.struct(F.lit(float(b)).alias("le"), F.col(f"__{i}").alias("n")) for i, b in enumerate(bounds)]
    return wide.select(*keys, F.inline(F.array(*pairs, F.struct(F.lit(float("inf")).alias("le"), F.col("__total").alias("n")))))


def summed(buckets: DataFrame, keys: list[str]) -> DataFrame:
    """Cumulative counts added up over all other labels."""
    return buckets.groupBy(*keys, "le").agg(F.sum("n").alias("n"))


def request_metrics(requests: DataFrame, route: str, status: Column, seconds: str, size: str, hits: str) -> dict[str, DataFrame]:
    """Requests by route and status label, and histograms of durations, sizes and result numbers by route, at the fixed bounds."""
    return {
        "requests": requests.groupBy(route, status_label(status).alias("status")).agg(F.count(F.lit(1)).alias("n")),
        "durations": histogram(requests, [route], seconds, LATENCY),
        "sizes": histogram(requests, [route], size, SIZES),
        "results": histogram(requests, [route], hits, RESULTS),
    }


def histogram_quantiles(buckets: DataFrame, keys: list[str], points: dict[str, float]) -> DataFrame:
    """A column for each named quantile, by linear interpolation in the first bucket whose cumulative count reaches its part of the total.

    Beyond the last finite bound the quantile is that bound; an empty histogram gives null.
    """
    rows = buckets.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("le", "n"))).alias("b"))
    total = F.element_at("b", -1)["n"]

    def quantile(q: float) -> Column:
        target = total * F.lit(q)
        at = F.array_position(F.transform("b", lambda x: x["n"] >= target), True).cast("int")
        low = F.when(at > 1, F.get("b", at - 2)["le"]).otherwise(0.0)
        below = F.when(at > 1, F.get("b", at - 2)["n"]).otherwise(0)
        high, upto = F.get("b", at - 1)["le"], F.get("b", at - 1)["n"]
        inside = F.when(upto == below, high).otherwise(low + (high - low) * (target - below) / (upto - below))
        return F.when(total > 0, F.when(high == float("inf"), low).otherwise(inside))

    return rows.select(*keys, *[quantile(q).alias(name) for name, q in points.items()])


def histogram_quantile(buckets: DataFrame, keys: list[str], q: float) -> DataFrame:
    """keys and ``quantile``: one of :func:`histogram_quantiles`."""
    return histogram_quantiles(buckets, keys, {"quantile": q})


def rate(df: DataFrame, keys: list[str], time: str, width: str, slide: str | None = None) -> DataFrame:
    """Events and events a second of each window."""
    seconds = F.unix_timestamp(F.col("w.end")) - F.unix_timestamp(F.col("w.start"))
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return df.groupBy(*keys, w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("start"), "n", (F.col("n") / seconds).alias("rate"))


def increase(df: DataFrame, keys: list[str], time: str, now: str, span: str) -> DataFrame:
    """Events of the span that ends at ``now``."""
    end = F.lit(now).cast("timestamp")
    inside = (F.col(time).cast("timestamp") > F.expr(f"timestamp'{now}' - interval {span}")) & (F.col(time).cast("timestamp") <= end)
    return df.groupBy(*keys).agg(F.count_if(inside).alias("increase"))


def alerts(samples: DataFrame, keys: list[str], time: str, value: str, above: float, hold_seconds: int) -> DataFrame:
    """Samples with ``firing``: the value has been above the bound at each sample for ``hold_seconds`` up to this one."""
    past = Window.partitionBy(*keys).orderBy(time)
    breach = F.coalesce(F.col(value) > above, F.lit(False))
    # The last calm sample so far; a run of breaches begins with the first one behind it.
    calm = samples.withColumn("__breach", breach).withColumn("__calm", F.last(F.when(~F.col("__breach"), F.col(time)), ignorenulls=True).over(past))
    run = calm.withColumn("__since", F.min(F.when(F.col("__breach"), F.col(time))).over(Window.partitionBy(*keys, "__calm").orderBy(time)))
    lasted = F.unix_timestamp(F.col(time).cast("timestamp")) - F.unix_timestamp(F.col("__since").cast("timestamp"))
    return run.withColumn("firing", F.col("__breach") & (lasted >= hold_seconds)).drop("__breach", "__calm", "__since")


def error_ratio(df: DataFrame, keys: list[str], error: Column) -> DataFrame:
    """Errors over all, the divisor being 0.001 at least."""
    return df.groupBy(*keys).agg(F.count_if(error).alias("errors"), F.count(F.lit(1)).alias("n")).withColumn("ratio", F.col("errors") / F.greatest(F.col("n"), F.lit(0.001)))
