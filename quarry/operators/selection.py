"""Quantiles, total orders and distinct counts at any size.

Exact quantiles are found by narrowing: counts of value ranges, pass by pass.
A total order is a range partitioning whose partitions are numbered by their
counts. Sketches stand for sets of rows and merge.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.sources.shared import near, removed, written

#: Ranges that a pass divides a range into, and rows that are sorted in the end.
RANGES, SORTED = 1024, 20_000


def exact_quantiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float], ranges: int = RANGES, sorted_rows: int = SORTED) -> DataFrame:
    """keys and for each point element number int((n - 1) * q) of the sorted values.

    Each pass counts the values of a key in equal ranges between the bounds
    known so far and keeps the range that holds the wanted place, with its
    smallest and largest value as new bounds. A range of at most
    ``sorted_rows`` rows is sorted. No task ever holds a key: passes combine
    counts before they shuffle. Nulls and values that aren't finite are left out.
    """
    v = F.col(value).cast("double")
    values = df.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], v.alias("__v")).where("__v is not null and not isnan(__v) and abs(__v) < double('infinity')")
    own = [f"__k{i}" for i in range(len(keys))]
    facts = values.groupBy(*own).agg(F.count(F.lit(1)).alias("left"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("point"), F.floor((F.col("left") - 1) * F.lit(q)).alias("place")) for name, q in points.items()]))
    targets, path = written(facts.where("left > 0").select("*", asked.alias("p")).select(*own, "p.point", "p.place", "left", "lo", "hi"), "targets")

    def within(some: DataFrame) -> DataFrame:
        """Values inside the bounds of their key's targets."""
        t = near(some).alias("t")
        x = values.alias("x")
        on = [F.col(f"x.{k}").eqNullSafe(F.col(f"t.{k}")) for k in own] + [F.col("__v") >= F.col("lo"), F.col("__v") <= F.col("hi")]
        joined = x.join(t, on) if own else x.join(t, on[-2:])
        return joined.select(*[F.col(f"t.{k}").alias(k) for k in own], "point", "place", "left", "lo", "hi", "__v")

    wide = (F.col("left") > sorted_rows) & (F.col("lo") < F.col("hi"))
    while not targets.where(wide).isEmpty():
        rows = within(targets.where(wide))
        # Halved, as the distance of two doubles may be none.
        share = (F.col("__v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        at = F.least(F.floor(share * ranges), F.lit(ranges - 1))
        counts = rows.groupBy(*own, "point", "place", at.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
        order = Window.partitionBy(*own, "point").orderBy("at")
        upto = counts.withColumn("upto", F.sum("n").over(order))
        found = upto.where((F.col("upto") > F.col("place")) & (F.col("upto") - F.col("n") <= F.col("place")))
        narrower = found.select(*own, "point", (F.col("place") - F.col("upto") + F.col("n")).alias("place"), F.col("n").alias("left"), "lo", "hi")
        kept = targets.where(~wide).unionByName(narrower)
        targets, new = written(kept, "targets")
        removed(df.sparkSession, path)
        path = new
    single = targets.where("lo = hi").select(*own, "point", F.col("lo").alias("__v"))
    order = Window.partitionBy(*own, "point").orderBy("__v")
    numbered = within(targets.where("lo < hi")).withColumn("r", F.row_number().over(order) - 1).where(F.col("r") == F.col("place")).select(*own, "point", "__v")
    wanted = [F.max(F.when(F.col("point") == name, F.col("__v"))).alias(name) for name in points]
    return single.unionByName(numbered).groupBy(*own).agg(*wanted).select(*[F.col(o).alias(k) for o, k in zip(own, keys, strict=True)], *points)


# Total orders


@dataclass(frozen=True)
class Ordered:
    """Rows in a total order, written by ranges: where each range begins, and what it holds."""

    rows: DataFrame
    starts: list[tuple[int, int, int]]
    total: int
    path: str

    def positions(self) -> DataFrame:
        """All rows with ``position``, from 1."""
        spark = self.rows.sparkSession
        starts = spark.createDataFrame(self.starts, "__range int, __begin long, __n long")
        return self.rows.join(F.broadcast(starts), "__range").withColumn("position", F.col("__begin") + F.col("__own") + 1).drop("__range", "__own", "__begin", "__n")

    def page(self, offset: int, limit: int) -> DataFrame:
        """Rows with positions offset + 1 to offset + limit, in order; only the ranges that hold them are read."""
        ranges = [r for r, begin, n in self.starts if begin < offset + limit and begin + n > offset]
        some = self.positions() if not ranges else Ordered(self.rows.where(F.col("__range").isin(ranges)), self.starts, self.total, self.path).positions()
        return some.where((F.col("position") > offset) & (F.col("position") <= offset + limit)).orderBy("position")


def ordered(df: DataFrame, order: list[Column | str]) -> Ordered:
    """``df`` in a total order: ranges of it are sorted side by side and written, and their counts (a row a range) give the places.

    ``order`` must decide between any two rows; rows that it leaves equal come in any order.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # The low 33 bits of this number are the row's place in its partition.
    numbered = ranged.withColumn("__own", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).withColumn("__range", F.spark_partition_id())
    rows, path = written(numbered, "ordered", "__range")
    begin, starts = 0, []
    for r in rows.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).orderBy("__range").collect():
        starts.append((r["__range"], begin, r["n"]))
        begin += r["n"]
    return Ordered(rows, starts, begin, path)


# Sketches


def quantile_sketches(df: DataFrame, keys: list[str], value: str, size: int = 400) -> DataFrame:
    """keys and a quantile sketch (KLL) of the values: some kilobytes, whatever the number of rows."""
    return df.groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), size).alias("sketch"))


def merged_quantiles(sketches: DataFrame, keys: list[str], points: dict[str, float]) -> DataFrame:
    """keys and estimated quantiles of all rows behind the sketches of a key."""
    whole = sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("__sketch"))
    return whole.select(*keys, *[F.kll_sketch_get_quantile_double("__sketch", F.lit(q)).alias(name) for name, q in points.items()])


#: Up to 2^BITS distinct values are counted exactly.
BITS = 14


def distinct_sketches(df: DataFrame, keys: list[str], value: str, bits: int = BITS) -> DataFrame:
    """keys and a sketch (theta) of the distinct values; up to 2^bits of them are kept as they are."""
    return df.groupBy(*keys).agg(F.theta_sketch_agg(value, bits).alias("sketch"))


def merged_distinct(sketches: DataFrame, keys: list[str], bits: int = BITS) -> DataFrame:
    """keys and the estimated number of distinct values behind all sketches of a key."""
    return sketches.groupBy(*keys).agg(F.theta_sketch_estimate(F.theta_union_agg("sketch", bits)).alias("distinct"))


def exact_overlap(df: DataFrame, keys: list[str], value: str, old: Column) -> DataFrame:
    """What :func:`overlap` estimates, counted: ``old`` is true for rows of the first version, false for those of the second.

    Any number of values; those of a key are dealt to all tasks. Keys need rows of both versions.
    """
    each = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.bool_or(old).alias("__old"), F.bool_or(~old).alias("__new"))
    counts = {"both": F.count_if(F.col("__old") & F.col("__new")), "either": F.count(F.lit(1)), "gone": F.count_if(F.col("__old") & ~F.col("__new"))}
    return each.groupBy(*keys).agg(*[c.alias(name) for name, c in counts.items()], F.bool_or("__old").alias("__a"), F.bool_or("__new").alias("__b")).where("__a and __b").drop("__a", "__b")


def overlap(left: DataFrame, right: DataFrame, keys: list[str], bits: int = BITS) -> DataFrame:
    """keys, and how many distinct values two versions' sketches have in both, in either, and only in the first."""
    both = left.select(*keys, F.col("sketch").alias("__a")).join(right.select(*keys, F.col("sketch").alias("__b")), keys)
    counts = {"both": F.theta_intersection("__a", "__b"), "either": F.theta_union("__a", "__b", bits), "gone": F.theta_difference("__a", "__b")}
    return both.select(*keys, *[F.theta_sketch_estimate(c).alias(name) for name, c in counts.items()])
