"""Queries that have to return the whole job, on the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

from quarry.operators import paging, quality, selection
from quarry.plans import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def rows_of(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet")


def test_every_line_is_looked_up(spark):
    lines = rows_of(spark, "lineitem")
    found = QUERIES["parent_lookup"](spark, FOLDER).agg(F.sum("n"), F.max("l_orderkey")).first()
    assert tuple(found) == (lines.count(), lines.agg(F.max("l_orderkey")).first()[0])


@pytest.mark.parametrize(("name", "table"), [("sort_stable", "orders"), ("sort_names", "part")])
def test_every_row_has_a_position(spark, name, table):
    found = sorted(r["position"] for r in QUERIES[name](spark, FOLDER).select("position").collect())
    assert found == list(range(1, rows_of(spark, table).count() + 1))


def test_positions(spark):
    rows = spark.createDataFrame([(1, "éa"), (2, None), (3, "b"), (4, "b"), (5, "ba"), (6, "")], "k int, v string")
    for descending, expected in ((False, [6, 3, 4, 5, 1, 2]), (True, [1, 5, 3, 4, 6, 2])):
        order = F.col("v").desc_nulls_last() if descending else F.col("v").asc_nulls_last()
        got = paging.positions(rows, [order, "k"]).orderBy("position").collect()
        assert [r["k"] for r in got] == expected


def test_shortages_are_newest_first(spark):
    found = [(r["day"], r["o_orderkey"]) for r in QUERIES["filter_shortages"](spark, FOLDER).collect()]
    assert len(found) > 1 and found == sorted(found, key=lambda r: (-r[0].toordinal(), r[1]))


def test_every_table_is_counted(spark):
    found = {r["entity"]: r["n"] for r in QUERIES["entity_counts"](spark, FOLDER).collect()}
    assert found == {n.removesuffix(".parquet"): rows_of(spark, n.removesuffix(".parquet")).count() for n in os.listdir(FOLDER) if n.endswith(".parquet")}


def test_every_file_gets_the_reason(spark):
    rows = spark.createDataFrame([("a", "y"), ("a", "x"), ("b", "x"), ("b", "y"), ("c", "z")], "file string, reason string")
    assert sorted(map(tuple, quality.keyed_reasons(rows).collect())) == [("a", "x", 2), ("b", "x", 2), ("c", "x", 1)]


def test_overlap_counts_more_values_than_a_sketch_holds(spark):
    n = 40_000
    rows = spark.range(n).select(F.lit("a").alias("k"), F.col("id").alias("v"), (F.col("id") % 2 == 0).alias("old"))
    rows = rows.unionByName(spark.range(0, n, 4).select(F.lit("a").alias("k"), F.col("id").alias("v"), F.lit(False).alias("old")))
    rows = rows.unionByName(spark.createDataFrame([("b", 1, True), ("a", None, True)], "k string, v long, old boolean"))
    assert list(map(tuple, selection.exact_overlap(rows, ["k"], "v", F.col("old")).collect())) == [("a", n // 4, n, n // 4)]


def test_groups_of_records_are_whole_brands(spark):
    brands = {r["p_brand"]: r["count"] for r in rows_of(spark, "part").groupBy("p_brand").count().collect()}
    found = QUERIES["view_full"](spark, FOLDER).select("groupe", "membres").distinct().collect()
    assert {r["groupe"]: r["membres"] for r in found} == brands
