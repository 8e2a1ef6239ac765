"""Records from clustered relations: equal to those joined anew, without a shuffle of the relations."""

import re

import pytest
from pyspark.sql import functions as F

from quarry.operators import catalogue
from quarry.plans.domain import catalogue_of
from quarry.plans.registry import Tables
from quarry.sources import clustered

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def held(spark, tmp_path_factory):
    c = catalogue_of(Tables(spark, FOLDER))
    path = f"file://{tmp_path_factory.mktemp('clusters')}/c"
    clustered.publish(c, path, buckets=4)
    return c, clustered.Records(spark, path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("include", ["", "avis,ruptures", "all"])
def test_records_equal_those_joined_anew(held, include):
    c, records = held
    fresh = catalogue.full_view(c, include)
    assert rows(records.full(include).select(*fresh.columns)) == rows(fresh)


def test_relations_are_not_shuffled(spark, held):
    records = held[1]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(records.full("all"))
        assert "SortMergeJoin" in text and "Exchange" not in text
        asked = spark.createDataFrame([("00000001",), ("zzz",)], "key string")
        # Only the asked codes move.
        text = plan(records.full("all", asked.withColumnRenamed("key", "cis")))
        assert not re.search(r"Exchange hashpartitioning\(cis[^\n]*\n[^\n]*(FileScan|Filter|ColumnarToRow)[^\n]*clustered_", text)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_look_ups(spark, held):
    c, records = held
    asked = spark.createDataFrame([(1, "00000001"), (2, "00000007"), (3, "none"), (4, "00000001")], "n int, key string")
    found = records.look_up(asked, "presentations")
    anew = catalogue.look_up_drugs(c, asked, "presentations")
    assert rows(found.select("n", "key", "found", F.col("medicament.cis"), F.size("medicament.presentations"))) == rows(anew.select("n", "key", "found", F.col("medicament.cis"), F.size("medicament.presentations")))


def test_only_named_sections_are_written(spark, held, tmp_path):
    clustered.publish(held[0], f"file://{tmp_path}/c", buckets=2, sections=())
    records = clustered.Records(spark, f"file://{tmp_path}/c")
    assert list(records.tables) == ["record"] and rows(records.full()) == rows(held[1].full())
