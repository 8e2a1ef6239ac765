"""Nested values of unknown shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sources.shared import removed, written


def _kind(v: Column) -> Column:
    shape = F.schema_of_variant(v)
    named = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}
    out = F.when(v.isNull() | F.is_variant_null(v), "null")
    for begins, kind in named.items():
        out = out.when(shape.startswith(begins), kind)
    return out.otherwise("number")


def key_walk(df: DataFrame, json: Column) -> DataFrame:
    """path, kind and n of every value at any depth of JSON texts: ``$.a[*].b``.

    One pass a level; each explodes only what the level before left nested,
    and ends when nothing is. Elements of an array share a path. Null texts are
    left out, broken ones end the walk with an error.
    """
    spark = df.sparkSession
    level = df.select(F.lit("$").alias("path"), F.parse_json(json).alias("v")).where(F.col("v").isNotNull())
    counts, paths = [], []
    while True:
        told, path = written(level.select("path", _kind(F.col("v")).alias("kind"), "v"), "level")
        paths.append(path)
        counts.append(told.groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n")).collect())
        inner = told.where(F.col("kind").isin("object", "array"))
        if inner.isEmpty():
            break
        each = inner.alias("i").lateralJoin(spark.tvf.variant_explode(F.col("i.v").outer())).select("path", "kind", "key", "value")
        step = F.when(F.col("kind") == "array", F.lit("[*]")).otherwise(F.concat(F.lit("."), "key"))
        level = each.select(F.concat("path", step).alias("path"), F.col("value").alias("v"))
    for path in paths:
        removed(spark, path)
    return spark.createDataFrame([tuple(r) for found in counts for r in found], "path string, kind string, n long")
