"""Registry of queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables of a folder by name, read when named."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def file_facts(*tables: DataFrame) -> str:
    """What tells one state of tables from another: names, sizes and times of their files."""
    rows = set()
    for df in tables:
        rows |= set(map(tuple, df.select("_metadata.file_path", "_metadata.file_size", F.col("_metadata.file_modification_time").cast("string")).distinct().collect()))
    return str(sorted(rows))


def query(sql: str | None = None):
    """Registers a function of Tables under its own name."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(rows: list[tuple], names: str) -> str:
    """The same rows as SQL."""

    def one(v: object) -> str:
        return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return "(values " + ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows) + f") as t({names})"
