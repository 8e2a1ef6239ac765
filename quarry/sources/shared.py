"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The codec of tables that hold a load's lines.
PACKED = "zstd"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir.

    Where that is unset a session on one machine, as in tests, gets a
    temporary folder; on a cluster that is an error, as executors would not
    see each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quarry-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame, name: str, by: str | None = None, codec: str | None = None) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read back, and its path; ``by`` is a column to deal files by, ``codec`` is Parquet's."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Deletes what :func:`written` has written."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def near(df: DataFrame, bound: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``bound`` rows, which are counted up to the bound."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df
