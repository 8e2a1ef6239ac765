"""Session helpers of the subpackage: shared files, folds, safe column names."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.shared import removed, shared_dir

__all__ = ["cut", "few", "fold", "fresh", "held_out", "learnable", "release", "removed", "shared_dir", "small_batches", "table"]


#: Rows and bytes of an Arrow batch: what a Python worker holds at once.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch limits to what the operators' memory bounds assume."""
    for key, bound in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        if now is None or not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= bound:
            spark.conf.set(key, str(bound))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    A lost executor costs a re-read, never a recomputation of what came before.
    """
    small_batches(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/quarry/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of :func:`cut` that nothing reads any more."""
    for df in tables:
        removed(df.sparkSession, df._cut_path)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def held_out(doc_id: Column) -> Column:
    """Rows whose fold is 2; a null id belongs to no fold, so it is not held out."""
    return F.coalesce(fold(doc_id) == 2, F.lit(False))


def learnable(doc_id: Column) -> Column:
    """Rows a model may learn labels from: a known id outside the held-out fold."""
    return F.coalesce(fold(doc_id) != 2, F.lit(False))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def few(df: DataFrame, bound: int) -> bool:
    """Whether ``df`` has at most ``bound`` rows; looks at no more than one row beyond."""
    return df.limit(bound + 1).count() <= bound
