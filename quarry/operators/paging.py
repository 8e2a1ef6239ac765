"""Pages of a total order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.scalars import decode_cursor, encode_cursor
from quarry.operators import selection


def page(df: DataFrame, order: list[Column | str], offset: int, limit: int) -> DataFrame:
    """Rows offset to offset + limit of a total order; sorted partially, top rows only."""
    return df.orderBy(*order).offset(offset).limit(limit)


def positions(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """All rows with ``position`` in a total order, from 1: sorted by ranges side by side, see :func:`selection.ordered`."""
    return selection.ordered(df, order).positions()


def meta(df: DataFrame, offset: int, limit: int, version: str) -> DataFrame:
    """One row: total, limit, has_more, cursor of the next page (null on the last), data version."""
    return df.agg(F.count(F.lit(1)).alias("total")).select("total", F.lit(limit).alias("limit"), (F.col("total") > offset + limit).alias("has_more"), F.when(F.col("total") > offset + limit, encode_cursor(offset + limit, version)).alias("next_cursor"), F.lit(version).alias("dataset_version"))


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    total: int
    has_more: bool
    next_cursor: str | None
    limit: int = 0
    version: str = ""

    @property
    def meta(self) -> dict[str, object]:
        """What a response says beside its rows."""
        return {"total": self.total, "limit": self.limit, "has_more": self.has_more, "next_cursor": self.next_cursor, "dataset_version": self.version}


def paginate(df: DataFrame, order: list[Column | str], cursor: str, limit: int, version: str) -> Page:
    """A page by cursor: the offset is bound to the total, a stale cursor raises."""
    total = df.count()
    offset = min(decode_cursor(cursor, version), total)
    end = min(offset + limit, total)
    return Page(page(df, order, offset, limit), total, end < total, encode_cursor(end, version) if end < total else None, limit, version)
