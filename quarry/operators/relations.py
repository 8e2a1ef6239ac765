"""Parent and child tables: nesting in order, lookups, roll-ups, groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nested(child: DataFrame, key: str, order: list[str], value: Column, name: str) -> DataFrame:
    """key and one array of values a key, in order."""
    pairs = F.array_sort(F.collect_list(F.struct(*order, value.alias("__value"))))
    return child.groupBy(key).agg(F.transform(pairs, lambda x: x["__value"]).alias(name))


def expand(parents: DataFrame, key: str, sections: dict[str, DataFrame]) -> DataFrame:
    """Parents with an array column for each section (key, name); none is null."""
    out = parents
    for name, section in sections.items():
        out = out.join(section, key, "left").withColumn(name, F.coalesce(name, F.array()))
    return out


def member(df: DataFrame, keys: DataFrame, key: str, wanted: bool = True) -> DataFrame:
    """Rows whose key is, or isn't, among the keys."""
    return df.join(keys.select(key).distinct(), key, "left_semi" if wanted else "left_anti")


def parents(rows: DataFrame, parent: DataFrame, child_key: str, parent_key: str, columns: list[str]) -> DataFrame:
    """Rows with columns of their parent; rows without one are dropped."""
    return rows.join(parent.select(parent_key, *columns), F.col(child_key) == F.col(parent_key))


def linked_last(rows: DataFrame, links: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Left join with the last link of each key."""
    return rows.join(links.groupBy(key).agg(F.max_by(value, order).alias(value)), key, "left")


def rollup_first_name(rows: DataFrame, code: str, parent: str, name: str) -> DataFrame:
    """code, name (of the smallest parent, then name) and the number of distinct parents; empty codes are left out."""
    return rows.where(F.col(code) != "").groupBy(code).agg(F.min_by(name, F.struct(parent, name)).alias(name), F.countDistinct(parent).alias("parents"))


def groups(rows: DataFrame, group: str, label: str, order: str, members: list[str], row_no: str) -> DataFrame:
    """One row a group: the label of its first row, and its members sorted."""
    return rows.groupBy(group).agg(F.min_by(label, row_no).alias(label), F.array_sort(F.collect_list(F.struct(order, *members))).alias("members"))


def last_group(rows: DataFrame, key: str, rank: list[str], value: Column) -> DataFrame:
    """key and the value of its last group in list order."""
    return rows.groupBy(key).agg(F.max_by(value, F.struct(*rank)).alias("value"))
