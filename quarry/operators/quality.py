"""Duplicates, referential integrity, counters and plausibility gates."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rejects told one by one, different values of a dictionary and of a small one.
DETAIL_ROWS, WIDE, NARROW = 1000, 65_535, 255


def first_wins(df: DataFrame, key: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that come first within their key, and the later ones."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return ranked.where("__rank = 1").drop("__rank"), ranked.where("__rank > 1").drop("__rank")


def last_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row a key: the last one, by partial aggregation."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last")).select(*key, "__last.*")


def in_scope(child: DataFrame, parent: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key exists in the parent, and orphans."""
    keys = parent.select(key).distinct()
    return child.join(keys, key, "left_semi"), child.join(keys, key, "left_anti")


def neutralise(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows are kept; a key that the parent doesn't have becomes null and ``orphan`` true."""
    keys = parent.select(F.col(key).alias("__key")).where("__key is not null").distinct()
    joined = child.join(keys, child[key] == F.col("__key"), "left")
    orphan = F.col(key).isNotNull() & F.col("__key").isNull()
    return joined.withColumn("orphan", orphan).withColumn(key, F.col("__key")).drop("__key").select(*child.columns, "orphan")


def reject_counters(rejects: DataFrame) -> DataFrame:
    """Counts by file, by reason and in all (both null), in one pass."""
    return rejects.groupingSets([["file"], ["reason"], []], "file", "reason").agg(F.count(F.lit(1)).alias("n"))


def report_order(rejects: DataFrame) -> DataFrame:
    """Reports come in one order: by file, line and reason."""
    return rejects.orderBy("file", "line_no", "reason")


def reject_detail(rejects: DataFrame, most: int = DETAIL_ROWS) -> DataFrame:
    """The first rejects in report order, with the start of their lines; counters cover all of them."""
    return report_order(rejects).limit(most)


def dominant_reason(rejects: DataFrame) -> DataFrame:
    """The most frequent reason; of equally frequent ones the smaller text."""
    return rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason").limit(1)


def keyed_reasons(rejects: DataFrame) -> DataFrame:
    """file, the most frequent reason of all files, and the file's number of rejects."""
    files = rejects.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    return files.crossJoin(F.broadcast(dominant_reason(rejects).select("reason"))).select("file", "reason", "n")


def entity_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """entity and n of every table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("entity"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def delta_counts(now: DataFrame, before: DataFrame) -> DataFrame:
    """entity and difference where both have a count and it changed."""
    return now.join(before.withColumnRenamed("n", "was"), "entity").where("n <> was").select("entity", (F.col("n") - F.col("was")).alias("delta"))


def scope_ratios(kept: Column, rejected: Column, out_of_scope: Column) -> tuple[Column, Column]:
    """Rejected and out-of-scope rows as parts of all; 0 if there are none."""
    return tuple(F.when(kept + part > 0, part / (kept + part)).otherwise(0.0) for part in (rejected, out_of_scope))


class GateError(ValueError):
    """A plausibility gate that a load doesn't pass; what is published stays."""

    def __init__(self, gate: str, message: str):
        super().__init__(f"{gate}: {message}")
        self.gate = gate


@dataclass(frozen=True)
class Gates:
    """Bounds; an out-of-scope ratio of 0 or less isn't checked."""

    reject_ratio: float = 0.01
    scope_ratio: float = 0.20
    floor: int = 10_000
    variation: float = 0.20
    required: tuple[str, ...] = ("specialites", "presentations", "composants")
    floor_of: str = "specialites"
    previous: dict[str, int] = field(default_factory=dict)


def ratio(part: int, kept: int) -> float:
    return part / (part + kept) if part + kept else 0.0


def check_dictionaries(sizes: dict[str, int], most: dict[str, int]) -> None:
    """Raises where a column has more different values than its code space."""
    for name in sorted(sizes):
        if sizes[name] > most.get(name, WIDE):
            raise GateError("dictionnaire", f"{name} has {sizes[name]} different values, at most {most.get(name, WIDE)} fit")


def check_gates(counts: dict[str, int], kept: int, rejected: int, out_of_scope: int, gates: Gates) -> None:
    """Raises on the first gate that fails: empty file, rejects, scope, floor, variation."""
    for name in gates.required:
        if not counts.get(name):
            raise GateError("fichier_vide", f"{name} has no rows")
    if ratio(rejected, kept) > gates.reject_ratio:
        raise GateError("taux_rejet", f"{rejected} of {rejected + kept} rows are rejected")
    if gates.scope_ratio > 0 and ratio(out_of_scope, kept) > gates.scope_ratio:
        raise GateError("hors_perimetre", f"{out_of_scope} of {out_of_scope + kept} rows have no parent")
    if counts.get(gates.floor_of, 0) < gates.floor:
        raise GateError("plancher_specialites", f"{counts.get(gates.floor_of, 0)} rows, {gates.floor} expected")
    for name in sorted(counts):
        if (was := gates.previous.get(name)) and abs(counts[name] - was) / was > gates.variation:
            raise GateError("variation_compteur", f"{name} changed from {was} to {counts[name]}")
