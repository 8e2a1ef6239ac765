"""The catalogue's relations, clustered by drug: what a load publishes for reading whole records.

Every section of a record is one table with a row a drug, in buckets by the
drug's code and sorted by it. Tables of equal buckets are joined where they
lie: records need no shuffle, and a look-up shuffles or sends only the codes
that are asked for.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import params
from quarry.operators import catalogue
from quarry.sources.shared import near
from quarry.sources.snapshot import _Store

BASE, FACTS = "record", "clusters.json"
#: Buckets of a small catalogue; give more where a bucket would pass some hundred megabytes.
BUCKETS = 8


def _columns(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def publish(c: catalogue.Catalogue, path: str, buckets: int = BUCKETS, sections: tuple[str, ...] = catalogue.SECTIONS) -> None:
    """Writes the records' own columns and the sections, all unless named, under ``path``; the facts are written last."""
    spark = c.specialites.sparkSession
    tables = {BASE: catalogue.full_view(c, "")} | {s: catalogue.sub_resource(c, s) for s in sections}
    columns = {}
    for name, df in tables.items():
        made = f"clustered_{uuid.uuid4().hex}"
        # One file a bucket: rows are dealt as the buckets are.
        dealt = df.repartition(buckets, "cis")
        dealt.write.mode("overwrite").bucketBy(buckets, "cis").sortBy("cis").format("parquet").option("path", f"{path}/{name}").saveAsTable(made)
        columns[name] = _columns(df)
        # The name goes, the files stay.
        spark.sql(f"drop table {made}")
    _Store(spark, path).write(json.dumps({"buckets": buckets, "columns": columns}), FACTS)


class Records:
    """Published relations, opened in this session."""

    def __init__(self, spark: SparkSession, path: str):
        facts = json.loads(_Store(spark, path).read(FACTS))
        self.buckets = facts["buckets"]
        self.tables: dict[str, DataFrame] = {}
        for name, columns in facts["columns"].items():
            opened = f"clustered_{uuid.uuid4().hex}"
            spark.sql(f"create table {opened} ({columns}) using parquet clustered by (cis) sorted by (cis) into {self.buckets} buckets location '{path}/{name}'")
            self.tables[name] = spark.table(opened)

    def sections(self, include: str | None) -> list[str]:
        return params.sections(include, catalogue.SECTIONS)

    def full(self, include: str | None = None, keys: DataFrame | None = None) -> DataFrame:
        """:func:`quarry.operators.catalogue.full_view` of all drugs, or of those in ``keys`` (cis).

        Keys go to every table before it is joined, by broadcast where they are few.
        """
        near_keys = None if keys is None else near(keys.select("cis").distinct())
        read = lambda name: self.tables[name] if near_keys is None else self.tables[name].join(near_keys, "cis", "left_semi")
        out = read(BASE)
        for section in self.sections(include):
            out = out.join(read(section), "cis", "left")
            if section not in ("generiques", "avis"):
                out = out.withColumn(section, F.coalesce(section, F.array()))
        return out

    def look_up(self, asked: DataFrame, include: str | None = None) -> DataFrame:
        """``asked`` (key) with found and the full record, as :func:`quarry.operators.catalogue.look_up_drugs`."""
        view = self.full(include, asked.select(F.col("key").alias("cis")))
        held = view.select(F.col("cis").alias("key"), F.struct(*view.columns).alias("medicament"))
        return asked.join(held, "key", "left").withColumn("found", F.col("medicament").isNotNull())
