"""Corpus pipeline: toxicity, quality, near duplicates, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``. Side tables are read from ``sf_dir``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import cut, table
from quarry.llm.decontaminate import decontaminate
from quarry.llm.jaccard import near_duplicate_survivors
from quarry.llm.packing import pack, pieces
from quarry.llm.quality import quality_filter
from quarry.llm.toxicity import toxicity_filter


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go. The model learns from the labelled documents of the stage's input.

    Null and empty texts and null ids stay; repeated rows are judged alike; an
    empty table stays empty; without labels of both kinds nothing goes.
    """
    return toxicity_filter(docs, table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as bad go. The model learns from the labelled documents of the stage's input.

    Null and empty texts go or stay by the share of good labels; repeated rows
    are judged alike; an empty table stays empty; without labels every score
    is 0.5, which is below the bound.
    """
    return quality_filter(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 or more.

    Null, empty and wordless texts and null ids stay; of rows that repeat the
    kept id all stay; an empty table stays empty.
    """
    return near_duplicate_survivors(docs, size=5, num=4, den=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share ten consecutive words with a benchmark item go, or all words of a shorter item.

    Null and empty texts and null ids stay; repeated rows are judged alike; an
    empty benchmark takes nothing.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens.

    Null and empty texts are their end alone; null ids and repeated rows are
    packed as they come; an empty table gives no sequences.
    """
    return pack(pieces(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Learnt scores and token ids are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
