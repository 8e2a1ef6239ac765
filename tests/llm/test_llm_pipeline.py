"""The corpus pipeline at the smallest size."""

import os

import pytest

import corpus_pipeline
from quarry.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER).cache()
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before, name
        before = docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).select("doc_id").distinct().count() == before


def test_names():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14)) and set(ORACLES) <= set(QUERIES)
