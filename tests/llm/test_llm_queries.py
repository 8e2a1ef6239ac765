"""The training-data queries against their SQL, and the pipeline's stages against brute force, at the smallest size."""

import os
import re

import duckdb
import pytest

import corpus_pipeline
from quarry.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fixed = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(columns), sorted((tuple(fixed(r[i]) for i in order) for r in rows), key=lambda r: [str(v) for v in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    found = QUERIES[name](spark, FOLDER)
    got = sorted_rows(found.columns, [tuple(r) for r in found.collect()])
    assert got[1]
    if name in ORACLES:
        connection = duckdb.connect()
        for t in ("documents", "pages", "benchmark", "labels"):
            connection.sql(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
        expected = connection.sql(ORACLES[name])
        assert got == sorted_rows(expected.columns, expected.fetchall())


def words_of(text, separators):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [w for w in re.split(separators, lowered) if w]


def grams(words, n):
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} - {()}


def kept(spark, stage):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = dict(corpus_pipeline.STAGES)[stage](spark, docs, FOLDER)
    return docs.collect(), sorted(r["doc_id"] for r in found.select("doc_id").collect())


def test_near_duplicates(spark):
    rows, found = kept(spark, "near_duplicates")
    sets = {r["doc_id"]: grams(words_of(r["text"], r"[ \t-\r]+"), 5) for r in rows}
    component = {d: d for d in sets}

    def root(d):
        while component[d] != d:
            d = component[d]
        return d

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 5 * both >= 4 * len(sets[a] | sets[b]) and root(a) != root(b):
                x, y = sorted((root(a), root(b)))
                component[y] = x
    assert len(found) == len({root(d) for d in ids}) == len({root(d) for d in found})


def test_decontamination(spark):
    rows, found = kept(spark, "decontamination")
    separators = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    items = [words_of(r["text"], separators) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    windows = {}
    for w in items:
        windows.setdefault(min(10, len(w)), set()).update(grams(w, min(10, len(w))))
    windows.pop(0, None)
    expected = []
    for r in rows:
        w = words_of(r["text"], separators)
        if not any(len(w) >= n and grams(w, n) & g for n, g in windows.items()):
            expected.append(r["doc_id"])
    assert found == sorted(expected)


def test_run(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER).cache()
    packed = corpus_pipeline.run(spark, FOLDER).select("doc_id", "sequence_id", "offset", "length").collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    fills = {}
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fills.get(r["sequence_id"], 0)
        fills[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fills.values()) <= 2048
