"""Severity of toxicity by cumulative-link ordinal regression.

P(severity >= k) = 1 / (1 + exp(-(w . x - t_k))): one weight vector shared by
all ordered thresholds t_1 < t_2 < t_3. Features are words and beginnings of
words (4 and 5 bytes, which inflected forms share), as log(1 + count); only
features whose document frequencies differ significantly between the classes
are kept. Labels say whether a text is toxic; a toxic training text's grade is
1, 2 or 3 by how many of its words carry a feature that is strongly tied to
toxic texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from quarry.llm import kernels as K
from quarry.llm.common import cut, fresh
from quarry.llm.quality import labelled_sample

#: Labelled documents of each class that training looks at.
SAMPLE_DOCS = 4000
#: Features of a model, their least number of documents and least G2 statistic.
FEATURES, LEAST_DOCS, LEAST_G2 = 8192, 6, 20.0
#: Words with strong features from which a toxic training text has grade 2 and 3.
GRADES = (3, 8)
#: Log odds ratio from which a feature counts as strong.
STRONG = 3.5
#: Probability of any toxicity from which a document is rejected.
TOXIC = 0.5

RESULT = "struct<severity:double,p_toxic:double,grade:int>"


def _features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Text number of each word and its features, [words, 3]: the word and its first 4 and 5 bytes."""
    words = K.Words(texts, K.ALNUM, prefixes=(4, 5))
    return np.repeat(np.arange(len(texts)), words.counts()), np.stack([words.hashes, *words.prefixes], axis=1)


def _pairs(texts: list[bytes], table: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, feature) and their counts; and text and feature number of every match, word by word.

    With a table, features are its indices and others are left out.
    """
    text, found = _features(texts)
    wide = np.repeat(text, 3)
    flat = found.ravel()
    if table is None:
        order = np.lexsort((flat, wide))
        t, f = wide[order], flat[order]
        new = np.ones(len(t), dtype=bool)
        new[1:] = (t[1:] != t[:-1]) | (f[1:] != f[:-1])
        first = np.flatnonzero(new)
        return t[first], f[first], np.diff(np.append(first, len(t))), wide, flat
    at = np.searchsorted(table, flat)
    at[at == len(table)] = 0
    hit = np.flatnonzero(table[at] == flat) if len(table) else np.zeros(0, np.int64)
    t, f = wide[hit], at[hit]
    key, count = np.unique(t * np.int64(max(len(table), 1)) + f, return_counts=True)
    return key // max(len(table), 1), key % max(len(table), 1), count, hit // 3, f


class ToxicityModel:
    """Sorted feature hashes, their weights, ordered thresholds."""

    def __init__(self, table: np.ndarray, weight: np.ndarray, threshold: np.ndarray):
        self.table, self.weight, self.threshold = table, weight, threshold

    def exceedance(self, texts: list[bytes]) -> np.ndarray:
        """P(severity >= k) per text, k = 1, 2, 3."""
        total = np.zeros(len(texts))
        if len(self.table):
            for a, b in K.text_slices(texts):
                t, f, n, _, _ = _pairs(texts[a:b], self.table)
                total[a:b] = np.bincount(t, weights=self.weight[f] * np.log1p(n), minlength=b - a)
        return 1 / (1 + np.exp(-np.clip(total[:, None] - self.threshold[None, :], -60, 60)))

    def column(self, text: str | Column) -> Column:
        """Struct of expected severity (0 to 3), P(severity >= 1) and the likeliest grade; null counts as empty."""
        model = self

        @arrow_udf(RESULT)
        def run(values: pa.Array) -> pa.Array:
            K.trim()
            p = model.exceedance([t or b"" for t in values.cast(pa.binary()).to_pylist()])
            each = -np.diff(np.concatenate((np.ones((len(p), 1)), p, np.zeros((len(p), 1))), axis=1), axis=1)
            return pa.StructArray.from_arrays([pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array(each.argmax(axis=1).astype(np.int32))], names=["severity", "p_toxic", "grade"])

        return run(text)


def _fit(doc: np.ndarray, feature: np.ndarray, value: np.ndarray, grade: np.ndarray, weight: np.ndarray, features: int, penalty: float = 1e-3, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Gradient steps (Adam) on the penalised likelihood; thresholds are a first one plus positive gaps."""
    n = len(grade)
    w, first, gap = np.zeros(features), 2.0, np.zeros(2)
    y = np.stack([(grade >= k).astype(float) for k in (1, 2, 3)], axis=1)
    theta = np.concatenate((w, [first], gap))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    scale = weight / weight.sum()
    for step in range(1, steps + 1):
        w, first, gap = theta[:features], theta[features], theta[features + 1 :]
        t = first + np.concatenate(([0.0], np.cumsum(np.exp(gap))))
        eta = np.bincount(doc, weights=w[feature] * value, minlength=n)
        p = 1 / (1 + np.exp(-np.clip(eta[:, None] - t[None, :], -40, 40)))
        # Grade likelihoods are differences of neighbouring exceedances.
        full = np.concatenate((np.ones((n, 1)), p, np.zeros((n, 1))), axis=1)
        own = np.maximum(full[np.arange(n), grade] - full[np.arange(n), grade + 1], 1e-9)
        slope = np.concatenate((np.zeros((n, 1)), p * (1 - p), np.zeros((n, 1))), axis=1)
        upper, lower = slope[np.arange(n), grade] / own, slope[np.arange(n), grade + 1] / own
        d_eta = -(upper - lower) * scale
        d_t = np.zeros((n, 5))
        d_t[np.arange(n), grade] += upper * scale
        d_t[np.arange(n), grade + 1] -= lower * scale
        d_t = d_t.sum(axis=0)[1:4]
        grad = np.concatenate((np.bincount(feature, weights=d_eta[doc] * value, minlength=features) + penalty * w / 10, [d_t.sum()], [np.exp(gap[0]) * d_t[1:].sum(), np.exp(gap[1]) * d_t[2]]))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    assert y.shape == (n, 3)
    w, first, gap = theta[:features], theta[features], theta[features + 1 :]
    return w, first + np.concatenate(([0.0], np.cumsum(np.exp(gap))))


def train_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = SAMPLE_DOCS) -> ToxicityModel:
    """Learns from at most ``per_class`` documents of each label outside the held-out fold.

    Equal texts of one label count once, those of an id with many texts up to
    the bound of ``labelled_sample``. Null and held-out ids and labels other
    than 0 and 1 are not learnt from; a null text is an empty one. Without toxic
    or without clean labelled texts nothing can be told apart: every severity
    is then near 0.
    """
    nothing = ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), np.array([6.0, 7.0, 8.0]))
    sample = cut(labelled_sample(docs, labels, label, per_class).dropDuplicates(["label", "text"]).select("doc_id", "text", "label"), "toxic")

    def document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, own = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()], batch.column("label").to_numpy()
            for a, b in K.text_slices(texts):
                t, f, _, _, _ = _pairs(texts[a:b], None)
                toxic = own[a:b][t].astype(bool)
                for flag in (False, True):
                    some, n = np.unique(f[toxic == flag], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(some.view(np.int64)), pa.array(n * (not flag)), pa.array(n * flag)], names=["feature", "clean", "toxic"])

    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return nothing
    n0, n1 = float(sizes[0]), float(sizes[1])
    counts = sample.select("text", "label").mapInArrow(document_frequencies, "feature bigint, clean bigint, toxic bigint").groupBy("feature").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")).where(F.col("c") + F.col("t") >= LEAST_DOCS)

    def part(k: Column, total: float, both: Column) -> Column:
        expected = both * total / (n0 + n1)
        rest, rest_expected = F.lit(total) - k, F.lit(total) - expected
        return F.when(k > 0, k * F.log(k / expected)).otherwise(0.0) + F.when(rest > 0, rest * F.log(rest / rest_expected)).otherwise(0.0)

    both = F.col("c") + F.col("t")
    g2 = 2 * (part(F.col("c"), n0, both) + part(F.col("t"), n1, both))
    kept = counts.withColumn("g2", g2).where(F.col("g2") >= LEAST_G2).orderBy(F.desc("g2"), "feature").limit(FEATURES).toPandas()
    if kept.empty:
        return nothing
    kept["feature"] = kept["feature"].to_numpy(dtype=np.int64).view(np.uint64)
    kept = kept.sort_values("feature")
    table = kept["feature"].to_numpy()
    odds = np.log((kept["t"] + 0.5) / (n1 + 1)) - np.log((kept["c"] + 0.5) / (n0 + 1))
    strong = odds.to_numpy() >= STRONG

    def design(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, own, ids = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()], batch.column("label"), batch.column("doc_id")
            for a, b in K.text_slices(texts):
                t, f, n, word, g = _pairs(texts[a:b], table)
                text_of, _ = _features(texts[a:b])
                marked = np.unique(word[strong[g]]) if len(word) else np.zeros(0, np.int64)
                hits = np.bincount(text_of[marked], minlength=b - a) if len(marked) else np.zeros(b - a, np.int64)
                edge = np.searchsorted(t, np.arange(b - a + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), own.slice(a, b - a), pa.array(hits.astype(np.int64)), pa.ListArray.from_arrays(pa.array(edge), pa.array(f.astype(np.int32))), pa.ListArray.from_arrays(pa.array(edge), pa.array(n.astype(np.int32)))],
                    names=["doc_id", "label", "hits", "features", "counts"],
                )

    # At most 4 * per_class texts, each with FEATURES numbers at most.
    # Features come first, so that no task gathers texts.
    made = sample.select("doc_id", "text", "label").mapInArrow(design, "doc_id bigint, label int, hits bigint, features array<int>, counts array<int>")
    rows = made.orderBy(F.xxhash64("doc_id"), "doc_id", "label", "hits", "features", "counts").toPandas()
    label_, hits = rows["label"].to_numpy(), rows["hits"].to_numpy()
    grade = np.where(label_ == 1, 1 + (hits >= GRADES[0]) + (hits >= GRADES[1]), 0)
    length = rows["features"].map(len).to_numpy()
    doc = np.repeat(np.arange(len(rows)), length)
    feature = np.concatenate([np.asarray(x, dtype=np.int64) for x in rows["features"]]) if len(rows) else np.zeros(0, np.int64)
    value = np.log1p(np.concatenate([np.asarray(x, dtype=float) for x in rows["counts"]]) if len(rows) else np.zeros(0))
    w, threshold = _fit(doc, feature, value, grade, np.ones(len(grade)), len(table))
    return ToxicityModel(table, w, threshold)


def toxicity_filter(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, columns unchanged, that are not toxic (null and empty texts stay)."""
    found = fresh(docs, "toxicity")
    model = train_toxicity(docs, labels)
    return docs.withColumn(found, model.column("text")).where(F.col(found)["p_toxic"] < TOXIC).drop(found)
