"""Compression classifier of text quality.

Two zstandard dictionaries are trained, on good and on bad labelled text. A
text is compressed with each in parts of ``PART`` bytes, so that the dictionary
matters throughout; the difference of the sizes over the larger one is the
only feature, which a logistic curve turns into the probability of label 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from quarry.llm import kernels as K
from quarry.llm.common import cut, fresh, learnable

#: Labelled documents of each class that training looks at, half for the dictionaries, half for the curve.
SAMPLE_DOCS = 3000
#: Parts of each class that a dictionary is trained on, and their length in characters.
SAMPLE_PARTS, PART_CHARS = 4000, 2048
DICTIONARY, LEVEL, PART = 112_640, 3, 2048
#: Score from which a document counts as good.
GOOD = 0.7


class QualityModel:
    """score = 1 / (1 + exp(-(slope * difference + offset)))."""

    def __init__(self, good: bytes | None, bad: bytes | None, slope: float = 0.0, offset: float = 0.0):
        self.good, self.bad, self.slope, self.offset = good, bad, slope, offset

    def differences(self, texts: list[bytes]) -> np.ndarray:
        """(size with the bad dictionary - size with the good one) / larger size; 0 for empty texts."""
        out = np.zeros(len(texts))
        if self.good is None or self.bad is None:
            return out
        good, bad = (zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_dict_id=False) for d in (self.good, self.bad))
        for i, t in enumerate(texts):
            if t:
                parts = [t[a : a + PART] for a in range(0, len(t), PART)]
                g, b = sum(len(good.compress(p)) for p in parts), sum(len(bad.compress(p)) for p in parts)
                out[i] = (b - g) / max(b, g)
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.differences(texts) + self.offset, -60, 60)))

    def column(self, text: str | Column, difference: bool = False) -> Column:
        """Score (or the bare difference) of a text column; null counts as empty."""
        model = self

        @arrow_udf("double")
        def run(values: pa.Array) -> pa.Array:
            K.trim()
            texts = [t or b"" for t in values.cast(pa.binary()).to_pylist()]
            return pa.array(model.differences(texts) if difference else model.scores(texts), pa.float64())

        return run(text)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """doc_id, text, label, half and n of labelled documents that may be learnt from.

    At most ``per_class`` documents of each label, those with the smallest
    hashes of their ids; only their ids (a bounded number) are broadcast. A
    document's equal rows are one with their number as ``n``. Where an id has
    several texts, at most ``2 * per_class`` texts of each label are kept, those
    with the smallest hashes of id and text, so no label or text is preferred.
    """
    known = labels.where(learnable(F.col("doc_id"))).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label")).where("label in (0, 1)").distinct()
    hashed = known.withColumn("h", F.xxhash64(F.col("doc_id"), F.lit(17)))
    some = hashed.where("label = 0").orderBy("h", "doc_id").limit(per_class).unionByName(hashed.where("label = 1").orderBy("h", "doc_id").limit(per_class))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(some), "doc_id").groupBy("doc_id", "text", "label", F.pmod("h", F.lit(2)).alias("half")).agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy("label").orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text")
    return rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= 2 * per_class).drop("r")


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve: Newton steps with a weak penalty on the slope."""
    scale = max(float(np.abs(x).max()), 1e-9) if len(x) else 1.0
    design = np.stack((x / scale, np.ones(len(x))), axis=1)
    w = np.zeros(2)
    penalty = np.array([1e-3, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -40, 40)))
        grad = design.T @ (weight * (p - y)) + penalty * w
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = SAMPLE_DOCS) -> QualityModel:
    """Learns from at most ``per_class`` documents of each label outside the held-out fold.

    Without labelled text of both classes every score is the share of label 1
    among the labels, or 0.5 without any. Null texts count as empty and teach
    nothing; of a document with several rows each row counts in the curve, up
    to the bound of :func:`labelled_sample`; labels other than 0 and 1, null
    ids and held-out ids are not learnt from. The texts are read once: the
    sample is written and trained on from there.

    With less than 4,096 bytes or 8 parts of a class, or where training a
    dictionary fails for lack of text, the class's text itself is its
    dictionary. With one class alone in the curve's half of the sample the
    curve's slope is 20 and its offset the odds of label 1.
    """
    sample = cut(labelled_sample(docs, labels, label, per_class), "quality")
    share = {r["label"]: r["n"] for r in labels.where(learnable(F.col("doc_id"))).where(F.col(label).isin(0, 1)).groupBy(F.col(label).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(share.values())
    parts = sample.where("half = 0 and text <> ''").select("label", "doc_id", "text", F.explode(F.sequence(F.lit(0), ((F.length("text") - 1) / PART_CHARS).cast("int"))).alias("k"))
    parts = parts.select("label", F.expr(f"substring(text, k * {PART_CHARS} + 1, {PART_CHARS})").alias("part"), F.xxhash64("doc_id", "k").alias("h"))
    dictionary: dict[int, bytes] = {}
    for c in (0, 1):
        found = [r["part"].encode() for r in parts.where(F.col("label") == c).orderBy("h", "part").limit(SAMPLE_PARTS).select("part").collect()]
        if sum(map(len, found)) >= 4096 and len(found) >= 8:
            try:
                dictionary[c] = zstandard.train_dictionary(min(DICTIONARY, sum(map(len, found)) // 4), found, k=200, d=8).as_bytes()
            except zstandard.ZstdError:
                # Too little or too uniform text for training: the text itself is the dictionary.
                dictionary[c] = b"".join(found)[-DICTIONARY:]
        elif found:
            dictionary[c] = b"".join(found)[-DICTIONARY:]
    prior = min(max(share.get(1, 0) / total, 0.001), 0.999) if total else 0.5
    if len(dictionary) < 2:
        return QualityModel(None, None, 0.0, float(np.log(prior / (1 - prior))))
    model = QualityModel(dictionary[1], dictionary[0])
    rows = sample.where("half = 1 and text <> ''").select("label", "n", model.column("text", difference=True).alias("x")).orderBy("label", "x", "n").toPandas()
    if rows["label"].nunique() < 2:
        return QualityModel(dictionary[1], dictionary[0], 20.0, float(np.log(prior / (1 - prior))))
    y = rows["label"].to_numpy(dtype=float)
    times = rows["n"].to_numpy(dtype=float)
    n = np.array([times[y == 0].sum(), times[y == 1].sum()])
    weight = times * np.where(y == 1, share[1] / n[1], share[0] / n[0]) / total * times.sum()
    return QualityModel(dictionary[1], dictionary[0], *_fit(rows["x"].to_numpy(dtype=float), y, weight))


def quality_filter(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, columns unchanged, whose score is at least GOOD.

    Null and empty texts are scored like any other, by the share of good
    labels, and stay or go with that score. Repeated rows are judged alike.
    """
    model = train_quality(docs, labels)
    score = fresh(docs, "quality")
    return docs.withColumn(score, model.column("text")).where(F.col(score) >= GOOD).drop(score)
