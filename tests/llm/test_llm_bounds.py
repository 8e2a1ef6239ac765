"""Bounds of training samples, texts without letters, and packing that stays as it is."""

import random
import zlib

import numpy as np
import pytest

from quarry.llm import language, packing, quality, toxicity


def learnable(i):
    return zlib.crc32(str(i).encode()) % 4 != 2


def labelled(n=160):
    rng = random.Random(2)
    good, bad = [f"good{i} sense" for i in range(60)], [f"bad{i} junk" for i in range(60)]
    ids = [i for i in range(4 * n) if learnable(i)][:n]
    return [(i, " ".join(rng.choices(good if i % 2 else bad, k=60)), i % 2) for i in ids]


def test_repeats_of_one_label_leave_the_curve_alone(spark):
    rows = labelled()
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, quality int")
    models = []
    for times in (1, 20):
        docs = spark.createDataFrame([(i, t) for i, t, y in rows for _ in range(1 if y else times)], "doc_id bigint, text string")
        models.append(quality.train_quality(docs, labels, per_class=30))
    # Each bad row weighs as often as it comes; no label is crowded out, so it is still a fitted curve.
    assert all(m.slope != 20.0 for m in models) and models[0].slope == pytest.approx(models[1].slope, rel=0.5)
    scores = [m.scores([rows[0][1].encode(), rows[1][1].encode()]) for m in models]
    assert all((np.argsort(s) == np.argsort([y for _, _, y in rows[:2]])).all() for s in scores)


def test_texts_of_one_id_are_bounded_for_each_label_alike(spark):
    rows = labelled(40)
    crowd = next(i for i, _, y in rows if y == 0)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, quality int")
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(crowd, f"bad text {k}") for k in range(500)], "doc_id bigint, text string")
    found = quality.labelled_sample(docs, labels, "quality", 10).collect()
    count = {y: sum(r["label"] == y for r in found) for y in (0, 1)}
    assert count[1] == 10 and count[0] <= 20
    twice = quality.labelled_sample(docs.unionByName(docs), labels, "quality", 10).collect()
    assert sorted((r["doc_id"], r["text"], 2 * r["n"]) for r in found) == sorted((r["doc_id"], r["text"], r["n"]) for r in twice)


def test_toxicity_takes_repeated_ids(spark):
    rng = random.Random(3)
    ids = [i for i in range(400) if learnable(i)][:120]
    text = lambda bad: " ".join(rng.choices(["vile", "awful", "hateful"] if bad else ["kind", "calm", "plain"], k=20))
    rows = [(i, text(i % 2)) for i in ids] + [(ids[0], text(ids[0] % 2)) for _ in range(300)] + [(None, "vile vile"), (ids[1], None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids] + [(None, 1), (7, None)], "doc_id bigint, toxic int")
    model = toxicity.train_toxicity(docs, labels, per_class=40)
    told = {r["text"]: r["t"]["p_toxic"] >= toxicity.TOXIC for r in docs.select("text", model.column("text").alias("t")).collect()}
    assert told["vile vile"] and all(flag == ("vile" in t or "awful" in t or "hateful" in t) for t, flag in told.items() if t)


def test_texts_without_letters_have_no_language(spark):
    texts = ["́", "िि", "1 ́ 2", "", None, "42 !", "é", "word"]
    rows = [(i, t, "de") for i, t in enumerate(["der und nicht"] * 40)] + [(100 + i, t, None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.train_languages(docs)
    found = {r["doc_id"]: r["l"]["lang"] for r in docs.select("doc_id", model.column("text").alias("l")).collect()}
    assert [found[100 + i] for i in range(len(texts))] == ["und"] * 6 + ["de"] * 2


def test_a_packing_read_twice_is_the_same(spark):
    rows = spark.createDataFrame([(i, 0, 100 + i % 7) for i in range(500)], "doc_id bigint, piece int, length bigint").repartition(6)
    packed = packing.pack(rows)
    assert sorted(map(tuple, packed.collect())) == sorted(map(tuple, packed.collect()))
    assert not packed.inputFiles() == []
