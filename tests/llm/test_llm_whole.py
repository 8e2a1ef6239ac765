"""Training-data operators on inputs where a bound could lose a part of the job."""

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import language, packing


def test_repeated_ids_keep_a_language(spark):
    # Five ids of a language, far from the sample by hash, repeated 4,000 times each.
    ids = spark.range(2000).where(language.learnable(F.col("id"))).withColumn("h", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30))).orderBy(F.desc("h")).limit(5)
    rare = ids.select(F.col("id").alias("doc_id")).crossJoin(spark.range(4000).select()).select("doc_id", F.lit("les chats dorment").alias("text"), F.lit("fr").alias("lang"))
    common = spark.range(2000, 2100).select(F.col("id").alias("doc_id"), F.lit("the cats are asleep").alias("text"), F.lit("en").alias("lang"))
    assert language.train_languages(rare.unionByName(common)).languages == ["en", "fr"]


def test_no_language_is_crowded_out(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_PARTS", 3)
    monkeypatch.setattr(language, "LANGUAGES", 4, raising=False)
    names = [f"l{i}" for i in range(8)]
    docs = spark.range(320).select(F.col("id").alias("doc_id"), F.concat(F.lit("words of "), F.col("id").cast("string")).alias("text"), F.concat(F.lit("l"), (F.col("id") % 8).cast("string")).alias("lang"))
    assert language.train_languages(docs).languages == names


def test_long_runs_are_scored_whole():
    lattice = language.Lattice()
    table = np.random.default_rng(1).random((lattice.size, 2)) / 100
    table[0] = 0
    runs = ["international" * 4, "straßenbahn" * 3, "ab" * 40, "thereisnoblankinthisverylongrunofletters"]
    codes = [np.array([ord(c) for c in "▁" + r], dtype=np.uint32) for r in runs]
    total, _ = language._Scorer(language.LanguageModel(["a", "b"], table)).totals(runs)
    for code, own in zip(codes, total, strict=True):
        alpha = [np.ones(2)] + [np.zeros(2) for _ in code]
        for i, j, number in lattice.numbers(code[None]):
            alpha[j] = alpha[j] + alpha[i] * table[number[0]]
        assert np.allclose(own, np.log(alpha[-1]))


def test_long_runs_are_learnt_whole():
    lattice = language.Lattice()
    p = np.random.default_rng(2).random(lattice.size) / 100
    p[0] = 1e-300
    for run in ("▁thereisnoblank", "▁ab"):
        code = np.array([[ord(c) for c in run]], dtype=np.uint32)
        found = language._log_expected(lattice, np.pad(code, ((0, 0), (0, 3))), np.array([len(run)]), np.log(p), np.array([2.0]))
        alpha, edges = language._forward(lattice, code, p[:, None], keep=True)
        beta = [0.0] * len(run) + [1.0]
        expected = np.zeros(lattice.size)
        for i, j, _, number in sorted(edges, key=lambda e: -e[0]):
            beta[i] += p[number[0]] * beta[j]
            expected[number[0]] += 2 * alpha[i, 0, 0] * p[number[0]] * beta[j] / alpha[-1, 0, 0]
        assert np.allclose(found, expected)


def test_every_letter_piece_is_used():
    assert language.Lattice().longest == 16
    assert len(language.Words(["कि"]).hashes) == 1


def test_all_underfull_bins_are_searched():
    # Searching only the 256 emptiest bins gives 2,087 bins; the bound is 2,077.
    lengths = np.random.default_rng(1).integers(300, 1400, 5000)
    bins = packing.pack_lengths(lengths)
    assert np.bincount(bins, weights=lengths).max() <= 2048
    assert bins.max() + 1 <= 2085


def test_groups_that_fill_little_meet(spark):
    # Nearly all bins of the first round are underfull; short pieces still find long ones in a later round.
    rows = spark.range(310).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 31 == 0, 540).otherwise(1500).cast("bigint").alias("length"))
    packed = packing.pack(rows, group=2).cache()
    assert packed.count() == 310 and packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()
    assert packed.select("sequence_id").distinct().count() == 300
