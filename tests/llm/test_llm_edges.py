"""Nulls, repeats, ties, empty tables, clashing names, long texts and damaged inputs of the operators."""

import random

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import decontaminate, jaccard, kernels, language, media, packing, quality, toxicity, urlfilter
from quarry.llm.common import shared_dir

DOCS = "doc_id long, text string, lang string"


def words(rng, n, kinds=300):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


def test_long_texts_are_hashed_in_parts(monkeypatch):
    rng = random.Random(1)
    texts = [words(rng, 300).encode(), b"", b"x" * 5000, "é ü".encode() * 40, b" \n", b"a"]
    whole = kernels.Words(texts, kernels.SPACED, prefixes=(2,))
    monkeypatch.setattr(kernels, "SEGMENT", 64)
    parts = kernels.Words(texts, kernels.SPACED, prefixes=(2,))
    assert (whole.hashes == parts.hashes).all() and (whole.bounds == parts.bounds).all() and (whole.prefixes[0] == parts.prefixes[0]).all()


def test_a_text_of_twenty_megabytes(spark):
    text = ("lorem ipsum dolor " * 1_200_000)[:20_000_000]
    sets = kernels.shingle_sets([text.encode()], 3)
    assert len(sets[0]) == 4  # three turns, and the cut-off end
    assert media.samples_of(media.film([media.padded(text[:3_000_000].encode())]))[0].tobytes()[:100] == text[:100].encode()


def test_packing_ignores_clashing_names(spark):
    rows = spark.createDataFrame([(1, 5, 7, 8, 9), (1, 5, 7, 8, 9), (None, 2048, 0, 0, 0)], "doc_id long, length long, sequence_id long, offset long, fill long")
    found = packing.pack(rows)
    assert found.count() == 3 and {"sequence_id", "offset"} <= set(found.columns)
    assert packing.pack(rows.limit(0)).count() == 0


@pytest.mark.parametrize(("low", "high", "most"), [(500, 1000, 1570), (400, 800, 1181), (300, 1030, 1341)])
def test_search_beats_best_fit(low, high, most):
    lengths = np.random.default_rng(0).integers(low, high, 4000)
    bins = packing.pack_lengths(lengths)
    assert np.bincount(bins, weights=lengths).max() <= 2048
    assert bins.max() + 1 <= most + 15  # the bound was measured on another draw


def test_quality_scores_are_the_definition(spark):
    rng = random.Random(3)
    good, bad = [words(rng, 80) + "." for _ in range(60)], [words(rng, 80).upper() for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(good + bad)] * 2, DOCS)
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)] + [(5, 1), (None, 1), (7, None), (8, 3)], "doc_id long, quality int")
    model = quality.train_quality(docs, labels)
    sizes = {}
    for name, held in (("good", model.good), ("bad", model.bad)):
        packer = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(held), write_checksum=False, write_dict_id=False)
        sizes[name] = [len(packer.compress(t.encode())) for t in good + bad]
    x = np.array([(b - g) / max(b, g) for g, b in zip(sizes["good"], sizes["bad"], strict=True)])
    expected = 1 / (1 + np.exp(-(model.slope * x + model.offset)))
    got = {r["doc_id"]: r["p"] for r in docs.select("doc_id", model.column("text").alias("p")).collect()}
    assert np.allclose([got[i] for i in range(120)], expected)
    assert quality.quality_filter(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("train", [lambda d, b: quality.train_quality(d, b), lambda d, b: toxicity.train_toxicity(d, b)])
def test_held_out_labels_are_not_read(spark, train):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, words(rng, 40) + (" bad idiot" if i % 2 else " good."), "en") for i in range(200)], DOCS)
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    turned = labels.select("doc_id", *[F.when(held, 1 - F.col(c)).otherwise(F.col(c)).alias(c) for c in ("quality", "toxic")])
    texts = [b"", b"w1 bad idiot", words(rng, 30).encode()]
    scores = [m.scores(texts) if hasattr(m, "scores") else m.exceedance(texts) for m in (train(docs, labels), train(docs, turned))]
    assert np.allclose(*scores)


def test_ordinal_fit_is_the_likeliest():
    rng = np.random.default_rng(2)
    n = 400
    x = rng.random(n) * 4
    grade = (x > 1).astype(int) + (x > 2) + (x > 3)
    w, t = toxicity._fit(np.arange(n), np.zeros(n, dtype=int), x, grade, np.ones(n), 1, penalty=0.0)

    def loss(w, t):
        p = 1 / (1 + np.exp(-(w * x[:, None] - t)))
        full = np.concatenate((np.ones((n, 1)), p, np.zeros((n, 1))), axis=1)
        return -np.log(np.maximum(full[np.arange(n), grade] - full[np.arange(n), grade + 1], 1e-12)).mean()

    best = loss(w[0], t)
    assert (np.diff(t) > 0).all() and best < loss(w[0] * 0.7, t) and best < loss(w[0], t + 0.5) and best < loss(w[0], t - 0.5)


def test_toxicity_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b", "en"), (1, "a b", "en"), (None, None, None)], DOCS)
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity.toxicity_filter(docs, labels).count() == 3
    assert toxicity.toxicity_filter(docs.limit(0), labels.limit(0)).count() == 0


def test_languages_of_repeats_and_ties(spark):
    rows = [(i, "aaa bbb", ("de", "fr")[i % 2]) for i in range(40)] * 2
    docs = spark.createDataFrame(rows, DOCS)
    model = language.train_languages(docs)
    found = {r["l"]["lang"] for r in docs.select(model.column("text").alias("l")).collect()}
    assert len(found) == 1 and found <= {"de", "fr"}
    turned = docs.withColumn("lang", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, "xx").otherwise(F.col("lang")))
    assert language.train_languages(turned).languages == ["de", "fr"]


def test_addresses_as_hosts(spark):
    urls = ["http://[2001:db8::1]:80/x", "http://user@10.0.0.1:8080/", "http://a.b.example/", "mailto:x"]
    assert [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(urlfilter.host_of(F.col("u"))).collect()] == ["[2001:db8::1]", "10.0.0.1", "a.b.example", None]
    captures = spark.createDataFrame([(u, 5) for u in urls] * 2, "url string, fetched_at long")
    entries = spark.createDataFrame([("0.0.1", "block", 1), ("[2001:db8::1]", "block", 1), ("b.example", "block", 1)], "pattern string, action string, since long")
    for broadcast in (50_000, 0):
        found = {r["url"]: r["blocked"] for r in urlfilter.filter_captures(captures, entries, broadcast).collect()}
        assert found == dict(zip(urls, [True, False, True, False], strict=True))
    assert urlfilter.filter_captures(captures, entries).count() == 8 and urlfilter.filter_captures(captures.limit(0), entries).count() == 0


def test_damaged_films(spark):
    whole = media.film([media.padded(b"hello"), media.padded(b"x" * 3000)])
    films = [whole[0], None, b"", b"RIFF", whole[1][:200], whole[1][:-40], whole[1][:300] + b"\xff\x00" * 50 + whole[1][400:], whole[1], whole[0]]
    df = spark.createDataFrame([(i, f, "c") for i, f in enumerate(films)], "k int, media binary, clip string")
    back = {r["k"]: r["b"] for r in df.select("k", media.read_column("media").alias("b")).collect()}
    assert bytes(back[7]["payload"])[:3000] == b"x" * 3000 and bytes(back[0]["payload"]) == bytes(back[8]["payload"]) == media.padded(b"hello")
    assert all(back[k] is None for k in (1, 2, 3, 4))
    rows = media.clip_rows(df.drop("clip")).where("k in (0, 7)").collect()
    assert [(r["first"], r["start_ms"]) for r in rows if r["clip"] == 0] == [(0, 0), (0, 0)]
    assert media.clip_rows(df.drop("clip").limit(0)).count() == 0


def test_media_tells_shots_by_histograms():
    still, other = np.full((10, media.FRAME), 7, dtype=np.uint8), np.full((6, media.FRAME), 200, dtype=np.uint8)
    assert media.shots(np.concatenate((still, other, still))) == [(0, 10), (10, 16), (16, 26)]
    assert media.shots(still) == [(0, 10)] and media.shots(still[:0]) == []


def test_large_benchmark_in_another_form(monkeypatch):
    rng = random.Random(8)
    items = [(str(i), words(rng, n, 40).encode()) for i, n in enumerate([30, 3, 12, 1])]
    texts = [words(rng, 200, 40).encode(), b"", b" ".join(t for _, t in items), items[0][1] + b" z " + items[2][1]]
    index = decontaminate.TestTexts(items)
    wide = decontaminate._scan(texts, index)
    # A shard in which few windows can occur gives the same as one in which all can.
    assert decontaminate._scan(texts[:1], index) + decontaminate._scan(texts[1:2], index) + decontaminate._scan(texts[2:3], index) + decontaminate._scan(texts[3:], index) == wide
    assert decontaminate._scan([items[2][1] + b" q"], index)[0][2][-1] == "2"
    monkeypatch.setattr(decontaminate, "_FORMS", ((31, 2),))
    assert decontaminate._scan(texts, decontaminate.TestTexts(items)) == wide and wide[2][2] == ["0", "1", "2", "3"]


def test_decontamination_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b c", "en"), (1, "a b c", "en"), (None, "x", None)], DOCS)
    bench = spark.createDataFrame([(None, "a b c"), ("i", ""), ("j", None), ("k", "x y")], "item_id string, text string")
    assert decontaminate.decontaminate(docs, bench).count() == 3
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0


def test_forest_in_rows(monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 3)
    links = np.zeros((8, 8), dtype=bool)
    for a, b in ((7, 5), (5, 2), (1, 4)):
        links[a, b] = links[b, a] = True
    assert jaccard._forest(8, lambda a, b: links[a:b]).tolist() == [0, 1, 2, 3, 1, 2, 6, 2]
    sets = [np.array(s, dtype=np.int64) for s in ([1, 2, 3], [2, 3, 4], [9], [])]
    assert jaccard._overlaps(sets).tolist() == [[3, 2, 0, 0], [2, 3, 0, 0], [0, 0, 1, 0], [0, 0, 0, 0]]
    group = pa.table({"rep": [4, 9], "text": ["a b c d", "a b c e"]})
    assert jaccard._block_links(group, 1, 1, 2).to_pylist() == [{"x": 4, "y": 9}]


def test_shared_folder(spark):
    assert shared_dir(spark).startswith("file:")


ODD_DOCS = [(1, None, "en", "s", 0), (2, "", None, "s", 0), (3, "a b c d e f", "en", None, 11), (3, "a b c d e f", "en", None, 11), (None, "a b c d e f", "en", "s", 11), (4, "A B C D E F", "en", "s", None), (5, "x " * 9000, "fr", "s", 18000)]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd_folder(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('odd')}"
    spark.createDataFrame([(3, 1, 0), (4, 1, 1), (None, 1, 1), (99, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("i", None), (None, "a b"), ("j", "q r s")], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, odd_folder, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.createDataFrame([(*r, "kept") for r in ODD_DOCS], COLUMNS + ", score string")
    found = stage(spark, docs, odd_folder)
    rows = found.collect()
    assert stage(spark, docs.limit(0), odd_folder).count() == 0
    if name == "packing":
        assert len([r for r in rows if r["piece"] == 0]) == len(ODD_DOCS) and sum(r["length"] for r in rows if r["doc_id"] == 1) == 1
        return
    assert found.columns == docs.columns
    kept = sorted((r["doc_id"] for r in rows), key=str)
    everything = sorted((r[0] for r in ODD_DOCS), key=str)
    expected = {"toxicity": everything, "decontamination": everything, "near_duplicates": sorted([1, 2, 3, 3, None, 5], key=str)}
    if name in expected:
        assert kept == expected[name]
    assert set(kept) <= set(everything)
