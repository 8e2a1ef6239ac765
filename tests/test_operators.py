import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarry.operators import cron, metrics, quality, search
from quarry.operators.paging import paginate
from quarry.streaming import limits


def test_cron():
    at = lambda e, t: cron.next_after(cron.parse(e), t)
    start = dt.datetime(2024, 2, 28, 23, 59)
    assert at("*/15 * * * *", start) == dt.datetime(2024, 2, 29, 0, 0)
    assert at("30 2 29 2 *", start) == dt.datetime(2024, 2, 29, 2, 30)
    assert at("0 0 13 * 5", start) == dt.datetime(2024, 3, 1)  # a Friday, or the 13th
    assert at("0 12 * * 7", start) == dt.datetime(2024, 3, 3, 12)
    assert at("0 0 31 2 *", start) is None
    assert cron.parse(" ") is None
    for bad in ("* * * *", "60 * * * *", "*/0 * * * *", "5-1 * * * *", "a * * * *"):
        with pytest.raises(cron.CronError):
            cron.parse(bad)


def test_gates():
    counts = {"specialites": 20, "presentations": 5, "composants": 5}
    ok = quality.Gates(floor=10)
    quality.check_gates(counts, 100, 1, 20, ok)
    for gate, args in {
        "fichier_vide": (counts | {"composants": 0}, 100, 0, 0, ok),
        "taux_rejet": (counts, 98, 2, 90, ok),
        "hors_perimetre": (counts, 79, 0, 21, ok),
        "plancher_specialites": (counts, 100, 0, 0, quality.Gates(floor=21)),
        "variation_compteur": (counts, 100, 0, 0, quality.Gates(floor=1, previous={"specialites": 30, "mitm": 0})),
    }.items():
        with pytest.raises(quality.GateError) as e:
            quality.check_gates(*args)
        assert e.value.gate == gate


def test_search(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Doliprane 500 mg"), (2, "Paracétamol Biogaran"), (3, "Efferalgan"), (4, "Dolirhume")], "id int, name string")
    holders = spark.createDataFrame([(3, "Paracétamol")], "id int, text string")
    texts = search.field_texts(docs, ["name"]).unionByName(holders.select("id", F.lit(1).alias("field"), "text"))
    search.publish_index(search.postings(texts), docs, f"file://{tmp_path}/index")
    index = search.open_index(spark, f"file://{tmp_path}/index")
    ids = lambda q, **k: [r["id"] for r in search.search(docs, index, q, **k).collect()]
    assert ids("paracétamol") == [2, 3]
    assert ids("PARACETAMOLL") == [2, 3]
    assert set(ids("doli")) == {1, 4}
    assert ids("doli ", rank=search.Rank(fallback_below=0)) == []
    assert ids("!!!") == []
    assert ids("paracetamol biogaran") == [2]
    assert ids("doli", limit=1, marketed=F.col("id") == 4) == [4] and ids("doli", limit=1, active=F.col("id") == 1) == [1]
    found = search.find(docs, index, "PARACETAMOLL")
    assert (found.tokens, found.exact, found.fallback, found.mode) == (1, 0, True, "trigram")
    times = iter((1.0, 3.5))
    best, seen = search.observed(docs, index, "paracetamol", 1, lambda: next(times))
    assert len(best) == 1 and seen == {"mode": "trigram", "seconds": 2.5, "results": 2, "tokens": 1, "fallback": True}


def test_repeated_grams_inflate(spark):
    words = spark.createDataFrame([("banana",), ("aaaaaa",)], "token string")
    terms = spark.createDataFrame([(0, "banana"), (1, "aaaaaa")], "i int, term string")
    found = {(r["term"], r["token"]) for r in search.similar(terms, search.grams(words), 0.4).collect()}
    assert ("banana", "banana") in found and ("aaaaaa", "aaaaaa") not in found


def test_pages(spark):
    df = spark.range(7).withColumnRenamed("id", "k")
    first = paginate(df, ["k"], "", 3, "version1")
    last = paginate(df, ["k"], paginate(df, ["k"], first.next_cursor, 3, "version1").next_cursor, 3, "version1")
    assert [r["k"] for r in first.rows.collect()] == [0, 1, 2] and first.has_more
    assert [r["k"] for r in last.rows.collect()] == [6] and not last.has_more and last.next_cursor is None


def test_quantile(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 100)], "k string, v double")
    buckets = metrics.histogram(df, ["k"], "v", (2.0, 4.0))
    found = metrics.histogram_quantile(buckets, ["k"], 0.6).first()["quantile"]
    assert found == pytest.approx(3.0)
    assert metrics.histogram_quantile(buckets, ["k"], 1.0).first()["quantile"] == 4.0


def events(spark):
    t = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(1, t + dt.timedelta(seconds=s), i) for i, s in enumerate((0, 0, 0, 1, 700))] + [(2, t, 9)], "u long, ts timestamp, id long")


def test_token_bucket(spark):
    rows = limits.token_bucket(events(spark), "u", "ts", "id", 0.5, 2.0).orderBy("u", "id").collect()
    assert [r["allowed"] for r in rows] == [True, True, False, False, True, True]
    assert rows[2]["wait"] == 2.0 and rows[3]["wait"] == 1.0


def test_streams(spark, tmp_path):
    events(spark).withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("u long, ts timestamp, id long").parquet(str(tmp_path / "in"))
    for name, df, mode in (("bucket", limits.token_bucket_stream(stream, "u", "ts", 0.5, 2.0), "append"), ("counts", limits.windowed_counts_stream(stream, "ts", ["u"], "5 minutes", "1 minute"), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(once=True).start()
        assert q.awaitTermination(60)
    assert spark.sql("select count_if(allowed) as n from bucket").first()["n"] == 4
    assert sorted(r["n"] for r in spark.sql("select n from counts").collect()) == [1, 1, 4]
