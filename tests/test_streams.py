"""Deliveries as a stream, and buckets that are swept."""

import uuid

import pytest
from pyspark.sql import functions as F
from test_ingest import LINES

from quarry.operators.quality import Gates
from quarry.sources import snapshot
from quarry.streaming import buckets, limits
from quarry.streaming.loads import load_deliveries

GATES = Gates(reject_ratio=1.0, scope_ratio=1.0, floor=0, variation=9.0)


def deliver(tmp_path, name, extra=()):
    folder = tmp_path / name
    folder.mkdir()
    for file, lines in LINES.items():
        (folder / file).write_bytes("\r\n".join([*lines, *(extra if file == "CIS_bdpm.txt" else ())]).encode("cp1252"))
    return f"file://{folder}"


def announce(tmp_path, *folders):
    inbox = tmp_path / "inbox"
    inbox.mkdir(exist_ok=True)
    hidden = inbox / f".{uuid.uuid4().hex}"
    hidden.write_text("\n".join(folders) + "\n")
    hidden.rename(inbox / hidden.name[1:])
    return f"file://{inbox}"


def test_a_load_that_dies_before_the_pointer_is_run_again_once(spark, tmp_path, monkeypatch):
    root, checkpoint = f"file://{tmp_path}/root", f"file://{tmp_path}/checkpoint"
    line = "60000009\tNEUF\tgélule\torale\tAutorisation active\tProcédure nationale\tCommercialisée\t05/06/2010\t\t\tLABO\tOui"
    first, second = deliver(tmp_path, "first"), deliver(tmp_path, "second", [line])
    inbox = announce(tmp_path, first)
    assert load_deliveries(spark, inbox, root, checkpoint, GATES) == ["published"]
    before = snapshot.current(spark, root)
    assert before.counts["specialites"] == 2 and before.batch == [0, 0]
    announce(tmp_path, second)
    write = snapshot._Store.write

    def dies(self, text, *parts):
        if parts == (snapshot.POINTER,):
            raise RuntimeError("the driver is gone")
        write(self, text, *parts)

    monkeypatch.setattr(snapshot._Store, "write", dies)
    with pytest.raises(Exception, match="the driver is gone"):
        load_deliveries(spark, inbox, root, checkpoint, GATES)
    assert snapshot.current(spark, root) == before
    monkeypatch.setattr(snapshot._Store, "write", write)
    # The same batch again: what was written but not published is not taken for published.
    assert load_deliveries(spark, inbox, root, checkpoint, GATES) == ["published"]
    after = snapshot.current(spark, root)
    assert after.counts["specialites"] == 3 and after.batch == [1, 0] and after.previous_hash == before.hash
    assert load_deliveries(spark, inbox, root, checkpoint, GATES) == []


def test_a_batch_that_was_published_is_not_published_again(spark, tmp_path):
    from quarry.plans import ingest

    root = f"file://{tmp_path}/root"
    folder = deliver(tmp_path, "only")
    assert ingest.sync(spark, folder, root, GATES, batch=(3, 1)) == "published"
    assert ingest.sync(spark, folder, root, GATES, force=True, batch=(3, 1)) == "unchanged"
    assert ingest.sync(spark, folder, root, GATES, force=True, batch=(3, 2)) == "published"
    assert len([n for n, _ in snapshot._Store(spark, root).snapshots()]) == 2


def test_swept_buckets_equal_the_fold(spark, tmp_path):
    buckets.use_rocksdb(spark)
    start = 1_700_000_000
    rows = [(k, (start + at) * 1_000_000, at * 10 + k) for at in (0, 1, 2, 3, 900, 901, 902, 5000, 5001) for k in (1, 2) if k == 2 or at < 900] + [(None, 7, 7)]
    schema = "k long, us long, o long"
    df = spark.createDataFrame(rows, schema).select("k", F.timestamp_micros("us").alias("at"), "o")
    source = f"file://{tmp_path}/in"
    for low, high in ((0, 800), (800, 3000), (3000, 9999)):
        df.where(F.unix_seconds("at").between(start + low, start + high - 1) | F.col("k").isNull()).where("k is not null").coalesce(1).write.mode("append").parquet(source)
    events = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    name = f"out_{uuid.uuid4().hex}"
    stream = buckets.swept_token_bucket(events, "k", "at", "o", 0.01, 2.0, idle_seconds=60)
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    found = sorted((r["k"], r["us"], r["o"], r["allowed"], round(r["wait"], 3)) for r in spark.table(name).collect())
    whole = limits.token_bucket(df, "k", "at", "o", 0.01, 2.0)
    expected = sorted((r["k"], r["us"], r["o"], r["allowed"], round(r["wait"], 3)) for r in whole.select("k", F.unix_micros("at").alias("us"), "o", "allowed", "wait").collect())
    assert found == expected
    states = [p for progress in query.recentProgress for p in progress["stateOperators"]]
    # Both keys have a state after the first batch; the one that stays away has none in the end.
    assert states[0]["numRowsTotal"] == 2 and states[-1]["numRowsTotal"] == 1
