"""Settings, identifiers, errors, one load at a time, the schedule, and what is watched."""

import threading
from datetime import UTC, datetime, timedelta

import pytest

import quarry.__main__ as command
from quarry.__main__ import arguments, main
from quarry.functions import ids, problems
from quarry.functions.params import ParameterError
from quarry.functions.scalars import StaleCursorError
from quarry.operators import cron, metrics, quality
from quarry.plans import config, service
from quarry.sources import scan, snapshot

KEY = "k" * 32


def test_config():
    found = config.load({"QUARRY_API_KEYS": f"{KEY}1, {KEY}2"})
    assert found.api_keys == (KEY + "1", KEY + "2") and found.sync_jitter == timedelta(minutes=30) and found.sync_cron is not None and KEY not in repr(found)
    assert config.load({"X_API_KEYS": KEY, "X_SYNC_CRON": ""}, "X_").sync_cron is None
    with pytest.raises(config.ConfigError) as e:
        config.load({"QUARRY_API_KEYS": f"{KEY},{KEY},short,", "QUARRY_ADDR": "nowhere", "QUARRY_RATE_LIMIT": "9", "QUARRY_RATE_BURST": "3", "QUARRY_CORS_ORIGINS": "*", "QUARRY_SYNC_JITTER": "-1m", "QUARRY_MAX_REJECT_RATIO": "2", "QUARRY_SNAPSHOT_KEEP": "0", "QUARRY_LOG_LEVEL": "loud", "QUARRY_ADMIN_KEY": "x", "QUARRY_SYNC_CRON": "61 * * * *", "QUARRY_SYNC_ON_START": "perhaps"})
    assert len(e.value.problems) == 11 and KEY not in str(e.value) and "repeats key 1" in str(e.value)


def test_identifiers():
    early, late = ids.request_id(1_700_000_000_000), ids.request_id(1_700_000_000_001)
    assert len(early) == 26 and early < late and ids.made_at(early) == datetime.fromtimestamp(1_700_000_000, UTC)
    assert len(ids.sync_id()) == 21 and ids.sync_id(1) < ids.sync_id(2) and ids.sync_id() != ids.sync_id()


def test_problems():
    assert len(problems.KINDS) == 11
    assert problems.answer(StaleCursorError("old"))["type"] == "cursor_stale"
    assert problems.answer(ParameterError("bad"), "/x", "id") == {"type": "invalid_parameter", "title": "Paramètre invalide", "status": 400, "detail": "bad", "instance": "/x", "request_id": "id"}
    assert "detail" not in problems.answer(KeyError("secret")) and problems.problem("?")["status"] == 500


def test_single_flight(spark, tmp_path):
    root = f"file://{tmp_path}/root"
    with service.single_flight(spark, root), pytest.raises(problems.Conflict), service.single_flight(spark, root):
        pass
    with service.single_flight(spark, root), service.single_flight(spark, root, timedelta(seconds=-1)):
        pass


def test_schedule():
    seen, stop, clock = [], threading.Event(), [datetime(2024, 1, 1, 3, 59)]

    def wait(seconds):
        clock[0] += timedelta(seconds=seconds)
        return len(seen) > 5

    def job():
        if len(seen) == 1:
            raise problems.Conflict("busy")
        if len(seen) == 3:
            raise ValueError("broken")
        return "published"

    service.run_schedule(cron.parse("0 4 * * *"), job, timedelta(minutes=10), stop, lambda: clock[0], wait, lambda what, about: seen.append((what, about)))
    assert [w for w, _ in seen] == ["next", "busy", "next", "failed", "next", "done", "next"]
    assert seen[2][1] == datetime(2024, 1, 2, 4)
    service.run_schedule(None, job)


def test_status(spark):
    manifest = snapshot.Manifest("h", "2024-01-01T00:00:00Z", {"specialites": 3}, {}, quarantine={"by_file": {"f": 2}})
    now = datetime(2024, 1, 1, 1, tzinfo=UTC)
    assert service.dataset_status(manifest, now)["age_seconds"] == 3600 and service.dataset_status(None, now)["age_seconds"] == -1
    assert {tuple(r) for r in service.gauges(spark, manifest).collect()} == {("dataset_records", "specialites", 3.0), ("dataset_quarantine_records", "f", 2.0)}


def test_gauges_are_replaced(spark, tmp_path):
    path = f"file://{tmp_path}/gauges"
    for counts in ({"a": 1, "b": 2}, {"b": 3}):
        service.publish_gauges(spark, snapshot.Manifest("h", "v", counts, {}), path)
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [("dataset_records", "b", 3.0)]


def test_command_line(spark, tmp_path, capsys):
    assert arguments(["s", "--force"]).force and arguments(["s"]).keep == 3
    assert main([f"file://{tmp_path}/nothing", "--data-dir", f"file://{tmp_path}/root", "--json"], spark) == 1
    assert '"result": "failed"' in capsys.readouterr().out


def test_command_line_obeys_settings(spark, tmp_path, capsys, monkeypatch):
    assert main(["s"], spark, {"QUARRY_SNAPSHOT_KEEP": "0", "QUARRY_MAX_REJECT_RATIO": "2"}) == 2
    assert capsys.readouterr().err.count("QUARRY_") == 2
    env = {"QUARRY_DATA_DIR": f"file://{tmp_path}/root", "QUARRY_SNAPSHOT_KEEP": "7", "QUARRY_MAX_REJECT_RATIO": "0", "QUARRY_SYNC_JITTER": "0"}
    seen = []

    def sync(session, source, root, gates, **other):
        seen.append((source, root, gates.reject_ratio, other["keep"]))
        if len(seen) == 2:
            raise RuntimeError("lost\nexecutor")
        return "published"

    monkeypatch.setattr(command.ingest, "sync", sync)
    assert main(["s"], spark, env) == 0 and main(["s", "--keep", "2", "--max-reject-ratio", "0.5"], spark, env) == 1
    assert seen == [("s", f"file://{tmp_path}/root", 0, 7), ("s", f"file://{tmp_path}/root", 0.5, 2)]
    # On a schedule: a load at the start, as nothing is published, then one at each time until stopped.
    seen[:] = [None] * 2
    times = iter([False, False, True])
    settings = config.load(env, serving=False)
    command.scheduled(spark, arguments(["s", "--json"], settings), settings, now=lambda: datetime(2024, 1, 1), wait=lambda seconds: next(times))
    assert len(seen) == 5 and capsys.readouterr().out.count('"done"') == 3
    command.scheduled(spark, arguments(["s"], settings), config.load(env | {"QUARRY_SYNC_ON_START": "false", "QUARRY_SYNC_CRON": ""}, serving=False))
    assert len(seen) == 5


def test_gates_of_the_build():
    quality.check_dictionaries({"forme": 65_535, "statut": 255}, {"statut": 255})
    with pytest.raises(quality.GateError) as e:
        quality.check_dictionaries({"statut": 256}, {"statut": 255})
    assert e.value.gate == "dictionnaire"


def test_long_line_ends_the_load(spark, monkeypatch):
    monkeypatch.setattr(scan, "LINE_BYTES", 8)
    fine = spark.createDataFrame([("f", "short\nlines")], "name string, text string")
    assert scan.lines(fine).count() == 2
    with pytest.raises(Exception, match="too long"):
        scan.lines(spark.createDataFrame([("f", "a\nlonger line")], "name string, text string")).collect()


def test_alerts(spark):
    rows = [("a", t, v) for t, v in enumerate([1, 9, 9, 1, 9, 9, 9, 9, 1])]
    samples = spark.createDataFrame(rows, "k string, t int, v int").selectExpr("k", "timestamp_seconds(t) as t", "v")
    assert [r["firing"] for r in metrics.alerts(samples, ["k"], "t", "v", 5, 2).orderBy("t").collect()] == [False] * 6 + [True, True, False]
