"""Rates, alert states, exact quantiles, orders, sketches, key walks, and files in parts, against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import counters, nested, selection
from quarry.sources import scan


def plain_increases(samples, span, step):
    """Increase by definition, evaluation by evaluation."""
    out = {}
    for key in {k for k, _, _ in samples}:
        own = sorted((us, v) for k, us, v in samples if k == key)
        lo, hi = own[0][0], own[-1][0]
        for e in range(-(-lo // (step * 10**6)), -(-hi // (step * 10**6)) + span // step):
            end = e * step
            part = [(us / 1e6, v) for us, v in own if (end - span) * 10**6 < us <= end * 10**6]
            if len(part) < 2 or part[0][0] == part[-1][0]:
                continue
            gain = part[-1][1] - part[0][1] + sum(a[1] for a, b in zip(part, part[1:], strict=False) if b[1] < a[1])
            sampled = part[-1][0] - part[0][0]
            mean = sampled / (len(part) - 1)
            before, after = part[0][0] - (end - span), end - part[-1][0]
            before, after = (mean / 2 if d >= 1.1 * mean else d for d in (before, after))
            if gain > 0 and part[0][1] >= 0:
                before = min(before, sampled * part[0][1] / gain)
            out[key, end] = gain * (sampled + before + after) / sampled
    return out


@pytest.mark.parametrize("bin_seconds", [37, 10**6])
def test_increase_by_definition(spark, bin_seconds):
    rng = random.Random(6)
    samples = []
    for key in ("a", "b"):
        v, us = 5.0, 1_000_000_000
        for _ in range(200):
            us += rng.randint(1, 40) * 500_000
            v = 0.0 if rng.random() < 0.1 else v + rng.randint(0, 4)
            samples.append((key, us, v))
    df = spark.createDataFrame(samples, "key string, us long, v double").select("key", F.timestamp_micros("us").alias("at"), "v", F.lit(1).alias("total")).unionByName(spark.createDataFrame([("a", None, 1.0, 1)], "key string, at timestamp, v double, total int"))
    found = {(r["key"], r["at"]): r["increase"] for r in counters.increases(df, ["key"], "at", "v", 120, 30, bin_seconds).collect()}
    expected = plain_increases(samples, 120, 30)
    assert found.keys() == expected.keys() and all(found[k] == pytest.approx(expected[k]) for k in expected)
    with pytest.raises(ValueError):
        counters.increases(df, ["key"], "at", "v", 100, 30)


@pytest.mark.parametrize("bin_steps", [1, 4, 1000])
def test_alerts_hold_over_bins_and_gaps(spark, bin_steps):
    rng = random.Random(7)
    rows = [(k, s * 10, rng.random() < 0.8) for k in "xy" for s in range(200) if rng.random() < 0.95] + [("z", 0, None)]
    df = spark.createDataFrame(rows, "key string, at long, bad boolean")
    found = {(r["key"], r["at"]): r["state"] for r in counters.alert_states(df, ["key"], "at", F.col("bad"), 30, 10, bin_steps).collect()}
    since: dict[str, tuple[int, int]] = {}
    for k, at, bad in rows:
        start, last = since.get(k, (None, None))
        if bad:
            start = start if last == at - 10 else at
            since[k] = (start, at)
            expected = "firing" if at - start >= 30 else "pending"
        else:
            since.pop(k, None)
            expected = "inactive"
        assert found[k, at] == expected


def test_quantiles_by_narrowing(spark):
    rng = random.Random(8)
    rows = [("wide", rng.lognormvariate(0, 9)) for _ in range(3000)] + [("same", 4.0)] * 500 + [("one", -1.5), (None, 2.0), (None, 8.0), ("none", None), ("odd", float("nan")), ("odd", 1.0)]
    rows += [("ties", float(rng.randint(0, 3))) for _ in range(999)] + [("huge", 1.7e308), ("huge", -1.7e308), ("huge", 5e-324)]
    df = spark.createDataFrame(rows, "key string, v double").repartition(4)
    points = {"low": 0.0, "mid": 0.5, "high": 0.99, "top": 1.0}
    for ranges, held in ((4, 3), (1024, 20_000)):
        found = {r["key"]: tuple(r[p] for p in points) for r in selection.exact_quantiles(df, ["key"], "v", points, ranges, held).collect()}
        for key in {k for k, _ in rows} - {"none"}:
            own = sorted(v for k, v in rows if k == key and v is not None and v == v)
            assert found[key] == tuple(own[int((len(own) - 1) * q)] for q in points.values())
        assert "none" not in found
    whole = selection.exact_quantiles(df.where("key = 'ties'"), [], "v", {"mid": 0.5}, 4, 3).first()
    assert whole["mid"] == sorted(v for k, v in rows if k == "ties")[499]


def test_order_and_deep_pages(spark):
    rng = random.Random(9)
    rows = [(rng.randint(0, 9), i) for i in range(500)]
    held = selection.ordered(spark.createDataFrame(rows, "a int, b int"), [F.desc("a"), "b"])
    expected = sorted(rows, key=lambda r: (-r[0], r[1]))
    assert [(r["a"], r["b"]) for r in held.positions().orderBy("position").collect()] == expected and held.total == 500
    for offset, limit in ((0, 7), (444, 20), (490, 50), (500, 5), (0, 0)):
        got = held.page(offset, limit).collect()
        assert [(r["a"], r["b"]) for r in got] == expected[offset : offset + limit]
        assert [r["position"] for r in got] == list(range(offset + 1, offset + 1 + len(got)))
    assert selection.ordered(spark.createDataFrame([], "a int"), ["a"]).page(0, 5).collect() == []


def test_sketches_of_versions(spark):
    df = spark.range(20_000).select((F.col("id") % 3).alias("key"), (F.col("id") % 7).alias("day"), (F.col("id") % 5000).alias("user"), F.col("id").cast("double").alias("v"))
    merged = {r["key"]: r["p"] for r in selection.merged_quantiles(selection.quantile_sketches(df, ["key", "day"], "v"), ["key"], {"p": 0.9}).collect()}
    assert all(abs(p / 20_000 - 0.9) < 0.01 for p in merged.values())
    users = {r["key"]: r["distinct"] for r in selection.merged_distinct(selection.distinct_sketches(df, ["key", "day"], "user"), ["key"]).collect()}
    assert users == {0: 5000, 1: 5000, 2: 5000}
    old, new = (selection.distinct_sketches(df.where(c), ["key"], "user") for c in ("user < 3000", "user >= 2000"))
    assert {(r["both"], r["either"], r["gone"]) for r in selection.overlap(old, new, ["key"]).collect()} == {(1000, 5000, 2000)}


def test_keys_at_any_depth(spark):
    docs = [json.dumps({"a": [{"b": [1, [2, None]], "c": "x"}, {"b": []}], "d": {"e": {"f": {"g": True}}}, "h": 1.5}), "3", None, "[]"]
    found = {(r["path"], r["kind"]): r["n"] for r in nested.key_walk(spark.createDataFrame([(d,) for d in docs], "doc string"), F.col("doc")).collect()}
    counts: dict[tuple[str, str], int] = {}

    def walk(path, v):
        kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(v), "number")
        counts[path, kind] = counts.get((path, kind), 0) + 1
        for step, inner in v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ():
            walk(path + (f".{step}" if isinstance(v, dict) else "[*]"), inner)

    for d in docs:
        if d is not None:
            walk("$", json.loads(d))
    assert found == counts


def test_files_in_parts(spark, tmp_path):
    (tmp_path / "whole.txt").write_bytes(b"a\tb\r\nc\td")
    (tmp_path / "parts.txt").mkdir()
    for k, text in enumerate((b"a\tb\n\n", b"c\t\xe9\n", b"e\tf\n")):
        (tmp_path / "parts.txt" / f"part-{k:05d}-x.txt").write_bytes(text)
    folder, names = f"file://{tmp_path}", ["whole.txt", "parts.txt"]
    staged = scan.stage(spark, folder, names)
    found = sorted((r["name"], r["line_no"], r["fields"]) for r in scan.fields(staged.lines).collect())
    assert found == [("parts.txt", 1, ["a", "b"]), ("parts.txt", 3, ["c", "é"]), ("parts.txt", 4, ["e", "f"]), ("whole.txt", 1, ["a", "b"]), ("whole.txt", 2, ["c", "d"])]
    facts = {r["name"]: tuple(r)[1:] for r in staged.facts.collect()}
    assert facts["parts.txt"] == (13, 4, "windows-1252", "lf") and facts["whole.txt"] == (8, 2, "utf-8", "crlf")
    hashes = {r["name"]: r["sha256"] for r in scan.file_hashes(scan.read_files(spark, folder, names)).collect()}
    import hashlib

    assert hashes["whole.txt"] == hashlib.sha256(b"a\tb\r\nc\td").hexdigest() and len(set(hashes.values())) == 2
