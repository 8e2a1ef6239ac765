"""Around a load: one at a time, on a schedule, from the command line; and what is known of the published data."""

from __future__ import annotations

import random
import threading
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.problems import Conflict
from quarry.operators import cron
from quarry.sources import snapshot

LOCK = ".lock"


@contextmanager
def single_flight(spark: SparkSession, root: str, stale: timedelta = timedelta(hours=6)):
    """Only one load of a snapshot root at a time; raises Conflict where another runs.

    The lock is a file that is created only if it isn't there, so it holds
    between sessions too, and that names its owner. One older than ``stale``
    was left by a load that died: it is taken away by a rename, which only one
    of several sessions can do, and then made anew. A session deletes only a
    lock that names it.
    """
    store = snapshot._Store(spark, root)
    path, owner = store.path(LOCK), uuid.uuid4().hex
    if store.fs.exists(path) and time.time() - store.fs.getFileStatus(path).getModificationTime() / 1000 > stale.total_seconds():
        aside = store.path(f"{LOCK}-{owner}")
        if not store.fs.rename(path, aside):
            raise Conflict("another session is taking over a lock")
        store.fs.delete(aside, False)
    store.fs.mkdirs(store.path())
    try:
        stream = store.fs.create(path, False)
    except Py4JJavaError as e:
        if not store.fs.exists(path):
            raise
        raise Conflict("a load is already running") from e
    stream.write(bytearray(owner.encode()))
    stream.close()
    try:
        yield
    finally:
        if store.exists(LOCK) and store.read(LOCK) == owner:
            store.fs.delete(path, False)


def run_schedule(schedule: cron.Schedule | None, job: Callable[[], object], jitter: timedelta = timedelta(), stop: threading.Event | None = None, now: Callable[[], datetime] = lambda: datetime.now(UTC).replace(tzinfo=None), wait: Callable[[float], bool] | None = None, report: Callable[[str, object], None] = lambda what, about: None) -> None:
    """Runs ``job`` at the schedule's times, each delayed at random by less than ``jitter``, until stopped.

    No schedule means never. A slot in which a job is already running is left
    out; a job that fails doesn't end the loop.
    """
    stop = stop or threading.Event()
    wait = wait or stop.wait
    while schedule is not None and not stop.is_set():
        began = now()
        at = cron.next_after(schedule, began)
        if at is None:
            report("no occurrence", schedule)
            return
        delay = (at - began).total_seconds() + random.uniform(0, jitter.total_seconds())
        report("next", at)
        if wait(max(0.0, delay)) or stop.is_set():
            return
        try:
            report("done", job())
        except Conflict as e:
            report("busy", e)
        except Exception as e:
            report("failed", e)


def age_seconds(generated_at: str | None, now: datetime) -> int:
    """Seconds since a version was made; -1 without one."""
    if not generated_at:
        return -1
    made = datetime.fromisoformat(generated_at.replace("Z", "+00:00"))
    return int((now.astimezone(UTC) - made.astimezone(UTC)).total_seconds())


@dataclass(frozen=True)
class Source:
    """Where the data come from; a deployment fills it in."""

    name: str = ""
    publisher: str = ""
    url: str = ""
    licence: str = ""
    disclaimer: str = ""


def dataset_status(manifest: snapshot.Manifest | None, now: datetime, source: Source | None = None) -> dict[str, object]:
    """Version, age, counts, rejects, rows out of scope, files and warnings of the published data."""
    if manifest is None:
        return {"version": None, "age_seconds": -1}
    return {
        "version": manifest.version,
        "hash": manifest.hash,
        "generated_at": manifest.version,
        "age_seconds": age_seconds(manifest.version, now),
        "source": vars(source or Source()),
        "counts": manifest.counts,
        "quarantine": manifest.quarantine,
        "out_of_scope": manifest.out_of_scope,
        "files": manifest.files,
        "warnings": manifest.warnings,
    }


def ages(versions: DataFrame, key: str, made: str, now: str) -> DataFrame:
    """key and age in seconds of many versions at a time; -1 where nothing was made yet."""
    return versions.select(key, F.coalesce(F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col(made).cast("timestamp")), F.lit(-1)).cast("bigint").alias("age_seconds"))


def gauges(spark: SparkSession, manifest: snapshot.Manifest) -> DataFrame:
    """name, label and value of what a version is watched by."""
    rows = [("dataset_records", entity, float(n)) for entity, n in manifest.counts.items()]
    for name, counters in (("dataset_quarantine_records", manifest.quarantine), ("dataset_out_of_scope_records", manifest.out_of_scope)):
        rows += [(name, file, float(n)) for file, n in counters.get("by_file", {}).items()]
    return spark.createDataFrame(rows, "name string, label string, value double")


def publish_gauges(spark: SparkSession, manifest: snapshot.Manifest, path: str) -> None:
    """Replaces all gauges: labels of earlier versions are gone."""
    gauges(spark, manifest).coalesce(1).write.mode("overwrite").parquet(path)
