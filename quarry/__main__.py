"""Loads from the command line: python -m quarry SOURCE [--scheduled].

Settings come from QUARRY_ variables, see ``quarry.plans.config``; options
override them. One load by default; with --scheduled one at the start if
nothing is published yet, then one at each of the schedule's times.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import threading
from collections.abc import Mapping

from pyspark.sql import SparkSession

from quarry.functions.ids import sync_id
from quarry.functions.problems import Conflict
from quarry.operators import quality
from quarry.plans import config, ingest, service
from quarry.sources import snapshot


def arguments(argv: list[str] | None = None, settings: config.Config | None = None) -> argparse.Namespace:
    settings = settings or config.load({}, serving=False)
    parser = argparse.ArgumentParser(prog="quarry", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("source", help="folder of the source files")
    parser.add_argument("--data-dir", default=settings.data_dir, help="root of the snapshots")
    parser.add_argument("--force", action="store_true", help="load although the source hasn't changed")
    parser.add_argument("--dry-run", action="store_true", help="do all but write a snapshot")
    parser.add_argument("--keep", type=int, default=settings.snapshot_keep, help="snapshots to keep")
    parser.add_argument("--max-reject-ratio", type=float, default=settings.max_reject_ratio, help="largest part of a file's rows that may be rejected")
    parser.add_argument("--json", action="store_true", help="report as JSON")
    parser.add_argument("--timeout", type=float, default=600, help="seconds after which a load is given up")
    parser.add_argument("--scheduled", action="store_true", help="go on loading at the schedule's times")
    return parser.parse_args(argv)


def run_load(session: SparkSession, asked: argparse.Namespace) -> str:
    """One load under the lock of its root, given up after the time asked; its result."""
    timer = threading.Timer(asked.timeout, session.sparkContext.cancelAllJobs)
    timer.start()
    try:
        with service.single_flight(session, asked.data_dir):
            gates = quality.Gates(reject_ratio=asked.max_reject_ratio)
            return ingest.sync(session, asked.source, asked.data_dir, gates, force=asked.force, dry_run=asked.dry_run, keep=asked.keep)
    finally:
        timer.cancel()


def failure(e: Exception) -> str:
    return str(e).splitlines()[0] if str(e) else type(e).__name__


def say(report: Mapping[str, object], as_json: bool) -> None:
    print(json.dumps(report, default=str) if as_json or not sys.stdout.isatty() else "\n".join(f"{k}: {v}" for k, v in report.items()), flush=True)


def scheduled(session: SparkSession, asked: argparse.Namespace, settings: config.Config, **clock: object) -> None:
    """Loads at the schedule's times, before them one if there is no snapshot and settings say so; ``clock`` as in ``run_schedule``."""

    def told(what: str, about: object) -> None:
        say({"event": what, "about": failure(about) if isinstance(about, Exception) else about}, asked.json)

    if settings.sync_on_start and snapshot.current(session, asked.data_dir) is None:
        try:
            told("done", run_load(session, asked))
        except Conflict as e:
            told("busy", e)
        except Exception as e:
            told("failed", e)
    service.run_schedule(settings.sync_cron, lambda: run_load(session, asked), settings.sync_jitter, report=told, **clock)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, env: Mapping[str, str] = os.environ) -> int:
    """0 if the load was published, checked or unchanged, or the schedule ended, else 1; 2 for settings that can't be used."""
    try:
        settings = config.load(env, serving=False)
    except config.ConfigError as e:
        print("\n".join(e.problems), file=sys.stderr)
        return 2
    asked = arguments(argv, settings)
    session = spark
    if session is None:
        session = SparkSession.builder.appName("quarry").getOrCreate()
        session.sparkContext.setLogLevel(settings.log_level)
    if asked.scheduled:
        scheduled(session, asked, settings)
        return 0
    report: dict[str, object] = {"sync_id": sync_id()}
    try:
        report["result"] = run_load(session, asked)
    except Exception as e:
        report |= {"result": "failed", "error": failure(e)}
    say(report, asked.json)
    return int(report["result"] == "failed")


if __name__ == "__main__":
    sys.exit(main())
