"""Cron expressions: five fields of numbers, lists, ranges and steps."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

_BOUNDS = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))


class CronError(ValueError):
    """An expression that can't be read."""


@dataclass(frozen=True)
class Schedule:
    minutes: frozenset[int]
    hours: frozenset[int]
    days: frozenset[int]
    months: frozenset[int]
    weekdays: frozenset[int]
    any_day: bool
    any_weekday: bool

    def matches(self, t: datetime) -> bool:
        """If day and weekday are both restricted, either suffices."""
        day, weekday = t.day in self.days, t.isoweekday() % 7 in self.weekdays
        fits = day and weekday if self.any_day or self.any_weekday else day or weekday
        return t.minute in self.minutes and t.hour in self.hours and t.month in self.months and fits


def _values(part: str, low: int, high: int) -> set[int]:
    body, slash, step = part.partition("/")
    if slash and not (step.isdigit() and int(step) > 0):
        raise CronError(f"bad step in {part!r}")
    if body == "*":
        first, last = low, high
    else:
        a, dash, b = body.partition("-")
        if not a.isdigit() or dash and not b.isdigit():
            raise CronError(f"bad value {part!r}")
        first = int(a)
        last = int(b) if dash else high if slash else first
    if not low <= first <= last <= high:
        raise CronError(f"{part!r} is out of bounds")
    return set(range(first, last + 1, int(step) if slash else 1))


def parse(expression: str) -> Schedule | None:
    """The schedule of an expression; None for an empty one, which means never."""
    if not expression.strip():
        return None
    fields = expression.split()
    if len(fields) != 5:
        raise CronError("five fields are needed")
    sets = [frozenset(v for part in f.split(",") for v in _values(part, *b)) for f, b in zip(fields, _BOUNDS, strict=True)]
    return Schedule(*sets[:4], frozenset(v % 7 for v in sets[4]), fields[2] == "*", fields[4] == "*")


def next_after(schedule: Schedule, t: datetime) -> datetime | None:
    """The first matching minute after t within four years, skipping whole days that don't match."""
    t = t.replace(second=0, microsecond=0) + timedelta(minutes=1)
    end = t + timedelta(days=4 * 366)
    while t < end:
        if schedule.matches(t):
            return t
        day = t.replace(hour=min(schedule.hours), minute=min(schedule.minutes))
        if schedule.matches(day) or (t.hour, t.minute) != (0, 0):
            t += timedelta(minutes=1)
        else:
            t += timedelta(days=1)
    return None


def next_column(schedule: Schedule | None, t: Column) -> Column:
    """:func:`next_after` of a column of times, in built-in functions; null for never.

    Days come first: the next 40 are looked at, and only where none of them
    fits those of four years. Then the day's first minute, or on the first day
    the first behind the time.
    """
    time = t.cast("timestamp_ntz")
    if schedule is None:
        return F.lit(None).cast("timestamp_ntz")
    minutes = sorted(60 * h + m for h in schedule.hours for m in schedule.minutes)

    def fits(d: Column) -> Column:
        day, weekday = F.dayofmonth(d).isin(*sorted(schedule.days)), (F.dayofweek(d) - 1).isin(*sorted(schedule.weekdays))
        either = day & weekday if schedule.any_day or schedule.any_weekday else day | weekday
        return F.month(d).isin(*sorted(schedule.months)) & either

    today = F.to_date(time)
    now = F.hour(time) * 60 + F.minute(time)
    later = F.get(F.filter(F.array(*map(F.lit, minutes)), lambda m: m > now), F.lit(0))

    def first(days: int) -> Column:
        ahead = F.sequence(F.date_add(today, 1), F.date_add(today, days), F.expr("interval 1 day"))
        return F.get(F.filter(ahead, fits), F.lit(0))

    at = lambda d, m: F.timestamp_add("MINUTE", m, d.cast("timestamp_ntz"))
    return F.when(fits(today) & later.isNotNull(), at(today, later)).otherwise(at(F.coalesce(first(40), first(4 * 366)), F.lit(minutes[0])))
