"""Working time as expressions. A calendar is 168 slots, slot = weekday * 24 + hour, Monday first.

From prefix sums over a doubled week, the closed hours of a span and the end of a stretch of
working minutes are closed forms: no loop over hours, no function outside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procweave.session import small

HOUR_US, WEEK_SLOTS = 3_600_000_000, 168
#: About what a calendar's arrays take.
ROW_BYTES = 4096
PREFIX_SCHEMA = "resource string, open array<boolean>, closed array<int>, opened array<int>, open_slots array<int>"


def prefixes(slots: list[bool]) -> tuple[list[bool], list[int], list[int], list[int]]:
    """(open, closed before each of 337 slots, open before each, numbers of the open ones)."""
    if len(slots) != WEEK_SLOTS:
        raise ValueError("a calendar has 168 slots")
    if not any(slots):
        raise ValueError("a calendar without an open hour never moves on")
    closed, opened = [0], [0]
    for k in range(2 * WEEK_SLOTS):
        closed.append(closed[-1] + (not slots[k % WEEK_SLOTS]))
        opened.append(opened[-1] + slots[k % WEEK_SLOTS])
    return list(slots), closed, opened, [k for k, x in enumerate(slots) if x]


def calendar_frame(spark: SparkSession, calendars: dict[str, list[bool]]) -> DataFrame:
    """A row of prefix arrays for each resource, marked for broadcasting if there are few enough."""
    rows = [(r, *prefixes(s)) for r, s in sorted(calendars.items())]
    return small(spark.createDataFrame(rows, PREFIX_SCHEMA), len(rows), ROW_BYTES)


def slot(ts: Column) -> Column:
    return F.weekday(ts) * 24 + F.hour(ts)


def _div(a: Column, b: int) -> Column:
    """Integer division of numbers that aren't negative."""
    return F.floor(a / F.lit(b)).cast("bigint") if b < 1000 else ((a - a % b) / b).cast("bigint")


def micros(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def closed_hours(start: Column, end: Column, closed: Column) -> Column:
    """Closed slots among start, start + 1 h, ... before end; 0 if the end isn't after the start."""
    us = micros(start, end)
    n = (us + (HOUR_US - 1) - (us + (HOUR_US - 1)) % HOUR_US) / HOUR_US
    n = n.cast("bigint")
    s0 = slot(start)
    weeks = ((n - n % WEEK_SLOTS) / WEEK_SLOTS).cast("bigint")
    return F.when(us <= 0, F.lit(0).cast("bigint")).otherwise(weeks * closed[WEEK_SLOTS] + closed[s0 + (n % WEEK_SLOTS).cast("int")] - closed[s0])


def working_minutes(start: Column, end: Column, closed: Column) -> Column:
    """Minutes of the span less its closed hours, not below 0."""
    return F.greatest(micros(start, end) - HOUR_US * closed_hours(start, end, closed), F.lit(0).cast("bigint")) / F.lit(6e7)


def move_minutes(start: Column, minutes: Column, opened: Column, is_open: Column, open_slots: Column) -> Column:
    """The time when `minutes` whole working minutes have passed; seconds ride along."""
    s0 = slot(start)
    week = F.size(open_slots) * 60
    target = 60 * opened[s0] + F.when(is_open[s0], F.minute(start)).otherwise(0) + minutes - 1
    rest = target % week
    by = ((target - rest) / week).cast("bigint") * (WEEK_SLOTS * 60) + open_slots[((rest - rest % 60) / 60).cast("int")] * 60 + rest % 60 + 1 - s0 * 60 - F.minute(start)
    return F.when(minutes <= 0, start).otherwise(F.timestamp_add("MINUTE", by.cast("int"), start))


def move(us: int, minutes: int, calendar: tuple[list[bool], list[int], list[int], list[int]]) -> int:
    """move_minutes for one time in microseconds since 1970-01-01, a Thursday."""
    if minutes <= 0:
        return us
    is_open, _, opened, slots = calendar
    minute_of = us // 60_000_000
    now = (minute_of // 60 + 72) % WEEK_SLOTS
    within = minute_of % 60
    target = 60 * opened[now] + (within if is_open[now] else 0) + minutes - 1
    weeks, rest = divmod(target, 60 * len(slots))
    return us + (weeks * WEEK_SLOTS * 60 + slots[rest // 60] * 60 + rest % 60 + 1 - now * 60 - within) * 60_000_000
