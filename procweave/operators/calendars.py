"""Weekly calendars from the hours at which events start and end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procweave.functions.calendars import WEEK_SLOTS


def hour_histogram(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., wd, h, n): starts and ends of events by weekday, Monday 0, and hour; one scan for both."""
    by = ["resource"] if by is None else by
    times = log.select(*by, F.explode(F.array("start_ts", "end_ts")).alias("ts")).where("ts is not null")
    return times.groupBy(*by, F.weekday("ts").alias("wd"), F.hour("ts").alias("h")).agg(F.count("*").alias("n"))


def open_hours(histogram: DataFrame, by: list[str], hour_share: float = 0.95, day_share: float = 0.95) -> DataFrame:
    """(by..., wd, h) that are open: the busiest weekdays until day_share is reached, and of each the
    busiest hours until hour_share is; what reaches a share still counts. Ties go to the earlier.

    Windows run over at most 168 rows of a key."""
    days = histogram.groupBy(*by, "wd").agg(F.sum("n").alias("n"))

    def before(keys: list[str], tie: str):
        run = Window.partitionBy(*keys).orderBy(F.desc("n"), tie).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(run), F.lit(0)) / F.sum("n").over(Window.partitionBy(*keys))

    top_days = days.withColumn("before", before(by, "wd")).where(F.col("before") < day_share).select(*by, "wd")
    hours = histogram.withColumn("before", before([*by, "wd"], "h")).where(F.col("before") < hour_share)
    return hours.join(top_days, [*by, "wd"], "left_semi").select(*by, "wd", "h")


def resource_calendars(log: DataFrame, resources: DataFrame | None = None, hour_share: float = 0.95, day_share: float = 0.95) -> DataFrame:
    """Open (resource, wd, h); of all resources where none are given."""
    if resources is not None:
        log = log.join(resources.select("resource"), "resource", "left_semi")
    return open_hours(hour_histogram(log), ["resource"], hour_share, day_share)


def arrival_calendar(log: DataFrame, hour_share: float = 0.95, day_share: float = 0.95) -> DataFrame:
    """Open (wd, h) by the first stored event of each case."""
    return open_hours(hour_histogram(log.where("event_idx = 0"), []), [], hour_share, day_share)


def slots(opened: DataFrame, by: list[str]) -> dict:
    """The 168 slots of each key of an open-hours table; a row a key and hour reaches the driver."""
    out: dict = {}
    for r in opened.collect():
        key = r["resource"] if by else ""
        out.setdefault(key, [False] * WEEK_SLOTS)[r["wd"] * 24 + r["h"]] = True
    return out
