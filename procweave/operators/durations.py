"""Arrival, execution and waiting times in working minutes, as training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procweave.functions.calendars import working_minutes
from procweave.operators.attributes import one_hot
from procweave.operators.features import interarrivals
from procweave.sources.event_log import step_order


def arrivals(log: DataFrame, calendar: DataFrame) -> DataFrame:
    """(case_id, start_ts, hour, weekday, minutes): of each case but the first, when the case before came and the
    working minutes since. calendar: a one-row frame of prefix arrays."""
    pairs = interarrivals(log).where("prev_ts is not null")
    held = pairs.crossJoin(F.broadcast(calendar.select("closed")))  # one row
    return held.select("case_id", "start_ts", F.hour("prev_ts").alias("hour"), F.weekday("prev_ts").alias("weekday"), working_minutes(F.col("prev_ts"), F.col("start_ts"), F.col("closed")).alias("minutes"))


def timed(rows: DataFrame, calendars: DataFrame, start: str, end: str, out: str) -> DataFrame:
    """rows whose resource has a calendar, with the working minutes from start to end.

    calendars: calendar_frame(), which is broadcast if it is small enough."""
    held = rows.where(F.col(start).isNotNull() & F.col(end).isNotNull()).join(calendars.select("resource", "closed"), "resource")
    return held.withColumn(out, working_minutes(F.col(start), F.col(end), F.col("closed"))).drop("closed")


def training_rows(timed_rows: DataFrame, key: str, value: str, numeric: list[str], values: dict[str, list[str]], history: list[str], resources: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Rows (key, row_id, ord, y, x) and the features' names: resource one-hots (execution) or the workload
    (waiting), history, numeric attributes and one-hot categories."""
    first = one_hot("resource", resources) if resources is not None else [F.col("workload")]
    names = [f"resource = {r}" for r in resources] if resources is not None else ["workload"]
    columns = [*first, *[F.col(f"`{h}`") for h in history], *[F.col(a) for a in numeric]]
    for a, own in sorted(values.items()):
        columns += one_hot(a, own)
    names += [*history, *numeric, *[f"{a} = {v}" for a, own in sorted(values.items()) for v in own]]
    flat = timed_rows.select("case_id", "step_idx", step_order(timed_rows).alias("ord"), F.col(key).alias("__key"), F.col(value).alias("__y"), *columns)
    x = F.array(*[F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(0.0)) for n in names])
    row = F.concat_ws("|", F.col("case_id").cast("string"), F.col("step_idx").cast("string"))
    return flat.select(F.col("__key").alias("key"), row.alias("row_id"), "ord", F.col("__y").alias("y"), x.alias("x")), names
