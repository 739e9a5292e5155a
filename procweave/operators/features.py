"""Features of events that need other events: workload, history, enabling times, inter-arrivals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procweave.operators.windows import previous, running_sum


def workload(log: DataFrame, probes: DataFrame, at: str, key: str = "event_id") -> DataFrame:
    """(key, workload): how many events of the probe's resource started before and end after its time.

    A sweep: intervals add 1 at their start and take 1 at their end; ends come before a probe at the
    same time and starts after it, so both bounds are strict. Intervals without length never count, and
    a probe without a resource has no workload.
    The running sum goes hour by hour, so a busy resource is spread over many tasks."""
    real = log.where("resource is not null and start_ts < end_ts")
    none = F.lit(None).cast(probes.schema[key].dataType)
    rows = real.select("resource", F.col("start_ts").alias("at"), F.lit(2).alias("turn"), F.lit(1).alias("d"), none.alias(key))
    rows = rows.unionAll(real.select("resource", "end_ts", F.lit(0), F.lit(-1), none))
    rows = rows.unionAll(probes.where(F.col(at).isNotNull()).select("resource", at, F.lit(1), F.lit(0), key))
    summed = running_sum(rows, "d", ["resource"], F.date_trunc("hour", "at"), ["at", "turn"], "workload")
    return summed.where(F.col(key).isNotNull()).select(key, F.col("workload").cast("bigint"))


def history(steps: DataFrame, labels: list[str], order: list[str], label: str = "label") -> DataFrame:
    """steps with a count column for each label: how often it came before in the case."""
    before = Window.partitionBy("case_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return steps.select("*", *[F.coalesce(F.sum((F.col(label) == F.lit(x)).cast("bigint")).over(before), F.lit(0).cast("bigint")).alias(x) for x in labels])


def flower_enabled(log: DataFrame) -> DataFrame:
    """enabled_ts where every activity may always happen: the end of the case's last event of the
    same activity, else the case's first start."""
    order = ["start_ts", "event_id"]
    same = Window.partitionBy("case_id", "activity").orderBy(*order)
    case = Window.partitionBy("case_id").orderBy(*order)
    return log.withColumn("enabled_ts", F.coalesce(F.lag("end_ts").over(same), F.first("start_ts").over(case)))


def case_starts(log: DataFrame) -> DataFrame:
    return log.groupBy("case_id").agg(F.min("start_ts").alias("start_ts"))


def interarrivals(log: DataFrame) -> DataFrame:
    """(case_id, start_ts, prev_ts): each case's start and that of the case before; null for the first.

    Days are sorted by themselves and the last start of each carried to the next."""
    return previous(case_starts(log), "start_ts", F.date_trunc("day", "start_ts"), ["start_ts", "case_id"], "prev_ts")
