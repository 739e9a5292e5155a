"""Who does the work: shares of resources, the retained ones, and who does which activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def value_counts(log: DataFrame, column: str) -> DataFrame:
    """(column, n) of the values that aren't null."""
    return log.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def shares(log: DataFrame) -> DataFrame:
    """(resource, share) of the events that have a resource."""
    counts = value_counts(log, "resource")
    return counts.select("resource", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


def retained(log: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(resource, share), by share descending and name, while the shares so far, own included, are within the threshold.

    The resource that crosses it is dropped, so a dominant one can leave nobody. The window is over
    resources, not events."""
    order = Window.orderBy(F.desc("n"), "resource").rowsBetween(Window.unboundedPreceding, 0)
    counts = value_counts(log, "resource").withColumn("total", F.sum("n").over(Window.partitionBy()))
    kept = counts.withColumn("so_far", F.sum("n").over(order) / F.col("total")).where(F.col("so_far") <= threshold)
    return kept.select("resource", (F.col("n") / F.col("total")).alias("share"))


def activity_resources(log: DataFrame, resources: DataFrame) -> DataFrame:
    """(activity, resource, prob): each activity's split over the retained resources; even if none of them did it."""
    counts = log.groupBy("activity", "resource").agg(F.count("*").alias("n"))
    names = resources.select("resource").distinct()
    activities = log.select("activity").where("activity is not null").distinct()
    pairs = activities.crossJoin(names)  # activities x resources, no rows of the log
    dense = pairs.join(counts, ["activity", "resource"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    own = Window.partitionBy("activity")
    total, size = F.sum("n").over(own), F.count("*").over(own)
    dense = dense.withColumn("prob", F.when(total == 0, F.lit(1.0) / size).otherwise(F.col("n") / total))
    return dense.where("prob > 0").select("activity", "resource", "prob")
