"""Case attributes: their joint distribution and one-hot columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Values of a categorical attribute that can be features.
MOST_VALUES = 1000


def joint_distribution(log: DataFrame, names: list[str]) -> DataFrame:
    """(names..., prob) over cases, by the values of each case's first event."""
    first = log.where("event_idx = 0")
    counts = first.groupBy(*names).agg(F.count("*").alias("n"))
    return counts.select(*names, (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("prob"))


def vocabulary(log: DataFrame, name: str) -> list[str]:
    """A categorical attribute's values, sorted. More than MOST_VALUES are refused: each would be a feature."""
    found = [r[0] for r in log.where(F.col(name).isNotNull()).select(name).distinct().limit(MOST_VALUES + 1).collect()]
    if len(found) > MOST_VALUES:
        raise ValueError(f"attribute {name} has more than {MOST_VALUES} values: drop it, or group them")
    return sorted(found)


def one_hot(column: str, values: list[str]) -> list[Column]:
    """A 0 or 1 column `column = value` for each value; 0 for null."""
    return [F.coalesce((F.col(column) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{column} = {v}") for v in values]
