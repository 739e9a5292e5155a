"""Running values over keys of any size, in two levels: within blocks, and over the blocks' totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(rows: DataFrame, value: str, keys: list[str], block: Column, order: list[str], out: str, frame_end: int = 0) -> DataFrame:
    """rows with the sum of value up to each row in (keys, block, order); block must grow with order.

    A key's rows are summed block by block, and the blocks' totals, a row each, are summed before
    them, so no task needs all of a key. frame_end=-1 leaves the row itself out. Rows with a null key
    or block are summed within their block alone."""
    rows = rows.withColumn("__block", block)
    totals = rows.groupBy(*keys, "__block").agg(F.sum(value).alias("__total"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "__block", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"))
    own = Window.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, frame_end)
    summed = rows.withColumn("__own", F.coalesce(F.sum(value).over(own), F.lit(0)))
    # joined on the window's own keys, so the rows stay where they are
    joined = summed.join(totals, [*keys, "__block"], "left")
    return joined.select(*[c for c in rows.columns if c != "__block"], (F.col("__own") + F.coalesce("__before", F.lit(0))).alias(out))


def previous(rows: DataFrame, value: str, block: Column, order: list[str], out: str) -> DataFrame:
    """rows with the value of the row before in (block, order), over all rows; null for the first."""
    rows = rows.withColumn("__block", block)
    own = Window.partitionBy("__block").orderBy(*order)
    last = rows.groupBy("__block").agg(F.max_by(value, F.struct(*order)).alias("__last"))
    last = last.select("__block", F.lag("__last").over(Window.orderBy("__block")).alias("__carried"))
    lagged = rows.withColumn("__own", F.lag(value).over(own)).withColumn("__place", F.row_number().over(own))
    joined = lagged.join(last, "__block")
    return joined.select(*[c for c in rows.columns if c != "__block"], F.when(F.col("__place") > 1, F.col("__own")).otherwise(F.col("__carried")).alias(out))
