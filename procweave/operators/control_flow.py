"""How often each transition fires when it may."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procweave.operators.attributes import one_hot
from procweave.sources.event_log import step_order


def frequency_weights(per_variant: DataFrame) -> DataFrame:
    """(transition, weight): times fired over times enabled, of transitions ever enabled.

    per_variant: alignment.aligned(), whose n cases of each variant count at once, so no case's steps are needed."""
    steps = per_variant.select("n", F.explode("steps").alias("s"))
    tried = steps.select("n", F.col("s.transition").alias("fired"), F.explode("s.prev_enabled").alias("transition"))
    return tried.groupBy("transition").agg((F.sum(F.when(F.col("transition") == F.col("fired"), F.col("n")).otherwise(0)) / F.sum("n")).alias("weight"))


def training_rows(steps: DataFrame, labels: list[str], numeric: list[str], values: dict[str, list[str]]) -> tuple[DataFrame, list[str]]:
    """Rows (key, row_id, ord, y, x) for all transitions at once, and the features' names; ord: the order of cases and steps.

    Each step is a row for every transition enabled before it; y is whether that one fired. Features:
    numeric attributes, one-hot categories, history."""
    columns = [F.col(a).cast("double").alias(a) for a in numeric]
    for a, own in sorted(values.items()):
        columns += one_hot(a, own)
    names = [*numeric, *[f"{a} = {v}" for a, own in sorted(values.items()) for v in own], *labels]
    flat = steps.select("case_id", "step_idx", step_order(steps).alias("ord"), "transition", F.explode("prev_enabled").alias("key"), *columns, *labels)
    x = F.array(*[F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(0.0)) for n in names])
    row = F.concat_ws("|", F.col("case_id").cast("string"), F.col("step_idx").cast("string"))
    return flat.select("key", row.alias("row_id"), "ord", (F.col("key") == F.col("transition")).cast("double").alias("y"), x.alias("x")), names
