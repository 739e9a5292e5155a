"""Incremental trees over a stream of training rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from procweave.operators.hoeffding import RULES, HoeffdingTree, dumped, loaded


def learned(rows: DataFrame, names: list[str], max_depth: int = 3, grace_period: int = 1000, classes: bool = False) -> DataFrame:
    """A stream of rules (key, RULES...), a key's current tree whenever it got rows.

    rows: a stream of (key string, ord, y, x). A key's tree is its state, of bounded size; each trigger's rows are
    learned in the order of ord, so they should come in order from trigger to trigger. A trigger's rows of a
    key are sorted in memory: the source's limit of rows or files for a trigger bounds them."""
    count, columns = len(names), ["key", *[p.split()[0] for p in RULES.split(", ")]]

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tree = loaded(state.get[0]) if state.exists else HoeffdingTree(count, max_depth, grace_period)
        part = pd.concat(list(batches)).sort_values("ord", kind="stable")
        for y, x in zip(part["y"], part["x"], strict=True):
            tree.learn(list(x), float(y))
        state.update((dumped(tree),))
        yield pd.DataFrame([(key[0], *r) for r in tree.rules(names, classes)], columns=columns).astype({"yes_id": "Int32", "no_id": "Int32"})

    return rows.withColumn("y", F.col("y").cast("double")).groupBy("key").applyInPandasWithState(update, f"key string, {RULES}", "tree binary", "update", GroupStateTimeout.NoTimeout)
