"""Decision trees for all keys at once, grown level by level from aggregates.

Rows are (key, row_id, y, x), x an array of numbers. At each level one pass over the rows counts and
sums the labels by node, feature and value, for the full tree and for those that leave a fold out
together; running sums over the distinct values give every split's squared error. For labels 0 and 1
the squared error is half the Gini impurity times the rows, so the same growth gives classification
trees. A tree is a column, an array of its splits by node, that a row walks down, so rows are neither
copied nor written again. No task needs all rows of a key: the aggregates are combined before they
are shuffled.

A feature of up to BINS distinct values in a key is split exactly, in the middle between neighbouring
values; of one with more, the values are put into BINS bins of about as many rows each, and splits are
at the bins' ends. So what one task sorts is bounded, whatever the rows.

The depth is chosen by three-fold cross-validation over 1..max_depth. Greedy trees of smaller depth
are the tops of deeper ones, so one growth per fold gives all depths. Folds go by a hash of row_id.
`<=` goes to the left; ties go to the first feature and the lowest threshold. Nodes are numbered as
in a heap: the children of n are 2n+1 and 2n+2."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procweave.session import Staging, small

FOLDS, FULL = 3, 3  # three trees that leave a fold out, and the full one
LEAST_GAIN = 1e-9
#: Values of a feature, in a key, that are told apart.
BINS = 512


def fold_of(row_id: Column) -> Column:
    return (F.conv(F.substring(F.md5(row_id.cast("string")), 1, 8), 16, 10).cast("long") % FOLDS).cast("int")


def wide_features(rows: DataFrame, key: str, staging: Staging, bins: int) -> DataFrame | None:
    """(key, feature, ends) of the features with more than about `bins` values in a key; None if there are none."""
    values = rows.select(key, F.posexplode("x").alias("feature", "v"))
    wide = values.groupBy(key, "feature").agg(F.approx_count_distinct("v", 0.02).alias("k")).where(F.col("k") > 0.9 * bins).select(key, "feature")
    wide = staging.write(wide, "wide")
    if wide.isEmpty():
        return None
    ends = values.join(small(wide, wide.count(), 40), [key, "feature"]).groupBy(key, "feature").agg(F.percentile_approx("v", [(k + 1) / bins for k in range(bins)], 20 * bins).alias("ends"))
    return staging.write(ends.select(key, "feature", F.array_distinct("ends").alias("ends")), "ends")


def _binned(values: DataFrame, key: str, ends: DataFrame | None) -> DataFrame:
    """Rows (key, feature, v...) with the values of wide features moved up to their bin's end, and at: whether v is one."""
    if ends is None:
        return values.withColumn("at", F.lit(False))
    held = values.join(small(ends, ends.count(), 8 * BINS), [key, "feature"], "left")
    steps = [1 << k for k in range(BINS.bit_length(), -1, -1)]
    place = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda p, step: F.when(F.get(F.col("ends"), p + step - 1) < F.col("v"), p + step).otherwise(p))
    held = held.withColumn("at", F.col("ends").isNotNull())
    return held.withColumn("v", F.when(F.col("at"), F.coalesce(F.get("ends", place), "v")).otherwise(F.col("v"))).drop("ends")


def _best(stats: DataFrame, groups: list[str]) -> DataFrame:
    """(groups..., feature, threshold) from sums by value."""
    own = Window.partitionBy(*groups, "feature")
    run = own.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    stats = stats.select(
        *groups, "feature", "v", "at", F.lead("v").over(own.orderBy("v")).alias("next"), F.sum("n").over(run).alias("nl"), F.sum("s").over(run).alias("sl"),
        F.sum("n").over(own).alias("nt"), F.sum("s").over(own).alias("st"),
    ).where("next is not null")
    rest_n, rest_s = F.col("nt") - F.col("nl"), F.col("st") - F.col("sl")
    gain = F.col("sl") * F.col("sl") / F.col("nl") + F.try_divide(rest_s * rest_s, rest_n) - F.col("st") * F.col("st") / F.col("nt")
    threshold = F.when(F.col("at"), F.col("v")).otherwise((F.col("v") + F.col("next")) / 2)
    stats = stats.select(*groups, "feature", threshold.alias("threshold"), F.round(gain, 9).alias("gain")).where(F.col("gain") > LEAST_GAIN)
    best = stats.groupBy(*groups).agg(F.max_by(F.struct("feature", "threshold"), F.struct("gain", -F.col("feature"), -F.col("threshold"))).alias("b"))
    return best.select(*groups, "b.feature", "b.threshold")


def best_splits(rows: DataFrame, groups: list[str]) -> DataFrame:
    """(groups..., feature, threshold): for each group, the split of least squared error, if any gains; exact."""
    stats = rows.select(*groups, "y", F.posexplode("x").alias("feature", "v"))
    stats = stats.groupBy(*groups, "feature", "v").agg(F.count("*").alias("n"), F.sum("y").alias("s"))
    return _best(stats.withColumn("at", F.lit(False)), groups)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _walked(splits: Column, tree: int, depth: int, size: int) -> Column:
    """The node that a row is in after `depth` levels of a tree; splits: an array of structs (feature, threshold) by tree and node."""
    down = lambda n, s: F.when(s.isNull(), n).otherwise(n * 2 + F.when(F.get(F.col("x"), s["feature"]) <= s["threshold"], 1).otherwise(2))
    node = F.lit(0)
    for _ in range(depth):
        node = _let(node, lambda n: _let(F.get(splits, n + tree * size), lambda s: down(n, s)))  # noqa: B023
    return node


def _with_trees(rows: DataFrame, splits: DataFrame, key: str, size: int, keys: int) -> DataFrame:
    """rows with __splits, all trees of their key."""
    places = F.sequence(F.lit(0), F.lit((FOLDS + 1) * size - 1))
    entry = F.struct((F.col("tree") * size + F.col("node")).alias("at"), F.struct("feature", "threshold").alias("split"))
    by_key = splits.groupBy(key).agg(F.map_from_entries(F.collect_list(entry)).alias("m")).select(key, F.transform(places, lambda k: F.try_element_at("m", k)).alias("__splits"))
    return rows.join(small(by_key, keys, 24 * (FOLDS + 1) * size), key, "left")


def grown(rows: DataFrame, max_depth: int, staging: Staging, key: str = "key", bins: int = BINS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, tests, placed): nodes (key, tree, node, n, value[, feature, threshold]); tests, sums of the rows
    left out by a tree, by the node they reach at each depth; placed, the rows with `leaf`, their node at each depth of the full tree."""
    size = (1 << max_depth) - 1  # nodes that can split
    rows = staging.write(rows.select(key, "row_id", F.col("y").cast("double").alias("y"), "x", fold_of(F.col("row_id")).alias("fold")), "rows")
    keys = rows.select(key).distinct().count()
    ends = wide_features(rows, key, staging, bins)
    splits = staging.spark.createDataFrame([], f"`{key}` {rows.schema[key].dataType.simpleString()}, tree int, node int, feature int, threshold double")
    learned = F.filter(F.array(*map(F.lit, range(FOLDS + 1))), lambda t: t != F.col("fold"))
    for depth in range(max_depth):
        at = rows.withColumn("nodes", F.array(*[F.lit(0)] * (FOLDS + 1)))
        if depth:
            walked = [_walked(F.col("__splits"), t, depth, size) for t in range(FOLDS + 1)]
            at = _with_trees(rows, splits, key, size, keys).withColumn("nodes", F.array(*walked))
        # a few combinations of nodes, whose sums the trees share
        values = _binned(at.select(key, "nodes", "fold", "y", F.posexplode("x").alias("feature", "v")), key, ends)
        sums = values.groupBy(key, "nodes", "fold", "feature", "v", "at").agg(F.count("*").alias("n"), F.sum("y").alias("s"))
        by_tree = sums.select(key, F.explode(learned).alias("tree"), "nodes", "feature", "v", "at", "n", "s").withColumn("node", F.col("nodes")[F.col("tree")])
        by_tree = by_tree.where(F.col("node") >= (1 << depth) - 1).groupBy(key, "tree", "node", "feature", "v", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        level = staging.write(_best(by_tree, [key, "tree", "node"]).select(key, "tree", F.col("node").cast("int"), F.col("feature").cast("int"), "threshold"), f"splits_{depth}")
        splits = splits.unionByName(level)
    at = _with_trees(rows, splits, key, size, keys)
    paths = [F.array(*[_walked(F.col("__splits"), t, d, size) for d in range(max_depth + 1)]) for t in range(FOLDS + 1)]
    sums = at.select(key, "fold", "y", F.array(*paths).alias("paths")).groupBy(key, "fold", "paths").agg(F.count("*").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("ss"))
    sums = staging.write(sums, "sums")
    values = sums.select(key, F.explode(learned).alias("tree"), "paths", "n", "s").select(key, "tree", F.explode(F.array_distinct(F.col("paths")[F.col("tree")])).alias("node"), "n", "s")
    values = values.groupBy(key, "tree", "node").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("value"))
    nodes = values.join(splits, [key, "tree", "node"], "left")
    tests = sums.select(key, F.col("fold").alias("tree"), F.posexplode(F.col("paths")[F.col("fold")]).alias("depth", "node"), "n", "s", "ss").where("depth > 0")
    return nodes, tests, at.withColumn("leaf", paths[FULL]).select(key, "row_id", "y", "leaf")


def depths(nodes: DataFrame, tests: DataFrame, classes: bool, key: str = "key") -> DataFrame:
    """(key, depth): the depth whose mean score over the folds is best, smaller ones first; accuracy for classes, else R2."""
    scored = tests.join(nodes.select(key, "tree", "node", "value"), [key, "tree", "node"])
    n, s, ss, v = (F.col(c) for c in ("n", "s", "ss", "value"))
    if classes:
        score = F.sum(F.when(v > 0.5, s).otherwise(n - s)) / F.sum(n)
    else:
        spread = F.sum(ss) - F.sum(s) * F.sum(s) / F.sum(n)
        score = 1 - F.sum(ss - 2 * v * s + n * v * v) / F.when(spread > 1e-9, spread)
    folds = scored.groupBy(key, "tree", "depth").agg(score.alias("score"))
    means = folds.groupBy(key, "depth").agg(F.round(F.avg(F.coalesce("score", F.lit(0.0))), 9).alias("score"))
    return means.groupBy(key).agg(F.max_by("depth", F.struct("score", -F.col("depth"))).alias("depth"))


def fit(rows: DataFrame, features: list[str], max_depth: int = 3, classes: bool = False, key: str = "key", bins: int = BINS) -> tuple[DataFrame, DataFrame]:
    """(rules, leaves) of the full trees at their chosen depths.

    rules: (key, node_id, feature, threshold, yes_id, no_id, value, n), feature by name and null in
    leaves. leaves: (key, row_id, y, leaf). rows: (key, row_id, y, x). Keys of up to three rows get
    depth 1. Keys without rows have no rules."""
    staging = Staging(rows.sparkSession, "trees")
    nodes, tests, placed = grown(rows, max_depth, staging, key, bins)
    nodes = staging.write(nodes, "nodes")
    chosen = nodes.where((F.col("tree") == FULL) & (F.col("node") == 0)).select(key, "n").join(depths(nodes, tests, classes, key), key, "left")
    chosen = staging.write(chosen.select(key, F.when(F.col("n") > 3, F.coalesce("depth", F.lit(1))).otherwise(1).alias("depth")), "depths")
    level = F.floor(F.log2(F.col("node") + F.lit(1.0))).cast("int")
    full = nodes.where(F.col("tree") == FULL).join(chosen, key).where(level <= F.col("depth"))
    inner = (level < F.col("depth")) & F.col("feature").isNotNull()
    names = F.array(*map(F.lit, features))
    pick = lambda c: F.when(inner, c)
    rules = full.select(
        key, F.col("node").alias("node_id"), pick(F.element_at(names, F.col("feature").cast("int") + 1)).alias("feature"), pick(F.col("threshold")).alias("threshold"),
        pick(F.col("node") * 2 + 1).alias("yes_id"), pick(F.col("node") * 2 + 2).alias("no_id"), "value", "n",
    )
    leaves = placed.join(small(chosen, chosen.count(), 40), key).select(key, "row_id", "y", F.col("leaf")[F.col("depth")].alias("leaf"))
    return rules, leaves
