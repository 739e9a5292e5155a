"""Trees that learn one row at a time and forget when the data change.

Leaves keep the number, mean and variance of the labels and, for each feature, a histogram of at
most BINS values with their label sums; where there are more values, the two nearest bins become one
at their mean (Ben-Haim and Tom-Tov 2010). Every grace_period rows a leaf looks for the split that takes
most variance away; it splits when the Hoeffding bound, sqrt(ln(1/delta) / 2n), says that the best
beats the second best (Domingos and Hulten 2000). Inner nodes watch their error with an adaptive
window (Bifet and Gavalda 2007). When it has grown, another tree begins to learn the node's rows beside
it, and takes its place when its error is lower by more than chance, or goes when it is higher (2009).
Labels 0 and 1 make classification trees: their variance is half the Gini impurity."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from math import log, sqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS, DELTA, TIE = 64, 1e-7, 0.05
#: Rows before a second tree is compared with the first, and the chance of an error that the comparison allows.
LEAST_ROWS, CHANCE = 300, 0.05

RULES = "node_id int, feature string, threshold double, yes_id int, no_id int, value double, n long, sd double, dist string, params array<double>, min double, max double"


class Adwin:
    """An adaptive window over a stream of numbers from 0 to 1: buckets of doubling sizes, five of each."""

    def __init__(self, delta: float = 0.002):
        self.delta, self.rows, self.n, self.total = delta, [[]], 0, 0.0

    def add(self, x: float) -> bool:
        """True if the mean has grown, after the old part is dropped."""
        self.rows[0].append(x)
        self.n, self.total = self.n + 1, self.total + x
        k = 0
        while k < len(self.rows) and len(self.rows[k]) > 5:
            if k + 1 == len(self.rows):
                self.rows.append([])
            self.rows[k + 1].append(self.rows[k].pop(0) + self.rows[k].pop(0))
            k += 1
        return self.n % 32 == 0 and self._shrink()

    def _shrink(self) -> bool:
        grown, cut = False, True
        while cut and self.n > 10:
            cut, n, total = False, 0, 0.0
            for k in range(len(self.rows) - 1, -1, -1):
                for b in self.rows[k]:
                    n, total = n + (1 << k), total + b
                    rest = self.n - n
                    if rest < 5 or n < 5:
                        continue
                    old, new = total / n, (self.total - total) / rest
                    mean = self.total / self.n
                    m = 1 / (1 / n + 1 / rest)
                    d = log(2 * log(self.n) / self.delta)
                    if abs(old - new) > sqrt(2 / m * max(mean * (1 - mean), 0) * d) + 2 / (3 * m) * d:
                        grown, cut = grown or new > old, True
            if cut:
                last = max(k for k, r in enumerate(self.rows) if r)
                dropped = self.rows[last].pop(0)
                self.n, self.total = self.n - (1 << last), self.total - dropped
        return grown


class Node:
    def __init__(self, depth: int):
        self.depth, self.n, self.mean, self.m2 = depth, 0, 0.0, 0.0
        self.low, self.high = float("inf"), float("-inf")
        self.bins: list[dict[float, list[float]]] = []
        self.split: tuple[int, float] | None = None
        self.yes: Node | None = None
        self.no: Node | None = None
        self.watch: Adwin | None = None
        self.other: Node | None = None  # the tree that may take this one's place, and both errors' sums since it began
        self.errors = [0, 0.0, 0.0]

    @property
    def sd(self) -> float:
        return sqrt(max(self.m2 / self.n, 0.0)) if self.n else 0.0


class HoeffdingTree:
    def __init__(self, features: int, max_depth: int = 3, grace_period: int = 1000):
        self.features, self.max_depth, self.grace, self.root = features, max_depth, grace_period, Node(0)
        self.spread = 1e-9

    def learn(self, x: list[float], y: float) -> None:
        self._learn(self.root, x, y)

    def _learn(self, node: Node, x: list[float], y: float) -> float:
        """Takes a row in; the error of the node's tree, from 0 to 1."""
        node.n += 1
        delta = y - node.mean
        node.mean += delta / node.n
        node.m2 += delta * (y - node.mean)
        node.low, node.high = min(node.low, y), max(node.high, y)
        if node.split is None:
            self.spread = max(self.spread, abs(y - node.mean))
            error = min(abs(y - node.mean) / self.spread, 1.0)
            if node.depth < self.max_depth:
                self._count(node, x, y)
            return error
        error = self._learn(node.yes if x[node.split[0]] <= node.split[1] else node.no, x, y)
        grown = node.watch.add(error)
        if node.other is not None:
            self._compare(node, error, self._learn(node.other, x, y))
        elif grown:
            node.other, node.errors = Node(node.depth), [0, 0.0, 0.0]
        return error

    def _count(self, leaf: Node, x: list[float], y: float) -> None:
        if not leaf.bins:
            leaf.bins = [{} for _ in range(self.features)]
        for own, v in zip(leaf.bins, x, strict=True):
            cell = own.setdefault(v, [0, 0.0])
            cell[0] += 1
            cell[1] += y
            if len(own) > BINS:
                values = sorted(own)
                _, a, b = min((b - a, a, b) for a, b in zip(values, values[1:], strict=False))
                (n, s), (m, t) = own.pop(a), own.pop(b)
                own[(a * n + b * m) / (n + m)] = [n + m, s + t]
        if leaf.n % self.grace == 0:
            self.try_split(leaf)

    @staticmethod
    def _compare(node: Node, error: float, other: float) -> None:
        node.errors = n, old, new = [node.errors[0] + 1, node.errors[1] + error, node.errors[2] + other]
        if n < LEAST_ROWS or n % 32:
            return
        mean = (old + new) / (2 * n)
        bound = sqrt(2 * mean * (1 - mean) * log(2 / CHANCE) * 2 / n)
        if old / n - new / n > bound:
            node.__dict__.update(node.other.__dict__)
        elif new / n - old / n > bound:
            node.other = None

    def try_split(self, node: Node) -> None:
        found = []
        for k, own in enumerate(node.bins):
            values = sorted(own)
            n, s = sum(c[0] for c in own.values()), sum(c[1] for c in own.values())
            nl, sl, best = 0, 0.0, (0.0, 0.0)
            for a, b in zip(values, values[1:], strict=False):
                nl, sl = nl + own[a][0], sl + own[a][1]
                gain = sl * sl / nl + (s - sl) ** 2 / (n - nl) - s * s / n
                if gain > best[0] + 1e-9:
                    best = (gain, (a + b) / 2)
            found.append((best[0], -k, best[1]))
        found.sort(reverse=True)
        if not found or found[0][0] <= 1e-9:
            return
        second = found[1][0] if len(found) > 1 else 0.0
        bound = sqrt(log(1 / DELTA) / (2 * node.n))
        if second / found[0][0] < 1 - bound or bound < TIE:
            node.split = (-found[0][1], found[0][2])
            node.yes, node.no, node.watch, node.bins = Node(node.depth + 1), Node(node.depth + 1), Adwin(), []
            for child in (node.yes, node.no):  # until rows come, what the parent knows
                child.mean, child.low, child.high = node.mean, node.low, node.high

    def rules(self, names: list[str], classes: bool, at: int = 0, node: Node | None = None) -> list[tuple]:
        """Rows of RULES; a leaf's draws are normal around its mean. A tree that saw nothing gives 0, or 1 for classes."""
        node = node or self.root
        value = node.mean if self.root.n else float(classes)
        low, high = (node.low, node.high) if self.root.n else (value, value)
        leaf = (None, None, None, None)
        if node.split is not None:
            leaf = (names[node.split[0]], node.split[1], 2 * at + 1, 2 * at + 2)
        dist = ("norm", [value, node.sd]) if node.sd > 0 else ("fixed", [value])
        row = (at, *leaf, value, node.n, node.sd, dist[0], dist[1], float(low), float(high))
        if node.split is None:
            return [row]
        return [row, *self.rules(names, classes, 2 * at + 1, node.yes), *self.rules(names, classes, 2 * at + 2, node.no)]


def folded(rows: DataFrame, names: list[str], max_depth: int = 3, grace_period: int = 1000, classes: bool = False) -> DataFrame:
    """Rules (key, RULES...) after one pass over (key, ord, y, x), key by key in the order of ord.

    Rows stream through a sorted partition, so what is held is the trees, not a key's rows."""
    count = len(names)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, tree = None, None

        def out() -> pd.DataFrame:
            return pd.DataFrame([(key, *r) for r in tree.rules(names, classes)], columns=["key", *[p.split()[0] for p in RULES.split(", ")]]).astype({"yes_id": "Int32", "no_id": "Int32"})

        for batch in batches:
            for k, y, x in zip(batch["key"], batch["y"], batch["x"], strict=True):
                if tree is None or k != key:
                    if tree is not None:
                        yield out()
                    key, tree = k, HoeffdingTree(count, max_depth, grace_period)
                tree.learn(list(x), float(y))
        if tree is not None:
            yield out()

    kind = rows.schema["key"].dataType.simpleString()
    ordered = rows.repartition("key").sortWithinPartitions("key", "ord").select("key", F.col("y").cast("double").alias("y"), "x")
    return ordered.mapInPandas(fold, f"key {kind}, {RULES}")


def dumped(tree: HoeffdingTree) -> bytes:
    return pickle.dumps(tree)


def loaded(state: bytes) -> HoeffdingTree:
    return pickle.loads(state)
