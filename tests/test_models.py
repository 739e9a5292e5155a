import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from procweave.functions import rules
from procweave.operators import distributions, hoeffding, trees


@pytest.fixture(scope="module")
def grid(spark):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        a, b = rng.randint(0, 5), rng.random()
        rows.append(("k1", str(i), 10.0 * (a > 2) + 3.0 * (b > 0.5) * (a > 2) + rng.random() * 0.1, [float(a), b]))
        rows.append(("k2", str(i), float(a == 1), [float(a), b]))
    rows += [("k3", "1", 5.0, [1.0, 1.0]), ("k3", "2", 5.0, [2.0, 1.0])]
    return spark.createDataFrame(rows, "key string, row_id string, y double, x array<double>"), rows


def test_trees_find_the_structure(spark, grid):
    df, rows = grid
    found, leaves = trees.fit(df, ["a", "b"], 3)
    nodes = rules.by_key(found.collect())
    root = nodes["k1"][0]
    assert (root["feature"], root["threshold"]) == ("a", 2.5)
    assert nodes["k1"][2]["feature"] == "b" and abs(nodes["k1"][2]["threshold"] - 0.5) < 0.05
    assert nodes["k3"][0]["feature"] is None and nodes["k3"][0]["value"] == 5
    for key, _, y, x in rows[:200:2]:
        assert abs(rules.leaf_of(nodes[key], dict(zip("ab", x, strict=True)))[1]["value"] - y) < 0.5
    assert leaves.count() == len(rows)
    at = {(r["key"], r["row_id"]): r["leaf"] for r in leaves.collect()}
    for key, row, _, x in rows[:300]:
        assert at[key, row] == rules.leaf_of(nodes[key], dict(zip("ab", x, strict=True)))[0]


def test_first_split_against_all_splits(spark, grid):
    df, rows = grid
    got = {r["key"]: (r["feature"], r["threshold"]) for r in trees.best_splits(df, ["key"]).collect()}
    for key in ("k1", "k2"):
        own, best = [(x, y) for k, _, y, x in rows if k == key], None
        for f in (0, 1):
            values = sorted({x[f] for x, _ in own})
            for a, b in zip(values, values[1:], strict=False):
                left, right = [y for x, y in own if x[f] <= (a + b) / 2], [y for x, y in own if x[f] > (a + b) / 2]
                error = sum((y - sum(s) / len(s)) ** 2 for s in (left, right) for y in s)
                if best is None or error < best[0] - 1e-9:
                    best = (error, f, (a + b) / 2)
        assert got[key] == best[1:]


def test_rules_compile_and_draw(spark, grid):
    nodes = rules.by_key(trees.fit(grid[0], ["a", "b"], 2, classes=True)[0].collect())["k2"]
    df = spark.createDataFrame([(float(a), b / 4) for a in range(6) for b in range(5)], "a double, b double")
    for r in df.select("a", "b", rules.compiled(nodes).alias("v")).collect():
        assert r["v"] == rules.leaf_of(nodes, {"a": r["a"], "b": r["b"]})[1]["value"]
    assert rules.to_dot(nodes).startswith("digraph") and rules.tests(nodes, "a") and not rules.tests(nodes, "z")
    assert rules.leaf_of(rules.constant(3.0), {})[1]["value"] == 3


def test_families_are_recognized(spark):
    rng = random.Random(4)
    made = {"norm": lambda: rng.gauss(50, 5), "expon": lambda: 2 + rng.expovariate(0.1), "uniform": lambda: rng.uniform(3, 9), "lognorm": lambda: math.exp(rng.gauss(2, 0.8)) - 1}
    rows = [(k, f()) for k, f in made.items() for _ in range(3000)] + [("one", 4.0)] * 5 + [("none", None), ("nan", float("nan"))]
    fits = {r["k"]: r["fit"] for r in distributions.fitted(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert {k: fits[k]["dist"] for k in made} == {k: k for k in made}
    assert fits["norm"]["params"] == pytest.approx([50, 5], rel=0.05) and fits["uniform"]["params"] == pytest.approx([3, 6], rel=0.05)
    assert (fits["one"]["dist"], fits["one"]["params"]) == ("fixed", [4.0]) and "none" not in fits and "nan" not in fits


def test_draws_in_both_forms(spark):
    fits = [("norm", [10.0, 2.0]), ("expon", [1.0, 3.0]), ("uniform", [2.0, 4.0]), ("lognorm", [0.5, -1.0, 3.0]), ("fixed", [5.0])]
    us = [k / 37 for k in range(38)]
    for dist, params in fits:
        fit = F.struct(F.lit(dist).alias("dist"), F.array(*map(F.lit, params)).alias("params"), F.lit(1.0).alias("min"), F.lit(12.0).alias("max"), F.lit(6.0).alias("mean"))
        got = [r[0] for r in spark.createDataFrame([(u,) for u in us], "u double").select("u", distributions.drawn(fit, F.col("u")).alias("d")).orderBy("u").select("d").collect()]
        for u, d in zip(us, got, strict=True):
            expected = distributions.sample(dist, params, 1.0, 12.0, 6.0, u)
            assert d == pytest.approx(expected, abs=1e-7)
    assert distributions.sample("fixed", [5.0], 1, 12, 6, 0.5) == 12 and distributions.sample("fixed", [5.0], 1, 12, 6, 0.5, "mean") == 6


def test_hoeffding_tree_splits_and_forgets():
    rng = random.Random(6)
    tree = hoeffding.HoeffdingTree(2, 3, 200)
    for _ in range(4000):
        x = [float(rng.randint(0, 3)), rng.random()]
        tree.learn(x, 10.0 * (x[0] > 1) + rng.random())
    assert tree.root.split == (0, 1.5)
    nodes = rules.by_key([dict(zip(["key", "node_id", "feature", "threshold", "yes_id", "no_id", "value"], ("k", *r[:6]), strict=True)) for r in tree.rules(["a", "b"], False)])["k"]
    assert abs(rules.leaf_of(nodes, {"a": 3, "b": 0})[1]["value"] - 10.5) < 0.3
    for _ in range(6000):
        x = [float(rng.randint(0, 3)), rng.random()]
        tree.learn(x, 10.0 * (x[0] <= 1) + rng.random())
    value = lambda a: rules.leaf_of(rules.by_key([dict(zip(["key", "node_id", "feature", "threshold", "yes_id", "no_id", "value"], ("k", *r[:6]), strict=True)) for r in tree.rules(["a", "b"], False)])["k"], {"a": a})[1]["value"]
    assert value(0) > 8 > 3 > value(3)
    assert hoeffding.HoeffdingTree(1).rules(["a"], True)[0][5] == 1.0 and hoeffding.HoeffdingTree(1).rules(["a"], False)[0][5] == 0.0


def test_stream_learns_what_a_batch_does(spark, tmp_path):
    from procweave.streaming.incremental import learned

    rng = random.Random(7)
    rows = [(rng.choice("pq"), i, float(i % 7), [float(i % 3)]) for i in range(600)]
    schema = "key string, ord long, y double, x array<double>"
    for k in range(3):
        spark.createDataFrame(rows[200 * k : 200 * k + 200], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = learned(stream, ["a"], grace_period=50).writeStream.outputMode("update").format("memory").queryName("trees").option("checkpointLocation", f"{tmp_path}/cp").start()
    run.processAllAvailable()
    run.stop()
    last = {r["key"]: r["n"] for r in spark.sql("select key, max(n) as n from trees where node_id = 0 group by key").collect()}
    batch = {r["key"]: r["n"] for r in hoeffding.folded(spark.createDataFrame(rows, schema), ["a"], grace_period=50).where("node_id = 0").collect()}
    assert last == batch == {k: sum(r[0] == k for r in rows) for k in "pq"}


def test_windows_in_two_levels(spark):
    from procweave.operators.windows import previous, running_sum

    rng = random.Random(8)
    rows = [(i, rng.choice("ab"), rng.randint(-3, 9)) for i in range(200)]
    df = spark.createDataFrame(rows, "i long, k string, v long")
    got = {r["i"]: r["s"] for r in running_sum(df, "v", ["k"], F.floor(F.col("i") / 7), ["i"], "s").collect()}
    assert got == {i: sum(v for j, q, v in rows if q == k and j <= i) for i, k, _ in rows}
    before = {r["i"]: r["p"] for r in previous(df, "v", F.floor(F.col("i") / 9), ["i"], "p").collect()}
    assert before == {i: rows[i - 1][2] if i else None for i, _, _ in rows}
    assert datetime(2024, 1, 1).weekday() == 0


def test_logistic_weights_follow_the_data(spark):
    from procweave.operators import logistic

    rng = random.Random(9)
    rows = []
    for _ in range(3000):
        a = rng.uniform(-2, 2)
        rows.append(("t", float(rng.random() < 1 / (1 + math.exp(-(0.5 + 1.5 * a)))), [a]))
    rows += [("always", 1.0, [0.0])] * 3
    df = spark.createDataFrame(rows, "key string, y double, x array<double>")
    models = logistic.fit(df, ["a"])
    assert set(models) == {"t"} and models["t"]["intercept"] == pytest.approx(0.5, abs=0.15) and models["t"]["coefficients"]["a"] == pytest.approx(1.5, abs=0.15)
    got = spark.createDataFrame([(1.0,)], "a double").select(logistic.compiled(models["t"])).first()[0]
    assert got == pytest.approx(logistic.probability(models["t"], {"a": 1.0}))


def test_densities_have_mass_one(spark):
    grid = spark.range(-4000, 20000).select((F.col("id") / 100).alias("x"))
    for family, params in (("norm", [10.0, 2.0]), ("expon", [1.0, 3.0]), ("uniform", [2.0, 4.0]), ("lognorm", [0.5, -1.0, 3.0])):
        p = F.array(*map(F.lit, params))
        assert grid.select(F.sum(distributions.density(family, p, F.col("x"))) / 100).first()[0] == pytest.approx(1, abs=0.01)
