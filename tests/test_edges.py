"""Order of learning, odd files and odd groups."""

import random
from datetime import datetime, timedelta
from heapq import heapify, heappop, heappush

import pytest
from pyspark.sql import functions as F

from procweave.functions.rules import by_key, constant
from procweave.operators import alignment, attributes, control_flow, distributions, features, hoeffding, trees
from procweave.plans.discovery import SimulatorParameters
from procweave.plans.simulation import SimulatorEngine, chance
from procweave.sources import event_log, petri_net

START = datetime(2024, 3, 4, 9)


def log_of(spark, cases):
    """cases: (case_id, activities, attribute) in the log's order, told by case_order."""
    rows = [
        (case, i, a, "r", START + timedelta(days=k, minutes=10 * i), START + timedelta(days=k, minutes=10 * i + 5), v, k)
        for k, (case, activities, v) in enumerate(cases)
        for i, a in enumerate(activities)
    ]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "case_id string, event_idx int, activity string, resource string, start_ts timestamp_ntz, end_ts timestamp_ntz, amount double, case_order long")


def test_incremental_trees_learn_in_log_order(spark):
    """Step 10 after step 9 and case 10 after case 9, however the rows lie; the outcome depends on it."""
    rng = random.Random(2)
    cases = [(str(k), "AB" * rng.randint(1, 9) if k % 3 else "B" * rng.randint(1, 14), float(k % 7)) for k in range(1, 60)]
    net = petri_net.flower(["A", "B"])
    steps = features.history(alignment.stepped(log_of(spark, cases), net), net.labels, ["step_idx"])
    rows, names = control_flow.training_rows(steps, net.labels, ["amount"], {})
    got = by_key(hoeffding.folded(rows.repartition(7), names, 3, 40, classes=True).collect())
    for key in ("A", "B", "tau_out"):
        tree = hoeffding.HoeffdingTree(len(names), 3, 40)
        for _, activities, amount in cases:
            seen = {"A": 0, "B": 0}
            for fired in [*activities, "tau_out"]:
                tree.learn([amount, seen["A"], seen["B"]], float(fired == key))
                if fired in seen:
                    seen[fired] += 1
        expected = {r[0]: r for r in tree.rules(names, True)}
        assert len(expected) > 1 and {k: (n["feature"], n["threshold"], n["value"], n["n"]) for k, n in got[key].items()} == {k: (r[1], r[2], r[5], r[6]) for k, r in expected.items()}


def test_bins_merge_and_second_trees_take_over():
    rng = random.Random(3)
    tree = hoeffding.HoeffdingTree(1, 1, 500)
    for _ in range(1000):
        x = rng.random()
        tree.learn([x], float(x > 0.7))
    assert tree.root.split[1] == pytest.approx(0.7, abs=0.03)
    beside = 0
    for _ in range(4400):  # the other way round: another tree learns beside before it takes over
        x = rng.random()
        tree.learn([x], float(x < 0.2))
        beside += tree.root.other is not None
    assert beside >= hoeffding.LEAST_ROWS
    assert tree.root.split[1] == pytest.approx(0.2, abs=0.03)
    leaf = hoeffding.HoeffdingTree(1, 3, 10**9)
    for _ in range(5000):
        leaf.learn([rng.random()], 1.0)
    assert len(leaf.root.bins[0]) == hoeffding.BINS and sum(c[0] for c in leaf.root.bins[0].values()) == 5000


def test_wide_features_are_split_at_bins(spark):
    rng = random.Random(4)
    rows = [("k", str(i), 5.0 * (x > 0.61) + 2.0 * (b > 3) + rng.random() / 10, [float(b), x]) for i in range(4000) for b, x in [(rng.randint(0, 6), rng.random())]]
    df = spark.createDataFrame(rows, "key string, row_id string, y double, x array<double>")
    for bins in (32, 512):
        nodes = by_key(trees.fit(df, ["b", "x"], 2, bins=bins)[0].collect())["k"]
        assert nodes[0]["feature"] == "x" and abs(nodes[0]["threshold"] - 0.61) < 1 / 30 and nodes[1]["feature"] == "b" == nodes[2]["feature"] and nodes[1]["threshold"] == 3.5
    with pytest.MonkeyPatch.context() as patch:  # the way for tables that are too large to broadcast
        patch.setattr("procweave.session.BROADCAST_BYTES", 0)
        again = by_key(trees.fit(df, ["b", "x"], 2)[0].collect())["k"]
    assert {k: (n["feature"], n["threshold"], n["n"], round(n["value"], 9)) for k, n in again.items()} == {k: (n["feature"], n["threshold"], n["n"], round(n["value"], 9)) for k, n in nodes.items()}


def test_groups_of_one_value_have_results(spark):
    df = spark.createDataFrame([("one", 4.0)] * 3 + [("two", 1.0), ("two", 3.0)], "k string, v double")
    (r,) = distributions.histogram(df.where("k = 'one'"), "v").collect()
    assert (r["bin"], r["lo"], r["hi"], r["n"], r["density"]) == (0, 4.0, 4.0, 3, None)
    base = distributions.summaries(df, ["k"], "v")
    shown = base.select("k", *[distributions.density(f, distributions.parameters(f), F.lit(2.0)).alias(f) for f in distributions.FAMILIES]).collect()
    one, two = sorted(shown)
    assert one[1:] == (None,) * 5 and two["uniform"] == 0.5 and all(x is not None for x in two[2:])
    assert distributions.histogram(df.where("false"), "v").count() == 0


def test_log_normals_with_a_shift_are_found(spark):
    rng = random.Random(5)
    for shift in (-40.0, 0.0, 25.0):
        rows = [(shift + 10 * 2.718281828 ** rng.gauss(0, 0.7),) for _ in range(4000)]
        fit = distributions.fitted(spark.createDataFrame(rows, "v double"), [], "v").first()["fit"]
        assert fit["dist"] == "lognorm" and fit["params"][1] == pytest.approx(shift, abs=2) and fit["params"][0] == pytest.approx(0.7, abs=0.15)


def test_vocabularies_are_bounded(spark):
    log = spark.range(1200).select(F.col("id").cast("string").alias("order_no"), F.lit("x").alias("kind"))
    assert attributes.vocabulary(log, "kind") == ["x"]
    with pytest.raises(ValueError):
        attributes.vocabulary(log, "order_no")


def test_models_that_choose():
    tree = {0: {"feature": "a", "threshold": 1.5, "yes_id": 1, "no_id": 2, "value": 0.0}, 1: {"feature": None, "value": 0.25}, 2: {"feature": None, "value": 1.0}}
    assert chance({"trees": [tree, tree, {0: {"feature": None, "value": 1.0}}]}, {"a": 1.0}) == pytest.approx(0.5)
    assert chance(lambda x: x["a"] / 4, {"a": 1.0}) == 0.25 and chance(None, {}) == 1.0 and chance(tree, {"a": 2}) == 1.0


def test_cases_on_one_clock_against_a_loop(spark):
    """Waiting depends on the resource's workload, so cases touch; each resource's list is scanned from its end."""
    waits = {0: {"feature": "workload", "threshold": 0.5, "yes_id": 1, "no_id": 2, "value": 0.0}, 1: constant(3.0)[0], 2: constant(11.0)[0]}
    p = SimulatorParameters(petri_net.sequence(["A", "B", "C"]), rules_mode=True, arrival=constant(4.0), execution={a: constant(float(m)) for a, m in (("A", 9), ("B", 5), ("C", 2))}, waiting={"auto": waits}, weights=dict.fromkeys("ABC"))
    got = [(r["case_id"], r["activity"], r["start_ts"], r["end_ts"]) for r in SimulatorEngine(p).apply(spark, 12, START, deterministic_time=True).collect()]
    minute, schedule, out = timedelta(minutes=1), [], []
    heap = [(START + 4 * (k + 1) * minute, k, 0) for k in range(12)]
    heapify(heap)
    while heap:
        at, case, step = heappop(heap)
        load = 0
        for start, end in reversed(schedule):
            if end <= at:
                break
            load += start <= at
        start = at + (0 if step == 0 else 11 if load else 3) * minute
        end = start + (9, 5, 2)[step] * minute
        schedule.append((start, end))
        out.append((f"case_{case + 1}", "ABC"[step], start, end))
        if step < 2:
            heappush(heap, (end, case, step + 1))
    assert sorted(got) == sorted(out) and [r[2:] for r in got] == sorted(r[2:] for r in out)


TRACE = """<log><trace><string key="concept:name" value="10"/><int key="amount" value="7"/><float key="rate" value="0.5"/><boolean key="urgent" value="true"/><date key="due" value="2024-02-01T00:00:00Z"/><string key="o'brien:x" value="q"/>
<event><string key="concept:name" value="A"/><string key="org:resource" value="r"/><date key="start:timestamp" value="2024-01-01T09:00:00+01:00"/><date key="time:timestamp" value="2024-01-01T09:05:00+01:00"/><int key="amount" value="3"/><float key="cost" value="x"/><int key="steps" value="2"/></event>
</trace><trace><string key="concept:name" value="9"/><event><string key="concept:name" value="B"/><date key="time:timestamp" value="2024-07-01T09:05:00{offset}"/><float key="cost" value="1.25"/></event></trace></log>"""


def test_xes_attributes_of_all_kinds(spark, tmp_path):
    (tmp_path / "a.xes").write_text(TRACE.format(offset="+01:00"))
    log = event_log.from_xes(spark, str(tmp_path / "a.xes"))
    kinds = {f.name: f.dataType.simpleString() for f in log.schema}
    assert {k: kinds[k] for k in ("amount", "rate", "urgent", "due", "o'brien_x", "event_amount", "cost", "steps")} == {"amount": "bigint", "rate": "double", "urgent": "boolean", "due": "timestamp_ntz", "o'brien_x": "string", "event_amount": "bigint", "cost": "double", "steps": "bigint"}
    first, second = log.orderBy("case_order").collect()
    assert (first["case_id"], first["amount"], first["rate"], first["urgent"], first["due"], first["event_amount"], first["cost"], first["steps"]) == ("10", 7, 0.5, True, datetime(2024, 2, 1), 3, None, 2)
    assert (second["case_id"], second["cost"], second["amount"], second["start_ts"], second["end_ts"]) == ("9", 1.25, None, None, datetime(2024, 7, 1, 9, 5))
    assert "case_order" not in event_log.attributes(log)


def test_xes_offsets_that_differ_need_a_word(spark, tmp_path):
    (tmp_path / "b.xes").write_text(TRACE.format(offset="+02:00").replace("00:00:00Z", "00:00:00+01:00"))
    with pytest.raises(ValueError):
        event_log.from_xes(spark, str(tmp_path / "b.xes"))
    ends = {o: [r["end_ts"] for r in event_log.from_xes(spark, str(tmp_path / "b.xes"), offsets=o).orderBy("case_order").collect()] for o in ("local", "utc")}
    assert ends == {"local": [datetime(2024, 1, 1, 9, 5), datetime(2024, 7, 1, 9, 5)], "utc": [datetime(2024, 1, 1, 8, 5), datetime(2024, 7, 1, 7, 5)]}


def test_a_file_of_two_nets(tmp_path):
    one = "<net id='{0}'><page><place id='{0}p'><initialMarking><text>1</text></initialMarking></place><place id='{0}q'/><transition id='{0}t'><name><text>T</text></name></transition><arc id='1' source='{0}p' target='{0}t'/><arc id='2' source='{0}t' target='{0}q'/></page></net>"
    (tmp_path / "n.pnml").write_text(f"<pnml>{one.format('a')}{one.format('b')}</pnml>")
    net = petri_net.from_pnml(str(tmp_path / "n.pnml"))
    assert net.places == ["ap", "aq"] and net.initial == {"ap": 1} and net.final == {"aq": 1}


def test_a_cluster_needs_a_shared_folder(spark):
    from procweave.session import shared_dir

    class Conf(dict):
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    assert shared_dir(spark)
    with pytest.raises(ValueError):
        shared_dir(Session())
