from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from procweave.functions.rules import constant
from procweave.operators import alignment, control_flow, resources
from procweave.plans.discovery import SimulatorParameters
from procweave.plans.simulation import SimulatorEngine
from procweave.sources import event_log
from procweave.sources.petri_net import flower, net, sequence

START = datetime(2024, 3, 4, 9)
TABLES = "/root/testdata/sf0.001"


def fixed(x):
    return {"dist": "fixed", "params": [x], "min": x, "max": x, "mean": x}


@pytest.fixture(scope="module")
def learned(spark):
    log = event_log.from_tables(spark, TABLES).drop("event_id")
    labels = [r[0] for r in log.select("activity").distinct().orderBy("activity").collect()]
    return log, labels, SimulatorParameters(flower(labels)).discover_from_eventlog(log, max_depth_tree=0)


def test_deterministic_sequence(spark):
    p = SimulatorParameters(sequence(["A", "B", "C"]), arrival=fixed(10.0), execution=dict.fromkeys("ABC", fixed(5.0)), waiting={"auto": fixed(2.0)})
    rows = SimulatorEngine(p).apply(spark, 3, START, deterministic_time=True).collect()
    at = lambda i, m: START + timedelta(minutes=10 * (i + 1) + m)
    expected = [(f"case_{i + 1}", a, "auto", at(i, e), at(i, s), at(i, t)) for i in range(3) for a, e, s, t in (("A", 0, 0, 5), ("B", 5, 7, 12), ("C", 12, 14, 19))]
    assert sorted(map(tuple, rows)) == sorted(expected)
    assert [tuple(r)[4:6] for r in rows] == sorted(tuple(r)[4:6] for r in rows)


def test_defaults_and_dead_ends(spark):
    dead = net([("A", "A", ["src"], ["p"]), ("B", "B", ["p", "q"], ["snk"])], "src", "snk")
    assert SimulatorEngine(SimulatorParameters(dead)).apply(spark, 2, START).count() == 2
    assert SimulatorEngine(SimulatorParameters(sequence(["A"]))).apply(spark, 0, START).count() == 0


def test_what_was_learned_comes_back(spark, learned):
    log, labels, p = learned
    simulated = SimulatorEngine(p).apply(spark, 1500, START, seed=3)
    assert set(simulated.columns) >= {"case_id", "activity", "resource", "enabled_ts", "start_ts", "end_ts", "segment", "nation"}
    again = event_log.indexed(simulated, "start_ts", "end_ts", "activity").cache()
    assert again.where("start_ts < enabled_ts or end_ts < start_ts").count() == 0
    weights = {r[0]: r[1] for r in control_flow.frequency_weights(alignment.aligned(alignment.log_variants(again), p.net)).collect()}
    # cases that end at once leave no event, so the silent end's weight is lower than it was learned
    for t in labels:
        assert weights[t] / sum(weights[x] for x in labels) == pytest.approx(p.weights[t] / sum(p.weights[x] for x in labels), abs=0.03)
    costs = alignment.aligned(alignment.variants(alignment.cases(again)), p.net)
    assert costs.where("cost > 0").count() == 0
    share = {r[0]: r[1] for r in resources.shares(again).collect()}
    total = log.join(spark.createDataFrame([(r,) for r in p.resources], "resource string"), "resource").count()
    for r in resources.value_counts(log, "resource").collect():
        if r[0] in p.resources:
            assert share[r[0]] == pytest.approx(r[1] / total, abs=0.05)


def test_results_do_not_depend_on_partitions(spark, learned):
    p = learned[2]
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    one = SimulatorEngine(p).apply(spark, 60, START, seed=5).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    two = SimulatorEngine(p).apply(spark, 60, START, seed=5).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert one == two and one != SimulatorEngine(p).apply(spark, 60, START, seed=6).collect()


def test_rules_mode_and_coupling(spark, learned):
    log, labels, _ = learned
    p = SimulatorParameters(flower(labels)).discover_from_eventlog(log, max_depth_tree=2)
    assert p.rules_mode and all(p.weights[x][0]["value"] <= 1 for x in labels) and p.weights["tau_in"] is None
    engine = SimulatorEngine(p)
    n = engine.apply(spark, 40, START, seed=1).count()
    assert n >= 10
    waits = {0: {"feature": "workload", "threshold": 0.5, "yes_id": 1, "no_id": 2, "value": 0.0}, 1: constant(3.0)[0], 2: constant(30.0)[0]}
    q = SimulatorParameters(sequence(["A", "B"]), rules_mode=True, arrival=constant(1.0), execution={"A": constant(9.0), "B": constant(9.0)}, waiting={"auto": waits}, weights={"A": None, "B": None})
    engine = SimulatorEngine(q)
    assert engine.coupled
    out = engine.apply(spark, 4, START, deterministic_time=True).where("activity = 'B'").select(F.timestamp_diff("MINUTE", "enabled_ts", "start_ts").alias("m")).collect()
    assert {r["m"] for r in out} <= {3, 30} and 30 in {r["m"] for r in out}


def test_parameters_are_kept_and_loaded(spark, learned, tmp_path):
    log, labels, p = learned
    for k, own in enumerate((p, SimulatorParameters(flower(labels)).discover_from_eventlog(log, max_depth_tree=1))):
        own.save(spark, f"{tmp_path}/{k}")
        again = SimulatorParameters.load(spark, f"{tmp_path}/{k}")
        assert SimulatorEngine(again).apply(spark, 25, START, seed=2).collect() == SimulatorEngine(own).apply(spark, 25, START, seed=2).collect()
    with pytest.raises(ValueError):
        replace(p, weights=dict(p.weights, click=lambda x: 1.0)).save(spark, f"{tmp_path}/f")


def test_logistic_mode(spark, learned):
    log, labels, _ = learned
    p = SimulatorParameters(flower(labels)).discover_from_eventlog(log, max_depth_tree=1, model_type="LogisticRegression")
    assert "coefficients" in p.weights[labels[0]] and SimulatorEngine(p).apply(spark, 10, START).count() >= 0
    with pytest.raises(ValueError):
        SimulatorParameters(flower(labels)).discover_from_eventlog(log, model_type="other")


def test_incremental_mode(spark, learned):
    log, labels, _ = learned
    p = SimulatorParameters(flower(labels)).discover_from_eventlog(log, max_depth_tree=2, incremental_discovery=True, grace_period=200)
    assert SimulatorEngine(p).apply(spark, 20, START).count() > 0
    with pytest.raises(ValueError):
        SimulatorParameters(flower(labels)).discover_from_eventlog(log, max_depth_tree=0, incremental_discovery=True)


def test_a_dominant_resource_is_an_error(spark):
    rows = [(f"c{i}", 0, "A", "boss", START + timedelta(hours=i), START + timedelta(hours=i, minutes=5)) for i in range(5)]
    log = spark.createDataFrame(rows, "case_id string, event_idx int, activity string, resource string, start_ts timestamp_ntz, end_ts timestamp_ntz")
    assert resources.retained(log).count() == 0
    with pytest.raises(ValueError):
        SimulatorParameters(sequence(["A"])).discover_from_eventlog(log, max_depth_tree=0)


XES = """<log><trace><string key="concept:name" value="k1"/><string key="kind" value="gold"/>
<event><string key="concept:name" value="A"/><string key="org:resource" value="r"/><date key="start:timestamp" value="2024-01-01T09:00:00.000+00:00"/><date key="time:timestamp" value="2024-01-01T09:05:00.500+00:00"/></event>
<event><string key="concept:name" value="B"/><string key="org:resource" value="s"/><date key="start:timestamp" value="2024-01-01T10:00:00Z"/><date key="time:timestamp" value="2024-01-01T10:05:00Z"/></event></trace>
<trace><string key="concept:name" value="k2"/><event><string key="concept:name" value="A"/></event></trace></log>"""


def test_xes(spark, tmp_path):
    (tmp_path / "a.xes").write_text(XES)
    rows = {(r["case_id"], r["event_idx"]): r for r in event_log.from_xes(spark, str(tmp_path / "a.xes")).collect()}
    assert set(rows) == {("k1", 0), ("k1", 1), ("k2", 0)}
    first = rows["k1", 0]
    assert (first["activity"], first["resource"], first["kind"]) == ("A", "r", "gold") and first["end_ts"] == datetime(2024, 1, 1, 9, 5, 0, 500_000)
    assert rows["k2", 0]["start_ts"] is None


def test_logs_are_checked(spark):
    with pytest.raises(ValueError):
        event_log.validated(spark.createDataFrame([(1,)], "case_id long"))
