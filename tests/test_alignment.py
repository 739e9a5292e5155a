import random
from datetime import datetime, timedelta

import pytest

from procweave.operators import alignment, control_flow, features
from procweave.sources import petri_net
from procweave.sources.petri_net import net

T0 = datetime(2024, 1, 1)
XOR = net([("A", "A", ["src"], ["p1"]), ("B", "B", ["p1"], ["snk"]), ("C", "C", ["p1"], ["snk"])], "src", "snk")
AND = net([("A", "A", ["src"], ["p1", "p2"]), ("B", "B", ["p1"], ["p3"]), ("C", "C", ["p2"], ["p4"]), ("D", "D", ["p3", "p4"], ["snk"])], "src", "snk")
LOOP = net([("A", "A", ["src"], ["p1"]), ("R", "R", ["p1"], ["src"]), ("B", "B", ["p1"], ["snk"])], "src", "snk")
SKIP = net([("A", "A", ["src"], ["p1"]), ("B", "B", ["p1"], ["p2"]), ("tau", None, ["p1"], ["p2"]), ("C", "C", ["p2"], ["snk"])], "src", "snk")
SEQ = petri_net.sequence(["A", "B", "C"])


def log(spark, *sequences):
    rows = []
    for c, s in enumerate(sequences):
        for i, a in enumerate(s):
            rows.append((f"c{c}", i, a, "r", T0 + timedelta(days=c, minutes=10 * i), T0 + timedelta(days=c, minutes=10 * i + 5)))
    return spark.createDataFrame(rows, "case_id string, event_idx int, activity string, resource string, start_ts timestamp_ntz, end_ts timestamp_ntz")


def weights(spark, model, *sequences):
    return {r[0]: r[1] for r in control_flow.frequency_weights(alignment.aligned(alignment.log_variants(log(spark, *sequences)), model)).collect()}


def test_weights_of_small_nets(spark):
    assert weights(spark, SEQ, "ABC", "ABC", "ABC") == {"A": 1, "B": 1, "C": 1}
    assert weights(spark, XOR, "AB", "AB", "AB", "AC") == {"A": 1, "B": 0.75, "C": 0.25}
    got = weights(spark, AND, "ABCD", "ACBD")
    assert got == pytest.approx({"A": 1, "B": 2 / 3, "C": 2 / 3, "D": 1})
    assert weights(spark, LOOP, "ARAB") == {"A": 1, "R": 0.5, "B": 0.5}
    assert weights(spark, SKIP, "ABC", "AC") == {"A": 1, "B": 0.5, "tau": 0.5, "C": 1}


def test_sticky_enabling_time(spark):
    steps = alignment.stepped(log(spark, "ARAB"), LOOP).orderBy("step_idx").collect()
    assert steps[3]["enabled_ts"] == T0 + timedelta(minutes=5)  # the end of the first A


def test_moves(spark):
    cost, moves = alignment.align(SEQ, list("AC"))
    assert cost // alignment.MOVE == 1 and moves == [("A", 0), ("B", None), ("C", 1)]
    rows = features.history(alignment.stepped(log(spark, "AC"), SEQ), SEQ.labels, ["step_idx"]).orderBy("step_idx").collect()
    assert rows[1]["resource"] is None and rows[1]["start_ts"] is None and (rows[2]["A"], rows[2]["B"], rows[2]["C"]) == (1, 1, 0)
    cost, moves = alignment.align(SEQ, list("AXBC"))
    assert cost // alignment.MOVE == 1 and moves == [("A", 0), (None, 1), ("B", 2), ("C", 3)]
    rows = alignment.stepped(log(spark, "AXBC"), SEQ).orderBy("step_idx").collect()
    assert [r["log_idx"] for r in rows] == [0, 2, 3]
    tau = [r for r in alignment.stepped(log(spark, "AC"), SKIP).collect() if r["transition"] == "tau"][0]
    assert tau["label"] is None and tau["resource"] is None and tau["start_ts"] is None


def test_costs_against_edit_distance():
    rng = random.Random(2)
    for _ in range(200):
        s = [rng.choice("ABCX") for _ in range(rng.randint(0, 7))]
        table = [[0] * 4 for _ in range(len(s) + 1)]
        for i in range(len(s) + 1):
            for j in range(4):
                options = [table[i - 1][j] + 1] if i else []
                options += [table[i][j - 1] + 1] if j else []
                options += [table[i - 1][j - 1]] if i and j and s[i - 1] == "ABC"[j - 1] else []
                table[i][j] = min(options, default=0)
        assert alignment.align(SEQ, s)[0] == table[len(s)][3] * alignment.MOVE


def test_unreachable_and_limits():
    stuck = net([("A", "A", ["src"], ["p"])], "src", "snk")
    with pytest.raises(ValueError):
        alignment.align(stuck, ["A"])
    with pytest.raises(ValueError):
        alignment.align(SEQ, list("ABC" * 5), limit=3)


def test_frequency_counts_model_moves_and_zeros(spark):
    got = {r[0]: r[1] for r in alignment.transition_frequency(log(spark, "AB", "AB"), XOR).collect()}
    assert got == {"A": 2, "B": 2, "C": 0}


def test_feature_table_columns(spark):
    table = alignment.feature_table(log(spark, "ABC", "AC"), SEQ)
    assert {"A", "B", "C", "workload", "prev_enabled", "enabled_ts"} <= set(table.columns)
    assert table.count() == 6 and table.where("resource is null and workload is null").count() == 1


def test_workload_against_all_pairs(spark):
    rng = random.Random(5)
    rows = []
    for i in range(120):
        a = T0 + timedelta(minutes=rng.randrange(0, 600, 5))
        rows.append((i, rng.choice(["x", "y", None]), a, a + timedelta(minutes=rng.randrange(0, 300, 5)), T0 + timedelta(minutes=rng.randrange(0, 700, 5))))
    df = spark.createDataFrame(rows, "event_id long, resource string, start_ts timestamp_ntz, end_ts timestamp_ntz, at_ts timestamp_ntz")
    got = {r[0]: r[1] for r in features.workload(df, df, "at_ts").collect()}
    assert got == {i: sum(r is not None and q[1] == r and q[3] > at and q[2] < at and q[2] < q[3] for q in rows) for i, r, _, _, at in rows}


PNML = """<?xml version="1.0"?><pnml xmlns="http://www.pnml.org/version-2009/grammar/pnml"><net id="n"><page id="g">
<place id="a"><initialMarking><text>1</text></initialMarking></place><place id="b"><name><text>mid</text></name></place><place id="c"/>
<transition id="t1"><name><text>Work</text></name></transition>
<transition id="t2"><name><text>skip</text></name><toolspecific tool="x" version="1" activity="$invisible$"/></transition>
<arc id="1" source="a" target="t1"/><arc id="2" source="t1" target="b"><inscription><text>2</text></inscription></arc>
<arc id="3" source="b" target="t2"><inscription><text>2</text></inscription></arc><arc id="4" source="t2" target="c"/></page>
<finalmarkings><marking><place idref="c"><text>1</text></place></marking></finalmarkings></net></pnml>"""


def test_pnml(spark, tmp_path):
    (tmp_path / "n.pnml").write_text(PNML)
    n = petri_net.from_pnml(str(tmp_path / "n.pnml"))
    assert n.transitions == {"t1": "Work", "t2": None} and (n.initial, n.final) == ({"a": 1}, {"c": 1})
    assert n.outputs["t1"] == {"b": 2} and n.enabled(n.fire(n.initial, "t1")) == ["t2"] and n.enabled({"b": 1}) == []
    assert [f.count() for f in n.frames(spark)] == [3, 2, 4]
    assert alignment.align(n, ["Work"])[0] == alignment.SILENT
