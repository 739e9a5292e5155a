"""Simulating new logs from discovered parameters.

Cases touch one another only through the workload. Unless a waiting rule tests it, every case is
simulated by itself, in as many tasks as Spark has; else one task runs all cases on one clock, as an
approximation would change the result. Draws come from a hash of the seed, the case and the draw's
number, so results don't depend on how cases are dealt out."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime
from hashlib import blake2b
from heapq import heappop, heappush
from math import isnan

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procweave.functions.calendars import calendar_frame, move, move_minutes, prefixes
from procweave.functions.rules import leaf_of, tests
from procweave.operators.distributions import drawn, sample
from procweave.operators.logistic import probability
from procweave.operators.windows import running_sum
from procweave.plans.discovery import SimulatorParameters
from procweave.session import Staging

EVENTS = "case_no long, activity string, resource string, enabled_us long, start_us long, end_us long"


def uniform(seed: int, case: int, draw: str) -> float:
    return int.from_bytes(blake2b(f"{seed}|{case}|{draw}".encode(), digest_size=8).digest(), "little") / 2**64


def uniform_column(seed: int, case: Column, draw: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), case, F.lit(draw)), 11) / F.lit(float(2**53))


def is_rules(model: object) -> bool:
    return isinstance(model, dict) and 0 in model


def chance(model: object, features: dict[str, float]) -> float:
    """What a model says of a row of features: rules, a logistic model, the mean of a forest's trees, or a
    function of the features, such as another library's classifier; 1 where there is no model."""
    if isinstance(model, dict) and "coefficients" in model:
        return probability(model, features)
    if isinstance(model, dict) and "trees" in model:
        return sum(chance(tree, features) for tree in model["trees"]) / len(model["trees"])
    if callable(model):
        return float(model(features))
    return float(leaf_of(model, features)[1]["value"]) if is_rules(model) else 1.0


def whole(x: float | None) -> int:
    return 0 if x is None or isnan(x) else int(x)


@dataclass
class Case:
    number: int
    marking: dict[str, int]
    tokens: dict[str, int]
    attributes: dict[str, float]
    history: dict[str, int]
    enabled: dict[str, int] = field(default_factory=dict)
    draws: int = 0


class Walker:
    """The token game of cases, in plain Python: one step of one case at a time."""

    def __init__(self, p: SimulatorParameters, deterministic: bool, seed: int):
        self.net, self.deterministic, self.seed = p.net, deterministic, seed
        self.rules_mode, self.weights, self.execution, self.waiting = p.rules_mode, p.weights, p.execution, p.waiting
        self.act_resource, self.resources = p.act_resource, p.resources
        self.calendars = {r: prefixes(s) for r, s in p.calendars.items()}
        self.schedule: dict[str, list[tuple[int, int]]] = {}

    def begin(self, number: int, arrival: int, attributes: dict[str, float]) -> Case:
        case = Case(number, dict(self.net.initial), dict.fromkeys(self.net.initial, arrival), attributes, dict.fromkeys(self.net.labels, 0))
        self._enable(case, arrival)
        return case

    def _enable(self, case: Case, now: int) -> None:
        case.enabled = {t: max((case.tokens[p] for p in self.net.inputs[t]), default=now) for t in self.net.enabled(case.marking)}

    def _u(self, case: Case) -> float:
        case.draws += 1
        return uniform(self.seed, case.number, str(case.draws))

    def _pick(self, case: Case, weights: list[tuple[str, float]]) -> str:
        target, so_far = self._u(case) * sum(w for _, w in weights), 0.0
        for name, w in weights:
            so_far += w
            if target <= so_far:
                return name
        return weights[-1][0]

    def _weight(self, transition: str, features: dict[str, float]) -> float:
        model = self.weights.get(transition)
        return chance(model, features) if self.rules_mode else float(model or 0.0)

    def _time(self, case: Case, model: dict, features: dict[str, float]) -> int:
        u = self._u(case)
        if is_rules(model):
            leaf = leaf_of(model, features)[1]
            if self.deterministic or leaf.get("dist") is None:
                return whole(leaf["value"])
            return whole(sample(leaf["dist"], leaf["params"], leaf["min"], leaf["max"], leaf["value"], u))
        if self.deterministic:
            return whole(model["mean"])
        return whole(sample(model["dist"], model["params"], model["min"], model["max"], model["mean"], u))

    def workload(self, resource: str, at: int) -> int:
        """Events of the resource that hold the time, scanned from the last one until one that has ended."""
        count = 0
        for start, end in reversed(self.schedule.get(resource, [])):
            if end <= at:
                break
            count += start <= at
        return count

    def step(self, case: Case, watch: bool) -> tuple | None:
        """Fires one transition; gives the event if it has a label."""
        own = case.attributes | case.history
        t = self._pick(case, [(x, self._weight(x, own)) for x in sorted(case.enabled)])
        enabled, label, event = case.enabled[t], self.net.transitions[t], None
        end = enabled
        if label is not None:
            resource = self._pick(case, sorted(self.act_resource[label].items()))
            wait = 0
            if sum(case.history.values()):
                wait = self._time(case, self.waiting[resource], ({"workload": self.workload(resource, enabled)} if watch else {}) | own)
            start = move(enabled, wait, self.calendars[resource])
            took = self._time(case, self.execution[label], {f"resource = {resource}": 1} | own)
            end = move(start, took, self.calendars[resource])
            event = (case.number, label, resource, enabled, start, end)
            if watch:
                self.schedule.setdefault(resource, []).append((start, end))
            case.history[label] += 1
        case.marking = self.net.fire(case.marking, t)
        for p in self.net.outputs[t]:
            case.tokens[p] = end
        case.enabled = {}
        if case.marking != self.net.final:
            self._enable(case, end)
        return event

    def apart(self, cases: Iterator[Case]) -> Iterator[tuple]:
        for case in cases:
            while case.enabled:
                if event := self.step(case, False):
                    yield event

    def together(self, cases: Iterator[Case]) -> Iterator[tuple]:
        """All cases on one clock, the one that may go on first before the others."""
        every = {c.number: c for c in cases}
        heap: list[tuple[int, int]] = []
        for c in every.values():
            if c.enabled:
                heappush(heap, (min(c.enabled.values()), c.number))
        while heap:
            case = every[heappop(heap)[1]]
            if event := self.step(case, True):
                yield event
            if case.enabled:
                heappush(heap, (min(case.enabled.values()), case.number))


class SimulatorEngine:
    def __init__(self, parameters: SimulatorParameters):
        self.parameters = parameters

    @property
    def coupled(self) -> bool:
        return self.parameters.rules_mode and any(is_rules(m) and tests(m, "workload") for m in self.parameters.waiting.values())

    def arrivals(self, spark: SparkSession, n_traces: int, t_start: datetime, deterministic: bool, seed: int) -> DataFrame:
        """(case_no, arrival_us). Moves along a calendar add up, so without rules the clock is one running sum."""
        p = self.parameters
        start = F.lit(t_start.replace(tzinfo=None)).cast("timestamp_ntz")
        if not is_rules(p.arrival):
            fit = F.struct(F.lit(p.arrival["dist"]).alias("dist"), F.array(*[F.lit(float(x)) for x in p.arrival["params"]]).alias("params"), *[F.lit(float(p.arrival[k])).alias(k) for k in ("min", "max", "mean")])
            ids = spark.range(n_traces).withColumnRenamed("id", "case_no")
            delta = F.lit(float(p.arrival["mean"])) if deterministic else drawn(fit, uniform_column(seed, F.col("case_no"), "arrival"))
            ids = ids.withColumn("delta", F.when(delta == 0, F.lit(1)).otherwise(delta.cast("bigint")))
            summed = running_sum(ids, "delta", [], F.floor(F.col("case_no") / 10_000), ["case_no"], "minutes")
            held = summed.crossJoin(F.broadcast(calendar_frame(spark, {"": p.arrival_calendar})))  # one row
            moved = move_minutes(start, F.col("minutes"), F.col("opened"), F.col("open"), F.col("open_slots"))
            return held.select("case_no", F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), moved).alias("arrival_us"))
        model, calendar = p.arrival, prefixes(p.arrival_calendar)
        first = int((t_start.replace(tzinfo=None) - datetime(1970, 1, 1)).total_seconds() * 1_000_000)

        def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now = first
            for batch in batches:
                out = []
                for number in batch["id"].tolist():
                    hour = now // 3_600_000_000
                    leaf = leaf_of(model, {"hour": hour % 24, "weekday": (hour // 24 + 3) % 7})[1]
                    if deterministic or leaf.get("dist") is None:
                        delta = leaf["value"]
                    else:
                        delta = sample(leaf["dist"], leaf["params"], leaf["min"], leaf["max"], leaf["value"], uniform(seed, number, "arrival"))
                    now = move(now, 1 if delta == 0 else whole(delta), calendar)
                    out.append((number, now))
                yield pd.DataFrame(out, columns=["case_no", "arrival_us"])

        # each arrival depends on the one before: one task, a row a case
        return spark.range(0, n_traces, 1, 1).mapInPandas(walk, "case_no long, arrival_us long")

    def apply(self, spark: SparkSession, n_traces: int, t_start: datetime, deterministic_time: bool = False, seed: int = 0) -> DataFrame:
        """A simulated log: case_id, activity, resource, enabled_ts, start_ts, end_ts and the attributes, by start and end.

        A case that comes to a dead end keeps the events it had."""
        p, coupled = self.parameters, self.coupled
        cases = self.arrivals(spark, n_traces, t_start, deterministic_time, seed)
        if p.attribute_rows is not None:
            j = F.floor(uniform_column(seed, F.col("case_no"), "attributes") * p.attribute_count)
            cases = cases.withColumn("j", F.least(j, F.lit(p.attribute_count - 1))).join(p.attribute_rows, "j").drop("j")
        if p.attribute_rows is not None or is_rules(p.arrival):
            cases = Staging(spark, "simulation").write(cases, "cases")  # read twice below
        names, values = p.attributes if p.attribute_rows is not None else [], p.values
        plain = SimulatorParameters(p.net, rules_mode=p.rules_mode, weights=p.weights, resources=p.resources, act_resource=p.act_resource, calendars=p.calendars, execution=p.execution, waiting=p.waiting)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            walker = Walker(plain, deterministic_time, seed)

            def begun() -> Iterator[Case]:
                for batch in batches:
                    for row in batch.to_dict("records"):
                        own: dict[str, float] = {}
                        for a in names:
                            if a in values:
                                own |= {f"{a} = {v}": int(row[a] == v) for v in values[a]}
                            else:
                                own[a] = row[a]
                        yield walker.begin(int(row["case_no"]), int(row["arrival_us"]), own)

            out: list[tuple] = []
            for event in walker.together(begun()) if coupled else walker.apart(begun()):
                out.append(event)
                if len(out) >= 10_000:
                    yield pd.DataFrame(out, columns=[x.split()[0] for x in EVENTS.split(", ")])
                    out = []
            yield pd.DataFrame(out, columns=[x.split()[0] for x in EVENTS.split(", ")])

        dealt = cases.coalesce(1).sortWithinPartitions("case_no") if coupled else cases.repartition("case_no")
        events = dealt.mapInPandas(run, EVENTS)
        if names:
            events = events.join(cases.select("case_no", *names), "case_no")
        ts = lambda c: F.timestamp_add("MICROSECOND", F.col(c), F.lit("1970-01-01").cast("timestamp_ntz"))
        return events.select(
            F.concat(F.lit("case_"), (F.col("case_no") + 1).cast("string")).alias("case_id"), "activity", "resource",
            ts("enabled_us").alias("enabled_ts"), ts("start_us").alias("start_ts"), ts("end_us").alias("end_ts"), *names,
        ).orderBy("start_ts", "end_ts", "case_id", "activity")
