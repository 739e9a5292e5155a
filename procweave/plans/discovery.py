"""Discovering a simulation's parameters from an event log and a net."""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procweave.functions.calendars import WEEK_SLOTS, calendar_frame
from procweave.functions.rules import by_key
from procweave.operators import alignment, calendars, control_flow, distributions, durations, hoeffding, logistic, resources, trees
from procweave.operators.attributes import vocabulary
from procweave.operators.windows import running_sum
from procweave.session import Staging
from procweave.sources.event_log import attributes, categorical, validated
from procweave.sources.petri_net import Marking, Net

LOGGER = logging.getLogger("procweave")
ONE = {"dist": "fixed", "params": [1.0], "min": 1.0, "max": 1.0, "mean": 1.0}
NOTHING = {"dist": "fixed", "params": [0.0], "min": 0.0, "max": 0.0, "mean": 0.0}


#: What is saved of parameters and of their net.
SAVED = ("rules_mode", "weights", "resources", "act_resource", "calendars", "arrival_calendar", "arrival", "execution", "waiting", "attributes", "values", "attribute_count")
NET = ("places", "transitions", "inputs", "outputs", "initial", "final")


def _numbered(read: dict) -> dict:
    """JSON has text for the numbers of rules' nodes."""
    return {int(k): v for k, v in read.items()} if read and all(k.isdecimal() and isinstance(v, dict) and "feature" in v for k, v in read.items()) else read


@dataclass
class SimulatorParameters:
    """What a simulation needs, with defaults: even choices, one resource, always open, a minute for all.

    Models of times are a distribution (a dict like ONE), or rules: nodes by number whose leaves
    have a value and a distribution. Weights are numbers, or rules or logistic models in rules mode; a
    transition without weighs 1 there. attribute_rows: a table (j, attributes...) of the cases to draw
    attributes from, j from 0; None without attributes."""

    net: Net
    initial_marking: Marking | None = None
    final_marking: Marking | None = None
    rules_mode: bool = False
    weights: dict = field(default_factory=dict)
    resources: list[str] = field(default_factory=lambda: ["auto"])
    act_resource: dict[str, dict[str, float]] = field(default_factory=dict)
    calendars: dict[str, list[bool]] = field(default_factory=dict)
    arrival_calendar: list[bool] = field(default_factory=lambda: [True] * WEEK_SLOTS)
    arrival: dict = field(default_factory=lambda: dict(ONE))
    execution: dict[str, dict] = field(default_factory=dict)
    waiting: dict[str, dict] = field(default_factory=dict)
    attributes: list[str] = field(default_factory=list)
    values: dict[str, list[str]] = field(default_factory=dict)
    attribute_rows: DataFrame | None = None
    attribute_count: int = 0

    def __post_init__(self) -> None:
        self.net.initial = self.initial_marking or self.net.initial
        self.net.final = self.final_marking or self.net.final
        for t in self.net.transitions:
            self.weights.setdefault(t, 1.0)
        for r in self.resources:
            self.calendars.setdefault(r, [True] * WEEK_SLOTS)
            self.waiting.setdefault(r, dict(ONE))
        for a in self.net.labels:
            self.act_resource.setdefault(a, {r: 1 / len(self.resources) for r in self.resources})
            self.execution.setdefault(a, dict(ONE))

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes everything to a folder, for load(). Choices that are functions can't be written."""
        if any(map(callable, self.weights.values())):
            raise ValueError("functions can't be saved")
        shown = {k: getattr(self, k) for k in SAVED} | {"net": {k: getattr(self.net, k) for k in NET}}
        spark.createDataFrame([(json.dumps(shown),)], "value string").coalesce(1).write.text(f"{path}/parameters")
        if self.attribute_rows is not None:
            self.attribute_rows.write.parquet(f"{path}/attributes")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SimulatorParameters:
        """What save() wrote."""
        shown = json.loads(spark.read.text(f"{path}/parameters").first()["value"], object_hook=_numbered)
        made = cls(Net(**shown.pop("net")), **shown)
        if made.attribute_count:
            made.attribute_rows = spark.read.parquet(f"{path}/attributes")
        return made

    def discover_from_eventlog(self, log: DataFrame, max_depth_tree: int = 3, incremental_discovery: bool = False, grace_period: int = 1000, verbose: bool = True, model_type: str = "DecisionTree") -> SimulatorParameters:
        """Learns everything from a log. max_depth_tree < 1: frequencies and one distribution a key.

        model_type: of the transitions' weights in rules mode, DecisionTree or LogisticRegression. verbose: whether
        the steps are logged. What reaches the driver has a row a transition, a resource, a calendar hour or a tree node."""
        say = LOGGER.info if verbose else LOGGER.debug
        if incremental_discovery and max_depth_tree < 1:
            raise ValueError("incremental discovery makes rules: max_depth_tree must be at least 1")
        if model_type not in ("DecisionTree", "LogisticRegression"):
            raise ValueError(f"unknown model type {model_type}")
        staging = Staging(log.sparkSession, "discovery")
        log = staging.write(validated(log), "log")  # read by every step below
        self.rules_mode = max_depth_tree >= 1
        self._attributes(log, staging)
        numeric = [a for a in self.attributes if a not in self.values]
        say("aligning cases with the net")
        steps = staging.write(alignment.feature_table(log, self.net), "features")
        say("learning the control flow")
        self._control_flow(log, steps, staging, numeric, max_depth_tree, incremental_discovery, grace_period, model_type)
        say("learning resources and calendars")
        kept = staging.write(resources.retained(log), "resources")
        self.resources = [r["resource"] for r in kept.collect()]
        if not self.resources:
            raise ValueError("one resource does more than 95 % of the work, so none is retained")
        self.act_resource = {}
        for r in resources.activity_resources(log, kept).collect():
            self.act_resource.setdefault(r["activity"], {})[r["resource"]] = r["prob"]
        self.calendars = calendars.slots(calendars.resource_calendars(log, kept), ["resource"])
        self.arrival_calendar = calendars.slots(calendars.arrival_calendar(log), [])[""]
        frame = calendar_frame(log.sparkSession, self.calendars)
        say("learning times")
        self._times(log, steps, frame, numeric, max_depth_tree, incremental_discovery, grace_period)
        self.__post_init__()
        return self

    def _attributes(self, log: DataFrame, staging: Staging) -> None:
        self.attributes = [a for a in attributes(log) if a != "event_id"]
        self.values = {a: vocabulary(log, a) for a in categorical(log) if a in self.attributes}
        if self.attributes:
            first = log.where("event_idx = 0").select("case_id", *self.attributes, F.lit(1).alias("one"))
            block = F.pmod(F.xxhash64(F.col("case_id").cast("string")), F.lit(4096))
            placed = running_sum(first, "one", [], block, ["case_id"], "j", frame_end=-1)
            self.attribute_rows = staging.write(placed.select(F.col("j").cast("long").alias("j"), *self.attributes), "attributes")
            self.attribute_count = self.attribute_rows.count()

    def _control_flow(self, log: DataFrame, steps: DataFrame, staging: Staging, numeric: list[str], depth: int, incremental: bool, grace: int, model_type: str) -> None:
        never = {t: 0.0 for t in self.net.transitions}
        if depth < 1:
            per_variant = alignment.aligned(alignment.log_variants(log), self.net)
            self.weights = never | {r["transition"]: r["weight"] for r in control_flow.frequency_weights(per_variant).collect()}
            return
        rows, names = control_flow.training_rows(steps, self.net.labels, numeric, self.values)
        both = rows.groupBy("key").agg(F.min("y").alias("lo"), F.max("y").alias("hi")).where("lo < hi").select("key")
        by_logistic = model_type == "LogisticRegression" and not incremental
        # a logistic model reads its own rows alone
        rows = staging.write(rows.join(both, "key", "left_semi"), "choices", ["key"] if by_logistic else None)
        if by_logistic:
            self.weights = {t: None for t in never} | logistic.fit(rows, names)
            return
        if incremental:
            rules = hoeffding.folded(rows, names, depth, grace, classes=True)
        else:
            rules = trees.fit(rows, names, depth, classes=True)[0]
        # a transition never tried, and one that always or never fired, weighs 1 in rules mode
        self.weights = {t: None for t in never} | by_key(rules.collect())

    def _times(self, log: DataFrame, steps: DataFrame, frame: DataFrame, numeric: list[str], depth: int, incremental: bool, grace: int) -> None:
        spark, history = log.sparkSession, self.net.labels
        real = steps.where("start_ts is not null")
        busy = durations.timed(real, frame, "start_ts", "end_ts", "minutes")
        waits = durations.timed(real, frame, "enabled_ts", "start_ts", "minutes")
        arrived = durations.arrivals(log, calendar_frame(spark, {"": self.arrival_calendar}))
        if depth < 1:
            # all three kinds in one pass
            rows = busy.select(F.lit("execution").alias("kind"), F.col("label").alias("key"), "minutes")
            rows = rows.unionAll(waits.select(F.lit("waiting"), "resource", "minutes")).unionAll(arrived.select(F.lit("arrival"), F.lit(""), "minutes"))
            fits: dict[str, dict] = {"execution": {}, "waiting": {}, "arrival": {}}
            for r in distributions.fitted(rows, ["kind", "key"], "minutes").collect():
                fits[r["kind"]][r["key"]] = r["fit"].asDict(recursive=True)
            self.execution = dict.fromkeys(history, NOTHING) | fits["execution"]
            self.waiting = dict.fromkeys(self.resources, NOTHING) | fits["waiting"]
            self.arrival = fits["arrival"].get("", NOTHING)
            return
        rows, names = durations.training_rows(busy, "label", "minutes", numeric, self.values, history, resources=self.resources)
        zero = {0: {"feature": None, "value": 0.0, **NOTHING}}
        self.execution = dict.fromkeys(history, zero) | self._rules(rows, names, depth, incremental, grace)
        rows, names = durations.training_rows(waits, "resource", "minutes", numeric, self.values, history)
        self.waiting = dict.fromkeys(self.resources, zero) | self._rules(rows, names, depth, incremental, grace)
        x = F.array(F.col("hour").cast("double"), F.col("weekday").cast("double"))
        rows = arrived.select(F.lit("").alias("key"), F.col("case_id").cast("string").alias("row_id"), F.struct("start_ts", "case_id").alias("ord"), F.col("minutes").alias("y"), x.alias("x"))
        self.arrival = self._rules(rows, ["hour", "weekday"], depth, incremental, grace).get("", zero)

    @staticmethod
    def _rules(rows: DataFrame, names: list[str], depth: int, incremental: bool, grace: int) -> dict[str, dict]:
        """Rules by key, whose leaves have a distribution."""
        if incremental:
            return by_key(hoeffding.folded(rows, names, depth, grace).collect())
        rules, leaves = trees.fit(rows, names, depth)
        fits = distributions.fitted(leaves, ["key", "leaf"], "y").select("key", F.col("leaf").alias("node_id"), "fit.dist", "fit.params", "fit.min", "fit.max")
        return by_key(rules.join(fits, ["key", "node_id"], "left").collect())
