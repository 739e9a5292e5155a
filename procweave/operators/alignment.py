"""Alignments of cases with a net, and the table of their steps with what each step knew.

Cost follows distinct sequences: cases with the same activities share a variant, each variant is
aligned once, and the steps are joined back. The search is A* on pairs of a marking and a place in
the sequence; a log move or a visible model move costs 10000, a silent one 1, a synchronous one
nothing; the activities left that the net doesn't know are a lower bound. Ties prefer synchronous
moves, then the transition's name, so the result is unique."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procweave.operators.features import history, workload
from procweave.sources.event_log import CASE_ORDER, attributes
from procweave.sources.petri_net import Net

MOVE, SILENT = 10_000, 1

STEPS = "array<struct<step_idx:int,transition:string,label:string,log_idx:int,prev_enabled:array<string>,since:int>>"


def align(net: Net, sequence: list[str], limit: int | None = None) -> tuple[int, list[tuple[str | None, int | None]]]:
    """(cost, moves): moves are (transition or None, place in the sequence or None), in order.

    The search is exact and goes on until it ends: it keeps the states that it has expanded, of which there
    are at most the net's markings by the sequence's length. Raises ValueError if the final marking can't be
    reached, or, where a caller gives a limit, after that many states."""
    known = set(net.labels)
    unknown = [0] * (len(sequence) + 1)
    for k in range(len(sequence) - 1, -1, -1):
        unknown[k] = unknown[k + 1] + (MOVE if sequence[k] not in known else 0)
    freeze = lambda m: tuple(sorted(m.items()))
    start, goal = (freeze(net.initial), 0), (freeze(net.final), len(sequence))
    heap, done, came = [(unknown[0], 0, 0, start)], set(), {start: (0, None, None)}
    count = 0
    while heap:
        _, _, _, state = heappop(heap)
        if state in done:
            continue
        done.add(state)
        if state == goal:
            moves: list[tuple[str | None, int | None]] = []
            cost = came[state][0]
            while came[state][1] is not None:
                moves.append(came[state][2])
                state = came[state][1]
            return cost, moves[::-1]
        if limit and len(done) > limit:
            raise ValueError(f"no alignment within {limit} states")
        marking, at = dict(state[0]), state[1]
        cost = came[state][0]
        options: list[tuple[int, int, tuple, tuple]] = []
        for t in net.enabled(marking):
            after, label = freeze(net.fire(marking, t)), net.transitions[t]
            if label is not None and at < len(sequence) and sequence[at] == label:
                options.append((cost, 0, (after, at + 1), (t, at)))
            options.append((cost + (SILENT if label is None else MOVE), 1, (after, at), (t, None)))
        if at < len(sequence):
            options.append((cost + MOVE, 2, (state[0], at + 1), (None, at)))
        for total, rank, new, move in options:
            if new not in done and (new not in came or total < came[new][0]):
                came[new] = (total, state, move)
                count += 1
                heappush(heap, (total + unknown[new[1]], rank, count, new))
    raise ValueError("the final marking can't be reached")


def replay(net: Net, moves: list[tuple[str | None, int | None]]) -> list[tuple]:
    """The steps of an alignment without log moves: (step_idx, transition, label, log_idx, prev_enabled, since).

    since: the event at whose end the transition was first seen enabled since it last fired, -1 for
    the case's start. A transition that lost a choice keeps it."""
    marking, seen, last, out = dict(net.initial), {}, -1, []
    for t, at in moves:
        if t is None:
            continue
        enabled = net.enabled(marking)
        for x in enabled:
            seen.setdefault(x, last)
        since = seen.pop(t)
        out.append((len(out), t, net.transitions[t], at, enabled, since))
        if at is not None:
            last = at
        marking = net.fire(marking, t)
    return out


def cases(log: DataFrame) -> DataFrame:
    """(case_id, variant, activities, events, first_start, attributes...): a row a case."""
    event = F.struct("event_idx", "activity", "resource", "start_ts", "end_ts")
    grouped = log.groupBy("case_id").agg(
        F.array_sort(F.collect_list(event)).alias("events"), F.min_by("start_ts", "event_idx").alias("first_start"),
        *[F.min_by(a, "event_idx").alias(a) for a in attributes(log) if a != "event_id"], *[F.min(c).alias(c) for c in log.columns if c == CASE_ORDER],
    )
    grouped = grouped.withColumn("activities", F.transform("events", lambda e: e["activity"]))
    return grouped.withColumn("variant", F.sha2(F.to_json("activities"), 256))


def log_variants(log: DataFrame) -> DataFrame:
    """variants() of a log's cases, of which only the activities are moved."""
    own = F.array_sort(F.collect_list(F.struct("event_idx", "activity")))
    grouped = log.groupBy("case_id").agg(F.transform(own, lambda e: e["activity"]).alias("activities"))
    return variants(grouped.withColumn("variant", F.sha2(F.to_json("activities"), 256)))


def variants(by_case: DataFrame) -> DataFrame:
    """(variant, activities, n), by distinct sequence."""
    return by_case.groupBy("variant").agg(F.first("activities").alias("activities"), F.count("*").alias("n"))


def aligned(distinct: DataFrame, net: Net) -> DataFrame:
    """(variant, n, cost, steps) of each distinct sequence."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for variant, n, activities in zip(batch["variant"], batch["n"], batch["activities"], strict=True):
                cost, moves = align(net, list(activities))
                names = ("step_idx", "transition", "label", "log_idx", "prev_enabled", "since")
                out.append((variant, n, cost // MOVE, [dict(zip(names, s, strict=True)) for s in replay(net, moves)]))
            yield pd.DataFrame(out, columns=["variant", "n", "cost", "steps"])

    return distinct.select("variant", "n", "activities").mapInPandas(run, f"variant string, n long, cost long, steps {STEPS}")


def stepped(log: DataFrame, net: Net) -> DataFrame:
    """A row for each step of each case that isn't a log move: the transition, what was enabled, and
    for steps with an event its resource, enabled_ts, start_ts and end_ts. Model moves have none."""
    by_case = cases(log)
    rows = by_case.join(aligned(variants(by_case), net).drop("n"), "variant")
    held = [c for c in by_case.columns if c not in ("variant", "activities", "events")]
    rows = rows.select(*held, "events", F.explode("steps").alias("s"))
    event = F.when(F.col("s.log_idx").isNotNull(), F.col("events")[F.col("s.log_idx")])
    real = F.col("s.log_idx").isNotNull()
    enabled = F.when(F.col("s.since") < 0, F.col("first_start")).otherwise(F.col("events")[F.greatest(F.col("s.since"), F.lit(0))]["end_ts"])
    return rows.select(
        *[c for c in held if c != "first_start"], F.col("s.step_idx").alias("step_idx"), F.col("s.transition").alias("transition"), F.col("s.label").alias("label"),
        F.col("s.log_idx").alias("log_idx"), F.col("s.prev_enabled").alias("prev_enabled"), event["resource"].alias("resource"),
        F.when(real, enabled).alias("enabled_ts"), event["start_ts"].alias("start_ts"), event["end_ts"].alias("end_ts"),
    )


def feature_table(log: DataFrame, net: Net) -> DataFrame:
    """stepped() with a history column for each label and the workload at enabling time."""
    steps = history(stepped(log, net), net.labels, ["step_idx"])
    steps = steps.withColumn("step_key", F.concat_ws("|", F.col("case_id").cast("string"), F.col("step_idx").cast("string")))
    loads = workload(log, steps.where("resource is not null"), "enabled_ts", "step_key")
    return steps.join(loads, "step_key", "left").drop("step_key")


def transition_frequency(log: DataFrame, net: Net) -> DataFrame:
    """(transition, n) of all transitions, model moves counted, 0 for those that never fire."""
    fired = aligned(log_variants(log), net).select("n", F.explode("steps").alias("s")).groupBy(F.col("s.transition").alias("transition")).agg(F.sum("n").alias("n"))
    names = log.sparkSession.createDataFrame([(t,) for t in net.transitions], "transition string")
    return names.join(fired, "transition", "left").select("transition", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
