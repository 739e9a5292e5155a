"""Petri nets: places, transitions with or without a label, weighted arcs, two markings."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Marking = dict[str, int]


@dataclass
class Net:
    """transitions: label by name, None if silent. inputs, outputs: places with arc weights by transition."""

    places: list[str]
    transitions: dict[str, str | None]
    inputs: dict[str, Marking]
    outputs: dict[str, Marking]
    initial: Marking = field(default_factory=dict)
    final: Marking = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.places, self.transitions = sorted(self.places), dict(sorted(self.transitions.items()))
        for side in (self.inputs, self.outputs):
            for t in self.transitions:
                side.setdefault(t, {})
            unknown = {p for arcs in side.values() for p in arcs} - set(self.places)
            if unknown:
                raise ValueError(f"arcs to unknown places {sorted(unknown)}")

    @property
    def labels(self) -> list[str]:
        return sorted({x for x in self.transitions.values() if x is not None})

    def enabled(self, marking: Marking) -> list[str]:
        """Transitions whose input places have tokens enough, by name."""
        return [t for t in self.transitions if all(marking.get(p, 0) >= n for p, n in self.inputs[t].items())]

    def fire(self, marking: Marking, transition: str) -> Marking:
        after = dict(marking)
        for p, n in self.inputs[transition].items():
            after[p] = after.get(p, 0) - n
        for p, n in self.outputs[transition].items():
            after[p] = after.get(p, 0) + n
        return {p: n for p, n in after.items() if n}

    def frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(places, transitions, arcs) as small tables."""
        arcs = [(p, t, n) for t, own in self.inputs.items() for p, n in own.items()] + [(t, p, n) for t, own in self.outputs.items() for p, n in own.items()]
        places = [(p, self.initial.get(p, 0), self.final.get(p, 0)) for p in self.places]
        return (
            spark.createDataFrame(places, "place string, initial int, final int"),
            spark.createDataFrame(list(self.transitions.items()), "transition string, label string"),
            spark.createDataFrame(arcs, "source string, target string, weight int"),
        )


def net(arcs: list[tuple[str, str, list[str], list[str]]] | list, initial: str, final: str) -> Net:
    """A net from (transition, label, input places, output places), arcs of weight 1."""
    inputs = {t: dict.fromkeys(a, 1) for t, _, a, _ in arcs}
    outputs = {t: dict.fromkeys(b, 1) for t, _, _, b in arcs}
    places = {p for _, _, a, b in arcs for p in (*a, *b)} | {initial, final}
    return Net(sorted(places), {t: label for t, label, _, _ in arcs}, inputs, outputs, {initial: 1}, {final: 1})


def flower(labels: list[str]) -> Net:
    """Any activity at any time, between a silent start and a silent end."""
    return net([("tau_in", None, ["src"], ["p"]), *[(x, x, ["p"], ["p"]) for x in sorted(labels)], ("tau_out", None, ["p"], ["snk"])], "src", "snk")


def sequence(labels: list[str]) -> Net:
    """One activity after another."""
    places = ["src", *[f"p{k}" for k in range(1, len(labels))], "snk"]
    return net([(x, x, [places[k]], [places[k + 1]]) for k, x in enumerate(labels)], "src", "snk")


def _text(element: ET.Element | None) -> str | None:
    found = None if element is None else element.find("{*}text") if element.find("{*}text") is not None else element.find("text")
    return None if found is None or found.text is None else found.text.strip()


def from_pnml(path: str) -> Net:
    """A PNML file's first net, with all its pages. Arcs without an inscription have weight 1; transitions marked as
    invisible are silent; without a final marking, the places without outputs are final."""
    kind = lambda e: e.tag.rpartition("}")[2]
    root = ET.parse(path).getroot()
    every = [*next((e for e in root.iter() if kind(e) == "net"), root).iter()]
    child = lambda e, name: next((c for c in e if kind(c) == name), None)
    places, initial, names, labels, arcs, final = [], {}, {}, {}, [], {}
    for e in every:
        if kind(e) == "place" and e.get("id"):
            places.append(e.get("id"))
            if (marked := _text(child(e, "initialMarking"))) and int(marked):
                initial[e.get("id")] = int(marked)
        elif kind(e) == "transition":
            tool = next((c for c in e if kind(c) == "toolspecific" and c.get("activity") == "$invisible$"), None)
            names[e.get("id")] = e.get("id")
            labels[e.get("id")] = None if tool is not None else _text(child(e, "name")) or e.get("id")
        elif kind(e) == "arc":
            arcs.append((e.get("source"), e.get("target"), int(_text(child(e, "inscription")) or 1)))
        elif kind(e) == "finalmarkings":
            for m in e:
                for p in m:
                    if (n := _text(p)) and int(n):
                        final[p.get("idref")] = int(n)
    inputs: dict[str, Marking] = {}
    outputs: dict[str, Marking] = {}
    for source, target, weight in arcs:
        if source in names:
            outputs.setdefault(source, {})[target] = weight
        else:
            inputs.setdefault(target, {})[source] = weight
    if not final:
        final = {p: 1 for p in places if not any(p in own for own in inputs.values())}
    return Net(places, labels, inputs, outputs, initial, final)
