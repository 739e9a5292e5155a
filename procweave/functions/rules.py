"""Decision rules: rows of a tree, as an expression, as a dictionary to walk, or as a drawing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def by_key(rows: list, key: str = "key") -> dict[str, dict[int, dict]]:
    """Collected rule rows as {key: {node_id: row as a dict}}."""
    out: dict[str, dict[int, dict]] = {}
    for r in rows:
        own = r.asDict(recursive=True) if hasattr(r, "asDict") else dict(r)
        out.setdefault(own.pop(key), {})[own.pop("node_id")] = own
    return out


def compiled(nodes: dict[int, dict], leaf: Callable[[int, dict], Column] | None = None, at: int = 0) -> Column:
    """A nested CASE over columns named like the features. leaf: what a leaf gives, its value if not told."""
    node = nodes[at]
    if node.get("feature") is None:
        return leaf(at, node) if leaf else F.lit(float(node["value"]))
    yes, no = (compiled(nodes, leaf, node[k]) for k in ("yes_id", "no_id"))
    return F.when(F.col(f"`{node['feature']}`") <= F.lit(float(node["threshold"])), yes).otherwise(no)


def leaf_of(nodes: dict[int, dict], features: dict[str, float]) -> tuple[int, dict]:
    """The leaf that a row of features reaches; what a row lacks counts as 0."""
    at = 0
    while nodes[at].get("feature") is not None:
        node = nodes[at]
        at = node["yes_id"] if features.get(node["feature"], 0) <= node["threshold"] else node["no_id"]
    return at, nodes[at]


def constant(value: float) -> dict[int, dict]:
    """Rules that give one value."""
    return {0: {"feature": None, "value": float(value), "dist": "fixed", "params": [float(value)], "min": float(value), "max": float(value)}}


def tests(nodes: dict[int, dict], feature: str) -> bool:
    return any(n.get("feature") == feature for n in nodes.values())


def to_dot(nodes: dict[int, dict], name: str = "tree") -> str:
    """The tree as Graphviz text; numbers are rounded for reading only."""
    lines = [f"digraph {name} {{", "  node [shape=box];"]
    for k, node in sorted(nodes.items()):
        if node.get("feature") is None:
            lines.append(f'  {k} [label="{round(node["value"], 3)}"];')
        else:
            lines.append(f'  {k} [label="{node["feature"]} <= {round(node["threshold"], 3)}"];')
            lines += [f'  {k} -> {node["yes_id"]} [label="True"];', f'  {k} -> {node["no_id"]} [label="False"];']
    return "\n".join([*lines, "}"])
