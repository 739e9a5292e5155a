"""Logistic regression by key, as an alternative to trees for transition weights."""

from __future__ import annotations

from math import exp

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit(rows: DataFrame, features: list[str], key: str = "key") -> dict[str, dict]:
    """{key: {intercept, coefficients by feature}} from rows (key, y, x).

    A distributed fit for each key, a transition of the net, with an L2 penalty of 1 / n as in usual
    libraries' default; keys are those with both labels."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi")).where("lo < hi").orderBy(key).collect()
    out = {}
    for r in counts:
        own = rows.where(F.col(key) == r[key]).select(F.col("y").alias("label"), array_to_vector("x").alias("features"))
        model = LogisticRegression(regParam=1.0 / r["n"], standardization=False, maxIter=200, tol=1e-9).fit(own)
        out[r[key]] = {"intercept": float(model.intercept), "coefficients": dict(zip(features, map(float, model.coefficients), strict=True))}
    return out


def probability(model: dict, features: dict[str, float]) -> float:
    """The chance that a row of features has label 1; what it lacks counts as 0."""
    z = model["intercept"] + sum(w * features.get(f, 0) for f, w in model["coefficients"].items())
    return 1 / (1 + exp(-max(min(z, 700.0), -700.0)))


def compiled(model: dict) -> Column:
    """probability() over columns named like the features."""
    z = F.lit(model["intercept"])
    for f, w in model["coefficients"].items():
        z = z + F.lit(w) * F.col(f"`{f}`")
    return 1 / (1 + F.exp(-z))
