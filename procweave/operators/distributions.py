"""Families of distributions fitted to durations by key, from aggregates, and chosen by distance.

A key's values are summed up by their number, mean, deviation, least, largest, and the quantiles at
POINTS evenly spaced probabilities, by a sketch that is exact up to ACCURACY values; so no task holds
all values of a key. Families: fixed (the mean), norm, expon (from the least value), lognorm (three
parameters: the shift is one of GAPS times the mean's distance from the least value below that, the one
under which the quantiles are likeliest), uniform. Of values that are all alike only fixed is a fit. The
distance is the mean absolute difference of the quantiles, the first Wasserstein distance at those
points; least wins, earlier families first among equals."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAMILIES = ("fixed", "norm", "expon", "lognorm", "uniform")
POINTS, ACCURACY = 100, 100_000
PROBABILITIES = [(i + 0.5) / POINTS for i in range(POINTS)]
#: How far below the least value the log-normal's shift is tried, in distances of the mean from the least value.
GAPS = (0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0)
NORMAL = [NormalDist().inv_cdf(p) for p in PROBABILITIES]

DIST = "struct<dist:string,params:array<double>,min:double,max:double,mean:double>"


def summaries(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row a key: n, distinct-or-not, avg, sd (of the population), lo, hi, log moments and quantiles. Null and NaN don't count."""
    x = F.col(value)
    base = rows.where(x.isNotNull() & ~F.isnan(x)).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(x).alias("avg"), F.stddev_pop(x).alias("sd"), F.min(x).alias("lo"), F.max(x).alias("hi"),
        F.percentile_approx(x, PROBABILITIES, ACCURACY).alias("quantiles"),
    )
    return base.withColumn("log_fit", F.when(F.col("hi") > F.col("lo"), _log_fit()))


def _log_fit() -> Column:
    """A struct (sd, loc, scale) of the log-normal fit, from the columns lo, avg and quantiles."""
    mean = lambda values: F.aggregate(values, F.lit(0.0), lambda a, b: a + b) / POINTS
    logs = lambda loc: F.transform("quantiles", lambda q: F.log(q - loc))
    moments = lambda v, loc: F.struct(mean(v).alias("mean"), mean(F.transform(v, lambda y: y * y)).alias("square"), loc.alias("loc"))
    fits = F.transform(F.transform(F.array(*map(F.lit, GAPS)), lambda g: F.col("lo") - g * (F.col("avg") - F.col("lo"))), lambda loc: F.transform(F.array(logs(loc)), lambda v: moments(v, loc))[0])
    sd = lambda m: F.sqrt(F.greatest(m["square"] - m["mean"] * m["mean"], F.lit(1e-18)))
    scored = F.transform(fits, lambda m, k: F.struct((-F.log(sd(m)) - m["mean"]).alias("score"), (-k).alias("k"), sd(m).alias("sd"), m["loc"].alias("loc"), F.exp(m["mean"]).alias("scale")))
    best = F.array_max(scored)
    return F.struct(best["sd"].alias("sd"), best["loc"].alias("loc"), best["scale"].alias("scale"))


def parameters(family: str) -> Column:
    """The fit's parameters, from the columns of summaries()."""
    made = {
        "fixed": ["avg"], "norm": ["avg", "sd"], "expon": ["lo", "avg - lo"], "uniform": ["lo", "hi - lo"],
        "lognorm": ["log_fit.sd", "log_fit.loc", "log_fit.scale"],
    }[family]
    return F.array(*[F.expr(f"cast({e} as double)") for e in made])


def quantile(family: str, params: Column, p: Column, z: Column) -> Column:
    """The quantile at p, where z is the standard normal's."""
    return {
        "fixed": lambda: params[0],
        "norm": lambda: params[0] + params[1] * z,
        "expon": lambda: params[0] - params[1] * F.log(1 - p),
        "uniform": lambda: params[0] + params[1] * p,
        "lognorm": lambda: params[1] + params[2] * F.exp(params[0] * z),
    }[family]()


def distance(family: str) -> Column:
    """Mean absolute difference between the sketch's quantiles and the fit's."""
    points = F.arrays_zip(F.col("quantiles").alias("x"), F.array(*map(F.lit, PROBABILITIES)).alias("p"), F.array(*map(F.lit, NORMAL)).alias("z"))
    gaps = F.transform(points, lambda s: F.abs(s["x"] - quantile(family, parameters(family), s["p"], s["z"])))
    return F.aggregate(gaps, F.lit(0.0), lambda a, b: a + b) / POINTS


def fitted(rows: DataFrame, keys: list[str], value: str, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """keys, n, and fit, the chosen distribution as a struct; one value alone is 'fixed'."""
    base = summaries(rows, keys, value)
    base = base.withColumns({f"w_{f}": distance(f) for f in families})
    options = F.array(*[F.struct(F.col(f"w_{f}").alias("w"), F.lit(k).alias("k"), F.lit(f).alias("dist"), parameters(f).alias("params")) for k, f in enumerate(families)])
    best = F.array_min(F.filter(options, lambda o: ~F.isnan(o["w"]) & o["w"].isNotNull()))
    fixed = F.struct(F.lit("fixed").alias("dist"), F.array(F.col("lo").cast("double")).alias("params"))
    chosen = F.when(F.col("lo") == F.col("hi"), fixed).otherwise(F.struct(best["dist"].alias("dist"), best["params"].alias("params")))
    fit = F.struct(chosen["dist"].alias("dist"), chosen["params"].alias("params"), F.col("lo").cast("double").alias("min"), F.col("hi").cast("double").alias("max"), F.col("avg").cast("double").alias("mean"))
    return base.select(*keys, "n", fit.alias("fit"))


def sample(dist: str, params: list[float], low: float, high: float, centre: float, u: float, fixed_draws: str = "max") -> float:
    """One draw for a uniform number u. Outside [low, high] it is the centre; fixed gives the largest value, or the mean."""
    if dist == "fixed":
        return high if fixed_draws == "max" else centre
    u = min(max(u, 1e-12), 1 - 1e-12)
    if dist == "expon":
        x = params[0] - params[1] * math.log(1 - u)
    elif dist == "uniform":
        x = params[0] + params[1] * u
    else:
        z = NormalDist().inv_cdf(u)
        x = params[0] + params[1] * z if dist == "norm" else params[1] + params[2] * math.exp(params[0] * z)
    return x if low <= x <= high else centre


def drawn(fit: Column, u: Column, fixed_draws: str = "max") -> Column:
    """sample() as an expression."""
    p = F.greatest(F.least(u, F.lit(1 - 1e-12)), F.lit(1e-12))
    z = normal_quantile(p)
    x = F.lit(None).cast("double")
    for family in ("norm", "expon", "uniform", "lognorm"):
        x = F.when(fit["dist"] == family, quantile(family, fit["params"], p, z)).otherwise(x)
    fixed = fit["max"] if fixed_draws == "max" else fit["mean"]
    return F.when(fit["dist"] == "fixed", fixed).when(x.between(fit["min"], fit["max"]), x).otherwise(fit["mean"])


#: Acklam's rational approximation of the normal quantile, fixed values: centre and tails, above and below the line.
CENTRE = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
CENTRE_BELOW = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
TAIL = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
TAIL_BELOW = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
TAIL_UNDER = 0.02425


def normal_quantile(p: Column) -> Column:
    """Standard normal quantile, within 2e-9 of its value."""

    def polynomial(terms: tuple[float, ...], x: Column) -> Column:
        out = F.lit(terms[0])
        for t in terms[1:]:
            out = out * x + t
        return out

    small, q = F.least(p, 1 - p), p - 0.5
    far = F.sqrt(-2 * F.log(small))
    tail = polynomial(TAIL, far) / polynomial(TAIL_BELOW, far)
    centre = polynomial(CENTRE, q * q) * q / polynomial(CENTRE_BELOW, q * q)
    return F.when(small >= TAIL_UNDER, centre).when(p < 0.5, tail).otherwise(-tail)


def histogram(rows: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """(bin, lo, hi, n, density) over equal bins between the extremes; the last bin holds the largest value.

    Values that are all alike are in one bin without width, whose density is null."""
    ends = rows.agg(F.min(value).alias("a"), F.max(value).alias("b"))
    width = (F.col("b") - F.col("a")) / bins
    spot = F.when(width > 0, F.least(F.floor(F.try_divide(F.col(value) - F.col("a"), width)).cast("int"), F.lit(bins - 1))).otherwise(0)
    counts = rows.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).select(spot.alias("bin"), "a", width.alias("w")).groupBy("bin", "a", "w").agg(F.count("*").alias("n"))
    total = rows.where(F.col(value).isNotNull()).agg(F.count("*").alias("total"))
    out = counts.crossJoin(F.broadcast(total))  # a row with a row for each bin
    return out.select("bin", (F.col("a") + F.col("bin") * F.col("w")).alias("lo"), (F.col("a") + (F.col("bin") + 1) * F.col("w")).alias("hi"), "n", F.try_divide(F.col("n"), F.col("total") * F.col("w")).alias("density"))


def density(family: str, params: Column, x: Column) -> Column:
    """The family's density at x, for drawing over a histogram; null for fixed and for fits without width."""
    over = F.try_divide
    scaled = lambda y: F.log(F.when(y > 0, y))
    return {
        "fixed": lambda: F.lit(None).cast("double"),
        "norm": lambda: over(F.exp(-(over(x - params[0], params[1]) ** 2) / 2), params[1] * math.sqrt(2 * math.pi)),
        "expon": lambda: F.when(x >= params[0], over(F.exp(-over(x - params[0], params[1])), params[1])).when(params[1] > 0, 0.0),
        "uniform": lambda: F.when(x.between(params[0], params[0] + params[1]), over(F.lit(1.0), params[1])).when(params[1] > 0, 0.0),
        "lognorm": lambda: F.when(x > params[1], over(F.exp(-(over(scaled(over(x - params[1], params[2])), params[0]) ** 2) / 2), (x - params[1]) * params[0] * math.sqrt(2 * math.pi))).when(params[0] > 0, 0.0),
    }[family]()
