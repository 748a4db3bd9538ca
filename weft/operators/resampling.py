"""Cluster bootstrap by hashed multiplicities, and summaries of simulated draws.

A draw weighs whole units: each of a unit's rows counts as often as a Poisson number of mean 1, hashed from draw and unit,
says. That is the multinomial draw of units but for its fixed total, and needs no table of units. Draw 0 weighs all by 1.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import forget, shared_table
from . import ranks
from .models import uniform

#: Chances that a Poisson number of mean 1 is at most 0, 1, ...; beyond the last one 2**-32 isn't reached.
POISSON = [math.fsum(math.exp(-1) / math.factorial(k) for k in range(j + 1)) for j in range(13)]


def multiplicity(draw: Column, unit: Column) -> Column:
    """How often a unit counts in a draw; 1 in draw 0."""
    u = uniform(F.lit("unit"), draw.cast("string"), unit.cast("string"))
    found = F.when(draw == 0, 1)
    for k, c in enumerate(POISSON):
        found = found.when(u < c, k)  # in this order, most hashes are made once or twice
    return found.otherwise(len(POISSON)).cast("long")


def bootstrap_medians(rows: DataFrame, by: Sequence[str], unit: str, value: str, draws: int) -> DataFrame:
    """by, draw, median, n for draws 0 to `draws`: the least value up to which half of the weights lie, n their sum.

    Equal values are one row with a weight for each draw, and all draws share one order: nothing is copied by draw. Rows with
    a null value or unit take no part; a draw that weighs none of a group's units has a null median and n = 0.
    """
    weights = {f"_w{d}": multiplicity(F.lit(d), F.col("_unit")) for d in range(draws + 1)}
    rows = rows.where(F.col(unit).isNotNull() & F.col(value).isNotNull()).select(*by, F.col(unit).alias("_unit"), F.col(value).alias("_v"))
    counted = rows.groupBy(*by, "_v").agg(*[F.sum(w).alias(c) for c, w in weights.items()])
    run = ranks.running_sums(counted, by, [F.col("_v")], list(weights))
    found = [
        F.struct(
            F.lit(d).alias("draw"),
            F.min(F.when((F.col(f"{c}_all") > 0) & (2 * F.col(f"{c}_upto") >= F.col(f"{c}_all")), F.col("_v"))).alias("median"),
            F.max(f"{c}_all").alias("n"),
        ).alias(c)
        for d, c in enumerate(weights)
    ]
    out = run.groupBy(*by).agg(*found)
    return out.select(*by, F.explode(F.array(*weights)).alias("_r")).select(*by, "_r.*")


def _levels(sums: list, draws: int, years: list[int]) -> np.ndarray:
    """Year effects of each draw, by least norm; the first year's is 0."""
    n, first = len(years), years[0]
    x, xy = np.zeros((draws + 1, n, n)), np.zeros((draws + 1, n))
    for r in sums:
        d, i, j = r["draw"], r["year0"] - first, r["year1"] - first
        x[d, i, i] += r["w"]
        x[d, j, j] += r["w"]
        x[d, i, j] -= r["w"]
        x[d, j, i] -= r["w"]
        xy[d, j] += r["wy"]
        xy[d, i] -= r["wy"]
    return np.array([np.r_[0.0, np.linalg.lstsq(a[1:, 1:], b[1:], rcond=None)[0]] for a, b in zip(x, xy, strict=True)])


def index_draws(pairs: DataFrame, unit: str, years: list[int], draws: int, floor: float = 1e-9) -> DataFrame:
    """draw, year, growth_pct: a repeat-sales index, fitted anew for each draw of units; draw 0 is the index of all pairs.

    pairs: unit, year0, year1, gap, y (log ratio); the fit is that of `models.repeat_index` with multiplicities as weights.
    Three passes serve all draws; each one's sums are draws x pairs of years numbers (two passes) or draws (one), solved on
    the driver. Pairs are written once with their multiplicities; a pair meets each draw in the task that reads it, and
    partial sums alone are shuffled. Pairs outside the years, of one year or with nulls take no part; a draw without pairs
    has no rows.
    """
    p = pairs.where(
        F.col("year0").between(years[0], years[-1]) & F.col("year1").between(years[0], years[-1]) & (F.col("year0") != F.col("year1"))
        & F.col("y").isNotNull() & F.col("gap").isNotNull() & F.col(unit).isNotNull()
    )
    spark, w = p.sparkSession, F.col("_w")
    times = F.array(*[multiplicity(F.lit(d), F.col(unit)) for d in range(draws + 1)])
    written = shared_table(p.select("year0", "year1", "gap", "y", times.alias("_times")))
    p = written.select("year0", "year1", "gap", "y", F.posexplode("_times").alias("draw", "_w")).where("_w > 0")

    def solved(rows: DataFrame, weight: Column) -> np.ndarray:
        s = rows.groupBy("draw", "year0", "year1").agg(F.sum(weight).alias("w"), F.sum(weight * F.col("y")).alias("wy"))
        return _levels(s.collect(), draws, years)

    level = solved(p, w)
    effects = [(d, a, b, float(level[d, j] - level[d, i])) for d in range(draws + 1) for i, a in enumerate(years) for j, b in enumerate(years) if a != b]
    effects = F.broadcast(spark.createDataFrame(effects, "draw int, year0 int, year1 int, _effect double"))  # draws x pairs of years
    rest = p.join(effects, ["draw", "year0", "year1"]).withColumn("_s", F.pow(F.col("y") - F.col("_effect"), 2))
    gap, s = F.col("gap"), F.col("_s")
    moments = {"n": w, "g": w * gap, "gg": w * gap * gap, "s": w * s, "gs": w * gap * s}
    found = rest.groupBy("draw").agg(*[F.sum(m).alias(c) for c, m in moments.items()], F.min("_s").alias("low")).collect()
    fits = []
    for r in found:
        spread = r["gg"] - r["g"] ** 2 / r["n"]
        slope = (r["gs"] - r["g"] * r["s"] / r["n"]) / spread if spread > 1e-12 * r["gg"] else 0.0
        fits.append((r["draw"], (r["s"] - slope * r["g"]) / r["n"], slope, r["low"] + floor))
    fits = F.broadcast(spark.createDataFrame(fits, "draw int, _a double, _b double, _least double"))  # a row a draw
    level = solved(p.join(fits, "draw"), w / F.greatest(F.col("_a") + F.col("_b") * gap, F.col("_least")))
    forget(written)
    growth = np.expm1(np.diff(level, axis=1)) * 100
    met = sorted(r["draw"] for r in found)
    return spark.createDataFrame([(d, y, float(g)) for d in met for y, g in zip(years[1:], growth[d], strict=True)], "draw int, year int, growth_pct double")


def summarised_draws(drawn: DataFrame, by: Sequence[str], value: str, weight: str) -> DataFrame:
    """by, draw, units, median, weighted: the values of each draw, for all units and for each segment.

    Every unit counts in its segment (`by`, null segments are one) and in the whole, whose `by` is null and `whole` true. Null
    values take no part; a weighted mean without weight is null.
    """
    rows = drawn.where(F.col(value).isNotNull())
    sides = [F.struct(F.lit(all_).alias("whole"), *[(F.lit(None) if all_ else F.col(c)).cast(drawn.schema[c].dataType).alias(c) for c in by]) for all_ in (True, False)]
    rows = rows.select("draw", value, weight, F.explode(F.array(*sides)).alias("_r")).select("draw", value, weight, "_r.*")
    v, w = F.col(value), F.col(weight)
    sums = {"units": F.lit(1), "_vw": v * w, "_w": w}
    out = ranks.quantiles(rows, ["whole", *by, "draw"], value, {"median": 0.5}, sums)
    mean = F.col("_vw") / F.when(F.col("_w") != 0, F.col("_w"))
    return out.select("whole", *by, "draw", "units", "median", mean.alias("weighted"))


def sensitivity(rows: DataFrame, windows: dict[str, tuple[float, float]], gap: str, year: str, value: str, weight: str, tail: float) -> DataFrame:
    """gap_window, policy, year, n, median, mean, weighted: one value under every window, outlier policy and aggregator.

    A row lies in each window whose bounds (exclusive) hold its gap. Policies: keep; winsorise, values beyond the window's
    `tail` quantiles become these; trim, such rows take no part. Null values, gaps and years take no part.
    """
    rows = rows.where(F.col(value).isNotNull() & F.col(year).isNotNull())
    inside = [F.when((F.col(gap) > lo) & (F.col(gap) < hi), F.lit(name)) for name, (lo, hi) in windows.items()]
    x = rows.select(F.col(year).alias("year"), F.col(value).alias("_v"), F.col(weight).alias("_w"), F.explode(F.array_compact(F.array(*inside))).alias("gap_window"))
    x = x.groupBy("gap_window", "year", "_v").agg(F.count(F.lit(1)).alias("_k"), F.sum("_w").alias("_w"))
    bounds = ranks.quantiles(x, ["gap_window"], "_v", {"_lo": tail, "_hi": 1 - tail}, times="_k")
    v, lo, hi = F.col("_v"), F.col("_lo"), F.col("_hi")
    cut = {"keep": v, "winsorise": F.least(F.greatest(v, lo), hi), "trim": F.when(v.between(lo, hi), v)}
    policies = F.array(*[F.struct(F.lit(k).alias("policy"), c.alias("v")) for k, c in cut.items()])
    y = x.join(F.broadcast(bounds), "gap_window").select("gap_window", "year", "_k", "_w", F.explode(policies).alias("_r"))  # a row a window
    y = y.select("gap_window", "year", "_k", "_w", "_r.*").where("v is not null")
    sums = {"n": F.col("_k"), "_s": F.col("v") * F.col("_k"), "_vw": F.col("v") * F.col("_w"), "_sw": F.col("_w")}
    out = ranks.quantiles(y, ["gap_window", "policy", "year"], "v", {"median": 0.5}, sums, times="_k")
    return out.select(
        "gap_window", "policy", "year", "n", "median", (F.col("_s") / F.col("n")).alias("mean"),
        (F.col("_vw") / F.when(F.col("_sw") != 0, F.col("_sw"))).alias("weighted"),
    )
