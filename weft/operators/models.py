"""Estimates: variance components, repeat-sales index, cohorts and hashed draws, calibration, weighted errors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) from the keys by md5, the same in every run and engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *keys)), 1, 8), 16, 10).cast("double") / 2**32


def variance_components(rows: DataFrame, a: str, b: str, order: list[str], y: str) -> DataFrame:
    """One row: variances of a, b and the residual of a balanced two-way random-effects table, sizes, shares.

    Levels of a that lack a level of b drop out; cells are cut to the smallest one's first rows by `order`. Nulls of y
    take no part. Not estimable (fewer than two levels, or no residual degrees of freedom): no row.
    """
    rows = rows.where(F.col(y).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    nb = rows.select(b).distinct().count()
    full = cells.groupBy(a).agg(F.count(F.lit(1)).alias("cells"), F.min("n").alias("n")).where(F.col("cells") == nb)
    size = full.agg(F.count(F.lit(1)).alias("na"), F.min("n").alias("n")).collect()[0]
    na, n = size["na"], size["n"] or 0
    rest = na * nb * n - na - nb + 1
    place = F.row_number().over(Window.partitionBy(a, b).orderBy(*order))
    kept = rows.join(full.select(a), a).withColumn("_place", place).where(F.col("_place") <= n)
    sums = kept.groupBy(a, b).agg(F.sum(y).alias("s"), F.sum(F.col(y) * F.col(y)).alias("ss"))
    by = lambda c: sums.groupBy(c).agg(F.sum("s").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias(f"q_{c}"))
    total = sums.agg(F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    g = F.col("s") * F.col("s") / (na * nb * n)  # one row each is joined
    wide = total.join(F.broadcast(by(a))).join(F.broadcast(by(b)))
    ss_a, ss_b = F.col(f"q_{a}") / (nb * n) - g, F.col(f"q_{b}") / (na * n) - g
    ms_e = F.greatest(F.lit(0.0), F.col("ss") - g - ss_a - ss_b) / max(rest, 1)
    out = wide.select(
        F.greatest(F.lit(0.0), (ss_a / max(na - 1, 1) - ms_e) / (nb * n)).alias("var_a"),
        F.greatest(F.lit(0.0), (ss_b / max(nb - 1, 1) - ms_e) / (na * n)).alias("var_b"),
        ms_e.alias("var_rest"), F.lit(na).alias("n_a"), F.lit(nb).alias("n_b"), F.lit(n).alias("n_cell"),
    ) if n else None
    if out is None or na < 2 or nb < 2 or rest <= 0:
        schema = "var_a double, var_b double, var_rest double, n_a int, n_b int, n_cell int, share_a double"
        return rows.sparkSession.createDataFrame([], schema)
    whole = F.col("var_a") + F.col("var_b") + F.col("var_rest")
    return out.withColumn("share_a", F.when(whole > 0, F.col("var_a") / whole).otherwise(0.0))


def repeat_index(pairs: DataFrame, years: list[int], floor: float = 1e-9) -> DataFrame:
    """year, growth_pct of a repeat-sales index: year effects from pairs of sales of one unit, weighted by gap.

    pairs: year0, year1, gap, y (log ratio). A pair is +1 in its later year and -1 in its earlier one. Normal equations are
    sums by pair of years, solved on the driver (one number for each pair of years); a second pass fits the squared
    residuals by the gap, and a third one weighs pairs by the inverse of that variance, not below the least squared
    residual plus `floor`. Pairs outside the years or with nulls take no part; a year without pairs has no effect of its
    own (least-norm solution). Without pairs there are no rows.
    """
    first, n = years[0], len(years) - 1
    p = pairs.where(F.col("year0").between(first, years[-1]) & F.col("year1").between(first, years[-1]) & F.col("y").isNotNull() & F.col("gap").isNotNull())
    spark = p.sparkSession

    def solved(weight: Column) -> np.ndarray | None:
        sums = p.groupBy("year0", "year1").agg(F.sum(weight).alias("w"), F.sum(weight * F.col("y")).alias("wy")).collect()
        if not sums:
            return None
        x, xy = np.zeros((n, n)), np.zeros(n)
        for r in sums:
            row = np.zeros(n)
            for year, sign in ((r["year1"], 1), (r["year0"], -1)):
                if year > first:
                    row[year - first - 1] += sign
            x += r["w"] * np.outer(row, row)
            xy += r["wy"] * row
        return np.r_[0.0, np.linalg.lstsq(x, xy, rcond=None)[0]]

    level = solved(F.lit(1.0))
    if level is None:
        return spark.createDataFrame([], "year int, growth_pct double")
    effect = lambda c, at: F.get(F.array(*[F.lit(float(v)) for v in at]), F.col(c) - first)
    square = F.pow(F.col("y") - effect("year1", level) + effect("year0", level), 2)
    fit = p.agg(F.regr_slope(square, "gap").alias("b"), F.regr_intercept(square, "gap").alias("a"), F.min(square).alias("low"), F.avg(square).alias("m")).collect()[0]
    slope, start = (fit["b"], fit["a"]) if fit["b"] is not None else (0.0, fit["m"])
    level = solved(1.0 / F.greatest(F.lit(start) + F.lit(slope) * F.col("gap"), F.lit(fit["low"] + floor)))
    growth = np.expm1(np.diff(level)) * 100
    return spark.createDataFrame([(y, float(g)) for y, g in zip(years[1:], growth, strict=True)], "year int, growth_pct double")


def simulated_cohort(units: DataFrame, pools: DataFrame, key: str, draws: int, cap: float) -> DataFrame:
    """draw, key, renews, growth: hashed Monte Carlo draws for each unit.

    units: key, chance (of renewal), center1, center0; pools: renews (0 or 1), at (from 0), residual, n (the pool's
    size). A unit renews if its uniform is below its chance; its residual is one of that pool's, by another uniform.
    Growth of renewals is capped. A pool is joined by place, never gathered. Units with a null chance take no part.
    """
    u = units.where("chance is not null").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    u = u.withColumn("renews", (uniform(F.lit("r"), F.col("draw"), F.col(key)) < F.col("chance")).cast("int"))
    size = pools.select("renews", "n").distinct()  # two rows
    u = u.join(F.broadcast(size), "renews")
    u = u.withColumn("at", F.floor(uniform(F.lit("p"), F.col("draw"), F.col(key)) * F.col("n")))
    u = u.drop("n").join(pools.drop("n"), ["renews", "at"])
    growth = F.when(F.col("renews") == 1, F.least(F.col("center1") + F.col("residual"), F.lit(cap))).otherwise(F.col("center0") + F.col("residual"))
    return u.select("draw", key, "renews", growth.alias("growth"))


def log_loss(p: Column, y: Column, edge: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(edge)), F.lit(1 - edge))
    return F.avg(-F.when(y == 1, F.ln(q)).otherwise(F.ln(1 - q)))


def f1(p: Column, y: Column, label: int) -> Column:
    """F1 of one label at a cut of one half; 0 without true positives."""
    said = (p >= 0.5).cast("int") == label
    hit, all_ = F.count_if(said & (y == label)), F.count_if(said) + F.count_if(y == label)
    return F.when(hit > 0, 2 * hit / all_).otherwise(0.0)
