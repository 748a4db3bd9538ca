"""Measurement and classification statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import running_sums


def suppressed_rate(num: Column, den: Column, k: int = 5) -> dict[str, Column]:
    """Counts and rate of a cell; small numerators hide numerator and rate, small denominators all."""
    small_den, small_num = den < k, (num > 0) & (num < k)
    return {
        "num": F.when(~small_den & ~small_num, num), "den": F.when(~small_den, den),
        "rate": F.when(~small_den & ~small_num, num / den), "suppressed": small_den | small_num,
    }


def calibration_bins(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """bin, n, conf, acc; the last bin is closed."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("conf"), F.avg(F.col(y).cast("double")).alias("acc")
    )


def rank_auc(df: DataFrame, by: Sequence[str], p: str, y: str) -> DataFrame:
    """Area under the ROC curve by mid-ranks of distinct scores; null where a group has one class alone."""
    s = df.groupBy(*by, p).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("pos"))
    s = running_sums(s, by, [F.col(p)], ["n"])
    s = s.withColumn("mid", F.col("n_upto") - F.col("n") + (F.col("n") + 1) / 2)
    pos, n = F.sum("pos"), F.sum("n")
    auc = (F.sum(F.col("mid") * F.col("pos")) - pos * (pos + 1) / 2) / (pos * (n - pos))
    return s.groupBy(*by).agg(F.when((pos > 0) & (pos < n), auc).alias("auc"))


def wilson(hit: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = hit / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return mid - half, mid + half


def bland_altman(df: DataFrame, by: Sequence[str], measured: str, reference: str) -> DataFrame:
    d, m = F.col(measured) - F.col(reference), (F.col(measured) + F.col(reference)) / 2
    sd = F.stddev_samp(d)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(d).alias("bias"), sd.alias("sd"), (F.avg(d) - 1.96 * sd).alias("low"),
        (F.avg(d) + 1.96 * sd).alias("high"), F.regr_slope(d, m).alias("slope"),
    )


def pooled_sd(df: DataFrame, cell: Sequence[str], value: str) -> DataFrame:
    cells = df.groupBy(*cell).agg(F.count(value).alias("n"), F.var_samp(value).alias("v")).where("n > 1")
    return cells.agg(
        F.sqrt(F.sum(F.col("v") * (F.col("n") - 1)) / F.sum(F.col("n") - 1)).alias("repeatability"),
        F.count(F.lit(1)).alias("cells"),
    )


def leave_group_out(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """For each group the line fitted to all others, from totals less the group's own sums, and its mean error."""
    sums = df.groupBy(group).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"),
        F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(x) * F.col(y)).alias("sxy"),
    )
    every = Window.partitionBy()
    rest = {c: F.sum(c).over(every) - F.col(c) for c in ("n", "sx", "sy", "sxx", "sxy")}
    sums = sums.select(group, *[v.alias(c) for c, v in rest.items()])
    det = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / det
    fit = sums.select(group, slope.alias("slope"), ((F.col("sy") - slope * F.col("sx")) / F.col("n")).alias("icept"))
    error = F.abs(F.col(y) - F.col("slope") * F.col(x) - F.col("icept"))
    return df.join(F.broadcast(fit) if fit.count() <= 100_000 else fit, group).groupBy(group).agg(
        F.first("slope").alias("slope"), F.first("icept").alias("intercept"), F.avg(error).alias("mae"),
        F.avg(F.abs(F.col(y) - F.col(x))).alias("mae_before"),
    )


def robust_fusion(df: DataFrame, key: Sequence[str], value: str, floor: float, factor: float) -> DataFrame:
    """Median after dropping values beyond max(floor, factor * MAD) of the median; under 3 values none is dropped."""
    w = Window.partitionBy(*key)
    df = df.withColumn("_m", F.median(value).over(w)).withColumn("_n", F.count(value).over(w))
    df = df.withColumn("_d", F.abs(F.col(value) - F.col("_m")))
    df = df.withColumn("_tol", F.greatest(F.lit(floor), factor * F.median("_d").over(w)))
    kept = df.where((F.col("_n") < 3) | (F.col("_d") <= F.col("_tol")))
    return kept.groupBy(*key).agg(
        F.median(value).alias("fused"), F.count(value).alias("used"), (F.max(value) - F.min(value)).alias("spread"),
        F.first("_n").alias("shots"),
    )


def accept_threshold(df: DataFrame, p: str, y: str, target: float) -> DataFrame:
    """The lowest score from which running accuracy (best first) still meets the target, over distinct scores."""
    s = df.groupBy(p).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("hit"))
    s = running_sums(s, [], [F.desc(p)], ["n", "hit"])
    met = s.where(F.col("hit_upto") / F.col("n_upto") >= target)
    return met.agg(F.min(p).alias("tau"), F.max("n_upto").alias("accepted"))
