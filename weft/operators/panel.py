"""Panel operators: consecutive pairs, growth, as-of joins, decomposition, price indices, windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import running_sums

YEAR_DAYS = 365.25


def consecutive_pairs(df: DataFrame, key: Sequence[str], order: Sequence[str], carry: Sequence[str], time: str) -> DataFrame:
    """Adds prev_<c> for each carried column, and gap_years to the previous row of the key; one window for all."""
    w = Window.partitionBy(*key).orderBy(*order)
    before = F.lag(F.struct(*dict.fromkeys([*carry, time]))).over(w)
    df = df.withColumn("_before", before)
    for c in carry:
        df = df.withColumn(f"prev_{c}", F.col(f"_before.{c}"))
    gap = F.datediff(F.col(time), F.col(f"_before.{time}")) / YEAR_DAYS
    return df.withColumn("gap_years", gap).drop("_before")


def annualised_growth(now: Column, before: Column, years: Column) -> Column:
    """Percent a year; null unless both levels and the gap are positive."""
    valid = (now > 0) & (before > 0) & (years > 0)
    return F.when(valid, (F.pow(now / before, 1 / years) - 1) * 100)


def pair_flags(low: float = 0.5, high: float = 2.5) -> dict[str, Column]:
    """Reasons that make a pair invalid, kept as columns; the bounds themselves are invalid."""
    gap = F.col("gap_years")
    return {
        "is_first": gap.isNull(), "too_close": F.coalesce(gap <= low, F.lit(False)),
        "too_far": F.coalesce(gap >= high, F.lit(False)),
    }


def asof_backward(
    left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, carry: Sequence[str],
    tolerance_seconds: int | None = None, right_tie: str | None = None,
) -> DataFrame:
    """For each left row the latest right row of its key at or before its time: union and one window, no range join.

    Equal right times: the greatest right_tie. Beyond the tolerance the carried columns are null. Null keys and null times
    match nothing, as in a join; left rows always stay.
    """
    tie = [right_tie] if right_tie else []
    fields = [F.col(c) for c in dict.fromkeys([right_time, *tie, *carry])]
    for c in (*by, right_time):
        right = right.where(F.col(c).isNotNull())
    r = right.select(*by, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(*fields).alias("_r"),
                     *[F.col(c).alias("_tie") for c in tie])
    l_ = left.withColumns({"_t": F.col(left_time), "_side": F.lit(1)})
    rows = l_.unionByName(r, allowMissingColumns=True)
    order = [F.col("_t"), F.col("_side"), *([F.col("_tie")] if tie else [])]
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_hit", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    if tolerance_seconds is not None:
        age = F.unix_micros(F.col("_t").cast("timestamp")) - F.unix_micros(F.col(f"_hit.{right_time}").cast("timestamp"))
        rows = rows.withColumn("_hit", F.when(age <= tolerance_seconds * 1_000_000, F.col("_hit")))
    return rows.select(*[F.col(c) for c in left.columns], *[F.col(f"_hit.{c}").alias(f"r_{c}") for c in carry])


def mix_decomposition(df: DataFrame, period: str, segment: Sequence[str], value: str) -> DataFrame:
    """Change of the mean between periods as within + recomposition + entry, which add up exactly."""
    seg = df.groupBy(period, *segment).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"))
    total = Window.partitionBy(period)
    seg = seg.withColumn("share", F.col("n") / F.sum("n").over(total)).withColumn("mean", F.col("s") / F.col("n"))
    before = seg.select((F.col(period) + 1).alias(period), *segment, F.col("share").alias("share0"),
                        F.col("mean").alias("mean0"))
    both = seg.select(period, *segment, "share", "mean").join(before, [period, *segment], "full_outer")
    zero = F.lit(0.0)
    matched = F.col("mean").isNotNull() & F.col("mean0").isNotNull()
    share, share0 = F.coalesce("share", zero), F.coalesce("share0", zero)
    within = F.when(matched, (share + share0) / 2 * (F.col("mean") - F.col("mean0"))).otherwise(zero)
    mixed = F.when(matched, (share - share0) * (F.col("mean") + F.col("mean0")) / 2).otherwise(zero)
    entry = F.when(matched, zero).otherwise(share * F.coalesce("mean", zero) - share0 * F.coalesce("mean0", zero))
    out = both.groupBy(period).agg(
        F.sum(within).alias("within"), F.sum(mixed).alias("recomposition"), F.sum(entry).alias("entry"),
        F.sum(share * F.coalesce("mean", zero)).alias("mean"), F.sum(share0 * F.coalesce("mean0", zero)).alias("mean_before"),
        F.count("mean").alias("here"), F.count("mean0").alias("there"),
    )
    return out.where("here > 0 and there > 0").drop("here", "there")


def fisher_index(df: DataFrame, period: str, segment: Sequence[str], price: str, quantity: str) -> DataFrame:
    """Fisher growth between periods on matched segments: sqrt(Laspeyres * Paasche) - 1, in percent."""
    seg = df.groupBy(period, *segment).agg(
        (F.sum(F.col(price) * F.col(quantity)) / F.sum(quantity)).alias("p1"), F.sum(quantity).alias("q1")
    )
    before = seg.select((F.col(period) + 1).alias(period), *segment, F.col("p1").alias("p0"), F.col("q1").alias("q0"))
    both = seg.join(before, [period, *segment])
    cross = lambda p, q: F.sum(F.col(p) * F.col(q))
    growth = F.sqrt(cross("p1", "q0") / cross("p0", "q0") * cross("p1", "q1") / cross("p0", "q1")) - 1
    return both.groupBy(period).agg((growth * 100).alias("fisher_pct"), F.count(F.lit(1)).alias("segments"))


def weighted_percentile(df: DataFrame, by: Sequence[str], value: str, weight: str, p: float) -> DataFrame:
    """The smallest value whose cumulative weight reaches p of the total (a step, not interpolated).

    A null or negative weight is an error; a weight of 0 counts for nothing, groups of such alone give no row.
    Equal values are summed first, then a group's values lie in as many ranges as they need.
    """
    wrong = F.col(weight).isNull() | F.isnan(weight) | (F.col(weight) < 0)
    checked = F.when(wrong, F.raise_error(F.lit(f"{weight}: weights must not be null or negative"))).otherwise(F.col(weight))
    v = df.withColumn(weight, checked).where(F.col(weight) > 0).groupBy(*by, value).agg(F.sum(weight).alias("_w"))
    v = running_sums(v, by, [F.col(value)], ["_w"])
    return v.groupBy(*by).agg(F.min(F.when(F.col("_w_upto") >= p * F.col("_w_all") - 1e-9, F.col(value))).alias("value"))


def sessions(df: DataFrame, key: Sequence[str], time: str, order: Sequence[str], gap_seconds: int) -> DataFrame:
    """Gap-based grouping: session number from 0 within the key; a longer gap than gap_seconds starts a new one."""
    w = Window.partitionBy(*key).orderBy(*order)
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    new = F.coalesce((micros - F.lag(micros).over(w) > gap_seconds * 1_000_000).cast("int"), F.lit(0))
    df = df.withColumn("_new", new)
    return df.withColumn("session", F.sum("_new").over(w).cast("long")).drop("_new")


def top_budget(df: DataFrame, share: float, order: Sequence[Column]) -> DataFrame:
    """The first half-even round(share * n) rows by a total order, by their running number; in no order."""
    n = df.count()
    from decimal import ROUND_HALF_EVEN, Decimal

    take = int((Decimal(str(share)) * n).quantize(Decimal(1), ROUND_HALF_EVEN))
    numbered = running_sums(df.withColumn("_one", F.lit(1)), [], order, ["_one"])
    return numbered.where(F.col("_one_upto") <= take).select(*df.columns)


def first_k(df: DataFrame, key: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
