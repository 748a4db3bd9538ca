"""Running sums, ranks and quantiles in the order of values, where one group may hold all rows.

Rows are written once, in ranges of (group, order), so a group spreads over as many tasks as its rows need. What each
range adds to the ranges after it is a table of at most one row a range more than there are groups; within a range a
window adds up. Nulls sort first and null groups are a group; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import shared_table


def running_sums(df: DataFrame, by: Sequence[str], order: Sequence[Column], sums: Sequence[str]) -> DataFrame:
    """Adds for each column of `sums` its sum up to and with the row, `<c>_upto`, and over the group, `<c>_all`.

    Rows that are equal in `by` and `order` stay in one range, in any order: make them one row first where they are many.
    Null addends count for nothing. Columns that begin with `_in_` or are named `_range` are taken.
    """
    ranged = shared_table(df.repartitionByRange(*map(F.col, by), *order).withColumn("_range", F.spark_partition_id()))
    own = ranged.groupBy(*by, "_range").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"_in_{c}") for c in sums])
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = own.select(
        *[F.col(c).alias(f"_in_by_{c}") for c in by], F.col("_range").alias("_in_range"),
        *[F.coalesce(F.sum(f"_in_{c}").over(earlier), F.lit(0)).alias(f"_in_before_{c}") for c in sums],
        *[F.sum(f"_in_{c}").over(group).alias(f"{c}_all") for c in sums],
    )
    same = F.col("_range") == F.col("_in_range")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_in_by_{c}"))
    here = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = {f"{c}_upto": F.coalesce(F.sum(c).over(here), F.lit(0)) + F.col(f"_in_before_{c}") for c in sums}
    out = ranged.join(totals, same).withColumns(upto)
    return out.select(*df.columns, *[f"{c}_{k}" for c in sums for k in ("upto", "all")])


def quantiles(
    df: DataFrame, by: Sequence[str], value: str, points: dict[str, float], sums: dict[str, Column] | None = None,
    times: str | None = None,
) -> DataFrame:
    """Exact interpolated quantiles of each group's values, as `percentile` gives them, and sums over all its rows.

    `times` names a column that says how often a row counts (whole, not negative). Null values take no part in quantiles; a
    group of nulls alone has null quantiles. Equal values are counted before they are dealt to ranges.
    """
    sums, often = sums or {}, F.col(times) if times else F.lit(1)
    counts = df.groupBy(*by, value).agg(
        F.sum(F.when(F.col(value).isNotNull(), often).otherwise(0)).alias("_n"), *[F.sum(c).alias(k) for k, c in sums.items()]
    )
    run = running_sums(counts, by, [F.col(value)], ["_n"])
    found = between(run, by, value, "_n", {name: (p, F.lit(0), "_n_all") for name, p in points.items()}, list(sums))
    return found.select(*by, *points, *sums)


def between(
    run: DataFrame, by: Sequence[str], value: str, n: str, points: dict[str, tuple[float, Column, str]],
    sums: Sequence[str] = (),
) -> DataFrame:
    """Values of each group at the points p of the ranks from a start on: name to (p, start, column with how many).

    `run` has running sums of `n`, how often each value occurs. Between two ranks it interpolates; no ranks give null.
    """
    upto, found = F.col(f"{n}_upto"), []
    for name, (p, start, many) in points.items():
        at = p * (F.col(many) - 1)
        for side, k in (("low", F.floor(at)), ("high", F.ceil(at))):
            holds = (F.col(many) > 0) & (start + k < upto) & (start + k >= upto - F.col(n))
            found.append(F.max(F.when(holds, F.col(value))).alias(f"_{side}_{name}"))
        found.append(F.max(at - F.floor(at)).alias(f"_part_{name}"))
    out = run.groupBy(*by).agg(*found, *[F.sum(c).alias(c) for c in sums])
    at = lambda c: F.col(f"_low_{c}") + (F.col(f"_high_{c}") - F.col(f"_low_{c}")) * F.col(f"_part_{c}")
    return out.select(*by, *[at(c).alias(c) for c in points], *sums)
