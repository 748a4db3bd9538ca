"""Ranks, running sums and quantiles against brute force, over many ranges."""

from __future__ import annotations

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from weft.operators import panel, ranks, stats

SCHEMA = "g string, v double, k long, other string"


@pytest.fixture
def many_ranges(spark):
    """One group with nearly all rows, ties, null groups and values; ranges that adaptive execution leaves apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rng = random.Random(5)
    groups = ["hot"] * 2000 + ["b"] * 7 + [None] * 40
    rows = [(g, rng.choice([None, 3.0, 3.0, rng.random() * 9]), rng.randrange(3), "x") for g in groups]
    yield rows + [("nulls", None, 2, "x"), ("one", 4.5, 1, None)]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _interpolated(values: list[float], p: float) -> float | None:
    if not values:
        return None
    at = Fraction(p) * (len(values) - 1)
    low, high = values[int(at)], values[-(-at.numerator // at.denominator)]
    return low + (high - low) * float(at - int(at))


@pytest.mark.parametrize("times", [None, "k"])
def test_quantiles(spark, many_ranges, times):
    df = spark.createDataFrame(many_ranges, SCHEMA)
    points = {"least": 0.0, "fifth": 0.05, "mid": 0.5, "most": 1.0}
    rows = ranks.quantiles(df, ["g"], "v", points, {"n": F.lit(1), "k_sum": F.col("k")}, times).collect()
    assert len(rows) == 5
    for r in rows:
        own = [x for x in many_ranges if x[0] == r["g"]]
        values = sorted(x[1] for x in own if x[1] is not None for _ in range(x[2] if times else 1))
        for name, p in points.items():
            want = _interpolated(values, p)
            assert r[name] == (None if want is None else pytest.approx(want, abs=1e-9))
        assert (r["n"], r["k_sum"]) == (len(own), sum(x[2] for x in own))


def test_running_sums_spread_a_hot_group(spark, many_ranges):
    rows = [(g, v, k, str(i)) for i, (g, v, k, _) in enumerate(many_ranges)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = ranks.running_sums(df, ["g"], [F.desc("v"), F.col("other")], ["k"])
    assert out.columns == [*df.columns, "k_upto", "k_all"]
    got = {r["other"]: (r["k_upto"], r["k_all"]) for r in out.collect()}
    for g in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is None, -(x[1] or 0), x[3]))
        total = 0
        for x in own:
            total += x[2]
            assert got[x[3]] == (total, sum(y[2] for y in own))
    ranges = df.repartitionByRange("g", F.desc("v"), "other").where("g = 'hot'").select(F.spark_partition_id()).distinct()
    assert ranges.count() > 1


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert ranks.running_sums(df, ["g"], [F.col("v")], ["k"]).count() == 0
    assert ranks.quantiles(df, ["g"], "v", {"mid": 0.5}).count() == 0
    assert panel.top_budget(df, 0.5, [F.col("v")]).count() == 0
    assert stats.accept_threshold(df.select("v", "k"), "v", "k", 0.5).collect()[0]["tau"] is None


def test_budget_of_equal_rows(spark):
    df = spark.createDataFrame([(1,)] * 5 + [(2,)] * 5, "x long")
    assert [r[0] for r in panel.top_budget(df, 0.7, [F.desc("x")]).orderBy("x").collect()] == [1, 1, 2, 2, 2, 2, 2]
