"""Estimate operators on small frames and edge cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import estimates


def test_square_measures(spark):
    df = spark.sql("select array(struct(0d x, 0d y), struct(2d x, 0d y), struct(2d x, 3d y), struct(0d x, 3d y)) s")
    assert df.select(*estimates.polygon_measures("s", 6)).collect()[0][:] == (6.0, 10.0, 2.0, 3.0)


def test_neighbours_count_copies_and_borders(spark):
    rows = [(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 0.99, 0.0), (4, -0.5, 0.0), (5, 9.0, 9.0)]
    got = estimates.neighbours_within(spark.createDataFrame(rows, "k int, x double, y double"), "k", "x", "y", 1.0)
    assert dict(map(tuple, got.collect())) == {1: 3, 2: 3, 3: 2, 4: 2, 5: 0}


def test_quotes_across_white_space_and_empty_sides(spark):
    q = spark.createDataFrame([(1, "One two\nthree FOUR five six"), (2, "too short"), (3, None)], "i int, t string")
    d = spark.createDataFrame([(7, "x one  two three four five six y"), (8, "one two three four five sixty"), (9, None)], "d int, t string")
    got = estimates.quoted_sources(q, d, "i", "t", "d", "t")
    assert {r[0]: (r["n_sources"], r["first_source"]) for r in got.collect()} == {1: (1, 7), 2: (0, None), 3: (0, None)}
    assert estimates.quoted_sources(q, d.limit(0), "i", "t", "d", "t").where("n_sources > 0").count() == 0


def test_lookup_clips_and_rates_pool(spark):
    p = spark.createDataFrame([(-1.0,), (0.25,), (2.0,)], "p double")
    got = p.select(estimates.piecewise_linear(F.col("p"), [(0.0, 0.0), (0.5, 1.0)])).collect()
    assert [r[0] for r in got] == [0.0, 0.5, 1.0]
    h = spark.createDataFrame([("a", True), ("a", False), ("b", True)], "g string, h boolean")
    assert {r[0]: r["rate"] for r in estimates.pooled_rate(h, "g", "h", 2, 4).collect()} == {"a": 0.5, "b": 0.6667}


def test_tiers_prefer_the_strictest(spark):
    left = spark.createDataFrame([(1, "x", 1), (2, "x", 9), (3, "z", 1)], "k int, a string, b int")
    right = spark.createDataFrame([(5, "x", 2), (6, "x", 1)], "t int, a string, b int")
    got = estimates.tiered_match(left, right, "t", [(["a", "b"], 1.0), (["a"], 0.5)])
    assert {r.k: (r.t, r.confidence) for r in got.collect()} == {1: (6, 1.0), 2: (5, 0.5), 3: (None, None)}
