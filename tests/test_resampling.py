"""Draws of units against copies of their rows, and the defined results at the edges."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from weft.operators import models, resampling

PAIRS = "unit int, year0 int, year1 int, gap double, y double"


def often(spark, units, draws):
    df = spark.createDataFrame([(u, d) for u in units for d in range(draws + 1)], "unit int, draw int")
    return {(r["unit"], r["draw"]): r["w"] for r in df.select("unit", "draw", resampling.multiplicity(F.col("draw"), F.col("unit")).alias("w")).collect()}


def test_multiplicities_have_mean_and_variance_one(spark):
    w = np.array([k for (_, d), k in often(spark, range(2000), 5).items() if d])
    assert abs(w.mean() - 1) < 0.05 and abs(w.var() - 1) < 0.1 and w.max() > 3


def test_index_draws_equal_refits_of_copied_rows(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(300):
        a = rnd.randrange(2000, 2004)
        b = rnd.randrange(a + 1, 2006)
        rows.append((i % 40, a, b, b - a + rnd.random() / 9, 0.03 * (b - a) + rnd.gauss(0, 0.02 * (b - a))))
    years = list(range(2000, 2006))
    odd = [(1, 1990, 2001, 1.0, 9.0), (1, 2000, 2001, 1.0, None), (None, 2000, 2001, 1.0, 9.0), (1, 2001, 2001, 0.1, 9.0)]
    got = resampling.index_draws(spark.createDataFrame(rows + odd, PAIRS), "unit", years, 3).collect()
    w = often(spark, range(40), 3)
    for d in range(4):
        copies = spark.createDataFrame([r[1:] for r in rows for _ in range(w[r[0], d])], PAIRS.split(", ", 1)[1])
        expected = {r["year"]: r["growth_pct"] for r in models.repeat_index(copies, years).collect()}
        mine = {r["year"]: r["growth_pct"] for r in got if r["draw"] == d}
        assert mine.keys() == expected.keys() and all(abs(mine[y] - expected[y]) < 1e-6 for y in mine)
    assert resampling.index_draws(spark.createDataFrame([], PAIRS), "unit", years, 2).count() == 0


def test_medians_weigh_units_and_keep_empty_draws(spark):
    rnd = random.Random(2)
    rows = [(k % 2, rnd.randrange(30), float(rnd.randrange(50))) for k in range(400)] + [(0, None, 1.0), (1, 3, None), (2, 7, 5.0)]
    df = spark.createDataFrame(rows, "g int, unit int, v double")
    got = {(r["g"], r["draw"]): (r["median"], r["n"]) for r in resampling.bootstrap_medians(df, ["g"], "unit", "v", 6).collect()}
    w = often(spark, range(30), 6)
    for g in range(3):
        for d in range(7):
            values = sorted(v for h, u, v in rows if h == g and u is not None and v is not None for _ in range(w[u, d]))
            assert got[g, d] == (values[(len(values) + 1) // 2 - 1] if values else None, len(values))
    assert any(n == 0 for _, n in got.values())
    assert resampling.bootstrap_medians(df.limit(0), ["g"], "unit", "v", 1).count() == 0


def test_segments_and_cube_at_the_edges(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 0.0), (1, "a", 3.0, 0.0), (1, None, 5.0, 2.0), (1, "a", None, 1.0)], "draw int, s string, v double, w double")
    got = {(r["whole"], r["s"]): (r["units"], r["median"], r["weighted"]) for r in resampling.summarised_draws(df, ["s"], "v", "w").collect()}
    assert got == {(True, None): (3, 3.0, 5.0), (False, "a"): (2, 2.0, None), (False, None): (1, 5.0, 5.0)}
    assert resampling.summarised_draws(df.limit(0), ["s"], "v", "w").count() == 0
    rows = spark.createDataFrame([(2000, 1.0, float(v), 1.0) for v in range(21)] + [(2000, 5.0, 99.0, 1.0), (2000, None, 99.0, 1.0)], "year int, gap double, v double, w double")
    cube = {r["policy"]: (r["n"], r["median"], r["mean"]) for r in resampling.sensitivity(rows, {"w": (0.5, 5.0)}, "gap", "year", "v", "w", 0.05).collect()}
    assert cube == {"keep": (21, 10.0, 10.0), "winsorise": (21, 10.0, 10.0), "trim": (19, 10.0, 10.0)}
