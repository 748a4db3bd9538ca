"""Booklets, hulls, curves and maps against brute force and numpy."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import booklets, geometry
from weft.plans import shapes as queries

SF = "/root/testdata/sf0.001"
OPTIONS = "b int, at int, o array<struct<reading:double,cost:long>>"


def cheapest(fields, low, high, miss):
    """The least (cost, choices) over all assignments."""
    best = None
    for choice in itertools.product(*[range(len(o) + 1) for o in fields]):
        cost, last, ok = 0, None, True
        for o, k in zip(fields, choice, strict=True):
            value, price = o[k] if k < len(o) else (None, miss)
            cost += price
            if value is not None:
                ok &= last is None or low <= value - last <= high
                last = value
        if ok and (best is None or (cost, choice) < best):
            best = cost, choice
    return best


def test_booklets_equal_all_assignments(spark):
    rnd = random.Random(3)
    rows = [(b, i, [(float(rnd.randrange(12)), rnd.randrange(4)) for _ in range(rnd.randrange(4))]) for b in range(60) for i in range(rnd.randrange(1, 6))]
    rows += [(100, 0, None), (101, 0, [(None, 1), (2.0, None), (3.0, 0)])]
    got = {r["b"]: r for r in booklets.repaired(spark.createDataFrame(rows, OPTIONS), "b", "at", "o", 0, 4, 3, 5).collect()}
    clean = lambda o: [x for x in o or [] if None not in x]
    for b in {r[0] for r in rows}:
        fields = [clean(o) for k, _, o in rows if k == b]
        cost, choice = cheapest(fields, 0, 4, 3)
        assert (got[b]["cost"], tuple(got[b]["chosen"]), got[b]["flagged"]) == (cost, choice, cost > 5)
        assert got[b]["readings"] == [o[k][0] if k < len(o) else None for o, k in zip(fields, choice, strict=True)]
    assert booklets.repaired(spark.createDataFrame([], OPTIONS), "b", "at", "o", 0, 4, 3, 5).count() == 0


def test_booklets_of_orders_equal_all_assignments(spark):
    fields = {}
    for r in sorted(queries._fields(spark, SF).where("l_orderkey < 300").collect(), key=lambda r: (r["l_orderkey"], r["at"])):
        fields.setdefault(r["l_orderkey"], []).append([(o["reading"], o["cost"]) for o in r["options"]])
    got = {r["l_orderkey"]: r for r in queries.booklet_repair(spark, SF).collect()}
    for key, own in fields.items():
        if len(own) <= 5:
            cost, choice = cheapest(own, 0, 60, 5)
            assert (got[key]["cost"], got[key]["chosen"]) == (cost, ",".join(map(str, choice)))
    assert 0 < sum(r["flagged"] for r in got.values()) < len(got)


def test_booklets_of_a_batch_go_together(spark):
    rnd = random.Random(8)
    values = [math.nan, math.inf, 0.0, -0.0, *map(float, range(-3, 9))]
    rows = [(b, i, [(rnd.choice(values), rnd.randrange(3)) for _ in range(rnd.randrange(6) * (b % 7 > 0))]) for b in range(120) for i in range(1 + b % 6)]
    out = booklets.repaired(spark.createDataFrame(rows, OPTIONS), "b", "at", "o", -1, 4, 2, 5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "aggregate(" not in plan.replace("HashAggregate(", "").replace("ObjectHashAggregate(", "")
    got = {r["b"]: r for r in out.collect()}
    assert len(got) == 120
    for b in got:
        fields = [o for k, _, o in rows if k == b]
        cost, choice = cheapest(fields, -1, 4, 2)
        assert (got[b]["cost"], tuple(got[b]["chosen"])) == (cost, choice)
        assert str(got[b]["readings"]) == str([o[k][0] if k < len(o) else None for o, k in zip(fields, choice, strict=True)])


def brute_rectangle(points):
    """The least area over many angles, a bound from above."""
    p = np.array(points)
    turns = np.linspace(0, np.pi / 2, 20_001)
    u = np.stack([np.cos(turns), np.sin(turns)], 1)
    return (np.ptp(p @ u.T, axis=0) * np.ptp(p @ np.stack([-u[:, 1], u[:, 0]]), axis=0)).min()


@pytest.mark.parametrize("parts", [1, 7])
def test_rectangles_equal_a_scan_of_angles(spark, parts):
    rnd = random.Random(parts)
    groups = {"hot": [(rnd.gauss(0, 3), rnd.gauss(0, 1)) for _ in range(3000)], "grid": [(float(i), float(j)) for i in range(5) for j in range(4)],
              "line": [(float(i), 2.0 * i) for i in range(9)], "one": [(1.0, 2.0)] * 3, None: [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)]}
    rows = [(g, x, y) for g, ps in groups.items() for x, y in ps] + [("hot", None, 1.0), ("hot", float("nan"), 1.0), ("hot", float("inf"), 0.0), ("bad", None, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(6)
    got = {r["g"]: r for r in geometry.rectangles(df, "g", "x", "y", parts).collect()}
    assert set(got) == set(groups)
    for g in ("hot", "grid", None):
        least = brute_rectangle(groups[g])
        assert got[g]["area"] <= least + 1e-9 and got[g]["area"] > least * 0.999
        assert got[g]["length"] * got[g]["width"] == pytest.approx(got[g]["area"]) and got[g]["length"] >= got[g]["width"]
        u = np.array([math.cos(math.radians(got[g]["angle"])), math.sin(math.radians(got[g]["angle"]))])
        assert np.ptp(np.array(groups[g]) @ u) == pytest.approx(got[g]["length"])
    assert got["grid"]["corners"] == 4 and got["line"]["area"] == pytest.approx(0) and got["line"]["length"] == pytest.approx(math.hypot(8, 16))
    assert (got["one"]["corners"], got["one"]["area"]) == (1, 0)
    # what goes on from the tasks are corners only
    assert len(geometry.hull_of(np.array(groups["hot"]))) < 60


def resample(points, n):
    p = np.array([*points, points[0]])
    length = np.r_[0, np.cumsum(np.hypot(*np.diff(p, axis=0).T))]
    at = np.arange(n) * length[-1] / n
    return np.stack([np.interp(at, length, p[:, c]) for c in (0, 1)], 1)


def test_curves_equal_numpy(spark):
    rnd = random.Random(5)
    curves = {k: [(rnd.gauss(0, 2) + 9 * math.cos(i / n * 6.28), rnd.gauss(0, 2) + 5 * math.sin(i / n * 6.28)) for i in range(n)] for k, n in enumerate((3, 17, 400))}
    curves[7] = [(2.0, 3.0)] * 4
    rows = [(k, i, x, y) for k, ps in curves.items() for i, (x, y) in enumerate(ps)] + [(0, 9, None, 1.0)]
    df = spark.createDataFrame(rows, "k int, i int, x double, y double").repartition(5)
    found = geometry.resampled(df, "k", "i", "x", "y", 32)
    got = {(r["k"], r["j"]): (r["x"], r["y"]) for r in found.collect()}
    smooth = {(r["k"], r["j"]): (r["x"], r["y"]) for r in geometry.low_pass(found, "k", 32, 5).collect()}
    assert len(got) == len(smooth) == 32 * len(curves)
    for k, ps in curves.items():
        want = resample(ps, 32) if k != 7 else np.full((32, 2), (2.0, 3.0))
        assert np.allclose([got[k, j] for j in range(32)], want)
        waves = np.fft.rfft(want, axis=0)
        waves[6:] = 0
        assert np.allclose([smooth[k, j] for j in range(32)], np.fft.irfft(waves, 32, axis=0))


def test_spikes_go_and_corners_stay(spark):
    rows = [(1, 0, 0.0, 0.0), (1, 1, 1.0, 0.0), (1, 2, 2.0, 50.0), (1, 3, 3.0, 0.0), (1, 4, 40.0, 0.0), (1, 5, 80.0, 30.0)]
    df = spark.createDataFrame(rows, "k int, i int, x double, y double")
    kept = geometry.without_spikes(df, "k", ["i"], "x", "y", 5.0)
    assert sorted(r["i"] for r in kept.collect()) == [0, 1, 3, 4, 5] and kept.columns == ["k", "i", "x", "y"]


def test_the_planted_map_is_found_among_outliers(spark):
    got = sorted(queries.planted_map(spark, SF).collect())
    assert [r["number"] for r in got] == pytest.approx(queries.PLANTED, abs=1e-4)
    m = queries._marks(spark, SF).where(F.xxhash64(F.lit("wrong"), "vec_id") % 4 != 0).count()
    assert m <= got[0]["pairs"] <= m + 5


def test_the_refit_equals_least_squares(spark):
    rng = np.random.default_rng(8)
    xy = rng.uniform(-5, 5, (200, 2))
    h = np.array([1.0, 0.2, 3.0, -0.1, 0.9, 1.0, 0.01, 0.02])
    w = xy @ h[6:] + 1
    uv = np.stack([(xy @ h[:2] + h[2]) / w, (xy @ h[3:5] + h[5]) / w], 1) + rng.normal(0, 0.01, (200, 2))
    rows = [(i, *map(float, (*p, *q))) for i, (p, q) in enumerate(zip(xy, uv, strict=True))]
    df = spark.createDataFrame([*rows, (900, None, 1.0, 1.0, 1.0)], "id int, x double, y double, u double, v double")
    fit, n = geometry.consensus_map(df, "id", 16, 10.0)
    assert n >= 190
    # all agree within ten, so that the refit is the fit to all
    assert n < 200 or fit == pytest.approx(geometry.solved(np.array([r[1:] for r in rows])).tolist(), abs=1e-6)
    with pytest.raises(ValueError, match="no four pairs"):
        geometry.consensus_map(df.limit(3), "id")
