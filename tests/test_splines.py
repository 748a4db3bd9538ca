"""B-splines against their recurrence and least squares in numpy."""

from __future__ import annotations

import random

import numpy as np
import pytest

from weft.operators import splines


def recurrence(x, i, p, t):
    if p == 0:
        return float(t[i] <= x < t[i + 1] or (x == t[-1] and t[i] < t[i + 1] == t[-1]))
    a = (x - t[i]) / (t[i + p] - t[i]) * recurrence(x, i, p - 1, t) if t[i + p] > t[i] else 0.0
    b = (t[i + p + 1] - x) / (t[i + p + 1] - t[i + 1]) * recurrence(x, i + 1, p - 1, t) if t[i + p + 1] > t[i + 1] else 0.0
    return a + b


def design(xs, axes):
    out = np.ones((len(xs), 1))
    for c, a in enumerate(axes):
        x = np.clip(xs[:, c], a.knots[0], a.knots[-1])
        own = np.array([[recurrence(v, i, a.degree, a.full) for i in range(a.size)] for v in x])
        out = (out[:, :, None] * own[:, None, :]).reshape(len(xs), -1)
    return out


def rows(spark):
    rnd = random.Random(1)
    made = [(rnd.uniform(-1, 6), float(rnd.randrange(5)), rnd.gauss(0, 1)) for _ in range(300)] + [(0.0, 4.0, 1.0), (5.0, 0.0, 2.0), (2.5, 2.0, -1.0)]
    made = [(a, b, y + a * a - a * b) for a, b, y in made]
    return made, spark.createDataFrame([*made, (None, 1.0, 1.0), (1.0, None, 1.0), (1.0, 1.0, None)], "a double, b double, y double")


@pytest.mark.parametrize("axes", [
    [splines.Axis("a", [0.0, 1.0, 2.5, 5.0])], [splines.Axis("a", [0.0, 5.0], 1)], [splines.Axis("a", [0.0, 2.0, 5.0], 2), splines.Axis("b", [0.0, 1.5, 4.0], 3)],
])
def test_equations_fit_and_prediction_equal_numpy(spark, axes):
    made, df = rows(spark)
    used = made if len(axes) > 1 else [*made, (1.0, None, 1.0)]
    xs, y = np.array([[r["ab".index(a.feature)] for a in axes] for r in used], float), np.array([r[2] for r in used])
    d = design(xs, axes)
    assert np.allclose(d.sum(1), 1)
    g, b, n = splines.normal_equations(df, axes, "y")
    assert n == len(used) and np.allclose(g, d.T @ d) and np.allclose(b, d.T @ y)
    c = splines.fitted(df, axes, "y", 3.0)
    penalty = splines.difference_penalty(axes)
    assert np.allclose((d.T @ d + 3 * penalty) @ c, d.T @ y)
    got = splines.predicted(df.where("y is not null"), axes, c, "p")
    assert got.columns == ["a", "b", "y", "p"]
    by_row = {(r["a"], r["b"]): r["p"] for r in got.collect()}
    assert all(by_row[u[0], u[1]] == pytest.approx(float(v)) for u, v in zip(used, d @ c, strict=True))
    assert by_row[None, 1.0] is None


def test_penalty_of_a_plane_is_none():
    axes = [splines.Axis("a", [0.0, 1.0, 2.0, 3.0]), splines.Axis("b", [0.0, 1.0, 2.0])]
    plane = np.add.outer(2.0 * np.arange(6), -3.0 * np.arange(5)).reshape(-1)
    assert np.allclose(splines.difference_penalty(axes) @ plane, 0)


def test_knots_are_quantiles(spark):
    _, df = rows(spark)
    made = [r["a"] for r in df.select("a").collect() if r["a"] is not None]
    assert splines.quantile_knots(df, "a", 4) == pytest.approx(np.quantile(made, [0, 0.25, 0.5, 0.75, 1]).tolist())
    with pytest.raises(ValueError, match="two different"):
        splines.quantile_knots(df.where("b = 1").selectExpr("b"), "b", 4)
    with pytest.raises(ValueError, match="no rows"):
        splines.fitted(df.limit(0), [splines.Axis("a", [0.0, 1.0])], "y")
