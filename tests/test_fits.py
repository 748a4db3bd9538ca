"""Fits on small tables: nulls, ties, empty tables, bounds that are proven."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import fits


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(800, 2)).round(1)
    hit = rng.random(800) < 1 / (1 + np.exp(-(0.4 + 1.5 * x[:, 0] - 0.7 * x[:, 1])))
    data = [(float(a), float(b), int(h), i % 4) for i, ((a, b), h) in enumerate(zip(x, hit, strict=True))]
    return spark.createDataFrame(data + [(None, 1.0, 1, 0), (1.0, None, 0, 1), (1.0, 1.0, None, 2)], "a double, b double, hit int, fold int")


def local(rows, *columns):
    return np.array(rows.dropna().select(*columns).toPandas(), float)


def test_least_squares_as_numpy(rows):
    data = local(rows, "a", "b", "hit")
    g = fits.gram(rows, [F.lit(1.0), F.col("a"), F.col("b")], F.col("hit"))[()]
    design = np.column_stack([np.ones(len(data)), data[:, :2]])
    assert np.allclose(fits.solve(g), np.linalg.lstsq(design, data[:, 2], rcond=None)[0])
    assert np.allclose(fits.solve(g, 3.0), np.linalg.solve(design.T @ design + np.diag([0, 3, 3]), design.T @ data[:, 2]))


def test_cross_validation_as_separate_fits(rows):
    data, lost = local(rows, "a", "b", "hit", "fold"), 0.0
    design = np.column_stack([np.ones(len(data)), data[:, :2]])
    for f in range(4):
        held = data[:, 3] == f
        w = np.linalg.lstsq(design[~held], data[~held, 2], rcond=None)[0]
        lost += ((data[held, 2] - design[held] @ w) ** 2).sum()
    found = fits.cross_validated(rows, [F.lit(1.0), F.col("a"), F.col("b")], F.col("hit"), F.col("fold"), {"one": [0, 1], "two": [0, 1, 2]}, [0.0, 5.0])
    assert [m for *_, m in found] == sorted(m for *_, m in found)
    assert {f[:2]: f[2] for f in found}[("two", 0.0)] == pytest.approx(lost / len(data))


@pytest.mark.parametrize(("link", "floor"), [("logistic", 0.0), ("probit", 0.0), ("logistic", 0.05), ("probit", 0.1)])
def test_likelihood_is_at_its_peak(rows, link, floor):
    data = local(rows, "a", "b", "hit")

    def loss(w):
        z = w[0] + data[:, :2] @ w[1:]
        p = 1 / (1 + np.exp(-z)) if link == "logistic" else np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])
        p = floor + (1 - 2 * floor) * p
        return -np.log(np.where(data[:, 2] == 1, p, 1 - p)).sum() + (w[1:] ** 2).sum() / 6

    w = fits.likelihood(rows, ["a", "b"], "hit", link, floor=floor)
    assert all(loss(w) < loss(w + 0.01 * np.array(d)) for d in itertools.product((-1, 0, 1), repeat=3) if any(d))


def test_likelihood_refuses(rows):
    with pytest.raises(ValueError):
        fits.likelihood(rows, ["a"], "hit", floor=0.5)
    with pytest.raises(ValueError):
        fits.likelihood(rows.where("false"), ["a"], "hit")
    with pytest.raises(ValueError):
        fits.likelihood(rows, ["a"], "hit", most=1)


def test_mixture_weights_are_least(spark):
    rng = np.random.default_rng(9)
    truth = rng.random(300)
    hit = (rng.random(300) < truth).astype(int)
    members = np.column_stack([np.clip(truth + rng.normal(scale=s, size=300), 0.02, 0.98) for s in (0.2, 0.3, 0.9)])
    df = spark.createDataFrame([(*map(float, m), int(h)) for m, h in zip(members, hit, strict=True)], "a double, b double, c double, hit int")
    w = fits.simplex_weights(df, ["a", "b", "c"], "hit")
    loss = lambda v: -np.log(np.where(hit == 1, members @ v, 1 - members @ v)).sum()
    assert w.min() >= 0 and w.sum() == pytest.approx(1)
    grid = [np.array([i, j, 50 - i - j]) / 50 for i in range(51) for j in range(51 - i)]
    assert loss(w) <= min(map(loss, grid)) + 1e-6
    assert fits.simplex_weights(df, ["a"], "hit") == pytest.approx([1.0])


def test_gate_tree_ties_and_pure_nodes(spark):
    df = spark.createDataFrame([(1.0, 1.0, True), (1.0, 1.0, True), (2.0, 2.0, False), (None, 2.0, True)], "a double, b double, bad boolean")
    splits, leaves = fits.gate_tree(df, ["a", "b"], "bad")
    assert splits == {1: ("a", 1.0)}  # both features cut alike: the first; the pure sides are leaves
    assert leaves == {2: True, 3: False}
    same = spark.createDataFrame([(1.0, True), (1.0, False)], "a double, bad boolean")
    assert fits.gate_tree(same, ["a"], "bad") == ({}, {1: False})


def test_boosting_keeps_its_directions(rows):
    numbers = rows.withColumn("y", 3 * F.col("a") - F.col("b"))
    start, stages = fits.boosted_stumps(numbers, {"a": 1, "b": 1}, "y", 4, 0.5)
    assert [f for f, *_ in stages] == ["a"] * 4 and all(low <= high for *_, low, high in stages)  # b may not rise
    error = lambda n: numbers.dropna().select(F.avg((F.col("y") - fits.boosted(start, stages[:n], 0.5)) ** 2)).first()[0]
    assert error(4) < error(2) < error(0)


def test_standardised_without_training_rows(spark):
    df = spark.createDataFrame([("a", 1.0, 0), ("a", 3.0, 0), ("a", 2.0, 1), ("b", 5.0, 1), (None, 1.0, 0)], "g string, x double, f int")
    found = {(r["g"], r["x"]): r["x_z"] for r in fits.standardised(df, "g", ["x"], F.col("f") == 0).collect()}
    assert found == {("a", 1.0): -1.0, ("a", 3.0): 1.0, ("a", 2.0): 0.0, ("b", 5.0): None, (None, 1.0): None}


def test_calibrated_rises_with_its_score(rows):
    train, held = rows.where("fold < 3"), rows.where("fold = 3")
    found = fits.calibrated(train, held, ["a"], "hit").orderBy("a").toPandas()
    assert found["confidence"].is_monotonic_increasing and found["confidence"].between(0, 1).all()
    assert len(found) == held.dropna(subset=["a"]).count()


def test_review_learns_from_earlier_batches_alone(spark):
    data = [(0, 0.9, True), (0, 0.2, False), (1, 0.9, False), (1, 0.95, True), (1, None, False), (2, 0.9, True)]
    df = spark.createDataFrame(data, "batch int, score double, ok boolean")
    found = fits.reviewed(df, F.col("batch"), F.col("score"), F.col("ok"), 1.0).orderBy("batch").collect()
    # nothing is known at first; then scores from 0.2's bin on are all right; 0.9 was wrong once, 0.95 never
    assert [(r["rows"], r["taken"], r["hits"], r["bin"]) for r in found] == [(2, 0, 0, None), (3, 2, 1, 5), (1, 0, 0, 19)]
    assert not fits.reviewed(df.where("false"), F.col("batch"), F.col("score"), F.col("ok"), 1.0).count()


def test_best_variant_ties_and_distrust(spark):
    data = [("k", 1, 1, 1)] * 3 + [("k", 1, 2, 2), ("k", None, 1, 1), ("d", 1, 0, None), ("d", 1, 0, None)]
    df = spark.createDataFrame(data, "kind string, truth int, a int, b int")
    found = {r["kind"]: tuple(r)[1:] for r in fits.best_variant(df, "kind", ["a", "b"], "truth", 2, 0.5, 0.9).collect()}
    assert found["k"] == ("a", 3, 4, False, pytest.approx(0.75 / 0.9))
    assert found["d"] == ("a", 0, 2, True, None)


def test_alignment_never_steps_back(spark):
    votes = [("k", 1, 2, 5, 4), ("k", 2, 1, 6, 4), ("k", 3, 3, 1, 4), ("k", 3, 3, 1, 4), (None, 1, 1, 9, 9), ("z", 1, 4, 0, 1)]
    df = spark.createDataFrame(votes, "kind string, level int, target int, votes int, size int")
    found = {(r["kind"], r["level"]): r["target"] for r in fits.ordered_alignment(df).collect()}

    def score(path):
        own = {(1, 2): 500, (2, 1): 600, (3, 3): 200}
        return sum(own.get((i, t), 0) - abs(t - i) for i, t in enumerate(path, 1)) - 100 * sum(a == b for a, b in itertools.pairwise(path))

    best = max((p for p in itertools.product((1, 2, 3), repeat=3) if list(p) == sorted(p)), key=lambda p: (score(p), p[::-1]))
    assert tuple(found[("k", i)] for i in (1, 2, 3)) == best
    assert found[("z", 1)] == 4 and len(found) == 4
