"""Histogram trees, forests and boosting against a local brute force on the same bins and weights."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import forest


def local_tree(x, y, w, directions, depth, least):
    """Splits and values by trying all cuts of all nodes."""
    splits, values, limits, rows = {}, {}, {1: (-np.inf, np.inf)}, {1: np.flatnonzero(w > 0)}
    for node in range(1, 2 ** (depth + 1)):
        at = rows.get(node, np.empty(0, int))
        if not len(at):
            continue
        n, total = w[at].sum(), (w * y)[at].sum()
        clip = lambda v, b=limits[node]: min(max(v, b[0]), b[1])
        best = None
        for f in range(x.shape[1]) if node < 2**depth else ():
            for b in sorted(set(x[at, f])):
                left = at[x[at, f] <= b]
                ln, ls = w[left].sum(), (w * y)[left].sum()
                if ln < least or n - ln < least:
                    continue
                low, high = clip(ls / ln), clip((total - ls) / (n - ln))
                gain = round(ls * ls / ln + (total - ls) ** 2 / (n - ln) - total * total / n, 6)
                if directions[f] * (high - low) >= 0 and gain > 0 and (best is None or gain > best[0]):
                    best = (gain, f, b, low, high)
        if best is None:
            values[node] = clip(total / n)
            continue
        gain, f, b, low, high = best
        splits[node] = (f, b, gain)
        lo, hi = limits[node]
        mid = (low + high) / 2
        limits[2 * node], limits[2 * node + 1] = ((lo, mid), (mid, hi)) if directions[f] > 0 else ((mid, hi), (lo, mid)) if directions[f] < 0 else ((lo, hi),) * 2
        rows[2 * node], rows[2 * node + 1] = at[x[at, f] <= b], at[x[at, f] > b]
    return splits, values


def local_value(tree, row, depth):
    splits, values = tree
    node = 1
    for _ in range(depth):
        if node in splits:
            f, b, _ = splits[node]
            node = 2 * node + (row[f] > b)
    return values[node]


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(6)
    rows = []
    for i in range(600):
        a, b, c = rnd.randrange(30), rnd.random(), rnd.choice([None, 1.0, 2.0, 5.0])
        rows.append((i, float(a), b, c, None if i % 50 == 7 else a * 3 - round(20 * b) + rnd.randrange(40)))
    return forest.Binned(spark.createDataFrame(rows, "id long, a double, b double, c double, y long"), ["a", "b", "c"], F.col("id"), ["y"], 8)


def local(data):
    rows = sorted(data.rows.where("y is not null").collect())
    return [r["key"] for r in rows], np.array([list(r["bins"]) for r in rows]), np.array([r["y"] for r in rows], float)


@pytest.mark.parametrize("directions", [(0, 0, 0), (1, -1, 0), (-1, 1, 1)])
def test_a_forest_equals_brute_force_on_its_members(spark, data, directions):
    depth, members = 4, 5
    trees = forest.forest(data, "y", directions, members, depth, 5)
    keys, x, y = local(data)
    assert all(len(e) <= 7 for e in data.ends) and x.max() <= 7
    ids = spark.createDataFrame([(k, m) for k in keys for m in range(members)], "key long, m int")
    w = {(r[0], r[1]): r[2] for r in ids.select("key", "m", forest.weight(F.col("key"), F.col("m"))).collect()}
    predicted = {r["key"]: r["p"] for r in data.rows.select("key", forest.prediction(trees, depth, F.col("bins")).alias("p")).collect()}
    grown = [local_tree(x, y, np.array([w[k, m] for k in keys]), directions, depth, 5) for m in range(members)]
    for t, (splits, values) in zip(trees, grown, strict=True):
        assert t.splits == splits and t.values == pytest.approx(values)
    for k, row in zip(keys, x, strict=True):
        assert predicted[k] == pytest.approx(np.mean([local_value(g, row, depth) for g in grown]))


def test_weights_are_poisson(spark):
    ids = spark.range(20_000).select(forest.weight(F.col("id"), F.lit(3)).alias("w"))
    share = {r["w"]: r["count"] / 20_000 for r in ids.groupBy("w").count().collect()}
    assert abs(share[0] - 0.368) < 0.015 and abs(share[1] - 0.368) < 0.015 and abs(share[2] - 0.184) < 0.015


def test_predictions_keep_their_directions(spark, data):
    trees = forest.forest(data, "y", [1, -1, 0], 6, 5, 1)
    grid = spark.range(8).crossJoin(spark.range(8).toDF("o")).select(F.array("id", "o", F.lit(0)).alias("bins"), "id", "o")
    p = {(r["id"], r["o"]): r["p"] for r in grid.select("id", "o", forest.prediction(trees, 5, F.col("bins")).alias("p")).collect()}
    assert all(p[i, o] <= p[i + 1, o] + 1e-9 for i in range(7) for o in range(8))
    assert all(p[i, o] >= p[i, o + 1] - 1e-9 for i in range(8) for o in range(7))


def test_boosting_equals_brute_force_and_lowers_the_error(data):
    start, trees = forest.boost(data, "y", [1, -1, 0], 4, 0.5, 2)
    _, x, y = local(data)
    left, ones = y - y.mean(), np.ones(len(y))
    errors = [np.mean(left**2)]
    assert start == pytest.approx(y.mean())
    for t in trees:
        splits, values = local_tree(x, left, ones, (1, -1, 0), 2, 5)
        assert {n: s[:2] for n, s in t.splits.items()} == {n: s[:2] for n, s in splits.items()}
        assert t.values == pytest.approx(values)
        left = left - 0.5 * np.array([local_value((splits, values), row, 2) for row in x])
        errors.append(np.mean(left**2))
    assert len(trees) == 4 and all(a > b for a, b in zip(errors, errors[1:], strict=False))


def test_rows_without_values(spark):
    rows = spark.createDataFrame([(1, None, None)], "id long, a double, y double")
    empty = forest.Binned(rows, ["a"], F.col("id"), ["y"], 4)
    assert empty.ends == [[]] and forest.forest(empty, "y", [0], 2)[0].splits == {}
    with pytest.raises(ValueError, match="no rows"):
        forest.boost(empty, "y", [0], 2, 0.1)
    empty.forget()


def test_levels_read_sums_of_equal_bins_not_rows(spark):
    rows = spark.range(4000).selectExpr("id as key", "array(cast(id % 3 as tinyint), cast(id % 2 as tinyint)) as bins", "id % 7 as y")
    got = forest.summed(rows, F.col("y"), 2, True).collect()
    assert len(got) == 12 and forest.summed(rows, F.col("y"), 1, False).agg(F.sum("n")).collect()[0][0] == 4000
