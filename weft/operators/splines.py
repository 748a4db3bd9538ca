"""B-splines of any degree and their tensor products, fitted by banded sums under a difference penalty.

On an interval between knots only degree + 1 functions differ from zero; the Cox-de Boor recurrence gives their values as expressions. The normal equations are sums of
products of these few values by interval (of one or of all features): one aggregate, whose size is set by knots and degree, is all that the driver sees.
Features outside the knots count as at the nearest end; rows with a null in a feature or in y take no part.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranks


@dataclass
class Axis:
    """A feature, its distinct knots in ascending order, and the degree."""

    feature: str
    knots: Sequence[float]
    degree: int = 3

    @property
    def full(self) -> list[float]:
        """All knots, the ends as often as the degree asks for."""
        t = [float(k) for k in self.knots]
        return [t[0]] * self.degree + t + [t[-1]] * self.degree

    @property
    def size(self) -> int:
        """The number of functions."""
        return len(self.knots) - 1 + self.degree


def quantile_knots(rows: DataFrame, feature: str, pieces: int) -> list[float]:
    """The distinct exact quantiles at 0, 1 / pieces, ..., 1."""
    points = {f"q{i}": i / pieces for i in range(pieces + 1)}
    found = ranks.quantiles(rows.select(F.lit(0).alias("all"), F.col(feature).cast("double").alias("v")), ["all"], "v", points).collect()
    knots = sorted({found[0][p] for p in points} - {None}) if found else []
    if len(knots) < 2:
        raise ValueError("a spline takes two different values at least")
    return knots


def local_values(rows: DataFrame, axis: Axis, name: str) -> DataFrame:
    """rows with `<name>_at`, the interval's number (also the first function's), and `<name>_0` ... `<name>_<degree>`, the functions' values there."""
    p, t, inner = axis.degree, F.lit(axis.full), axis.knots
    x = F.least(F.greatest(F.col(axis.feature).cast("double"), F.lit(float(inner[0]))), F.lit(float(inner[-1])))
    at = sum((F.when(x >= float(k), 1).otherwise(0) for k in inner[1:-1]), F.lit(0))
    out = rows.withColumn(f"{name}_x", F.when(F.col(axis.feature).isNotNull(), x)).withColumn(f"{name}_at", F.when(F.col(axis.feature).isNotNull(), at))
    x, j = F.col(f"{name}_x"), F.col(f"{name}_at") + p
    values = [F.lit(1.0)]
    for d in range(1, p + 1):
        new, saved = [], F.lit(0.0)
        for r in range(d):
            right, left = F.get(t, j + r + 1), F.get(t, j + 1 - d + r)
            part = values[r] / (right - left)
            new.append(saved + (right - x) * part)
            saved = (x - left) * part
        values = [*new, saved]
        out = out.withColumns({f"_{name}_{d}_{i}": v for i, v in enumerate(values)})
        values = [F.col(f"_{name}_{d}_{i}") for i in range(d + 1)]
    made = [f"_{name}_{d}_{i}" for d in range(1, p + 1) for i in range(d + 1)]
    return out.withColumns({f"{name}_{i}": v for i, v in enumerate(values)}).drop(f"{name}_x", *made)


def _local(rows: DataFrame, axes: Sequence[Axis]) -> tuple[DataFrame, list[str], list[tuple[tuple[int, ...], Column]]]:
    """rows with local values, the intervals' columns, and the products of the axes' functions: offsets and value."""
    for n, a in enumerate(axes):
        rows = local_values(rows, a, f"_s{n}")
    products = []
    for offsets in itertools.product(*[range(a.degree + 1) for a in axes]):
        value = F.lit(1.0)
        for n, i in enumerate(offsets):
            value = value * F.col(f"_s{n}_{i}")
        products.append((offsets, value))
    return rows, [f"_s{n}_at" for n in range(len(axes))], products


def normal_equations(rows: DataFrame, axes: Sequence[Axis], y: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums of products of all functions, of functions with y, and the number of rows; functions of several axes in row-major order."""
    local, at, products = _local(rows.where(F.col(y).isNotNull()), axes)
    for a in axes:
        local = local.where(F.col(a.feature).isNotNull())
    pairs = list(itertools.combinations_with_replacement(range(len(products)), 2))
    own = {f"p{i}": v for i, (_, v) in enumerate(products)}
    local = local.select(*at, F.col(y).cast("double").alias("_y"), *[v.alias(k) for k, v in own.items()])
    sums = [F.sum(F.col(f"p{i}") * F.col(f"p{j}")) for i, j in pairs] + [F.sum(F.col(f"p{i}") * F.col("_y")) for i in range(len(products))]
    shape = [a.size for a in axes]
    size, total = int(np.prod(shape)), 0
    g, b = np.zeros((size, size)), np.zeros(size)
    for row in local.groupBy(*at).agg(F.count(F.lit(1)), *sums).collect():
        start, found = row[: len(at)], row[len(at) + 1 :]
        places = [int(np.ravel_multi_index([s + o for s, o in zip(start, offsets, strict=True)], shape)) for offsets, _ in products]
        total += row[len(at)]
        for (i, j), s in zip(pairs, found, strict=False):
            g[places[i], places[j]] += s
            if i != j:
                g[places[j], places[i]] += s
        np.add.at(b, places, found[len(pairs) :])
    if not total:
        raise ValueError("no rows to fit")
    return g, b, total


def difference_penalty(axes: Sequence[Axis], order: int = 2) -> np.ndarray:
    """The sum over axes of squared differences of neighbouring coefficients along each."""
    size = [a.size for a in axes]
    out = np.zeros((int(np.prod(size)),) * 2)
    for n, k in enumerate(size):
        d = np.diff(np.eye(k), min(order, k - 1), axis=0)
        own = np.eye(1)
        for m, other in enumerate(size):
            own = np.kron(own, d.T @ d if m == n else np.eye(other))
        out += own
    return out


def fitted(rows: DataFrame, axes: Sequence[Axis], y: str, strength: float = 1.0, order: int = 2) -> np.ndarray:
    """Coefficients that lower the squared error plus `strength` times the penalty; where rows leave a choice, the smallest."""
    g, b, _ = normal_equations(rows, axes, y)
    return np.linalg.lstsq(g + strength * difference_penalty(axes, order), b, rcond=None)[0]


def predicted(rows: DataFrame, axes: Sequence[Axis], coefficients: np.ndarray, name: str) -> DataFrame:
    """rows with the spline's value in the column `name`; null where a feature is."""
    local, at, products = _local(rows, axes)
    values, shape = F.lit([float(c) for c in coefficients]), [a.size for a in axes]
    out = F.lit(0.0)
    for offsets, v in products:
        place = F.lit(0)
        for n, o in enumerate(offsets):
            place = place * shape[n] + F.col(at[n]) + o
        out = out + v * F.get(values, place)
    return local.withColumn(name, out).select(*rows.columns, name)
