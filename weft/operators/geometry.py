"""Shapes of points: hulls and least rectangles by merging, closed curves by their arc length and harmonics, transforms by consensus."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks

#: Parts in which a group's partial hulls meet before they are one.
PARTS = 64


def hull_of(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull, anticlockwise from the least; points on its sides are none."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def chain(ordered: np.ndarray) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for x, y in ordered.tolist():
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (x - out[-2][0]):
                out.pop()
            out.append((x, y))
        return out

    low, high = chain(points), chain(points[::-1])
    return np.array(low[:-1] + high[:-1])


def least_rectangle(hull: np.ndarray) -> tuple[float, float, float, float]:
    """area, length, width (length >= width), angle of the longer side in [0, 180): one side lies on a side of the hull."""
    if len(hull) < 2:
        return 0.0, 0.0, 0.0, 0.0
    sides = np.roll(hull, -1, 0) - hull
    size = np.hypot(*sides.T)
    along = sides / size[:, None]
    best = None
    for i in range(0, len(hull), 256):  # blocks of sides against all corners
        u = along[i : i + 256]
        a, b = hull @ u.T, hull @ np.stack([-u[:, 1], u[:, 0]])
        w, h = np.ptp(a, axis=0), np.ptp(b, axis=0)
        k = int(np.argmin(np.round(w * h, 9)))
        if best is None or round(w[k] * h[k], 9) < round(best[0], 9):
            best = (w[k] * h[k], w[k], h[k], u[k])
    area, w, h, (x, y) = best
    angle = np.degrees(np.arctan2(y, x)) + (0 if w >= h else 90)
    return float(area), float(max(w, h)), float(min(w, h)), float(angle % 180)


def _hulls(group_type: pa.DataType):
    """Rows of grp, part, x, y, sorted by grp and part, to the hull of each; unsorted rows give some hulls more."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            keys = list(zip(batch.column("grp").to_pylist(), batch.column("part").to_pylist(), strict=True))
            points = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y")], 1)
            places: dict[tuple, list[int]] = {}
            for i, k in enumerate(keys):
                places.setdefault(k, []).append(i)
            for k, at in places.items():
                held[k] = hull_of(np.concatenate([held[k], points[at]]) if k in held else points[at])
            if len(held) > 10_000:
                yield rows(held)
                held = {}
        if held:
            yield rows(held)

    def rows(held: dict) -> pa.RecordBatch:
        n = [len(h) for h in held.values()]
        at = np.repeat(np.arange(len(n)), n)
        points = np.concatenate(list(held.values()))
        grp, part = (pa.array([k[i] for k in held], t).take(pa.array(at)) for i, t in ((0, group_type), (1, pa.int32())))
        return pa.RecordBatch.from_arrays([grp, part, pa.array(points[:, 0]), pa.array(points[:, 1])], ["grp", "part", "x", "y"])

    return read


def rectangles(points: DataFrame, group: str, x: str, y: str, parts: int = PARTS) -> DataFrame:
    """group, corners, area, length, width, angle: each group's hull and the least rectangle around it.

    Each task makes the hulls of its own rows, these meet in `parts` parts a group, and the parts' hulls in one; what travels and is gathered are corners,
    so that one group may hold all rows. Points with nulls or non-finite numbers take no part; a null group is a group.
    """
    good = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y") & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    rows = points.select(F.col(group).alias("grp"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(good)
    kind = rows.schema["grp"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    merge = lambda df: df.mapInArrow(_hulls(to_arrow_type(kind)), f"grp {kind.simpleString()}, part int, x double, y double")
    own = merge(rows.withColumn("part", F.lit(0)))
    some = merge(own.withColumn("part", F.pmod(F.xxhash64("x", "y"), F.lit(parts)).cast("int")).repartition("grp", "part"))
    last = merge(some.withColumn("part", F.lit(0)).repartition("grp"))
    corners = last.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("c"))

    def measured(c: pa.Array) -> pa.Array:
        out = [least_rectangle(hull_of(np.array([[p["x"], p["y"]] for p in own]))) for own in c.to_pylist()]
        return pa.array([dict(zip(("area", "length", "width", "angle"), o, strict=True)) for o in out], pa.struct([(n, pa.float64()) for n in ("area", "length", "width", "angle")]))

    fit = F.arrow_udf(measured, "area double, length double, width double, angle double")
    return corners.withColumn("r", fit("c")).select(F.col("grp").alias(group), F.size("c").alias("corners"), "r.*")


def without_spikes(points: DataFrame, curve: str, order: Sequence[str], x: str, y: str, limit: float) -> DataFrame:
    """Points but those further than `limit` from the middle of their neighbours, where the neighbours are within `limit` of each other."""
    w = Window.partitionBy(curve).orderBy(*order)
    near = {f"_{side}_{c}": f(c).over(w) for side, f in (("b", F.lag), ("a", F.lead)) for c in (x, y)}
    far = lambda ax, ay, bx, by: F.hypot(ax - bx, ay - by)
    c = F.col
    apart = far(c(x), c(y), (c(f"_b_{x}") + c(f"_a_{x}")) / 2, (c(f"_b_{y}") + c(f"_a_{y}")) / 2)
    spike = (apart > limit) & (far(c(f"_b_{x}"), c(f"_b_{y}"), c(f"_a_{x}"), c(f"_a_{y}")) <= limit)
    return points.withColumns(near).where(~F.coalesce(spike, F.lit(False))).drop(*near)


def resampled(points: DataFrame, curve: str, order: str, x: str, y: str, samples: int) -> DataFrame:
    """curve, j, x, y: `samples` points at equal arc lengths of each closed curve, from its first point on.

    A side emits the samples that fall on it, so nothing is joined. Lengths are running sums over ranges of (curve, order), so one curve may hold all rows; only the
    neighbour of a point needs a window. Curves of one place have all samples there. Points with nulls take no part; repeated orders go by x, then y.
    """
    rows = points.select(F.col(curve).alias("curve"), F.col(order).alias("at"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    w = Window.partitionBy("curve").orderBy("at", "x", "y")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follow = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole)).alias(f"n{c}")
    sides = rows.select("curve", "at", "x", "y", follow("x"), follow("y"))
    sides = sides.withColumn("length", F.hypot(F.col("nx") - F.col("x"), F.col("ny") - F.col("y"))).withColumn("one", F.lit(1).cast("long"))
    run = ranks.running_sums(sides, ["curve"], [F.col("at"), F.col("x"), F.col("y")], ["length", "one"])
    step = F.col("length_all") / samples
    low, high = (F.col("length_upto") - F.col("length")) / step, F.col("length_upto") / step
    first = F.when(F.col("one_upto") == 1, 0).otherwise(F.ceil(F.round(low, 9)))
    last = F.when(F.col("one_upto") == F.col("one_all"), samples).otherwise(F.ceil(F.round(high, 9)))
    on = F.when(F.col("length_all") == 0, F.when(F.col("one_upto") == 1, F.sequence(F.lit(0), F.lit(samples - 1)))).when(
        first < last, F.sequence(first.cast("int"), (last - 1).cast("int"))
    )
    share = F.when(F.col("length") > 0, F.least(F.greatest((F.col("j") - low) * step / F.col("length"), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    out = run.withColumn("j", F.explode(on))
    mid = lambda c: (F.col(c) + share * (F.col(f"n{c}") - F.col(c))).alias(c)
    return out.select(F.col("curve").alias(curve), "j", mid("x"), mid("y"))


def low_pass(curves: DataFrame, curve: str, samples: int, harmonics: int) -> DataFrame:
    """curve, j, x, y: resampled curves (columns j, x, y) with their first harmonics alone, 2 * harmonics < samples."""
    turn = lambda: 2 * np.pi * F.col("_k") * F.col("j") / samples
    each = curves.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(harmonics))))
    part = [F.sum(F.col(c) * f(turn())).alias(f"{c}{n}") for c in ("x", "y") for n, f in (("c", F.cos), ("s", F.sin))]
    terms = each.groupBy(curve, "_k").agg(*part)
    twice = F.when(F.col("_k") == 0, 1.0).otherwise(2.0) / samples
    back = terms.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    wave = lambda c: F.sum(twice * (F.col(f"{c}c") * F.cos(turn()) + F.col(f"{c}s") * F.sin(turn()))).alias(c)
    return back.groupBy(curve, "j").agg(wave("x"), wave("y"))


def solved(pairs: np.ndarray) -> np.ndarray | None:
    """The projective map (8 numbers, the ninth is 1) of four or more rows x, y, u, v by least squares; null where they don't fix one."""
    x, y, u, v = pairs.T
    o, z = np.ones(len(x)), np.zeros(len(x))
    a = np.concatenate([np.stack([x, y, o, z, z, z, -u * x, -u * y], 1), np.stack([z, z, z, x, y, o, -v * x, -v * y], 1)])
    found, _, rank, _ = np.linalg.lstsq(a, np.r_[u, v], rcond=None)
    return found if rank == 8 else None


def mapped(h: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """The place of x, y under the map h, an array of 8."""
    w = h[6] * x + h[7] * y + 1
    return F.try_divide(h[0] * x + h[1] * y + h[2], w), F.try_divide(h[3] * x + h[4] * y + h[5], w)


def consensus_map(pairs: DataFrame, key: str, tries: int = 64, reach: float = 1.0) -> tuple[list[float], int]:
    """The projective map from x, y to u, v that most pairs agree with within `reach`, refitted to those, and their number.

    The pairs with the smallest hashes are dealt in fours: the hypotheses, a stated number that the driver solves. All pairs vote for all hypotheses in
    one aggregate. The winner's pairs are gathered as the sums of its normal equations. Ties: the earlier hypothesis. Pairs with nulls take no part; without a
    hypothesis that four points fix it's an error.
    """
    rows = pairs.select(key, *[F.col(c).cast("double").alias(c) for c in "xyuv"]).dropna()
    drawn = rows.orderBy(F.xxhash64(key), key).limit(4 * tries).select(*"xyuv").collect()
    fours = [np.array(drawn[i : i + 4]) for i in range(0, len(drawn) - 3, 4)]
    maps = [m.tolist() for m in map(solved, fours) if m is not None]
    if not maps:
        raise ValueError("no four pairs fix a map")

    def agrees(h: Column) -> Column:
        px, py = mapped(h, F.col("x"), F.col("y"))
        return F.coalesce(F.hypot(px - F.col("u"), py - F.col("v")) <= reach, F.lit(False))

    votes = rows.select("*", F.posexplode(F.lit(maps)).alias("i", "h")).where(agrees(F.col("h"))).groupBy("i").count()
    best = votes.orderBy(F.desc("count"), "i").limit(1).collect()
    if not best:
        raise ValueError("no pair agrees with a map")
    one, n = maps[best[0]["i"]], best[0]["count"]
    zero, unit = F.lit(0.0), F.lit(1.0)
    x, y, u, v = map(F.col, "xyuv")
    equations = [([x, y, unit, zero, zero, zero, -u * x, -u * y], u), ([zero, zero, zero, x, y, unit, -v * x, -v * y], v)]
    cells = {f"{i},{j}": sum(((a[i] * (a[j] if j < 8 else b)) for a, b in equations), F.lit(0.0)) for i in range(8) for j in range(i, 9)}
    sums = rows.where(agrees(F.lit(one))).agg(*[F.sum(c).alias(k.replace(",", "_")) for k, c in cells.items()]).collect()[0]
    m = np.zeros((8, 9))
    for k in cells:
        i, j = map(int, k.split(","))
        m[i, j] = sums[k.replace(",", "_")]
        if j < 8:
            m[j, i] = m[i, j]
    fit = np.linalg.lstsq(m[:, :8], m[:, 8], rcond=None)[0]
    return fit.tolist(), n
