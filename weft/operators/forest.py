"""Trees of any depth on binned features: forests of hashed bootstrap members, and boosting, with directions.

Features are binned once by their quantiles, and the binned rows are written. One pass sums the rows of each member by their bins
together, and these sums are written too. A level of all members is one aggregate of them by (member, node, feature, bin), partial
first, so that what is shuffled and collected is bounded by members x nodes x features x bins, whatever the rows. A row's weight in a member is
Poisson(1) by a hash of its key, so members need no draws to be kept. No table grows with distinct values, and none is left behind.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import forget, shared_table
from . import ranks

#: The distribution of Poisson(1) up to which a hash in [0, 1) counts 0, 1, 2, ... times.
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975, 0.99999887)


@dataclass
class Tree:
    """Splits: node to (feature, bin, gain), rows in bins up to it go to 2 * node, others to the next; values of all leaves."""

    splits: dict[int, tuple[int, int, float]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)


def edges(rows: DataFrame, features: Sequence[str], bins: int) -> list[list[float]]:
    """Each feature's upper ends of all bins but the last: its distinct quantiles at 1 / bins, 2 / bins, ..."""
    long = rows.select(F.posexplode(F.array(*[F.col(f).cast("double") for f in features])).alias("feature", "value"))
    found = ranks.quantiles(long, ["feature"], "value", {f"q{i}": i / bins for i in range(1, bins)}).collect()
    ends = {r["feature"]: sorted({r[f"q{i}"] for i in range(1, bins)} - {None}) for r in found}
    return [ends.get(i, []) for i in range(len(features))]


def bin_of(feature: str, ends: Sequence[float]) -> Column:
    """How many ends are below the feature; nulls are in a bin above all."""
    at = sum((F.when(F.col(feature) > e, 1).otherwise(0) for e in ends), F.lit(0))
    return F.when(F.col(feature).isNull(), len(ends)).otherwise(at).cast("tinyint")


def weight(key: Column, member: Column) -> Column:
    """How often the row is in the member's bootstrap sample."""
    u = F.pmod(F.xxhash64(key, member), F.lit(2**32)) / F.lit(float(2**32))
    return sum((F.when(u >= p, 1).otherwise(0) for p in POISSON), F.lit(0))


def _lookup(trees: Sequence[Tree], what: int, size: int) -> Column:
    """An array by member and node, 0 based: the split's feature or bin, -1 where there's none."""
    return F.lit([t.splits[n][what] if n in t.splits else -1 for t in trees for n in range(size)])


def _placed(bins: Column, trees: Sequence[Tree], depth: int) -> Column:
    """The node of each member that a row is in: an array; bins: an array of the row's bins."""
    size = 2 ** (depth + 1)
    nodes = F.array_repeat(F.lit(1), len(trees))
    if not any(t.splits for t in trees):
        return nodes
    features, cuts = _lookup(trees, 0, size), _lookup(trees, 1, size)
    for _ in range(depth):
        def step(n: Column, m: Column) -> Column:
            at = m * size + n
            f = F.get(features, at)
            return F.when(f < 0, n).otherwise(2 * n + (F.get(bins, f) > F.get(cuts, at)).cast("int"))

        nodes = F.transform(nodes, step)
    return nodes


def grow(
    binned: DataFrame, y: Column, count: int, directions: Sequence[int], depth: int, bootstrap: bool, least: int = 1,
) -> list[Tree]:
    """Trees fitted to y by squared error; binned: key, bins (an array).

    directions: for each feature 1 (the prediction may only rise with it), -1 (only fall) or 0. A cut against its direction is not taken, and what is
    on either side stays on its side of the middle of the two, further down too. A side has at least `least` (weighted) rows. Ties: the earlier feature, then the
    smaller bin. Rows with null y take no part.
    """
    sums = shared_table(summed(binned, y, count, bootstrap))
    found = _grow(sums, count, directions, depth, least)
    forget(sums)
    return found


def summed(binned: DataFrame, y: Column, count: int, bootstrap: bool) -> DataFrame:
    """member, bins, n, s: weights and weighted y of each member's rows with the same bins. One pass over the rows; what follows reads sums."""
    rows = binned.withColumn("_y", y.cast("double")).where("_y is not null")
    rows = rows.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))) if count > 1 else rows.withColumn("member", F.lit(0))
    times = weight(F.col("key"), F.col("member")) if bootstrap else F.lit(1)
    rows = rows.withColumn("w", times).where("w > 0")
    return rows.groupBy("member", "bins").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("_y")).alias("s"))


def _grow(sums: DataFrame, count: int, directions: Sequence[int], depth: int, least: int) -> list[Tree]:
    trees, limits = [Tree() for _ in range(count)], [{1: (float("-inf"), float("inf"))} for _ in range(count)]
    clip = lambda v, bounds: min(max(v, bounds[0]), bounds[1])
    for level in range(depth + 1):
        here = sums.withColumn("node", F.get(_placed(F.col("bins"), trees, level), F.col("member"))).where(F.col("node") >= 2**level)
        if level == depth:
            leaves = here.groupBy("member", "node").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
            for r in leaves:
                trees[r["member"]].values[r["node"]] = clip(r["s"] / r["n"], limits[r["member"]][r["node"]])
            break
        cells = here.select("member", "node", "n", "s", F.posexplode("bins").alias("feature", "bin"))
        cells = cells.groupBy("member", "node", "feature", "bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
        nodes: dict[tuple[int, int], dict[tuple[int, int], tuple[int, float]]] = {}
        for r in cells:
            nodes.setdefault((r["member"], r["node"]), {})[r["feature"], r["bin"]] = (r["n"], r["s"])
        for (m, node), hist in sorted(nodes.items()):
            n = sum(c for (f, _), (c, _) in hist.items() if f == 0)
            total = sum(s for (f, _), (_, s) in sorted(hist.items()) if f == 0)
            bounds, best = limits[m][node], None
            for f in range(len(directions)):
                ln, ls = 0, 0.0
                for (_, b), (c, s) in sorted(x for x in hist.items() if x[0][0] == f):
                    ln, ls = ln + c, ls + s
                    if ln < least or n - ln < least:
                        continue
                    low, high = clip(ls / ln, bounds), clip((total - ls) / (n - ln), bounds)
                    if directions[f] * (high - low) < 0:
                        continue
                    gain = round(ls * ls / ln + (total - ls) ** 2 / (n - ln) - total * total / n, 6)
                    if gain > 0 and (best is None or gain > best[0]):
                        best = (gain, f, b, low, high)
            if best is None:
                trees[m].values[node] = clip(total / n, bounds)
                continue
            gain, f, b, low, high = best
            trees[m].splits[node] = (f, b, gain)
            mid = (low + high) / 2
            left, right = {1: ((bounds[0], mid), (mid, bounds[1])), -1: ((mid, bounds[1]), (bounds[0], mid)), 0: (bounds, bounds)}[directions[f]]
            limits[m][2 * node], limits[m][2 * node + 1] = left, right
    return trees


def prediction(trees: Sequence[Tree], depth: int, bins: Column) -> Column:
    """The mean of the trees' values; null without trees."""
    size = 2 ** (depth + 1)
    values = F.lit([float(t.values.get(n, 0.0)) for t in trees for n in range(size)])
    at = F.transform(_placed(bins, trees, depth), lambda n, m: F.get(values, m * size + n))
    return F.aggregate(at, F.lit(0.0), lambda t, v: t + v) / F.lit(float(len(trees)))


class Binned:
    """Rows with their bins, written once; `forget` deletes them."""

    def __init__(self, rows: DataFrame, features: Sequence[str], key: Column, keep: Sequence[str], bins: int = 16):
        if not 2 <= bins <= 127:
            raise ValueError("2 to 127 bins")
        self.features, self.ends = list(features), edges(rows, features, bins)
        at = F.array(*[bin_of(f, e) for f, e in zip(features, self.ends, strict=True)])
        self.rows = shared_table(rows.select(key.alias("key"), at.alias("bins"), *keep))

    def forget(self) -> None:
        forget(self.rows)


def forest(data: Binned, y: str, directions: Sequence[int], members: int = 20, depth: int = 4, least: int = 5) -> list[Tree]:
    """Trees of bootstrap members; a member whose sample is empty has the value 0."""
    return grow(data.rows, F.col(y), members, directions, depth, True, least)


def boost(data: Binned, y: str, directions: Sequence[int], rounds: int, rate: float, depth: int = 4, least: int = 5) -> tuple[float, list[Tree]]:
    """Mean of y, and trees each fitted to what the ones before left, of which the share `rate` counts."""
    start, trees = data.rows.agg(F.avg(y)).collect()[0][0], []
    if start is None:
        raise ValueError("no rows to fit")
    sums = shared_table(summed(data.rows, F.col(y), 1, False))
    for _ in range(rounds):
        left = sums.withColumn("s", F.col("s") - F.col("n") * boosted(start, trees, rate, depth, F.col("bins")))
        tree = _grow(left, 1, directions, depth, least)[0]
        if not tree.splits:
            break
        trees.append(tree)
    forget(sums)
    return start, trees


def boosted(start: float, trees: Sequence[Tree], rate: float, depth: int, bins: Column) -> Column:
    out = F.lit(float(start))
    return out + rate * len(trees) * prediction(trees, depth, bins) if trees else out
