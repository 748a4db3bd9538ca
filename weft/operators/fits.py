"""Models fitted by sums: least squares, likelihoods, mixtures, trees, boosting, calibration, review as it learns.

Equal rows are counted first where a fit reads the rows in each step, and written once; the driver sees sums alone, whose
number is set by parameters (features, folds, members, depth). Rows with a null in a used column take no part. A fit of no
rows raises ValueError.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import forget, shared_table
from . import ranks
from .models import uniform

# The normal distribution function by a polynomial, error below 7.5e-8.
NORMAL_T, NORMAL_B = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def normal_density(z: Column) -> Column:
    return F.exp(-z * z / 2) / float(np.sqrt(2 * np.pi))


def normal_cdf(z: Column) -> Column:
    t = 1 / (1 + NORMAL_T * F.abs(z))
    powers = F.lit(0.0)
    for b in reversed(NORMAL_B):
        powers = (powers + b) * t
    tail = normal_density(z) * powers
    return F.when(z < 0, tail).otherwise(1 - tail)


def logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def _counted(rows: DataFrame, columns: Sequence[str], sums: dict[str, Column] | None = None) -> DataFrame:
    whole = rows.dropna(subset=list(columns))
    sums = sums or {}
    return shared_table(whole.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"), *[v.alias(k) for k, v in sums.items()]))


def gram(rows: DataFrame, basis: Sequence[Column], y: Column, by: Sequence[Column] = (), weight: Column | None = None) -> dict[tuple, np.ndarray]:
    """For each group, the weighted sums of products of all pairs of (basis, y), as a symmetric matrix; one pass.

    Groups are folds or members, a number set by parameters. A null in any basis column or y leaves the row out.
    """
    columns = [*basis, y]
    places = list(itertools.combinations_with_replacement(range(len(columns)), 2))
    w = F.lit(1.0) if weight is None else weight
    known = rows.where(sum((c.isNull().cast("int") for c in columns), F.lit(0)) == 0)
    keys = [c.alias(f"_by_{i}") for i, c in enumerate(by)]
    found = {}
    for row in known.groupBy(*keys).agg(*[F.sum(columns[i] * columns[j] * w) for i, j in places]).collect():
        if row[len(keys)] is None:
            continue
        m = np.zeros((len(columns), len(columns)))
        for (i, j), s in zip(places, row[len(keys) :], strict=True):
            m[i, j] = m[j, i] = s
        found[tuple(row[: len(keys)])] = m
    if not found:
        raise ValueError("no rows to fit")
    return found


def solve(g: np.ndarray, ridge: float = 0.0, use: Sequence[int] | None = None) -> np.ndarray:
    """Coefficients from a matrix of `gram`; the first basis column is the constant, which the ridge leaves alone."""
    use = list(range(len(g) - 1)) if use is None else list(use)
    penalty = np.diag([0.0 if i == 0 else ridge for i in use])
    return np.linalg.solve(g[np.ix_(use, use)] + penalty, g[use, -1])


def cross_validated(
    rows: DataFrame, basis: Sequence[Column], y: Column, fold: Column, families: dict[str, Sequence[int]], ridges: Sequence[float]
) -> list[tuple[str, float, float]]:
    """(family, ridge, mean squared error on held-out folds), best first, for nested families of basis columns.

    One pass takes the sums of each fold; every fit and every error comes from them. Ties go to the earlier family and ridge.
    """
    folds = gram(rows, basis, y, [fold])
    total = sum(folds.values())
    found = []
    for family, use in families.items():
        for ridge in ridges:
            lost = 0.0
            for g in folds.values():
                w = solve(total - g, ridge, use)
                lost += g[-1, -1] - 2 * w @ g[list(use), -1] + w @ g[np.ix_(use, use)] @ w
            found.append((family, float(ridge), float(lost / total[0, 0])))
    return sorted(found, key=lambda f: f[2])


def bagged(rows: DataFrame, basis: Sequence[Column], y: Column, key: Sequence[Column], members: int) -> np.ndarray:
    """Coefficients of members (rows) fitted on bootstrap samples; their mean is the ensemble, as it is linear.

    Each row counts in each member a Poisson(1) number of times, drawn by the hash of its key, so no rows are moved.
    """
    u = uniform(F.lit("bag"), F.col("_member"), *[k.cast("string") for k in key])
    steps = np.cumsum([np.exp(-1) / f for f in (1, 1, 2, 6, 24, 120, 720)])
    often = sum(((u >= float(s)).cast("double") for s in steps), F.lit(0.0))
    spread = rows.withColumn("_member", F.explode(F.array(*[F.lit(m) for m in range(members)])))
    fits = gram(spread, basis, y, [F.col("_member")], often)
    return np.array([solve(fits[(m,)]) for m in range(members)])


def likelihood(
    rows: DataFrame, features: Sequence[str], y: str, link: str = "logistic", strength: float = 3.0, floor: float = 0.0, most: int = 50
) -> np.ndarray:
    """Constant and slopes that maximise the Bernoulli likelihood of y in {0, 1} less slopes' squares / (2 * strength).

    link: logistic or probit; `floor` is the rate at which labels are flipped either way. Fisher scoring, one aggregate a
    step over counted rows. Raises ValueError where it has not converged after `most` steps.
    """
    if link not in ("logistic", "probit") or not 0 <= floor < 0.5 or strength <= 0:
        raise ValueError("link, floor or strength is not valid")
    counted = _counted(rows, [*features, y])
    x = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    at, k = np.zeros(len(x)), len(x)
    for _ in range(most):
        z = sum((float(a) * c for a, c in zip(at, x, strict=True)), F.lit(0.0))
        clean = logistic(z) if link == "logistic" else normal_cdf(z)
        slope = clean * (1 - clean) if link == "logistic" else normal_density(z)
        p = F.least(F.greatest(floor + (1 - 2 * floor) * clean, F.lit(1e-12)), F.lit(1 - 1e-12))
        slope = (1 - 2 * floor) * slope
        pull, weight = F.col("_n") * (F.col(y) - p) * slope / (p * (1 - p)), F.col("_n") * slope * slope / (p * (1 - p))
        pairs = list(itertools.combinations_with_replacement(range(k), 2))
        row = counted.agg(*[F.sum(pull * c) for c in x], *[F.sum(weight * x[i] * x[j]) for i, j in pairs]).collect()[0]
        if row[0] is None:
            raise ValueError("no rows to fit")
        gradient, info = np.array(row[:k]), np.zeros((k, k))
        for (i, j), s in zip(pairs, row[k:], strict=True):
            info[i, j] = info[j, i] = s
        penalty = np.array([0.0] + [1 / strength] * (k - 1))
        step = np.linalg.solve(info + np.diag(penalty), gradient - penalty * at)
        at = at + step
        if np.abs(step).max() < 1e-9:
            forget(counted)
            return at
    raise ValueError("the likelihood fit did not converge")


def simplex_weights(rows: DataFrame, members: Sequence[str], y: str, most: int = 60, gap: float = 1e-9) -> np.ndarray:
    """Weights (not negative, sum 1) of member probabilities, at most eight, whose mixture has the least log-loss.

    Damped Newton steps, each one aggregate over counted rows; a step's quadratic is minimised on the simplex by trying each
    set of positive weights. Stops when the log-loss is proven to be within `gap` of the least, else raises ValueError.
    """
    k = len(members)
    if not 1 <= k <= 8:
        raise ValueError("one to eight members")
    counted = _counted(rows, [*members, y])
    q = [F.least(F.greatest(F.when(F.col(y) == 1, F.col(m)).otherwise(1 - F.col(m)), F.lit(1e-12)), F.lit(1.0)) for m in members]
    pairs = list(itertools.combinations_with_replacement(range(k), 2))
    w = np.full(k, 1 / k)
    for _ in range(most):
        mix = sum((float(a) * c for a, c in zip(w, q, strict=True)), F.lit(0.0))
        n = F.col("_n")
        row = counted.agg(F.sum(n), *[F.sum(n * c / mix) for c in q], *[F.sum(n * q[i] * q[j] / (mix * mix)) for i, j in pairs]).collect()[0]
        if not row[0]:
            raise ValueError("no rows to fit")
        g, h = np.array(row[1 : k + 1]) / row[0], np.zeros((k, k))
        for (i, j), s in zip(pairs, row[k + 1 :], strict=True):
            h[i, j] = h[j, i] = s / row[0]
        if g.max() - 1 <= gap:  # the log-loss is convex, so this bounds what is left
            forget(counted)
            return w
        best, least = w, 0.0
        for r in range(1, k + 1):
            for use in map(list, itertools.combinations(range(k), r)):
                # least of -g.v + (v-w) h (v-w) / 2 over v on these members, sum 1
                lines = np.block([[h[np.ix_(use, use)], np.ones((r, 1))], [np.ones((1, r)), np.zeros((1, 1))]])
                v = np.zeros(k)
                v[use] = np.linalg.lstsq(lines, np.append((h @ w + g)[use], 1.0), rcond=None)[0][:r]
                value = -g @ (v - w) + (v - w) @ h @ (v - w) / 2
                if v.min() >= 0 and value < least:
                    best, least = v, value
        d = best - w
        size = float(np.sqrt(max(d @ h @ d, 0.0)))
        w = w + d * (1.0 if size < 0.25 else 1 / (1 + size))
        w = np.maximum(w, 0) / np.maximum(w, 0).sum()
    raise ValueError("the weights did not converge")


def _split_sums(counted: DataFrame, features: Sequence[str], by: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Sums up to each value of each feature, by node: one row a node, feature and value."""
    stacked = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f).cast("double").alias("value")) for i, f in enumerate(features)]))
    long = counted.select(*by, *sums, stacked.alias("_at")).select(*by, *sums, "_at.feature", "_at.value")
    each = long.groupBy(*by, "feature", "value").agg(*[F.sum(c).alias(c) for c in sums])
    return ranks.running_sums(each, [*by, "feature"], [F.col("value")], sums)


def gate_tree(rows: DataFrame, features: Sequence[str], bad: str, depth: int = 2) -> tuple[dict[int, tuple[str, float]], dict[int, bool]]:
    """Splits (node to feature and threshold; rows up to it go to 2 * node, others to the next) and leaves (node to bad).

    Both classes weigh the same in all; a split has the least Gini impurity, ties by feature order, then smaller value. Pure
    nodes and nodes of equal rows are leaves; a leaf is bad if more than half of its weight is. bad: boolean.
    """
    counted = _counted(rows, features, {"_bad": F.count_if(F.col(bad)), "_good": F.count_if(~F.col(bad))})
    all_bad, all_good = counted.agg(F.sum("_bad"), F.sum("_good")).collect()[0]
    if all_bad is None:
        raise ValueError("no rows to fit")
    all_bad, all_good = max(all_bad, 1), max(all_good, 1)
    gini = lambda b, g: F.when(b + g > 0, b / all_bad * (g / all_good) / (b / all_bad + g / all_good)).otherwise(0.0)
    splits: dict[int, tuple[str, float]] = {}
    placed = lambda: counted.withColumn("node", node_of(splits, depth))
    for level in range(depth):
        run = _split_sums(placed().where(F.col("node") >= 2**level), features, ["node"], ["_bad", "_good"])
        b, g, tb, tg = (F.col(c) for c in ("_bad_upto", "_good_upto", "_bad_all", "_good_all"))
        cuts = run.where((b + g < tb + tg) & (tb > 0) & (tg > 0))
        loss = F.round(gini(b, g) + gini(tb - b, tg - g), 12)
        best = cuts.groupBy("node").agg(F.min(F.struct(loss.alias("loss"), "feature", "value")).alias("best")).collect()
        splits |= {r["node"]: (features[r["best"]["feature"]], r["best"]["value"]) for r in best}
    sides = placed().groupBy("node").agg(F.sum("_bad").alias("b"), F.sum("_good").alias("g")).collect()
    forget(counted)
    return splits, {r["node"]: r["b"] / all_bad > r["g"] / all_good for r in sides}


def node_of(splits: dict[int, tuple[str, float]], depth: int) -> Column:
    """The node in which a row ends."""
    node = F.lit(1)
    for _ in range(depth):
        following = node
        for at, (feature, value) in splits.items():
            following = F.when(node == at, 2 * at + (F.col(feature) > value).cast("int")).otherwise(following)
        node = following
    return node


def boosted_stumps(rows: DataFrame, features: dict[str, int], y: str, rounds: int, rate: float) -> tuple[float, list[tuple]]:
    """Mean of y, and each round's (feature, threshold, left, right): squared error lowered by one cut at a time.

    features: name to 1 (may only rise), -1 (may only fall) or 0. A cut against its direction is not taken; ties go to the
    earlier feature, then to the smaller value. Fewer rounds come back where no cut is left.
    """
    names = list(features)
    counted = _counted(rows.where(F.col(y).isNotNull()), names, {"_y": F.sum(F.col(y).cast("double"))})
    n, s = counted.agg(F.sum("_n"), F.sum("_y")).collect()[0]
    if not n:
        raise ValueError("no rows to fit")
    direction = F.array(*[F.lit(features[f]) for f in names])
    start, stages = s / n, []
    for _ in range(rounds):
        left = counted.withColumn("_left", F.col("_y") - F.col("_n") * boosted(start, stages, rate))
        run = _split_sums(left, names, [], ["_n", "_left"])
        low, high = F.col("_left_upto") / F.col("_n_upto"), (F.col("_left_all") - F.col("_left_upto")) / (F.col("_n_all") - F.col("_n_upto"))
        cuts = run.where(F.col("_n_upto") < F.col("_n_all")).where(F.get(direction, F.col("feature")) * (high - low) >= 0)
        gain = low * F.col("_left_upto") + high * (F.col("_left_all") - F.col("_left_upto"))
        best = cuts.agg(F.min(F.struct((-F.round(gain, 3)).alias("loss"), "feature", "value", low.alias("low"), high.alias("high")))).collect()[0][0]
        if best is None:
            break
        stages.append((names[best["feature"]], best["value"], best["low"], best["high"]))
    forget(counted)
    return start, stages


def boosted(start: float, stages: Sequence[tuple], rate: float) -> Column:
    """Prediction of `boosted_stumps`; a null feature counts as above every threshold."""
    out = F.lit(float(start))
    for feature, value, low, high in stages:
        out = out + rate * F.when(F.col(feature) <= value, F.lit(float(low))).otherwise(F.lit(float(high)))
    return out


def standardised(rows: DataFrame, group: str, columns: Sequence[str], train: Column) -> DataFrame:
    """rows with `<c>_z`: distance from the group's training mean in its training deviations (1e-8 at least).

    Groups are joined, so they may be many; rows of groups without training rows and nulls have null.
    """
    fit = rows.where(train).groupBy(group).agg(
        *[F.avg(c).alias(f"_mean_{c}") for c in columns], *[F.greatest(F.stddev_pop(c), F.lit(1e-8)).alias(f"_scale_{c}") for c in columns]
    )
    z = {f"{c}_z": (F.col(c) - F.col(f"_mean_{c}")) / F.col(f"_scale_{c}") for c in columns}
    return rows.join(fit, group, "left").withColumns(z).select(*rows.columns, *z)


def calibrated(train: DataFrame, rows: DataFrame, features: Sequence[str], y: str, strength: float = 1.0) -> DataFrame:
    """rows with `confidence`: logistic probability of y, then the monotone step function fitted to it, both on train.

    Between the steps' ends it interpolates, beyond them it keeps the end. Rows with null features are left out.
    """
    w = likelihood(train, features, y, strength=strength)
    p = logistic(sum((float(a) * F.col(f) for a, f in zip(w[1:], features, strict=True)), F.lit(float(w[0]))))
    as_vector = VectorAssembler(inputCols=["_p"], outputCol="_at")
    pooled = _counted(train.withColumn("_p", p), ["_p"], {"_hits": F.sum(F.col(y))})
    shares = pooled.select("_p", (F.col("_hits") / F.col("_n")).alias("_share"), F.col("_n").cast("double").alias("_weight"))
    fit = IsotonicRegression(featuresCol="_at", labelCol="_share", weightCol="_weight", predictionCol="confidence").fit(as_vector.transform(shares))
    forget(pooled)
    return fit.transform(as_vector.transform(rows.dropna(subset=list(features)).withColumn("_p", p))).select(*rows.columns, "confidence")


def reviewed(rows: DataFrame, batch: Column, score: Column, right: Column, target: float, bins: int = 20) -> DataFrame:
    """batch, rows, taken, hits, bin: what passes without review when each batch uses the bound that the batches before it set.

    Scores in [0, 1] are dealt to equal bins; the bound is the least bin from which on the share of right rows so far is at
    least `target` (null and nothing taken if there is none, as in the first batch). Counts go to batches and bins
    before they are added up, in ranges of batches, so batches may be many. right: boolean; null scores count as bin 0.
    """
    at = F.least(F.floor(F.coalesce(score, F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")
    counts = rows.select(batch.alias("batch"), at.alias("bin"), right.cast("int").alias("hit")).groupBy("batch", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits")
    )
    grid = counts.select("batch").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    whole = grid.join(counts, ["batch", "bin"], "left").fillna(0, ["n", "hits"])
    down = Window.partitionBy("batch").orderBy(F.desc("bin"))  # a batch has `bins` rows here
    above = whole.withColumn("n", F.sum("n").over(down)).withColumn("hits", F.sum("hits").over(down))
    run = ranks.running_sums(above, ["bin"], [F.col("batch")], ["n", "hits"])
    seen, known = F.col("n_upto") - F.col("n"), F.col("hits_upto") - F.col("hits")
    bound = F.when((seen > 0) & (known >= target * seen), F.struct("bin", "n", "hits"))
    found = run.groupBy("batch").agg(F.max(F.when(F.col("bin") == 0, F.col("n"))).alias("rows"), F.min(bound).alias("b"))
    pick = lambda c: F.coalesce(F.col(f"b.{c}"), F.lit(0))
    return found.select("batch", "rows", pick("n").alias("taken"), pick("hits").alias("hits"), F.col("b.bin").alias("bin"))


def best_variant(rows: DataFrame, kind: str, variants: Sequence[str], reference: str, enough: int, least: float, trusted: float) -> DataFrame:
    """kind, variant, agreed, compared, distrusted, factor: for each kind the reading that agrees most with the reference.

    Ties go to the earlier variant. Nulls on either side are not compared. A kind is distrusted if at least `enough` were
    compared and at most the share `least` agreed; else its findings are weighed by factor, agreement over `trusted`, 1 at most.
    """
    pairs = [F.struct(F.lit(-i).alias("order"), F.lit(v).alias("variant"), F.col(v).alias("read")) for i, v in enumerate(variants)]
    long = rows.select(kind, F.col(reference).alias("_true"), F.explode(F.array(*pairs)).alias("_v")).where(
        F.col("_true").isNotNull() & F.col("_v.read").isNotNull()
    )
    counts = long.groupBy(kind, "_v.order", "_v.variant").agg(
        F.count_if(F.col("_v.read") == F.col("_true")).alias("agreed"), F.count(F.lit(1)).alias("compared")
    )
    best = counts.groupBy(kind).agg(F.max(F.struct("agreed", "order", "variant", "compared")).alias("b")).select(kind, "b.*")
    share = F.col("agreed") / F.col("compared")
    distrusted = (F.col("compared") >= enough) & (F.col("agreed") <= least * F.col("compared"))
    return best.select(
        kind, "variant", "agreed", "compared", distrusted.alias("distrusted"),
        F.when(~distrusted, F.when(F.col("compared") >= enough, F.least(share / trusted, F.lit(1.0))).otherwise(1.0)).alias("factor"),
    )


def ordered_alignment(votes: DataFrame) -> DataFrame:
    """kind, level, target: levels mapped to targets in order, never back, so that they gather the most votes.

    votes: kind, level, target (ranks on one scale, whole numbers), votes, size (of the level). A step of distance costs a
    hundredth of a vote, sharing the former level's target a quarter of the level's size. Equal maps: the one whose last
    level has the higher target, and so on down. Every level that has votes gets a target. A kind's levels are one task's
    rows: at most levels times targets. Nulls take no part; repeated rows add up, sizes take the most.
    """
    known = votes.dropna(subset=["kind", "level", "target", "votes", "size"])
    known = known.groupBy("kind", "level", "target").agg(F.sum("votes").cast("long").alias("votes"), F.max("size").cast("long").alias("size"))
    schema = known.select("kind", "level", "target").schema

    def align(key, rows):
        levels, targets = sorted(rows["level"].unique()), sorted(rows["target"].unique())
        own = {(r.level, r.target): 100 * r.votes for r in rows.itertuples()}
        size = rows.groupby("level")["size"].max()
        tables: list[dict] = []
        for level in levels:
            table = {}
            for t in targets:
                score = own.get((level, t), 0) - abs(t - level)
                if not tables:
                    table[t] = (score, t)
                    continue
                table[t] = max((s + score - (25 * size[level] if p == t else 0), p) for p, (s, _) in tables[-1].items() if p <= t)
            tables.append(table)
        at = max(targets, key=lambda t: (tables[-1][t][0], t))
        out = []
        for level, table in zip(reversed(levels), reversed(tables), strict=True):
            out.append((key[0], level, at))
            at = table[at][1]
        return type(rows)(out, columns=["kind", "level", "target"])

    return known.groupBy("kind").applyInPandas(align, schema)
