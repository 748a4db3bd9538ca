"""Links between records: codes with confusable characters, boxes, one-to-one pairs, bracketing lines."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import reduce
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import forget, shared_table
from .ranks import running_sums
from .rounds import FINISH, dropped, one_to_one

# Pairs of characters that readers take for each other, and one member for each chain of such pairs.
CONFUSABLE = "01 17 38 56 69 49 0O 1I 5S 8B 2Z -/".split()
FOLD_FROM, FOLD_TO = "17OI8B569SZ/", "00003344442-"
_EITHER_WAY = {p for x in CONFUSABLE for p in (x, x[::-1])}
_PARTNERS = {c: [p[1] for p in sorted(_EITHER_WAY) if p[0] == c] for c in "".join(CONFUSABLE)}


def folded(code: Column) -> Column:
    """A code with confusable characters made equal."""
    return F.translate(F.upper(code), FOLD_FROM, FOLD_TO)


def shortened(text: Column, deletions: int) -> Column:
    """All texts that arise by deleting up to so many (at most two) characters, the text included, as an array."""
    n = F.length(text)
    part = lambda first, last: F.substring(text, first, F.greatest(last - first + 1, F.lit(0)))
    places = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    one = F.transform(places, lambda i: F.concat(part(F.lit(1), i - 1), part(i + 1, n)))
    two = F.flatten(
        F.transform(
            places,
            lambda i: F.transform(
                F.filter(places, lambda j: j > i), lambda j: F.concat(part(F.lit(1), i - 1), part(i + 1, j - 1), part(j + 1, n))
            ),
        )
    )
    return F.array_distinct(F.concat(F.array(text), *[one, two][:deletions]))


def near_texts(left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """_a, _b, distance of all pairs of distinct texts (_text) of both sides within `most` edits."""
    if not 0 <= most <= 2:
        raise ValueError("at most two edits")
    pieces = lambda df, c: df.select(F.col("_text").alias(c)).distinct().select(
        c, F.explode(F.transform(shortened(F.col(c), most), lambda t: F.xxhash64(t))).alias("_piece")
    )
    pairs = pieces(left, "_a").join(pieces(right, "_b"), "_piece").select("_a", "_b").distinct()
    return pairs.withColumn("distance", F.levenshtein("_a", "_b")).where(F.col("distance") <= most)


def near_codes(codes: DataFrame, registry: DataFrame, code: str, name: str, most: int, best: int | None = None) -> DataFrame:
    """code, name, distance of all pairs whose folded edit distance is at most `most` (0 to 2); none is missed.

    With `best`, names farther than the nearest `best` of a code are left out (all at the last one's distance stay): folded texts are
    weighed by how many names they stand for, before any pair is spread.

    Two texts within d edits share a text that each reaches by at most d deletions, so distinct folded texts meet on these,
    by hash, and only their pairs are spread to codes and names. Null codes and names pair with nothing; repeated ones
    count once.
    """
    side = lambda df, c: df.select(c).where(F.col(c).isNotNull()).distinct().withColumn("_text", folded(F.col(c)))
    left, right = side(codes, code), side(registry, name)
    pairs = near_texts(left, right, most)
    if best is not None:
        nearer = Window.partitionBy("_a").orderBy("distance").rangeBetween(Window.unboundedPreceding, -1)
        names = right.groupBy(F.col("_text").alias("_b")).agg(F.count(F.lit(1)).alias("_names"))
        pairs = pairs.join(names, "_b").withColumn("_nearer", F.coalesce(F.sum("_names").over(nearer), F.lit(0)))
        pairs = pairs.where(F.col("_nearer") < best).select("_a", "_b", "distance")
    left, right = left.withColumnRenamed("_text", "_a"), right.withColumnRenamed("_text", "_b")
    return left.join(pairs, "_a").join(right, "_b").select(code, name, "distance")


def nearest_hashes(hashes: DataFrame, asked: Column, best: int, rows: int = 65_536, questions: int = 8_192) -> DataFrame:
    """id, other, distance: per cell the `best` rows of another id whose hash differs in the fewest bits, ties to smaller ids; hashes: id, h (longs).

    Every row that `asked` holds for meets all rows, in cells of about `questions` by `rows`. A cell compares one question at a time with its rows, so a task
    holds one cell and nothing is sorted but what the cells leave: at most `best` rows a question and cell. Rows with nulls take no part.
    """
    known = hashes.where("id is not null and h is not null").select(F.col("id").cast("long"), "h")
    n, m = known.agg(F.count(F.lit(1)), F.count_if(asked)).first()
    blocks, parts = max(1, -(-n // rows)), max(1, -(-m // questions))
    deal = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = known.where(asked).withColumn("part", deal(parts)).withColumn("block", each(blocks))
    right = known.withColumn("block", deal(blocks)).withColumn("part", each(parts))

    def compare(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        theirs = theirs.sort_by("id")
        ids, h, found = theirs["id"].to_numpy(), theirs["h"].to_numpy().view(np.uint64), []
        for i, x in zip(mine["id"].to_pylist(), mine["h"].to_numpy().view(np.uint64), strict=True):
            apart = np.bitwise_count(h ^ x)
            apart[slice(*np.searchsorted(ids, [i, i + 1]))] = 255
            for _ in range(min(best, len(ids))):
                at = apart.argmin()  # the first of the least
                if apart[at] == 255:
                    break
                found.append((i, int(ids[at]), int(apart[at])))
                apart[at] = 255
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.table({"id": pa.array(columns[0], pa.int64()), "other": pa.array(columns[1], pa.int64()), "distance": pa.array(columns[2], pa.int32())})

    cells = left.groupBy("part", "block").cogroup(right.groupBy("part", "block"))
    return cells.applyInArrow(compare, "id long, other long, distance int")


def reading_cost(a: str, b: str, cheap: float = 0.4) -> float:
    """Edit distance in which confusable characters cost `cheap`; equal ends cost nothing and are left out first."""
    head = len(os.path.commonprefix([a, b]))
    a, b = a[head:], b[head:]
    tail = len(os.path.commonprefix([a[::-1], b[::-1]]))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    above = [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [float(i)]
        for j, y in enumerate(b, 1):
            swap = 0.0 if x == y else cheap if x + y in _EITHER_WAY else 1.0
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + swap))
        above = row
    return above[-1]


def swapped(text: str, times: int) -> list[str]:
    """All texts with exactly so many characters replaced by a confusable one."""
    places = [i for i, x in enumerate(text) if x in _PARTNERS]
    found = []
    for at in combinations(places, times):
        for chosen in product(*(_PARTNERS[text[i]] for i in at)):
            own = list(text)
            for i, x in zip(at, chosen, strict=True):
                own[i] = x
            found.append("".join(own))
    return found


def linked_codes(codes: DataFrame, registry: DataFrame, facts: list[str], most: float = 2.0, few: int = 2_000) -> DataFrame:
    """code, the best two registry rows by score, and the question that they leave: CONFIRM, CHOOSE or NO_MATCH.

    codes and registry: code and facts. score = 0.8 * agreeing facts - clashing facts - cost, ties by registry code.
    CONFIRM needs cost 0, no clash, and a second candidate more than 1 behind. A cost is 0.4 * swaps of confusable characters + other edits, so the steps
    below, from the least cost that each may add, make every pair of a cost of at most `most` (2 at most). Only codes take part in a step whose best two so
    far don't beat all that it may add; facts that have to agree are keys of the join beside the text. Up to `few` rows of codes are sent to all tasks.
    """
    if not 0 <= most <= 2:
        raise ValueError("a cost of at most two")
    spark = codes.sparkSession
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = [f"_own_{f}" for f in facts]
    # a fold of single characters, so that each edit of a code is one edit of its folded text
    fold = lambda c: F.translate(c, FOLD_FROM, FOLD_TO)

    def side(df: DataFrame, name: str, names: list[str]) -> DataFrame:
        rows = df.select(F.col("code").alias(name), *[F.col(f).alias(g) for f, g in zip(facts, names, strict=True)])
        return shared_table(rows.where(F.col(name).isNotNull()).distinct().repartition(parts))

    mine, theirs = side(codes, "code", own), side(registry, "match", facts)
    missing = theirs.agg(F.count(F.lit(1)), *[F.count_if(F.col(f).isNull()) for f in facts]).first()[1:]

    @F.arrow_udf("double")
    def cost(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([reading_cost(x.as_py(), y.as_py()) for x, y in zip(a, b, strict=True)], pa.float64())

    def swaps(least: int, last: int) -> Callable[[Column], Column]:
        @F.arrow_udf("array<string>")
        def texts(a: pa.Array) -> pa.Array:
            return pa.array([[t for n in range(least, last + 1) for t in swapped(x.as_py(), n)] for x in a], pa.list_(pa.string()))

        return texts

    pieces = lambda n: (lambda c: shortened(c, n),) * 2
    folded_pieces = lambda n: (lambda c: shortened(fold(c), n),) * 2
    # the least cost of a pair that no step before has made, and the keys on which codes and registry meet
    steps = [
        (0.0, swaps(0, 1), F.array),
        (0.8, swaps(2, 2), F.array),
        (1.0, *pieces(1)),  # one edit
        (1.2, *folded_pieces(0)),  # swaps alone
        (1.4, *folded_pieces(1)),  # one edit and swaps
        (2.0, *pieces(2)),  # two edits
    ]
    # equal facts narrow a folded text enough: no need to spell out two swaps
    with_facts = [steps[0], (1.0, *pieces(1)), (0.8, *folded_pieces(0)), *steps[4:]]
    candidate = F.struct("loss", "match", "cost", "clash", *own, *facts)
    best = None
    for states in product(*(("agree", "missing", "other") if n else ("agree", "other") for n in missing)):
        by = {state: [f for f, s in zip(facts, states, strict=True) if s == state] for state in ("agree", "missing", "other")}
        rows = theirs
        for state, fs in by.items():
            for f in fs:
                rows = rows.where(F.col(f).isNull() if state == "missing" else F.col(f).isNotNull())
        asked = mine.where(reduce(Column.__and__, (F.col(f"_own_{f}").isNotNull() for f in by["agree"]), F.lit(True)))
        asked = asked.withColumn("clash", sum((F.col(f"_own_{f}").isNotNull().cast("int") for f in by["other"]), F.lit(0)))
        if len(by["other"]) == 1:
            # three values of a fact leave two that clash with any value
            order = Window.partitionBy("match", *by["agree"]).orderBy(*by["other"])
            rows = rows.withColumn("_at", F.row_number().over(order)).where("_at <= 3").drop("_at")
        # dealt out before each name is taken to pieces; by a key, Spark would leave it as the distinct rows lie
        rows = shared_table(rows.repartition(parts))
        names = shared_table(rows.select("match", *by["agree"]).distinct().repartition(parts))
        for least, left_keys, right_keys in with_facts if by["agree"] else steps:
            if least > most:
                continue
            gain = F.col("clash") - 0.8 * len(by["agree"])
            still = asked.withColumn("_bound", F.lit(None).cast("double"))
            if best is not None:
                second = best.where(F.size("best") == 2).select("code", F.get("best", F.lit(1))["loss"].alias("_bound"))
                still = asked.join(second, "code", "left")
            still = still.where(F.col("_bound").isNull() | (gain + least <= F.col("_bound") + 1e-6))
            n = still.count()
            if not n:
                continue
            key = lambda keys, c: F.explode(F.transform(keys(F.col(c)), lambda t: F.xxhash64(t))).alias("_key")
            left = still.repartition(parts).select("*", *[F.col(f"_own_{f}").alias(f) for f in by["agree"]], key(left_keys, "code"))
            right = names.select("*", key(right_keys, "match"))
            on = ["_key", *by["agree"]]
            left, right = (F.broadcast(left), right) if n <= few else (left.repartition(parts, *on), right.repartition(parts, *on))
            pairs = left.join(right, on).drop("_key")
            near = F.greatest(F.lit(0.0), 0.4 * F.levenshtein("code", "match"))
            pairs = pairs.where((near <= most + 1e-6) & (F.col("_bound").isNull() | (gain + near <= F.col("_bound") + 1e-6))).distinct()
            pairs = pairs.repartition(parts).withColumn("cost", cost("code", "match")).where(F.col("cost") <= most)
            pairs = pairs.join(rows, ["match", *by["agree"]]) if by["missing"] or by["other"] else pairs
            for f in by["other"]:
                pairs = pairs.where(F.coalesce(F.col(f"_own_{f}") != F.col(f), F.lit(True)))
            score = F.round(0.8 * F.lit(len(by["agree"])) - F.col("clash") - F.col("cost"), 6)
            found = pairs.withColumn("loss", -score).select("code", candidate.alias("c"))
            if best is not None:
                found = found.unionByName(best.select("code", F.explode("best").alias("c")))
            # the two least of each code; a pair that two steps make is one, as its facts are part of it
            order = Window.partitionBy("code").orderBy("c")
            found = found.withColumn("_at", F.dense_rank().over(order)).where("_at <= 2")
            before, best = best, shared_table(found.groupBy("code").agg(F.array_sort(F.collect_set("c")).alias("best")))
            if before is not None:
                forget(before)
        forget(rows, names)
    forget(mine, theirs)
    if best is None:
        return codes.select("code").distinct().select("code", *[F.lit(None).cast("string").alias(c) for c in ("first", "second")], F.lit("NO_MATCH").alias("question"))
    first, second = F.get("best", F.lit(0)), F.get("best", F.lit(1))
    alone = second.isNull() | (second["loss"] - first["loss"] > 1)
    kind = F.when(F.col("best").isNull(), "NO_MATCH").when((first["cost"] == 0) & (first["clash"] == 0) & alone, "CONFIRM").otherwise("CHOOSE")
    return codes.select("code").distinct().join(best, "code", "left").select(
        "code", first["match"].alias("first"), second["match"].alias("second"), kind.alias("question")
    )


def cells(low: Column, high: Column, size: float) -> Column:
    return F.explode(F.sequence(F.floor(low / size), F.floor(high / size)))


def overlapping(boxes: DataFrame, other: DataFrame, size: float) -> DataFrame:
    """Pairs of boxes that share area, once each, over a grid of cells: columns of both, b's with `b_`.

    boxes: page, id, x0, y0, x1, y1. The pair is kept in the cell of the lower corner of its intersection alone.
    """
    grid = lambda df: df.withColumn("cx", cells(F.col("x0"), F.col("x1"), size)).withColumn("cy", cells(F.col("y0"), F.col("y1"), size))
    b = grid(other).withColumnsRenamed({c: f"b_{c}" for c in other.columns if c != "page"})
    pairs = grid(boxes).join(b, ["page", "cx", "cy"])
    x, y = F.greatest("x0", "b_x0"), F.greatest("y0", "b_y0")
    share = (x < F.least("x1", "b_x1")) & (y < F.least("y1", "b_y1"))
    return pairs.where(share & (F.floor(x / size) == F.col("cx")) & (F.floor(y / size) == F.col("cy"))).drop("cx", "cy")


def nearest_corners(boxes: DataFrame, other: DataFrame, bands: int = 5, finish: int = FINISH) -> DataFrame:
    """page, a, b, cost: boxes that share area, each used once, taken by (cost, a, b); cost: the way between their lower corners along both axes.

    boxes, other: page, id, x0, y0, x1, y1. Pairs are made band by band, each up to twice the cost of the one before, and only of boxes that are still free. On
    one corner all boxes share area at cost 0, so the first of one side gets the first of the other and so on, without pairs. Rows with nulls take no part.
    """
    columns = ["page", "id", "x0", "y0", "x1", "y1"]
    sides = [shared_table(df.select(*columns).dropna().where("x1 > x0 and y1 > y0")) for df in (boxes, other)]
    widest = [df.agg(F.max(F.col("x1") - F.col("x0")), F.max(F.col("y1") - F.col("y0")), F.count(F.lit(1)), F.count_distinct("page", "id")).first() for df in sides]
    if not all(w[2] for w in widest):
        return sides[0].join(sides[1].select("page", F.col("id").alias("b")), "page").select("page", F.col("id").alias("a"), "b", (F.col("x0") + F.col("y0")).alias("cost")).limit(0)
    most, found = 1.001 * float(max(w[0] for w in widest) + max(w[1] for w in widest)), []

    def settle(won: DataFrame) -> None:
        found.append(shared_table(won.select("page", "a", "b", "cost")))
        for i, end in enumerate("ab"):
            left = shared_table(sides[i].join(found[-1].select("page", F.col(end).alias("id")), ["page", "id"], "left_anti").select(*columns))
            forget(sides[i])
            sides[i] = left

    cost = F.abs(F.col("x0") - F.col("b_x0")) + F.abs(F.col("y0") - F.col("b_y0"))
    if all(w[2] == w[3] for w in widest):
        corner = ["page", "x0", "y0"]
        placed = [running_sums(df.withColumn("n", F.lit(1)), corner, [F.col("id")], ["n"]).select(*corner, "id", "n_upto") for df in sides]
        same = placed[0].join(placed[1].withColumnRenamed("id", "b"), [*corner, "n_upto"])
        settle(same.withColumns({"b_x0": F.col("x0"), "b_y0": F.col("y0")}).select("page", F.col("id").alias("a"), "b", cost.alias("cost")))
    share = (F.greatest("x0", "b_x0") < F.least("x1", "b_x1")) & (F.greatest("y0", "b_y0") < F.least("y1", "b_y1"))
    low = 0.0
    for high in (most / 2**k for k in reversed(range(bands))):
        cell = lambda c, high=high: F.floor(F.col(c) / (1.001 * high))
        around = lambda c, cell=cell: F.explode(F.array(cell(c) - 1, cell(c), cell(c) + 1))
        left = sides[0].withColumn("cx", around("x0")).withColumn("cy", around("y0"))
        right = sides[1].withColumnsRenamed({c: f"b_{c}" for c in columns[1:]})
        pairs = left.join(right.withColumn("cx", cell("b_x0")).withColumn("cy", cell("b_y0")), ["page", "cx", "cy"])
        pairs = pairs.where(share & (cost >= low) & (cost < high))
        settle(one_to_one(pairs.select("page", F.col("id").alias("a"), F.col("b_id").alias("b"), cost.alias("cost")), finish))
        low = high
    return reduce(DataFrame.unionByName, found)


def longest_texts(boxes: DataFrame, size: float, share: float = 0.6) -> DataFrame:
    """Boxes that stay when, from the longest text down, each drops that a kept one covers by more than `share` of its area.

    boxes: page, id, x0, y0, x1, y1, text. Only boxes with a longer (or equal and smaller id) box over them can drop;
    these pairs, found over a grid, are decided in rounds.
    """
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    width = F.least("x1", "b_x1") - F.greatest("x0", "b_x0")
    height = F.least("y1", "b_y1") - F.greatest("y0", "b_y0")
    first = (F.length("b_text") > F.length("text")) | ((F.length("b_text") == F.length("text")) & (F.col("b_id") < F.col("id")))
    over = overlapping(boxes, boxes, size).where(first & (width * height > share * area))
    fallen = dropped(over.select("page", "id", F.col("b_id").alias("by")))
    return boxes.join(fallen, ["page", "id"], "left_anti")


def bracketed(points: DataFrame, lines: list[tuple[str, float]], x: str, overhang: float = 1.5, near: float = 0.4) -> DataFrame:
    """points with `grid` (line number plus the share of the way to the next line) and `label` of the nearest line.

    lines: label and position, ascending. Outside the lines the first or last gap goes on for `overhang` gaps; beyond,
    grid is null. The label is null if the nearest line is more than `near` of the gap beside it away.
    """
    positions, labels = F.array(*[F.lit(float(p)) for _, p in lines]), F.array(*[F.lit(n) for n, _ in lines])
    n, at = len(lines), F.col(x)
    below = F.size(F.filter(positions, lambda p: p <= at))
    i = F.least(F.greatest(below, F.lit(1)), F.lit(n - 1))
    a, gap = F.get(positions, i - 1), F.get(positions, i) - F.get(positions, i - 1)
    share = (at - a) / gap
    grid = F.when(share.between(-overhang, 1 + overhang), i + share)
    nearest = F.when(share <= 0.5, i - 1).otherwise(i)
    label = F.when(F.abs(at - F.get(positions, nearest)) <= near * gap, F.get(labels, nearest))
    return points.withColumn("grid", grid).withColumn("label", label)
