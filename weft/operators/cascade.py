"""Comparison of two versions of the parts of elements, when no key joins the parts: a cascade of tiers.

Parts: el, id (unique in el), size, qty and gap (null: not stated). Two numbers are equal, different or, if one isn't stated, unknown.
Each tier sees the parts that the earlier ones left open on both sides, and takes one-to-one pairs greedily:

1. exact: same size, nothing different, something equal; fewest unknown first. A planned part without quantity may also share a
   drawn one that is taken.
2. split: the planned quantity is the sum of several drawn parts of the size (fewest parts; ties to those that come first). Planned parts
   of an element and size choose in order of their ids.
3. differs: same size, something different; fewest differences, then least relative distance, first. If only the quantity differs and is a multiple
   of the plan's (2 to 12 times), it's `multiple`.
4. unknown: there's a drawn part of the size left, but nothing to compare.
5. swapped: another size, nothing different, something equal.
6. absent, or unknown where no quantity was planned. Drawn parts that nothing took are added.

Elements are counted first. Those of at most `small` parts are dealt by el, once, and the elements of a batch go through all tiers together
(`_tiers`); larger ones go tier by tier through joins and rounds (`rounds`), so that no task holds one. Both give the same rows. Numbers that aren't whole
are compared by the joins alone.

Defined results: parts with null el or id take no part; a null size is equal to no size; an empty side leaves all of the other absent, unknown or
added; equal rows with one id count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules as R
from ..tables import forget, shared_table
from .rounds import FINISH, one_to_one, taken_in_order

SMALL = 100  # parts of an element on both sides, so 2500 pairs at most
TASK_ROWS = 500_000
BATCH_ROWS = 10_000
TIERS = pa.array(["exact", "split", "multiple", "differs", "unknown", "swapped", "absent", "added"])
DIFFERS = pa.array([[], ["qty"], ["gap"], ["qty", "gap"], ["size"]], pa.list_(pa.string()))
WHOLE = (T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType())

FOUND = "el long, plan_id long, tier string, shop_ids array<long>, differs array<string>"


def _relation(name: str) -> Column:
    return R.tri_state(F.col(name), F.col(f"s_{name}"))


def _count(what: str) -> Column:
    return sum(((_relation(c) == what).cast("int") for c in ("qty", "gap")), F.lit(0))


def least_parts(values: list[int], target: int) -> list[int] | None:
    """The fewest positions of at least two of the values that add up to the target; of equal numbers those met first."""
    best: dict[int, tuple[int, ...]] = {0: ()}
    for i, v in enumerate(values):
        for total, ids in sorted(best.items(), reverse=True):
            if total + v <= target and (total + v not in best or len(ids) + 1 < len(best[total + v])):
                best[total + v] = (*ids, i)
    return list(best[target]) if len(best.get(target, ())) > 1 else None


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of el, size, plan, pool (sorted arrays of id and qty) to el, plan_id, shop_ids."""
    for batch in batches:
        out = []
        for el, plan, pool in zip(*(batch.column(c).to_pylist() for c in ("el", "plan", "pool")), strict=True):
            free = [(p["id"], p["qty"]) for p in pool if p["qty"] > 0]
            for part in plan:
                if part["qty"] > 0 and (at := least_parts([q for _, q in free], part["qty"])):
                    out.append((el, part["id"], [free[i][0] for i in at]))
                    free = [f for i, f in enumerate(free) if i not in at]
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["el", "plan_id", "shop_ids"])


def _starts(values: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])


def _tiers(rows: pa.RecordBatch) -> pa.RecordBatch:
    """All tiers for whole elements; rows: el, side (0 the plan's, 1 the shop's), id, size, qty, gap in this order."""
    key = [rows.column(c).to_numpy() for c in ("el", "side", "id")]
    once = np.append(True, np.any([k[1:] != k[:-1] for k in key], axis=0))
    rows, (el, side, part) = rows.filter(pa.array(once)), (k[once] for k in key)
    size = rows.column("size").dictionary_encode().indices.fill_null(-1).to_numpy()
    known = {c: rows.column(c).is_valid().to_numpy(zero_copy_only=False) for c in ("qty", "gap")}
    value = {c: rows.column(c).fill_null(0).to_numpy() for c in ("qty", "gap")}

    # every pair of an element, by their rows
    element = np.cumsum(np.append(False, el[1:] != el[:-1]))
    plan, shop = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    many = np.bincount(element[shop], minlength=element[-1] + 1)
    n, first = many[element[plan]], (np.cumsum(many) - many)[element[plan]]
    a, b = np.repeat(plan, n), shop[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first, n)]

    both = {c: known[c][a] & known[c][b] for c in known}
    other = {c: both[c] & (value[c][a] != value[c][b]) for c in known}
    differing, unstated = sum(other.values(), np.zeros(len(a), int)), sum((~x for x in both.values()), np.zeros(len(a), int))
    same = (differing == 0) & (unstated < 2)
    sized = (size[a] == size[b]) & (size[a] >= 0)
    free, found = np.ones(len(el), bool), []

    def settle(tier: str, of: np.ndarray, ids: np.ndarray, counts: np.ndarray | int = 1, differs: np.ndarray | int = 0) -> None:
        """Rows with their number of shop parts, and all these parts; neither is open any more."""
        free[of], free[ids] = False, False
        code = TIERS.index(tier).as_py()
        found.append((np.full(len(of), code), of, np.broadcast_to(counts, len(of)), ids, np.broadcast_to(differs, len(of))))

    def pairs(wanted: np.ndarray, *cost: np.ndarray) -> np.ndarray:
        """Greedy pairs by cost, whose first is the last to be compared; equal costs stay in order of ids."""
        at = np.flatnonzero(wanted & free[a] & free[b])
        at = at[np.lexsort([c[at] for c in cost])]
        return at[taken_in_order(a[at], b[at], len(el))]

    at = pairs(sized & same, unstated)
    settle("exact", a[at], b[at])
    at = np.flatnonzero(sized & same & free[a] & ~known["qty"][a])
    at = at[_starts(a[at])]
    settle("exact", a[at], b[at])

    qty = value["qty"]
    at = np.flatnonzero(sized & free[a] & free[b] & both["qty"] & (qty[b] > 0) & (qty[b] <= qty[a]))
    n, total = np.bincount(a[at], minlength=len(el)), np.zeros(len(el), np.int64)
    np.add.at(total, a[at], qty[b[at]])
    at = at[np.where(n > 2, total >= qty, (n == 2) & (total == qty))[a[at]]]
    split, taken = [], []
    for one, pool in zip(a[at][_starts(a[at])], np.split(b[at], _starts(a[at])[1:]), strict=False):
        pool = pool[free[pool]]
        if chosen := least_parts(qty[pool].tolist(), int(qty[one])):
            free[pool[chosen]] = False
            split.append(one)
            taken.append(pool[chosen])
    settle("split", np.array(split, int), np.concatenate([np.zeros(0, int), *taken]), np.array([len(x) for x in taken], int))

    apart = sum(np.where(other[c], np.abs(value[c][b] - value[c][a]) / np.maximum(value[c][a], 1), 0.0) for c in known)
    at = pairs(sized & (differing > 0), apart, differing)
    p, s = qty[a[at]], qty[b[at]]
    times = np.where(p > 0, s / np.maximum(p, 1), 0.0)
    multiple = other["qty"][at] & ~other["gap"][at] & (times == np.floor(times)) & (times >= 2) & (times <= 12)
    settle("multiple", a[at[multiple]], b[at[multiple]])
    at = at[~multiple]
    settle("differs", a[at], b[at], differs=other["qty"][at] + 2 * other["gap"][at])

    none = np.zeros(0, int)
    settle("unknown", np.unique(a[sized & free[a] & free[b]]), none, 0)
    at = pairs(~sized & (size[a] >= 0) & (size[b] >= 0) & same, unstated)
    settle("swapped", a[at], b[at], differs=4)
    left = np.flatnonzero(free & (side == 0))
    settle("unknown", left[~known["qty"][left]], none, 0)
    settle("absent", left[known["qty"][left]], none, 0)
    left = np.flatnonzero(free)
    settle("added", left, left)

    tier, of, counts, ids, differs = (np.concatenate(x) for x in zip(*found, strict=True))
    shop_ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(part[ids]))
    columns = [pa.array(el[of]), pa.array(part[of], mask=side[of] == 1), TIERS.take(pa.array(tier)), shop_ids, DIFFERS.take(pa.array(differs))]
    return pa.RecordBatch.from_arrays(columns, ["el", "plan_id", "tier", "shop_ids", "differs"])


def _small_elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order to what `_tiers` finds; the last element of a batch may go on in the next one."""
    rest = None
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            rows = batch.slice(at, BATCH_ROWS)
            rows = rows if rest is None else pa.concat_batches([rest, rows])
            el = rows.column("el").to_numpy()
            cut = int(np.searchsorted(el, el[-1]))
            rest = rows.slice(cut)
            if cut:
                yield _tiers(rows.slice(0, cut))
    if rest is not None:
        yield _tiers(rest)


class _Open:
    """Parts that are still open on both sides, and what was found."""

    def __init__(self, plan: DataFrame, shop: DataFrame, finish: int):
        known = lambda df: df.where("el is not null and id is not null").dropDuplicates(["el", "id"])
        self.plan, self.shop = shared_table(known(plan)), shared_table(known(shop).toDF("el", "s_id", "s_size", "s_qty", "s_gap"))
        self.finish, self.found, self.all_shop = finish, [], self.shop

    def pairs(self, pairs: DataFrame, cost: Column, *extra: str) -> DataFrame:
        """Greedy pairs of candidates, with their columns again."""
        narrow = pairs.select(F.col("el").alias("page"), F.col("id").alias("a"), F.col("s_id").alias("b"), cost.alias("cost"))
        won = one_to_one(narrow, self.finish).select(F.col("page").alias("el"), F.col("a").alias("id"), F.col("b").alias("s_id"))
        return won.join(pairs, ["el", "id", "s_id"]).dropDuplicates(["el", "id", "s_id"]) if extra else won

    def settle(self, tier: Column, rows: DataFrame, shop_ids: Column, differs: Column | None = None) -> None:
        """Takes rows of el, id out of the plan, and their shop parts out of the shop."""
        differs = F.array().cast("array<string>") if differs is None else differs
        done = shared_table(rows.select("el", F.col("id").alias("plan_id"), tier.alias("tier"), shop_ids.alias("shop_ids"), differs.alias("differs")))
        self.found.append(done)
        plan = shared_table(self.plan.join(done.select("el", F.col("plan_id").alias("id")), ["el", "id"], "left_anti"))
        used = done.select("el", F.explode("shop_ids").alias("s_id"))
        shop = shared_table(self.shop.join(used, ["el", "s_id"], "left_anti"))
        forget(self.plan, *([self.shop] if self.shop is not self.all_shop else []))
        self.plan, self.shop = plan, shop


def compare_parts(plan: DataFrame, shop: DataFrame, finish: int = FINISH, small: int = SMALL) -> DataFrame:
    """el, plan_id (null: added), tier, shop_ids, differs (names of what differs); plan and shop: el, id, size, qty, gap."""
    columns = ["el", "id", "size", "qty", "gap"]
    plan, shop = (df.select(*columns).where("el is not null and id is not null") for df in (plan, shop))
    kinds = [{c: df.schema[c].dataType for c in columns} for df in (plan, shop)]
    if kinds[0]["size"] != kinds[1]["size"] or kinds[0]["size"] not in (*WHOLE, T.StringType()) or any(k[c] not in WHOLE for k in kinds for c in columns if c != "size"):
        return _by_joins(plan, shop, finish)
    whole = lambda df, side: df.select(
        F.col("el").cast("long"), F.lit(side).alias("side"), F.col("id").cast("long"), "size", F.col("qty").cast("long"), F.col("gap").cast("long")
    )
    sides = shared_table(whole(plan, 0).unionByName(whole(shop, 1)))
    large = shared_table(sides.groupBy("el").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > small).select("el"))
    some = large.count() > 0
    dealt = sides.join(large, "el", "left_anti") if some else sides
    tasks = max(sides.sparkSession.sparkContext.defaultParallelism, sides.count() // TASK_ROWS + 1)
    dealt = dealt.repartition(tasks, "el").sortWithinPartitions("el", "side", "id", "size", "qty", "gap")
    out = dealt.mapInArrow(_small_elements, FOUND)
    if some:
        kept = sides.join(large, "el", "left_semi")
        out = out.unionByName(_by_joins(*(kept.where(F.col("side") == i).select(*columns) for i in (0, 1)), finish))
    return out


def _by_joins(plan: DataFrame, shop: DataFrame, finish: int) -> DataFrame:
    """What `compare_parts` returns, tier by tier over all elements."""
    now = _Open(plan, shop, finish)
    one, none = F.array("s_id"), F.array().cast("array<long>")
    sized = lambda shop=None: now.plan.join(
        (now.shop if shop is None else shop).withColumn("size", F.col("s_size")), ["el", "size"]
    )
    same = (_count("!") == 0) & (_count("=") > 0)

    now.settle(F.lit("exact"), now.pairs(sized().where(same), _count("?")), one)
    shared = sized(now.all_shop).where(same & F.col("qty").isNull()).groupBy("el", "id").agg(F.min("s_id").alias("s_id"))
    now.settle(F.lit("exact"), shared, one)

    pool = lambda df, i, q, size: df.where(F.col(q).isNotNull()).groupBy("el", F.col(size).alias("size")).agg(
        F.sort_array(F.collect_list(F.struct(F.col(i).alias("id"), F.col(q).cast("long").alias("qty")))).alias("parts")
    )
    both = pool(now.plan, "id", "qty", "size").withColumnRenamed("parts", "plan")
    both = both.join(pool(now.shop, "s_id", "s_qty", "s_size").withColumnRenamed("parts", "pool"), ["el", "size"])
    split = both.where(F.size("pool") > 1).select("el", "plan", "pool").mapInArrow(_splits, "el long, plan_id long, shop_ids array<long>")
    now.settle(F.lit("split"), split.withColumnRenamed("plan_id", "id"), F.col("shop_ids"))

    apart = lambda c: F.when(_relation(c) == "!", F.abs(F.col(f"s_{c}") - F.col(c)) / F.greatest(F.col(c), F.lit(1))).otherwise(0.0)
    worst = F.struct(_count("!").alias("n"), (apart("qty") + apart("gap")).alias("distance"))
    differing = now.pairs(sized().where(_count("!") > 0), worst, "all")
    times = F.col("s_qty") / F.col("qty")
    multiple = (_relation("qty") == "!") & (_relation("gap") != "!") & (F.col("qty") > 0) & (times == F.floor(times)) & times.between(2, 12)
    names = F.array_compact(F.array(*[F.when(_relation(c) == "!", F.lit(c)) for c in ("qty", "gap")]))
    now.settle(F.when(multiple, "multiple").otherwise("differs"), differing, one, F.when(multiple, F.array().cast("array<string>")).otherwise(names))

    left = now.plan.join(now.shop.select("el", F.col("s_size").alias("size")).distinct(), ["el", "size"], "left_semi")
    now.settle(F.lit("unknown"), left.select("el", "id"), none)

    other = now.shop.where("s_size is not null")
    by = lambda c: now.plan.where("size is not null").join(other.withColumn(c, F.col(f"s_{c}")), ["el", c]).select(
        "el", "id", "size", now.plan["qty"], now.plan["gap"], "s_id", "s_size", "s_qty", "s_gap"
    )
    swapped = by("qty").unionByName(by("gap")).where(same & (F.col("size") != F.col("s_size"))).distinct()
    now.settle(F.lit("swapped"), now.pairs(swapped, _count("?")), one, F.array(F.lit("size")))

    rest = now.plan.select("el", F.col("id").alias("plan_id"), F.when(F.col("qty").isNull(), "unknown").otherwise("absent").alias("tier"), none.alias("shop_ids"))
    added = now.shop.select("el", F.lit(None).cast("long").alias("plan_id"), F.lit("added").alias("tier"), one.alias("shop_ids"))
    out = rest.unionByName(added).withColumn("differs", F.array().cast("array<string>"))
    for found in now.found:
        out = out.unionByName(found)
    return out


def match_content(plan: DataFrame, shop: DataFrame, near: float, finish: int = FINISH) -> DataFrame:
    """Elements paired by what they hold: el, other, shared, verdict (`same`, `differs`, null without a partner), distance.

    plan, shop: el, kind, place (a number), part (any hashable content; null takes no part). Candidates are of one kind, share a part and lie
    within `near`; the rows of an element have one kind and place. Those that hold every part of the plan come first, by distance; then by the number of missing parts. Each element is used once.
    """
    sides = []
    for df in (plan, shop):
        df = df.where("el is not null and kind is not null and place is not null")
        sides.append(shared_table(df.select("el", "kind", "place", "part").distinct()))
    mine, theirs = sides
    a = mine.groupBy(F.col("el").alias("a")).agg(F.count("part").alias("n"))
    # slots are wide, so most elements look into one; a pair meets in the slot of its right side, and only if it's near does it count
    slot = lambda at: F.floor(at / (8 * near)) if near > 0 else at
    reach = F.array_distinct(F.array(slot(F.col("place") - 1.001 * near), slot(F.col("place") + 1.001 * near)))
    left = mine.where("part is not null").select(F.col("el").alias("a"), "kind", "part", "place", F.explode(reach).alias("slot"))
    right = theirs.where("part is not null").select(F.col("el").alias("b"), "kind", "part", F.col("place").alias("b_place"), slot(F.col("place")).alias("slot"))
    pairs = left.join(right, ["kind", "part", "slot"]).withColumn("distance", F.abs(F.col("place") - F.col("b_place"))).where(F.col("distance") <= near)
    pairs = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.min("distance").alias("distance"))
    pairs = shared_table(pairs.join(a, "a").withColumn("missing", F.col("n") - F.col("shared")))
    cost = F.struct((F.col("missing") > 0).alias("differs"), F.when(F.col("missing") > 0, F.col("missing")).otherwise(0).alias("missing"), "distance")
    won = one_to_one(pairs.select(F.lit(0).alias("page"), "a", "b", cost.alias("cost")), finish).select("a", "b")
    won = won.join(pairs, ["a", "b"])
    verdict = F.when(F.col("missing") == 0, "same").when(F.col("missing") > 0, "differs")
    out = a.select("a").join(won, "a", "left")
    return out.select(F.col("a").alias("el"), F.col("b").alias("other"), "shared", verdict.alias("verdict"), "distance")


def pair_revisions(old: DataFrame, new: DataFrame, near: float = 40.0, finish: int = FINISH) -> DataFrame:
    """old_id, new_id, tier: marks of two revisions, each used once. old, new: id, kind, label, page, x, y (ids unique on each side).

    Tiers: `page` (same kind, label and page), `label` (same kind and label on another page), `place` (same kind and page, at most `near` apart, not both labelled). In a tier the
    nearest pairs come first, across pages those of the nearest places. What is left is `removed` (new_id null) or `added` (old_id null). Marks without place meet by label
    alone, as if they were far; a null label is none; nulls in kind or page are equal to nothing; rows without id take no part.
    """
    columns = ["id", "kind", "label", "page", "x", "y"]
    a = shared_table(old.where("id is not null").select(*columns))
    b = shared_table(new.where("id is not null").select(*columns).toDF(*[f"n_{c}" for c in columns]))
    distance = F.coalesce(F.hypot(F.col("x") - F.col("n_x"), F.col("y") - F.col("n_y")), F.lit(float("inf")))
    slot = lambda c: F.floor(F.col(c) / near)
    around = lambda c: F.explode(F.array(slot(c) - 1, slot(c), slot(c) + 1))
    unlabelled = F.col("label").isNull() | F.col("n_label").isNull()

    def candidates(tier: str, a: DataFrame, b: DataFrame) -> DataFrame:
        same = ["kind", "label", "page"] if tier == "page" else ["kind", "label"] if tier == "label" else ["kind", "page"]
        right = b.withColumns({c: F.col(f"n_{c}") for c in same})
        if tier != "place":
            return a.select("id", "x", "y", *same).join(right.select("n_id", "n_x", "n_y", *same), same)
        left = a.withColumn("cx", around("x")).withColumn("cy", around("y"))
        pairs = left.join(right.withColumn("cx", slot("n_x")).withColumn("cy", slot("n_y")), [*same, "cx", "cy"])
        return pairs.where(unlabelled & (distance <= near))

    found = []
    for tier in ("page", "label", "place"):
        pairs = candidates(tier, a, b).select(F.lit(0).alias("page"), F.col("id").alias("a"), F.col("n_id").alias("b"), distance.alias("cost"))
        won = shared_table(one_to_one(pairs, finish).select(F.col("a").alias("old_id"), F.col("b").alias("new_id"), F.lit(tier).alias("tier")))
        found.append(won)
        rest = shared_table(a.join(won, a["id"] == won["old_id"], "left_anti")), shared_table(b.join(won, b["n_id"] == won["new_id"], "left_anti"))
        forget(a, b)
        a, b = rest
    out = a.select(F.col("id").alias("old_id"), F.lit(None).cast(b.schema["n_id"].dataType).alias("new_id"), F.lit("removed").alias("tier"))
    out = out.unionByName(b.select(F.lit(None).cast(a.schema["id"].dataType).alias("old_id"), F.col("n_id").alias("new_id"), F.lit("added").alias("tier")))
    for won in found:
        out = out.unionByName(won)
    return out
