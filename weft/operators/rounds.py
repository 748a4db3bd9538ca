"""Greedy choices in parallel rounds: what a sequential pass in order would choose, without one task for a whole group.

In a round, a pair that is the best left for both of its ends is taken: nothing before it can claim either end, so the
sequential pass takes it too. Pairs that touch a taken one are dropped, and the rest goes on. When at most `finish` pairs are left (counted), they
are decided in order in one task. Rounds grow with the longest chain of pairs in which each waits for the one before, about
log(pairs) where costs are unrelated to the chain. Tables of a round are deleted when the next one is written.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import forget, shared_table

FINISH = 20_000


def taken_in_order(a: np.ndarray, b: np.ndarray, ends: int) -> np.ndarray:
    """Positions of the pairs that a pass in order takes while both ends are free, by rounds on arrays.

    Ends are numbers below `ends`; none is left of one pair and right of another.
    """
    rest, first, won = np.arange(len(a)), np.zeros(ends, np.int64), [np.zeros(0, np.int64)]
    while len(rest):
        back = rest[::-1]
        first[a[back]] = back  # of equal ends the last one stays: the first in order
        first[b[back]] = back
        best = rest[(first[a[rest]] == rest) & (first[b[rest]] == rest)]
        free = np.ones(ends, bool)
        free[a[best]], free[b[best]] = False, False
        rest = rest[free[a[rest]] & free[b[rest]]]
        won.append(best)
    return np.concatenate(won)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs in order, each while both ends are free."""
    left, right = set(), set()
    for batch in batches:
        taken = []
        for i, (p, a, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("page", "a", "b")), strict=True)):
            if (p, a) not in left and (p, b) not in right:
                left.add((p, a))
                right.add((p, b))
                taken.append(i)
        yield batch.take(pa.array(taken, pa.int64()))


def one_to_one(pairs: DataFrame, finish: int = FINISH) -> DataFrame:
    """page, a, b, cost of pairs taken greedily by (cost, a, b) while both ends are free; pairs: page, a, b, cost.

    Each page for itself. Pairs with nulls take no part; repeated pairs count with their least cost; an empty table gives no rows.
    """
    whole = pairs.where("page is not null and a is not null and b is not null and cost is not null")
    rest, taken = shared_table(whole.groupBy("page", "a", "b").agg(F.min("cost").alias("cost"))), []
    while rest.count() > finish:
        best = lambda end, rest=rest: rest.groupBy("page", end).agg(F.min(F.struct("cost", "a", "b")).alias("m")).select("page", "m.*")
        won = shared_table(best("a").join(best("b").select("page", "a", "b"), ["page", "a", "b"]).select("page", "a", "b", "cost"))
        free = rest.join(won.select("page", "a"), ["page", "a"], "left_anti").join(won.select("page", "b"), ["page", "b"], "left_anti")
        free = shared_table(free.select("page", "a", "b", "cost"))
        forget(rest)
        rest = free
        taken.append(won)
    last = rest.coalesce(1).sortWithinPartitions("page", "cost", "a", "b").select("page", "a", "b", "cost")
    return reduce(DataFrame.unionByName, taken, last.mapInArrow(_in_order, last.schema))


def dropped(over: DataFrame, finish: int = FINISH) -> DataFrame:
    """page, id of the items that fall when each falls to any kept one before it; over: page, id, by (before id in one order).

    An item that nothing left stands over is kept, and all that it stands over fall; a fallen item stands over nothing.
    """
    rest, gone = shared_table(over.select("page", "id", "by").distinct()), []
    while rest.count() > finish:
        asked = rest.select("page", "id").distinct()
        kept = rest.select("page", "by").distinct().join(asked.withColumnRenamed("id", "by"), ["page", "by"], "left_anti")
        fallen = shared_table(rest.join(kept, ["page", "by"]).select("page", "id").distinct())
        left = rest.join(fallen, ["page", "id"], "left_anti").join(fallen.withColumnRenamed("id", "by"), ["page", "by"], "left_anti")
        left = shared_table(left.select("page", "id", "by"))
        forget(rest)
        rest = left
        gone.append(fallen)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waits, stands, schema = {}, {}, None
        for batch in batches:
            schema = batch.schema
            for page, i, by in zip(*(batch.column(c).to_pylist() for c in ("page", "id", "by")), strict=True):
                waits.setdefault((page, i), set()).add((page, by))
                stands.setdefault((page, by), set()).add((page, i))
        ready, fell = [x for x in stands if x not in waits], set()
        while ready:  # each is decided once all before it are
            one = ready.pop()
            for other in stands.get(one, ()):
                if one not in fell:
                    fell.add(other)
                waits[other].discard(one)
                if not waits[other]:
                    ready.append(other)
        if fell:
            yield pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for c, n in zip(zip(*fell, strict=True), ("page", "id"), strict=True)], ["page", "id"])

    last = rest.coalesce(1).mapInArrow(read, rest.select("page", "id").schema)
    return reduce(DataFrame.unionByName, gone, last)
