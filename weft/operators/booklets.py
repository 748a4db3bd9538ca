"""Rules between the fields of a booklet, and the cheapest readings that keep them.

A field has candidate readings with costs. Fields of a booklet stand in an order; the difference of two that follow each other has to lie within bounds. Among all
choices of one candidate a field, or of none at the price `miss`, the cheapest that keeps every rule is taken. Spark gathers a booklet into one row, as long as its
fields are many; the booklets of a batch that have equally many fields go through them together, from the last to the first: per reading that came last the least
cost of all fields after it. The choices then follow the least costs from the first field on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NEVER = 1 << 60


def _choices(readings: np.ndarray, costs: np.ndarray, last: np.ndarray, low: float, high: float, miss: int) -> tuple[np.ndarray, np.ndarray]:
    """The least cost of each booklet and its choice by field, the smallest from the first field on.

    readings, costs: booklets x fields x candidates, as many as the longest list; costs of the rest are _NEVER. last: by booklet and field the choice of none.
    """
    many, n, m = readings.shape
    # by the number of fields read: what is left to pay after the last reading, one by earlier field and candidate, and one (the last) for no reading yet
    after = [np.zeros((many, n * m + 1), np.int64)]
    with np.errstate(invalid="ignore"):
        fits = lambda i, at: (readings[:, i, None, :] - at[..., None] >= low) & (readings[:, i, None, :] - at[..., None] <= high)
        for i in reversed(range(n)):
            then = after[-1]
            onward = np.minimum(costs[:, i] + then[:, i * m : (i + 1) * m], _NEVER)
            best = np.full((many, i * m + 1), _NEVER)
            best[:, -1] = onward.min(axis=1, initial=_NEVER)
            if i and m:
                earlier = readings[:, :i].reshape(many, i * m)
                best[:, :-1] = np.where(fits(i, earlier), onward[:, None, :], _NEVER).min(axis=2)
            skip = np.concatenate([then[:, : i * m], then[:, -1:]], axis=1) + miss
            after.append(np.minimum(best, skip))
        after.reverse()
        each, at = np.arange(many), np.full(many, -1)  # the place of the last reading
        total, chosen = after[0][:, -1], np.empty((many, n), np.int32)
        for i in range(n):
            now = after[i][each, at]
            none, ways = at < 0, np.minimum(costs[:, i] + after[i + 1][:, i * m : (i + 1) * m], _NEVER)
            if i and m:
                before = readings[:, :i].reshape(many, i * m)[each, np.maximum(at, 0)]
                ways = np.where(none[:, None] | fits(i, before[:, None])[:, 0], ways, _NEVER)
            good = ways == now[:, None]
            found = good.any(axis=1)
            k = good.argmax(axis=1) if m else np.zeros(many, np.int64)
            chosen[:, i] = np.where(found, k, last[:, i])
            at = np.where(found, i * m + k, at)
    return total, chosen


def repaired(
    fields: DataFrame, booklet: str, order: str, candidates: str, low: float, high: float, miss: int, bound: int,
) -> DataFrame:
    """booklet, cost, chosen (candidate numbers from 0; one more than there are: none), readings (null: none), flagged (cost above `bound`).

    candidates: an array of structs reading (double) and cost (long). A field without a reading rules nothing; the next is held against the last that has one. Ties: the
    choices that are smaller from the first field on. Null arrays have no candidates; candidates with nulls are none; null booklets are a booklet; an
    empty table gives no rows.
    """
    known = F.filter(F.coalesce(candidates, F.array().cast("array<struct<reading:double,cost:long>>")), lambda c: c["reading"].isNotNull() & c["cost"].isNotNull())
    typed = F.transform(known, lambda c: F.struct(c["reading"].cast("double").alias("reading"), c["cost"].cast("long").alias("cost")))
    rows = fields.select(F.col(booklet).alias("_booklet"), F.struct(F.col(order).alias("at"), typed.alias("options")).alias("field"))
    gathered = rows.groupBy("_booklet").agg(F.sort_array(F.collect_list("field")).alias("fields"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = batch.column("fields")
            per = np.diff(fields.offsets.to_numpy()).astype(np.int64)
            flat = fields.flatten()
            options = flat.field("options")
            sizes, values = np.diff(options.offsets.to_numpy()).astype(np.int64), options.flatten()
            reading, cost = values.field("reading").to_numpy(), values.field("cost").to_numpy()
            first, begin = np.cumsum(per) - per, np.cumsum(sizes) - sizes
            totals, choice, read = np.empty(len(per), np.int64), np.empty(len(sizes), np.int32), np.full(len(sizes), np.nan)
            for n in np.unique(per):
                alike = np.flatnonzero(per == n)
                widest = sizes[first[alike, None] + np.arange(n)].max(initial=0)
                step = max(1, 200_000 // max(1, (n * widest + 1) * max(widest, n)))
                for own in (alike[i : i + step] for i in range(0, len(alike), step)):
                    place = first[own, None] + np.arange(n)  # booklets x fields
                    has = sizes[place][:, :, None] > np.arange(widest)
                    here = np.where(has, begin[place][:, :, None] + np.arange(widest), 0)
                    readings = np.where(has, reading[here], np.nan) if widest else np.empty(has.shape)
                    costs = np.where(has, cost[here], _NEVER) if widest else np.empty(has.shape, np.int64)
                    totals[own], chosen = _choices(readings, costs, sizes[place], low, high, miss)
                    choice[place] = chosen
            some = np.flatnonzero(choice < sizes)
            read[some] = reading[begin[some] + choice[some]]
            offsets = pa.array(np.r_[0, np.cumsum(per)].astype(np.int32))
            shown = pa.array(read, mask=choice >= sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_booklet"), pa.array(totals), pa.ListArray.from_arrays(offsets, pa.array(choice)), pa.ListArray.from_arrays(offsets, shown)],
                ["_booklet", "cost", "chosen", "readings"],
            )

    kind = dict(fields.dtypes)[booklet]
    best = gathered.mapInArrow(decide, f"_booklet {kind}, cost long, chosen array<int>, readings array<double>")
    return best.select(F.col("_booklet").alias(booklet), "cost", "chosen", "readings", (F.col("cost") > bound).alias("flagged"))
