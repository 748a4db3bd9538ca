"""Exact top-k inner products over an impact-ordered index, score at a time.

Vectors are quantised to integers and dealt to packed blocks: candidates to groups of about `group_rows`, queries to slices
of about `slice_rows`; a pair of group and slice is one cell, in which a stated query set meets all rows of the group.
Queries times rows is the work that is asked for; what travels are compact blocks, once for each slice and group.

In a cell the candidates, longest first, are indexed in parts of `part_rows`. A part's index is impact-ordered: each
dimension has posting lists (candidate and component), one for each quantised impact, the number of `levels` that the
component's absolute value reaches. Segments are processed by descending impact, each adding its share to the
accumulators of all queries. After an impact, what its lower ones can still add to a pair is at most the norm of the
candidate's components that are left times the norm of the query's as many largest components. The query's k-th best
score so far, over earlier parts too, is a lower bound. Processing stops only on proof: when the candidates that may
still reach it are cheaper to rescore exactly than the segments that are left, or none can. They are then rescored,
so every score that is returned is exact. A part whose longest candidate can't reach any query's bound is left unread.

Defined results: null vectors and vectors with null or non-finite components take no part; inner products exist between
vectors of equal length only; a query never meets rows of its own id; repeated ids are candidates each, as queries
they count once (smallest vector); ties go to the smaller id, repeated ids give equal rows; null ids take no part; an
empty table gives no rows. Components whose products would leave 62 bits are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches, renamed, shared_table

#: Scores stay below this in absolute value.
LIMIT = 2**62
LEVELS = (16, 12, 9, 6, 4, 3, 2, 1)


class Part:
    """The impact-ordered index of some candidates."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, levels: tuple[int, ...]):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        size = np.abs(self.rows)
        #: impact of each component: how many levels it reaches (0: it is in no list but the last)
        impact = (size[:, :, None] >= np.sort(levels)).sum(2) if levels else np.zeros(self.rows.shape, np.int64)
        self.norm = float(np.sqrt((self.rows.astype(np.float64) ** 2).sum(1).max(initial=0)))
        #: by descending impact: posting lists (dimension, candidates, components), norms and numbers of what is left
        self.impacts = []
        for i in range(len(levels), -1, -1):
            at = impact == i
            lists = [(d, np.flatnonzero(at[:, d])) for d in range(at.shape[1])]
            lists = [(d, c, self.rows[c, d]) for d, c in lists if len(c)]
            rest = np.where(impact < i, self.rows, 0).astype(np.float64)
            self.impacts.append((lists, np.sqrt((rest**2).sum(1)), (rest != 0).sum(1)))


class Best:
    """Each query's best k so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.id = np.full((n, k), -LIMIT), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.r_[self.score[q], scores], np.r_[self.id[q], ids]
        top = np.lexsort((i, -s))[: self.k]
        self.score[q], self.id[q] = s[top], i[top]

    def bound(self) -> np.ndarray:
        return self.score[:, -1].astype(np.float64)


def search_part(
    part: Part, query_ids: np.ndarray, queries: np.ndarray, best: Best, seen: list | None = None, cost: float = 4.0
) -> None:
    """Adds the part's candidates to each query's best; `seen` gathers the number of impacts processed and possible."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(part.rows).max(initial=0)) * max(1, queries.shape[1])
    kind = np.float32 if most < 2**23 else np.float64 if most < 2**52 else np.int64  # sums are exact
    q = queries.astype(np.float64)
    # norm of a query's m largest components
    largest = np.sqrt(np.cumsum(np.sort(q**2, 1)[:, ::-1], 1))
    largest = np.concatenate([np.zeros((len(q), 1)), largest], 1) * (1 + 1e-9)
    before = best.bound()
    asks = np.flatnonzero(largest[:, -1] * part.norm * (1 + 1e-9) >= before)
    if not len(asks):
        return
    own = part.ids[:, None] == query_ids[asks][None, :]
    scores, weights = np.zeros((len(part.ids), len(asks)), kind), np.ascontiguousarray(queries[asks].T.astype(kind))
    left = sum(len(c) for lists, _, _ in part.impacts for _, c, _ in lists)
    k = best.k
    for step, (lists, rest, number) in enumerate(part.impacts):
        for d, at, values in lists:
            scores[at] += values.astype(kind)[:, None] * weights[d][None, :]
            left -= len(at)
        bound = rest[:, None] * (1 + 1e-9) * largest[asks].T[number]
        exact = not rest.any()
        low = np.where(own, -np.inf, scores - bound)
        need = before[asks]
        if len(part.ids) >= k:
            need = np.maximum(need, np.partition(low, -k, 0)[-k])
        possible = (scores + bound >= need[None, :]) & ~own
        if exact or possible.sum() * len(q[0]) * cost <= left * len(asks):
            break
    if seen is not None:
        seen.append((step + 1, len(part.impacts), int(possible.sum())))
    rows = part.rows.astype(np.int64)
    for j, i in enumerate(asks.tolist()):
        at = np.flatnonzero(possible[:, j])
        found = scores[at, j].astype(np.int64) if exact else rows[at] @ queries[i].astype(np.int64)
        if len(at) > k:
            keep = np.argsort(-found, kind="stable")[:k]  # ids ascend, so ties keep the smaller
            at, found = at[keep], found[keep]
        best.add(i, found, part.ids[at])


_PACKED = "block long, dims int, n int, ids binary, rows binary"


def _pack(rows_a_block: int):
    """Rows of id, x to blocks of equal dimensions, in the narrowest type that holds them."""

    def packed(block: int, dims: int, ids: list, xs: list) -> tuple:
        x = np.array(xs, np.int64).reshape(len(xs), dims)
        most = max(-int(x.min(initial=0)), int(x.max(initial=0)))  # the least 64-bit value has no absolute value
        if most**2 * max(1, dims) >= LIMIT:
            raise ValueError("components are beyond what 64-bit scores hold")
        kind = np.int8 if most < 2**7 else np.int16 if most < 2**15 else np.int64
        return block, dims, len(ids), np.array(ids, np.int64).tobytes(), x.astype(kind).tobytes()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held = TaskContext.get().partitionId() << 32, {}
        for batch in batches:
            out = []
            for i, x in zip(batch.column("id").to_pylist(), batch.column("x").to_pylist(), strict=True):
                ids, xs = held.setdefault(len(x), ([], []))
                ids.append(i)
                xs.append(x)
                if len(ids) == rows_a_block:
                    out.append(packed(block, len(x), *held.pop(len(x))))
                    block += 1
            if out:
                yield _rows(out)
        if held:
            yield _rows([packed(block + j, d, *h) for j, (d, h) in enumerate(held.items())])

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [c.split()[0] for c in _PACKED.split(", ")]
        )

    return read


def _search_cells(k: int, levels: tuple[int, ...], part_rows: int, at_once: int):
    """Rows sorted by dims, grp, slice, candidates first, to each query's best in the group."""

    def unpacked(blocks: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.concatenate([np.frombuffer(i, np.int64) for _, _, i, _ in blocks])
        rows = []
        for dims, n, _, x in blocks:
            width = len(x) // (n * dims) if dims else 1
            rows.append(np.frombuffer(x, f"<i{width}").reshape(n, dims).astype(np.int64))
        x = np.concatenate(rows)
        return ids, x if x.shape[1] else np.zeros((len(ids), 1), np.int64)

    def cell(candidates: list[tuple], queries: list[tuple]) -> pa.RecordBatch | None:
        if not candidates or not queries:
            return None
        ids, rows = unpacked(candidates)
        order = np.argsort(-(rows.astype(np.float64) ** 2).sum(1), kind="stable")
        ids, rows = ids[order], rows[order]
        query_ids, q = unpacked(queries)
        best = Best(len(q), k)
        for i in range(0, len(ids), part_rows):
            part = Part(ids[i : i + part_rows], rows[i : i + part_rows], levels)
            for j in range(0, len(q), at_once):
                some = Best(0, k)
                some.score, some.id = best.score[j : j + at_once], best.id[j : j + at_once]  # views
                search_part(part, query_ids[j : j + at_once], q[j : j + at_once], some)
        found = best.id != np.iinfo(np.int64).max
        columns = np.repeat(query_ids, k).reshape(len(q), k)[found], best.id[found], best.score[found]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = None, ([], [])
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c, i=i, batch=batch: batch.column(c)[i].as_py()
                key = get("dims"), get("grp"), get("slice")
                if key != now:
                    if now is not None and (out := cell(*sides)) is not None:
                        yield out
                    now, sides = key, ([], [])
                sides[get("asks")].append((get("dims"), get("n"), get("ids"), get("rows")))
        if now is not None and (out := cell(*sides)) is not None:
            yield out

    return read


def exact_topk(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", query_divisor: int = 20, k: int = 20,
    scale: int = 64, levels: tuple[int, ...] = LEVELS, group_rows: int = 65536, slice_rows: int = 512,
    part_rows: int = 4096, at_once: int = 256,
) -> DataFrame:
    """query_id, rank from 1, vec_id, score; queries are the ids divisible by query_divisor."""
    v = renamed(vectors, id=id_col, x=vec_col)
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    v = v.where(F.col("id").isNotNull() & F.col("x").isNotNull()).where(finite)
    v = v.select(
        F.col("id").cast("long").alias("id"),
        F.transform("x", lambda c: F.floor(F.lit(scale) * c.cast("double"))).alias("x"),
    )
    queries = v.where(F.col("id") % query_divisor == 0).groupBy("id", F.size("x").alias("dims")).agg(F.min("x").alias("x"))
    some = max(1, min(slice_rows, 1024))
    rows = shared_table(in_batches(v, _pack(min(group_rows, 4096)), _PACKED))
    asks = shared_table(in_batches(queries.select("id", "x"), _pack(some), _PACKED))
    counted = lambda df: df.agg(F.coalesce(F.sum("n"), F.lit(0))).collect()[0][0]
    groups, slices = max(1, -(-counted(rows) // group_rows)), max(1, -(-counted(asks) // slice_rows))
    dealt = lambda name, n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int").alias(name)
    each = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = rows.select("*", F.lit(0).alias("asks"), dealt("grp", groups), each("slice", slices))
    right = asks.select("*", F.lit(1).alias("asks"), dealt("slice", slices), each("grp", groups))
    cells = left.unionByName(right).repartition("dims", "grp", "slice").sortWithinPartitions("dims", "grp", "slice", "asks")
    found = in_batches(cells, _search_cells(k, levels, part_rows, at_once), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
