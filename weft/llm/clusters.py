"""Exact Lloyd clustering of integer vectors with Drake's adaptive bounds.

A vector keeps an upper bound on the distance to its own centroid, lower bounds on those to the `bounds` nearest other
centroids, each by name, and one lower bound on all that remain. When centroids move, bounds move with them. A vector
whose upper bound is below every lower bound stays without a look at it; otherwise its own distance is made exact; then
only the named centroids that are in doubt are measured again; and where the remainder's bound can't certify the order, all are.
The number of bounds adapts: after each round it shrinks to the most that any vector needed. Bounds are rounded
away from the truth and compared strictly, so that a tie is always measured, in exact integers.

Vectors are packed in blocks and written once, bucketed by block. What changes in a round, the bounds, is a bucketed table of its
own, so that a round reads both without a shuffle, writes a fifth of the vectors' size and survives lost executors. Sums by
cluster are added up in each block and partition; the driver sees centroids x dimensions sums and nothing that grows.

Defined results: null vectors and vectors of another length, or with null or non-finite components, take no part. Repeated
ids are vectors each; a null id is a vector too, but starts no centroid while others are left. Of equal hashes the smaller vector
starts first. With fewer vectors than `k` there are fewer centroids; an empty table gives no rows. Other columns are ignored.
Components beyond 2**27 after scaling are an error, as their squared distances would leave 64 bits.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import shared_dir
from .common import in_batches, renamed, shared_table

#: Components stay within this in absolute value.
LIMIT = 2**27
_SLACK = 1e-9


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances, vectors by centroids."""
    most = int(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)))
    if 4 * most * most * max(1, x.shape[1]) < 2**53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - one) ** 2).sum(1) for one in c], 1) if len(c) else np.zeros((len(x), 0), np.int64)


def _above(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _below(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


class Bounds:
    """Bounds of some vectors: own centroid, upper bound, named others by lower bound, their bounds, and the remainder's."""

    def __init__(self, cluster: np.ndarray, upper: np.ndarray, order: np.ndarray, lower: np.ndarray, rest: np.ndarray):
        self.cluster, self.upper, self.order, self.lower, self.rest = cluster, upper, order, lower, rest

    @classmethod
    def measured(cls, x: np.ndarray, c: np.ndarray, b: int) -> Bounds:
        """From exact distances to all centroids."""
        d = distances(x, c)
        order = np.argsort(d, axis=1, kind="stable")  # ties: the smaller number
        root = np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
        rest = root[:, b + 1] if len(c) > b + 1 else np.full(len(x), np.inf)
        return cls(order[:, 0].astype(np.int16), _above(root[:, 0]), order[:, 1 : b + 1].astype(np.int16), _below(root[:, 1 : b + 1]), _below(rest))

    def to_bytes(self) -> tuple[bytes, ...]:
        return tuple(a.tobytes() for a in (self.cluster, self.upper, self.order, self.lower, self.rest))

    @classmethod
    def from_bytes(cls, cluster: bytes, upper: bytes, order: bytes, lower: bytes, rest: bytes) -> Bounds:
        own = np.frombuffer(cluster, np.int16)
        wide = lambda raw, kind: np.frombuffer(raw, kind).reshape(len(own), -1)
        return cls(own, np.frombuffer(upper, np.float32), wide(order, np.int16), wide(lower, np.float32), np.frombuffer(rest, np.float32))


def advance(x: np.ndarray, c: np.ndarray, moved: np.ndarray, old: Bounds, b: int) -> tuple[Bounds, int, int]:
    """Bounds after the centroids moved, the most named bounds that a vector needed, and how many distances were measured."""
    step = np.sqrt(moved.astype(np.float64)) * (1 + _SLACK)
    own, order = old.cluster.copy(), old.order.copy()
    upper = old.upper.astype(np.float64) + step[own]
    lower = old.lower.astype(np.float64) - step[order]
    rest = old.rest.astype(np.float64) - step.max(initial=0)
    doubt = lambda u, low: ~(u[:, None] * (1 + _SLACK) < low)
    at = np.flatnonzero(doubt(upper, np.c_[lower, rest]).any(1))
    exact = ((x[at] - c[own[at]]) ** 2).sum(1)
    measured = len(at)
    upper[at] = np.sqrt(exact.astype(np.float64))
    named, beyond = doubt(upper[at], lower[at]), doubt(upper[at], rest[at][:, None])[:, 0]
    some = named.any(1) & ~beyond
    needed = order.shape[1] if beyond.any() else int(named.sum(1).max(initial=0))

    few, which = at[some], named[some]
    if len(few):
        d = ((x[few][:, None, :] - c[order[few]]) ** 2).sum(2)
        measured += int(which.sum())
        far = np.iinfo(np.int64).max
        both = np.c_[exact[some], np.where(which, d, far)]
        names = np.c_[own[few], order[few]]
        least = both.min(1)
        best = np.where(both == least[:, None], names, np.iinfo(np.int16).max).argmin(1)
        low = np.where(which, np.sqrt(d.astype(np.float64)), lower[few])
        rows = np.flatnonzero(best > 0)
        z = best[rows] - 1
        own[few[rows]], order[few[rows], z] = names[rows, best[rows]], names[rows, 0]
        low[rows, z] = np.sqrt(exact[some][rows].astype(np.float64))
        upper[few], lower[few] = np.sqrt(least.astype(np.float64)), low
    sort = np.argsort(lower, axis=1, kind="stable")
    order, lower = np.take_along_axis(order, sort, 1), np.take_along_axis(lower, sort, 1)
    out = Bounds(own, _above(upper), order, _below(lower), _below(rest))

    all_ = at[beyond]
    if len(all_):
        new = Bounds.measured(x[all_], c, order.shape[1])
        measured += len(all_) * len(c)
        for name in ("cluster", "upper", "order", "lower", "rest"):
            getattr(out, name)[all_] = getattr(new, name)
    if b < out.order.shape[1]:  # dropped bounds go to the remainder
        out.rest = np.minimum(out.rest, out.lower[:, b:].min(1))
        out.order, out.lower = np.ascontiguousarray(out.order[:, :b]), np.ascontiguousarray(out.lower[:, :b])
    return out, needed, measured


_BLOCK = "block long, n int, ids array<long>, rows binary"
_STATE = "cluster binary, upper binary, order binary, lower binary, rest binary"
_ROUND = f"block long, {_STATE}, sums binary, counts binary, needed int, measured long"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows, strict=True), types, strict=True)], list(names))


def _pack(dims: int, rows_a_block: int):
    def packed(block: int, ids: list, x: np.ndarray) -> tuple:
        low, high = int(x.min(initial=0)), int(x.max(initial=0))
        if low < -LIMIT or high > LIMIT:
            raise ValueError("components are beyond what 64-bit distances hold")
        kind = next(t for t in (np.int8, np.int16, np.int32) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
        return block, len(ids), ids, x.astype(kind).tobytes()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, ids, xs = TaskContext.get().partitionId() << 32, [], np.empty((0, dims), np.int64)
        for batch in batches:
            ids += batch.column("id").to_pylist()
            xs = np.concatenate([xs, batch.column("x").flatten().to_numpy().reshape(-1, dims)])
            while len(ids) >= rows_a_block:
                yield _batch([packed(block, ids[:rows_a_block], xs[:rows_a_block])], _BLOCK)
                block, ids, xs = block + 1, ids[rows_a_block:], xs[rows_a_block:]
        if ids:
            yield _batch([packed(block, ids, xs)], _BLOCK)

    return read


def _vectors(n: int, rows: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(rows, f"<i{len(rows) // (n * dims)}").reshape(n, dims).astype(np.int64)


def _assign(centroids: np.ndarray, moved: np.ndarray | None, b: int):
    """Rows of blocks, with their bounds unless `moved` is None, to new bounds and sums by cluster."""
    k, dims = centroids.shape

    def one(row: dict) -> tuple:
        x = _vectors(row["n"], row["rows"], dims)
        if moved is None:
            bounds, needed, measured = Bounds.measured(x, centroids, b), 0, len(x) * k
        else:
            old = Bounds.from_bytes(*(row[c.split()[0]] for c in _STATE.split(", ")))
            bounds, needed, measured = advance(x, centroids, moved, old, b)
        sums = np.zeros((k, dims), np.int64)
        np.add.at(sums, bounds.cluster, x)
        return row["block"], *bounds.to_bytes(), sums.tobytes(), np.bincount(bounds.cluster, minlength=k).tobytes(), needed, measured

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield _batch([one({c: batch.column(c)[i].as_py() for c in batch.schema.names if c != "ids"})], _ROUND)

    return read


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums and counts of a partition's blocks, then what was measured and needed, as rows of at, value."""
    total, needed = None, 0
    for batch in batches:
        for s, n, m, z in zip(*(batch.column(c).to_pylist() for c in ("sums", "counts", "measured", "needed")), strict=True):
            own = np.r_[np.frombuffer(s + n, np.int64), m]
            total, needed = own if total is None else total + own, max(needed, z)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total) + 1)), pa.array(np.r_[total, needed])], ["at", "value"])


def _placed(centroids: np.ndarray):
    """Rows of blocks with their bounds to vec_id, cluster, distance."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n, rows, own = (batch.column(c)[i].as_py() for c in ("n", "rows", "cluster"))
                own = np.frombuffer(own, np.int16)
                d = ((_vectors(n, rows, centroids.shape[1]) - centroids[own]) ** 2).sum(1)
                ids = batch.column("ids")[i].values
                yield pa.RecordBatch.from_arrays([ids, pa.array(own.astype(np.int32)), pa.array(d)], ["vec_id", "cluster", "distance"])

    return read


class _Bucketed:
    """A table bucketed by block in the shared folder; `drop` deletes it."""

    def __init__(self, df: DataFrame, buckets: int):
        self.spark, self.name = df.sparkSession, f"weft_{uuid.uuid4().hex}"
        self.path = f"{shared_dir(self.spark)}/{self.name}"
        dealt = df.repartition(buckets, "block").write.bucketBy(buckets, "block").sortBy("block")
        dealt.option("path", self.path).saveAsTable(self.name)
        self.df = self.spark.read.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"drop table if exists {self.name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def starting_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors (rows of id, x) whose ids have the smallest hashes, in their order."""
    named = kept.withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256))
    first = named.orderBy(F.col("hash").asc_nulls_last(), "x").limit(k).select("x").collect()
    return np.array([r["x"] for r in first], np.int64)


def cluster_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 64, scale: int = 1024, k: int = 8,
    rounds: int = 10, seed: int = 3, bounds: int = 3, least_bounds: int = 1, block_rows: int = 4096, trace: list | None = None,
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256; `trace` gathers what each round measured."""
    v = renamed(vectors, id=id_col, x=vec_col)
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    v = v.where(F.col("x").isNotNull()).where(F.size("x") == dims).where(finite)
    v = v.select(
        F.col("id").cast("long").alias("id"),
        F.transform("x", lambda c: F.floor(F.lit(scale) * c.cast("double"))).alias("x"),
    )
    centroids = starting_centroids(v, k, seed)
    spark = vectors.sparkSession
    if not len(centroids):
        return spark.createDataFrame(
            [], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        )
    packed = shared_table(in_batches(v, _pack(dims, block_rows), _BLOCK))
    n = packed.count()
    buckets = max(min(n, spark.sparkContext.defaultParallelism), -(-n // 256))  # a block of 64 dimensions is a megabyte at most
    blocks, state, moved = _Bucketed(packed, buckets), None, None
    b = max(1, min(bounds, len(centroids) - 1))
    for i in range(rounds + 1):
        rows = blocks.df.select("block", "n", "rows")
        if state is not None:
            rows = rows.join(state.df.drop("sums", "counts", "needed", "measured"), "block")
        new = _Bucketed(in_batches(rows, _assign(centroids, moved, b), _ROUND), buckets)
        if state is not None:
            state.drop()
        state = new
        parts = in_batches(state.df.select("sums", "counts", "measured", "needed"), _added, "at long, value long").groupBy("at")
        parts = parts.agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("sum"), F.max("value").alias("max"))
        total = {r["at"]: r for r in parts.collect()}
        needed, measured = total[len(total) - 1]["max"], int(total[len(total) - 2]["sum"])
        if trace is not None:
            trace.append((b, needed, measured))
        if i == rounds:
            break
        if i:
            b = min(b, max(least_bounds, needed))
        old = centroids.copy()
        for c in range(len(centroids)):
            if n := int(total[centroids.size + c]["sum"]):
                centroids[c] = [int(total[c * dims + d]["sum"]) // n for d in range(dims)]
        moved = ((centroids - old) ** 2).sum(1)
    rows = blocks.df.join(state.df.select("block", "cluster"), "block").select("n", "ids", "rows", "cluster")
    placed = shared_table(in_batches(rows, _placed(centroids), "vec_id long, cluster int, distance long"))
    state.drop()
    blocks.drop()
    inertia = dict(placed.groupBy("cluster").agg(F.sum("distance")).collect())
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    facts = [(c, d, sum(inertia.values()), digest(centroids[c])) for c, d in inertia.items()]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
