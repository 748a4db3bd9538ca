"""Joins of sets within canopies (groups that hold all possible partners of a set), in chunks of bounded size.

A canopy's sets go to chunks; a join finds the links in a chunk and gives new labels. A canopy of several chunks goes on with what its
chunks left open: a few representatives of each label meet, then every set outside the largest label meets all others, one cell of
two half chunks at a time. Where the keys that tie a canopy together are many and small, so that all-to-all would be more work, the sets of each key
that still holds several labels meet instead; the cheaper way is chosen for each canopy from counts. Neither misses a link, as linked sets
share a key, and sets of one label need no test.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, in_batches, shared_table
from .graph import components

CHUNK_TOKENS, CHUNK_DOCS = 1_000_000, 4096
#: Bytes of the chunk's membership matrix up to which it is kept dense.
DENSE = 1 << 26

#: From labels, sets and further columns of a chunk's rows to new labels from 0.
Join = Callable[[np.ndarray, list[np.ndarray], list[list]], np.ndarray]


class Groups:
    """Union-find over positions, with all labels kept flat: the smaller group takes the label of the larger."""

    def __init__(self, labels: np.ndarray):
        self.label = np.unique(labels, return_inverse=True)[1]
        order = np.argsort(self.label, kind="stable")
        self.members = np.split(order, np.flatnonzero(np.diff(self.label[order])) + 1)

    def join(self, a: int, b: int) -> None:
        x, y = self.label[a], self.label[b]
        if x == y:
            return
        if len(self.members[x]) < len(self.members[y]):
            x, y = y, x
        self.label[self.members[y]] = x
        self.members[x] = np.r_[self.members[x], self.members[y]]


def holders(rank: np.ndarray, owner: np.ndarray, shared: int, sets: int):
    """A function from tokens and positions of sets to how many of the tokens each of these sets holds."""
    of = rank < shared
    if shared * sets <= DENSE:
        has = np.zeros((shared, sets), np.uint8)
        has[rank[of], owner[of]] = 1

        def dense(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
            if 4 * len(at) < sets:
                return has[np.ix_(tokens, at)].sum(0, dtype=np.int64)
            return has[tokens].sum(0, dtype=np.int64)[at]

        return dense
    order = np.argsort(rank[of], kind="stable")
    posting = owner[of][order]
    start = np.r_[0, np.cumsum(np.bincount(rank[of], minlength=shared))]

    def count(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
        n = start[tokens + 1] - start[tokens]
        place = np.arange(n.sum()) + np.repeat(start[tokens] - np.cumsum(n) + n, n)
        return np.bincount(posting[place], minlength=sets)[at]

    return count


def _join_chunks(join: Join, extra: list[str]):
    """Rows sorted by canopy, chunk to edges between labels that a link joins."""

    def joined(rows: list[tuple]) -> pa.RecordBatch | None:
        labels = np.array([r[0] for r in rows])
        new = join(labels, [r[1] for r in rows], [list(c) for c in zip(*(r[2:] for r in rows), strict=True)])
        least = np.full(new.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, new, labels)
        changed = labels != least[new]
        if not changed.any():
            return None
        pairs = np.unique(np.stack([labels, least[new]], 1)[changed], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("canopy", "chunk", "label")), strict=True))
            columns = [batch.column(c) for c in ("tokens", *extra)]
            for i, (canopy, chunk, label) in enumerate(keys):
                if (canopy, chunk) != now and rows:
                    if (found := joined(rows)) is not None:
                        yield found
                    rows = []
                now = canopy, chunk
                rows.append((label, *(c[i].values.to_numpy(zero_copy_only=False).view(np.uint64) for c in columns)))
        if rows and (found := joined(rows)) is not None:
            yield found

    return read


def in_chunks(sets: DataFrame, join: Join, extra: list[str]) -> DataFrame:
    """Edges from labels to the smaller label that they join, from rows of canopy, chunk (a string), label, tokens."""
    dealt = sets.select("canopy", "chunk", "label", "tokens", *extra).repartition("canopy", "chunk")
    return in_batches(dealt.sortWithinPartitions("canopy", "chunk"), _join_chunks(join, extra), "a long, b long")


def number_of_chunks(docs: Column, tokens: Column, most_tokens: int, most_docs: int) -> Column:
    return F.greatest(F.ceil(tokens / most_tokens), F.ceil(docs / most_docs)).cast("int")


def chunked(rows: DataFrame, by: str, tokens: int = CHUNK_TOKENS, docs: int = CHUNK_DOCS) -> DataFrame:
    """Adds `of`, the number of chunks of each canopy, and `chunk`, a row's own."""
    size = rows.groupBy("canopy").agg(number_of_chunks(F.count(F.lit(1)), F.sum("n"), tokens, docs).alias("of"))
    return rows.join(shared_table(size), "canopy").withColumn("chunk", F.pmod(F.xxhash64(by), F.col("of")).cast("string"))


def _costs(rows: DataFrame, by: list[str], half: tuple[int, int]) -> DataFrame:
    """by, docs, top (the label with the most tokens), labels, cost: rows that all cells would read."""
    parts = rows.groupBy(*by, "label").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    all_ = parts.groupBy(*by).agg(
        F.max(F.struct("tokens", "label", "docs")).alias("top"), F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs"),
        F.count(F.lit(1)).alias("labels"),
    )
    inner = number_of_chunks(F.col("docs"), F.col("tokens"), *half)
    out = F.col("docs") - F.col("top.docs")
    outer = number_of_chunks(out, F.col("tokens") - F.col("top.tokens"), *half)
    return all_.where("labels > 1").select(*by, F.col("top.label").alias("top"), (outer * F.col("docs") + inner * out).alias("cost"))


def across(
    many: DataFrame, edges: DataFrame, keys: DataFrame, join: Join, extra: list[str], chunk_tokens: int, chunk_docs: int,
    trace: list | None = None,
) -> DataFrame:
    """Edges between chunks of the canopies that have several; keys: s, node; `trace` gathers rows read by cells."""
    root = edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "label")
    rows = many.drop("chunk", "of").withColumnRenamed("label", "own")
    rows = rows.join(root.withColumnRenamed("label", "own"), "own", "left")
    rows = rows.withColumn("label", F.coalesce("root", "own")).drop("root")
    # representatives: the root and three more of each component of a chunk
    pick = Window.partitionBy("canopy", "label").orderBy(F.col("own") != F.col("label"), F.xxhash64("own"), "n")
    few = rows.withColumn("at", F.row_number().over(pick)).where("at <= 4")
    first = shared_table(in_chunks(chunked(few, "own", chunk_tokens, chunk_docs), join, extra))
    met = components(first).withColumnRenamed("node", "label")
    rows = rows.join(met, "label", "left").withColumn("label", F.coalesce("component", "label")).drop("component")
    rows = shared_table(rows)

    half = chunk_tokens // 2, chunk_docs // 2
    whole = _costs(rows, ["canopy"], half)
    by_key = keys.withColumnRenamed("node", "own").join(rows.select("own", "canopy", "label", "n"), "own")
    by_key = shared_table(by_key)
    mixed = shared_table(_costs(by_key, ["canopy", "s"], half))
    cheaper = whole.select("canopy", F.col("cost").alias("all"), F.col("top").alias("largest"))
    cheaper = cheaper.join(mixed.groupBy("canopy").agg(F.sum("cost").alias("some")), "canopy", "left").na.fill(0, ["some"])
    cheaper = shared_table(cheaper.withColumn("keyed", F.col("some") < F.col("all")))
    if trace is not None:
        trace += [tuple(r) for r in cheaper.select("all", "some").collect()]
    # groups in which all sets outside the largest label meet all others: a canopy, or a key of it
    named = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string")).alias("group")
    unkeyed = cheaper.where("not keyed").select("canopy", named("c", "canopy"), F.col("largest").alias("top"))
    groups = rows.join(unkeyed, "canopy")
    keyed = mixed.join(cheaper.where("keyed").select("canopy"), "canopy", "left_semi").select("s", named("k", "s"), "top")
    own = by_key.select("own", "s").join(shared_table(keyed), "s").drop("s")
    groups = groups.unionByName(rows.join(own, "own"))
    groups = shared_table(groups.drop("canopy").withColumnRenamed("group", "canopy"))
    inner = chunked(groups, "own", *half).drop("chunk")
    outer = chunked(groups.where("label <> top"), "own", *half).drop("chunk")
    place = F.pmod(F.xxhash64("own"), F.col("of")).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sizes = lambda df, name: shared_table(df.groupBy("canopy").agg(F.max("of").alias(name)))
    # each cell holds one chunk of all sets and one of those outside the largest label
    carried = ["canopy", "label", "tokens", *extra]
    all_rows = inner.join(sizes(outer, "others"), "canopy").select(*carried, place.alias("i"), spread("others").alias("j"))
    out_rows = outer.join(sizes(inner, "others"), "canopy").select(*carried, place.alias("j"), spread("others").alias("i"))
    cells = all_rows.unionByName(out_rows)
    last = shared_table(in_chunks(cells.withColumn("chunk", F.concat_ws("-", "i", "j")), join, extra))
    forget(rows, by_key, mixed, cheaper, groups)
    return first.unionByName(last)
