"""Exact n-gram Jaccard join by prefix trees, as connected components of its links.

A document is the set of its distinct k-word shingles (64-bit hashes). Two link when their Jaccard similarity is at
least `percent` / 100. Every link counts, but links are not listed: the result is each document's component.

1. Sets. Equal sets collapse to one node, their smallest id.
2. Prefixes. The shingles with the lowest hashes (all below `reach` of the hash range, and never fewer than a link
   needs to share one) are dealt to buckets by hash, already merged by chunk: a shingle met twice in a chunk is known
   to be repeated and only one of its rows travels on, so a shingle that a third of all documents share fills no
   bucket. What is left are (shingle, node) pairs of repeated shingles.
3. Bounds. With p of n shingles below the reach, a linked document shares at least p - n // 5 of them (for 80 percent),
   so nodes with fewer repeated ones have no link. Of a node with a repeated ones, the a - c + 1 rarest in the global
   order are keys; linked nodes share a key. Common passages and lines, being frequent, are keys of no one.
4. Nodes that keys connect form a canopy. A few keys more than needed are kept, so that linked nodes share several. A
   canopy larger than a chunk is split by that: pairs are counted over its rare keys alone, as two ids a row, and one
   chance shingle no longer ties two groups together. What is still larger takes steps 2 to 4 again with all shingles of its sets,
   four fifths of which a link then needs to be repeated ones. A canopy's sets go to chunks of bounded size, in which the prefix-tree join
   runs: sets, ordered globally, are a trie. One traversal carries the overlaps of the path so far with the open sets,
   so that a shared path is counted once for all sets below it. At each node of the trie the overlap and the greatest
   length that remains in its subtree bound what any set below can share with an open set; sets out of reach are
   closed for the whole subtree, and a subtree without open sets is left. Pairs already in one component are closed.
5. Canopies of several chunks: the chunks' components meet by representatives first; then all nodes outside a canopy's
   largest component meet all its chunks, or, where that is less work, the nodes of each key that still holds several components
   meet. Neither misses a link, as linked nodes share a key, and pairs within a component need no test.

Defined results: without words or text: an empty set, linked with nothing; a null id is linked with nothing and its
component is null; rows that repeat an id are one node that unites their sets' links; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import CHUNK_DOCS, CHUNK_TOKENS, Groups, across, chunked, holders, in_chunks, number_of_chunks
from .common import Rolling, WordHashes, forget, in_batches, renamed, shared_table, slices, small_side
from .graph import components

PERCENT = 80
#: How many of their keys linked nodes share at least, if that many of their tokens have to be shared at all.
SHARED_KEYS = 8
#: Keys of at most so many nodes are counted by pairs; others tie all their nodes together.
RARE = 16


def shingles(text: str | None, k: int, memo: WordHashes, rolling: Rolling) -> np.ndarray:
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        return rolling.windows(memo.of(words), len(words)) ^ np.uint64(len(words))
    return np.unique(rolling.windows(memo.of(words), k))


def need(n: int, percent: int) -> int:
    """The least overlap with any linked set."""
    return -(-n * percent // 100)


def prefix(tokens: np.ndarray, reach: float, percent: int) -> tuple[int, int]:
    """Length of the prefix, and the least number of its tokens that a linked set's prefix shares."""
    n = len(tokens)
    below = n if reach >= 1 else int(np.searchsorted(tokens, np.uint64(int(reach * 2**64))))
    spare = n - need(n, percent)
    return max(below, spare + 1), max(1, below - spare)


def _each(batches, make):
    """Lists of what make gives for rows of id, text: a tuple or None."""
    memo, rolling = WordHashes(), Rolling()
    for batch in batches:
        for part in slices(batch):
            pairs = zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True)
            rows = [r for i, t in pairs if (r := make(i, t, memo, rolling)) is not None]
            if rows:
                yield rows


_LIGHT = "id long, n long, sig binary, p long, c long, tokens binary"


def _signatures(k: int, reach: float, percent: int):
    """One row per text; `tokens` are the prefix's, so that no later step but the join itself makes shingles again."""

    def make(i, text, memo, rolling):
        tokens = shingles(text, k, memo, rolling)
        p, c = prefix(tokens, reach, percent) if len(tokens) else (0, 0)
        return i, len(tokens), xxhash.xxh3_128_digest(tokens.tobytes()), p, c, tokens[:p].tobytes()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = zip(*(c.split() for c in _LIGHT.split(", ")), strict=True)
        types = [pa.int64() if kind == "long" else pa.binary() for kind in kinds]
        for rows in _each(batches, make):
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, list(names))

    return read


_LISTS = pa.list_(pa.int64())


def _deal(buckets: int, chunk: int = 1_000_000):
    """Rows of id, tokens to buckets; rows of local repeats go through with bucket -1 - b."""

    def merged(tokens: list, ids: list) -> list[pa.RecordBatch]:
        s, d = np.concatenate(tokens), np.concatenate(ids)
        order = np.argsort(s, kind="stable")
        s, d = s[order], d[order]
        first = np.r_[True, s[1:] != s[:-1]]
        many = ~first | np.r_[~first[1:], False]
        bucket = ((s * np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(40)).astype(np.int64) % buckets
        out = []
        # a repeated token's rows pass; its first row also tells the bucket (id null as -1: seen elsewhere)
        for pick, sign, keep in ((many, -1, True), (first, 1, False)):
            b, ss = bucket[pick], s[pick]
            dd = d[pick] if keep else np.where(many[pick], -1, d[pick])
            o = np.argsort(b, kind="stable")
            b, ss, dd = b[o], ss[o], dd[o]
            at = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.empty(0, np.int64)
            ends = np.r_[at, len(b)].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.view(np.int64))) for x in (ss, dd)]
            out.append((pa.array(b[at] if sign > 0 else -1 - b[at]), *lists))
        return [pa.RecordBatch.from_arrays(list(x), ["bucket", "s", "d"]) for x in out if len(x[0])]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, ids, size = [], [], 0
        for batch in batches:
            for i, own in zip(batch.column("id").to_pylist(), batch.column("tokens"), strict=True):
                own = np.frombuffer(own.as_py(), np.uint64)
                tokens.append(own)
                ids.append(np.full(len(own), i, np.int64))
                size += len(own)
                if size >= chunk:
                    yield from merged(tokens, ids)
                    tokens, ids, size = [], [], 0
        if size:
            yield from merged(tokens, ids)

    return read


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by bucket: (s, d) of the tokens that occur twice or more."""

    def pairs(s: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(s), pa.array(d)], ["s", "d"])

    def settled(parts: list) -> pa.RecordBatch:
        s, d = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(s, kind="stable")
        s, d = s[order], d[order]
        first = np.r_[True, s[1:] != s[:-1]]
        keep = (~first | np.r_[~first[1:], False]) & (d != -1)
        return pairs(s[keep], d[keep])

    now, parts = None, []
    for batch in batches:
        buckets = batch.column("bucket").to_pylist()
        for i, b in enumerate(buckets):
            s, d = (batch.column(c)[i].values.to_numpy() for c in ("s", "d"))
            if b < 0:
                yield pairs(s, d)
                continue
            if b != now and parts:
                yield settled(parts)
                parts = []
            now = b
            parts.append((s, d))
    if parts:
        yield settled(parts)


_PLACED = "canopy long, chunk string, of int, label long, n long, tokens array<long>"


def _sets(k: int):
    """Rows of a text and a place for one set of its id to rows of the place and the set, if the text has that set."""
    names = ["canopy", "chunk", "of", "label", "n"]
    types = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, rolling = WordHashes(), Rolling()
        for batch in batches:
            for part in slices(batch):
                sets = [shingles(t, k, memo, rolling) for t in part.column("text").to_pylist()]
                asked = part.column("sig").to_pylist()
                at = [i for i, s in enumerate(sets) if len(s) and xxhash.xxh3_128_digest(s.tobytes()) == asked[i]]
                if at:
                    columns = [part.column(c).take(pa.array(at)).cast(kind) for c, kind in zip(names, types, strict=True)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([sets[i].view(np.int64) for i in at], _LISTS)], [*names, "tokens"])

    return read


def _common(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


class Trie:
    """Sets as sorted paths; a node is a range of them, with the length of the path that they share."""

    def __init__(self, paths: list[np.ndarray]):
        self.walk = sorted(range(len(paths)), key=lambda i: paths[i].astype(">u4").tobytes())
        self.paths = [paths[i] for i in self.walk]
        self.shares = np.array([_common(a, b) for a, b in zip(self.paths, self.paths[1:], strict=False)], np.int64)

    def depth(self, low: int, high: int) -> int:
        """The path that the sets low to high - 1 share."""
        return int(self.shares[low : high - 1].min()) if high - low > 1 else len(self.paths[low])

    def children(self, low: int, high: int, depth: int) -> Iterator[tuple[int, int]]:
        """Ranges of the sets that go on in the same way after depth."""
        ends = (np.flatnonzero(self.shares[low : high - 1] == depth) + low + 1).tolist()
        yield from zip([low, *ends], [*ends, high], strict=True)


def tree_join(
    sets: list[np.ndarray], labels: np.ndarray, percent: int = PERCENT, visited: list | None = None, step: int = 256
) -> np.ndarray:
    """New labels: the sets' groups after all links between sets of different groups.

    `visited` gathers the ranges of the trie's nodes that were entered (for tests)."""
    token, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(-count, kind="stable")  # the global order: frequent first, so that paths are shared
    rank = np.empty(len(token), np.int64)
    rank[order] = np.arange(len(token))
    shared = int((count > 1).sum())
    lengths = np.array([len(s) for s in sets], np.int64)
    rank = rank[inverse]
    trie = Trie([np.sort(p[p < shared]) for p in np.split(rank, np.cumsum(lengths)[:-1])])
    place = np.empty(len(sets), np.int64)
    place[trie.walk] = np.arange(len(sets))
    held = holders(rank, place[np.repeat(np.arange(len(sets)), lengths)], shared, len(sets))
    size, groups = lengths[trie.walk], Groups(labels[trie.walk])
    path = np.array([len(p) for p in trie.paths], np.int64)

    def reach(low: int, high: int, depth: int, open_: np.ndarray, overlap: np.ndarray) -> np.ndarray:
        """Which open sets a set of the subtree may still link with."""
        own = size[low:high]
        remains = int(path[low:high].max()) - depth
        may = (100 + percent) * (overlap + remains) >= percent * (size[open_] + own.min())
        may &= (100 * size[open_] >= percent * own.min()) & (percent * size[open_] <= 100 * own.max())
        label = groups.label[low]
        if (groups.label[low:high] == label).all():
            may &= groups.label[open_] != label
        return may

    stack = [(0, len(sets), 0, np.arange(len(sets)), np.zeros(len(sets), np.int64))]
    while stack:
        low, high, depth, open_, overlap = stack.pop()
        later = open_ > low  # a link is found from its first set
        open_, overlap = open_[later], overlap[later]
        may = reach(low, high, depth, open_, overlap)
        open_, overlap = open_[may], overlap[may]
        if visited is not None and len(open_):
            visited.append((low, high))
        end, tokens = trie.depth(low, high), trie.paths[low]
        while depth < end and len(open_):
            to = min(end, depth + step)
            overlap = overlap + held(tokens[depth:to], open_)
            depth = to
            may = reach(low, high, depth, open_, overlap)
            open_, overlap = open_[may], overlap[may]
        if not len(open_):
            continue
        if high - low == 1:
            for j in open_[(100 + percent) * overlap >= percent * (size[open_] + size[low])].tolist():
                groups.join(low, j)
            continue
        stack += [(i, j, depth, open_, overlap) for i, j in reversed(list(trie.children(low, high, depth)))]
    out = np.empty(len(sets), np.int64)
    out[trie.walk] = groups.label
    return out


def _keys(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Table of each surviving node's keys: s, node, df, `core` (among the rarest, of which linked nodes share one) and
    `least` (how many of the keys linked nodes share, if the other has as many); deletes the table `pairs`."""
    for last in (False, False, True):  # nodes that fall make others' tokens unique
        held = pairs.groupBy("node").agg(F.count(F.lit(1)).alias("a")).join(nodes.select("node", "c"), "node")
        held = shared_table(held.where("a >= c"))
        if last:
            order = Window.partitionBy("node").orderBy("df", "s")
            keyed = pairs.join(small_side(held), "node").withColumn("at", F.row_number().over(order))
            keyed = keyed.withColumn("least", F.least("c", F.lit(SHARED_KEYS)).cast("int")).where("at <= a - c + least")
            made = shared_table(keyed.select("s", "node", "df", (F.col("at") <= F.col("a") - F.col("c") + 1).alias("core"), "least"))
        else:
            kept = pairs.join(small_side(held).select("node"), "node")
            often = shared_table(kept.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
            made = shared_table(kept.drop("df").join(often, "s"))
            forget(often)
        forget(pairs, held)
        pairs = made
    return pairs


def _stars(keys: DataFrame) -> DataFrame:
    """Edges from a key's first node to its others."""
    hubs = keys.groupBy("s").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("held")).where("held > 1")
    return keys.join(hubs.select("s", "hub"), "s").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))


def _split(canopies: DataFrame, keys: DataFrame, by_set: DataFrame, chunk_tokens: int, chunk_docs: int, trace: list | None) -> tuple[DataFrame, DataFrame | None]:
    """node, canopy: those of more than a chunk by pairs that share as many keys as a link needs, or one of many nodes; and what was split.

    Linked nodes share `least` keys. If none of these has more than RARE nodes, they are counted by pairs.
    """
    size = canopies.join(by_set.select("node", "n"), "node").groupBy("canopy")
    size = size.agg(number_of_chunks(F.count(F.lit(1)), F.sum("n"), chunk_tokens, chunk_docs).alias("of"), F.count(F.lit(1)).alias("docs"))
    large = shared_table(size.where("of > 1").select("canopy", (4 * F.col("of") * F.col("docs")).alias("cost")))
    if large.isEmpty():
        return canopies, None
    held = shared_table(keys.join(small_side(shared_table(canopies.join(large, "canopy").select("node"))), "node"))
    rare = held.where(F.col("df") <= RARE).groupBy("s").agg(F.collect_list(F.struct("node", "least")).alias("h")).where(F.size("h") > 1)
    rare = rare.select(F.explode("h").alias("x"), "h").select("x", F.explode("h").alias("y")).where("x.node < y.node")
    if trace is not None:  # what all sets would read in cells of half chunks, and the pairs that are counted instead
        trace.append((large.agg(F.sum("cost")).collect()[0][0], rare.count()))
    shared = rare.groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    shared = shared.agg(F.count(F.lit(1)).alias("n"), F.min(F.least("x.least", "y.least")).alias("least"))
    met = shared.where("n >= least").select("a", "b").unionByName(_stars(held.where(F.col("df") > RARE)).distinct())
    fine = components(met).toDF("node", "canopy")
    forget(held)
    return canopies.join(large, "canopy", "left_anti").select("node", "canopy"), fine


def _repeated(own: DataFrame, total: int) -> DataFrame:
    """Table s, node of the repeated shingles of rows id, tokens; total: about how many these hold."""
    dealt = in_batches(own, _deal(max(64, total // 500_000)), "bucket long, s array<long>, d array<long>")
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket")
    return shared_table(in_batches(dealt, _repeats, "s long, d long").withColumnRenamed("d", "node"))


def _canopies(keys: DataFrame, by_set: DataFrame, chunk_tokens: int, chunk_docs: int, trace: list | None) -> tuple[DataFrame, DataFrame | None]:
    """node, canopy of the nodes that keys connect, and those that are of more than a chunk (None: there are none)."""
    met = components(_stars(keys.where("core")).distinct()).toDF("node", "canopy")
    small, fine = _split(met, keys, by_set, chunk_tokens, chunk_docs, trace)
    if fine is None:
        return small, None
    size = fine.join(by_set.select("node", "n"), "node").groupBy("canopy")
    size = size.agg(number_of_chunks(F.count(F.lit(1)), F.sum("n"), chunk_tokens, chunk_docs).alias("of"))
    large = shared_table(size.where("of > 1").select("canopy"))
    if large.isEmpty():
        return small.unionByName(fine), None
    return small.unionByName(fine.join(large, "canopy", "left_anti").select("node", "canopy")), fine.join(large, "canopy")


def link_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = PERCENT,
    reach: float = 0.3, chunk_tokens: int = CHUNK_TOKENS, chunk_docs: int = CHUNK_DOCS, trace: list | None = None,
) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id; `trace` gathers the work between chunks of large canopies."""
    docs = renamed(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    seen = shared_table(in_batches(docs, _signatures(k, reach, percent), _LIGHT))
    light = shared_table(seen.drop("tokens"))
    whole = light.where("n > 0 and id is not null")
    by_set = whole.groupBy("sig").agg(F.min("id").alias("node"), F.min("n").alias("n"), F.min("c").alias("c"))
    by_set = shared_table(by_set)
    # rows whose set has a smaller id; an id all of whose rows are such is a copy
    named = shared_table(whole.select("id", "sig").join(by_set.select("sig", "node"), "sig").select("id", "node"))
    copies = named.groupBy("id").agg(F.min(F.col("node") < F.col("id")).alias("copy")).where("copy").select("id")
    nodes = by_set.groupBy("node").agg(F.min("c").alias("c"))
    total = whole.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("p")).collect()[0]["p"]
    own = seen.where("n > 0 and id is not null").select("id", "tokens")
    own = own.join(small_side(shared_table(copies)), "id", "left_anti")
    pairs = _repeated(own, int(total))
    forget(seen)
    keys = _keys(pairs, nodes)
    canopies, large = _canopies(keys, by_set, chunk_tokens, chunk_docs, trace)
    core = keys.where("core").select("s", "node")
    if large is not None:
        ids = small_side(shared_table(large.select(F.col("node").alias("id"))))
        again = shared_table(in_batches(docs.join(ids, "id"), _signatures(k, 1.0, percent), _LIGHT).where("n > 0"))
        total = again.agg(F.coalesce(F.sum("p"), F.lit(0))).collect()[0][0]
        # an id with several sets takes the least bound
        whole_nodes = again.groupBy(F.col("id").alias("node")).agg(F.min("c").alias("c"))
        more_keys = _keys(_repeated(again.select("id", "tokens"), int(total)), whole_nodes)
        fine, still = _canopies(more_keys, by_set, chunk_tokens, chunk_docs, trace)
        canopies = canopies.unionByName(fine)
        if still is not None:
            canopies = canopies.unionByName(still.select("node", "canopy"))
        core = core.join(ids.withColumnRenamed("id", "node"), "node", "left_anti").select("s", "node").unionByName(more_keys.where("core").select("s", "node"))
        forget(again)

    # sets of the nodes in canopies; a node whose id is repeated has several
    members = canopies.join(by_set.select("node", "sig", "n"), "node")
    members = chunked(members.withColumnRenamed("node", "label"), "label", chunk_tokens, chunk_docs)
    members = shared_table(members)
    placed = docs.join(small_side(members.withColumn("id", F.col("label"))), "id")
    sets = shared_table(in_batches(placed, _sets(k), _PLACED))
    join = lambda labels, rows, _: tree_join(rows, labels, percent)
    edges = shared_table(in_chunks(sets, join, []))
    many = sets.where("of > 1")
    if not many.isEmpty():
        more = across(many, edges, core, join, [], chunk_tokens, chunk_docs, trace)
        edges = shared_table(edges.unionByName(more))
    forget(sets, members, keys, *([more_keys] if large is not None else []))
    edges = edges.unionByName(named.where("id <> node").select(F.col("id").alias("a"), F.col("node").alias("b")))
    found = components(edges)
    out = light.join(found, light["id"] == found["node"], "left")
    return out.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of docs but for those whose component has a smaller id; rows without id stay."""
    found = link_components(docs, id_col, text_col, **settings)
    gone = found.where("component_id < doc_id").select(F.col("doc_id").alias("_weft_gone")).distinct()
    gone = small_side(shared_table(gone))
    return docs.join(gone, F.col(f"`{id_col}`") == F.col("_weft_gone"), "left_anti")
