"""Near copies by SuperMinHash, banding, verification on full sets and union-find.

A document is the set of its distinct k-word shingles (64-bit hashes). A SuperMinHash signature gives each element a random
permutation of the signature's places, so that its ranks are correlated: component c is the least (rank of c + a fraction) over the
elements. Two sets agree in a component with the probability of their Jaccard similarity, with less variance than independent minima have. All
elements take a rank at a time; a component met by any element is settled, and a document stops when all its components are,
after about 1 + m ln(m) / n ranks.

Bands of `rows` components are keys. Sets whose similarity is 0.85 share none of 42 bands of 6 with a probability of (1 - 0.85^6)^42 = 2.3e-9
or less; more similar ones sooner share one. Exact copies are one set (by 128-bit digest). Sets that keys tie together are a
canopy; its sets go to chunks, where those that share a band are compared in full, unless union-find already has them in
one group. `chunks` tells how canopies larger than a chunk go on. Every link is confirmed by the full sets; links are not listed, the result
is each document's component.

Defined results: without words or text: an empty set, linked with nothing, its own component and kept; a null id is linked with
nothing, its component is null and it's kept; rows that repeat an id are one node that unites their sets' links; an empty table
gives no rows; other columns are ignored. Texts are read whole, of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import CHUNK_DOCS, CHUNK_TOKENS, Groups, across, chunked, holders, in_chunks
from .common import Rolling, WordHashes, forget, in_batches, mixed, renamed, shared_table, slices, small_side
from .graph import components
from .jaccard import shingles

PERCENT = 85
BANDS, ROWS = 42, 6
#: Elements whose permutations are held at once.
AT_ONCE = 1 << 13
_STEP = 0x9E3779B97F4A7C15
_SHIFT = np.uint64(56)


def signatures(sets: list[np.ndarray], m: int, seed: int = 1, ranks: list | None = None) -> np.ndarray:
    """SuperMinHash of each set, sets by m (at most 256): rank in the high byte, fraction below; `ranks` gathers the ranks used."""
    out = np.full((len(sets), m), np.iinfo(np.uint64).max)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    elements = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    for at in range(0, len(elements), AT_ONCE):
        own = owner[at : at + AT_ONCE]
        _settle(out[own[0] : own[-1] + 1], own - own[0], elements[at : at + AT_ONCE], m, seed, ranks)
    return out


def _settle(out: np.ndarray, owner: np.ndarray, elements: np.ndarray, m: int, seed: int, ranks: list | None) -> None:
    """Lowers `out` by these elements, a rank at a time; what lower ranks settled stays."""
    flat, base = out.reshape(-1), owner * m
    place = None  # each element's permutation of the components, made as far as it is used
    for j in range(m):
        # a component whose value has a lower rank can't change; a document without others is done
        todo = (out >> _SHIFT).max(1) >= np.uint64(j)
        live = todo[owner]
        if not live.all():
            owner, elements, base = owner[live], elements[live], base[live]
            place = place[live] if place is not None else None
        if not len(elements):
            break
        r = mixed(elements + np.uint64((2 * j + seed) * _STEP % 2**64))
        k = j + ((r & np.uint64(0xFFFFFFFF)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        if place is None:
            here = k
            place = np.broadcast_to(np.arange(m, dtype=np.uint8), (len(elements), m)).copy()
            start = np.arange(len(elements)) * m
            place.reshape(-1)[start + k] = 0
        else:
            start = np.arange(len(elements)) * m + k
            here = place.reshape(-1)[start]
            place.reshape(-1)[start] = place[:, j]
        at = base + here
        value = (np.uint64(j) << _SHIFT) | (r >> np.uint64(8))
        if j:
            new = np.flatnonzero(flat[at] > value)
            at, value = at[new], value[new]
        np.minimum.at(flat, at, value)
    if ranks is not None:
        ranks.append(j)


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """64-bit keys of all bands, sets by bands; a set without elements has none (all zero)."""
    n, m = signature.shape
    bands = signature.reshape(n, m // rows, rows)
    keys = np.zeros((n, m // rows), np.uint64)
    for i in range(rows):
        keys = mixed(keys + bands[:, :, i] + np.uint64(_STEP))
    return mixed(keys + np.arange(m // rows, dtype=np.uint64)[None, :])


def _signed(batches, k: int, bands: int, rows: int):
    """Lists of (ids, sets, keys) of bounded slices of the rows of id, text."""
    memo, rolling = WordHashes(), Rolling()
    for batch in batches:
        for part in slices(batch):
            sets = [shingles(t, k, memo, rolling) for t in part.column("text").to_pylist()]
            yield part.column("id").to_pylist(), sets, band_keys(signatures(sets, bands * rows), rows).view(np.int64)


_LISTS = pa.list_(pa.int64())


def _light(k: int, bands: int, rows: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets, keys in _signed(batches, k, bands, rows):
            sig = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            columns = [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets]), pa.array(sig, pa.binary()), pa.array(list(keys), _LISTS)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "sig", "keys"])

    return read


def _sets(k: int, bands: int, rows: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets, keys in _signed(batches, k, bands, rows):
            sig = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            columns = [pa.array(ids, pa.int64()), pa.array(sig, pa.binary()), pa.array([s.view(np.int64) for s in sets], _LISTS), pa.array(list(keys), _LISTS)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "sig", "tokens", "keys"])

    return read


def verified(labels: np.ndarray, sets: list[np.ndarray], keys: np.ndarray, percent: int, pairs: list | None = None) -> np.ndarray:
    """New labels after all links between sets that share a band; `pairs` gathers how many pairs were compared."""
    token, rank, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    place = np.empty(len(token), np.int64)
    place[order] = np.arange(len(token))
    shared, size = int((count > 1).sum()), np.array([len(s) for s in sets])
    rank = place[rank]
    held = holders(rank, np.repeat(np.arange(len(sets)), size), shared, len(sets))
    own = [p[p < shared] for p in np.split(rank, np.cumsum(size)[:-1])]
    groups = Groups(labels)
    for i in range(len(sets) - 1):
        open_ = np.flatnonzero(groups.label[i + 1 :] != groups.label[i]) + i + 1
        open_ = open_[(100 * size[open_] >= percent * size[i]) & (percent * size[open_] <= 100 * size[i])]
        open_ = open_[(keys[open_] == keys[i]).any(1)]
        if not len(open_):
            continue
        if pairs is not None:
            pairs.append(len(open_))
        overlap = held(own[i], open_)
        for j in open_[(100 + percent) * overlap >= percent * (size[open_] + size[i])].tolist():
            groups.join(i, j)
    return groups.label


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = PERCENT, bands: int = BANDS,
    rows: int = ROWS, chunk_tokens: int = CHUNK_TOKENS, chunk_docs: int = CHUNK_DOCS, trace: list | None = None,
) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept; `trace` gathers the work between chunks."""
    docs = renamed(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    seen = shared_table(in_batches(docs, _light(k, bands, rows), "id long, n long, sig binary, keys array<long>"))
    whole = seen.where("n > 0 and id is not null")
    by_set = shared_table(whole.groupBy("sig").agg(F.min("id").alias("node"), F.min("n").alias("n")))
    # rows whose set has a smaller id; an id all of whose rows are such is a copy
    named = shared_table(whole.select("id", "sig").join(by_set.select("sig", "node"), "sig").select("id", "node"))
    copies = named.groupBy("id").agg(F.min(F.col("node") < F.col("id")).alias("copy")).where("copy").select("id")
    copies = small_side(shared_table(copies))
    own = whole.join(copies, "id", "left_anti").select(F.explode("keys").alias("s"), F.col("id").alias("node"))
    hubs = own.groupBy("s").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").drop("last")
    hubs = shared_table(hubs)
    keys = shared_table(own.join(hubs, "s"))
    stars = keys.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    canopies = components(stars).toDF("node", "canopy")

    members = canopies.join(by_set.select("node", "sig", "n"), "node")
    members = shared_table(chunked(members.withColumnRenamed("node", "label"), "label", chunk_tokens, chunk_docs))
    ids = small_side(members.select(F.col("label").alias("id")).distinct())
    sets = in_batches(docs.join(ids, "id"), _sets(k, bands, rows), "id long, sig binary, tokens array<long>, keys array<long>")
    sets = sets.join(members, (sets["sig"] == members["sig"]) & (sets["id"] == members["label"]))
    sets = shared_table(sets.select("canopy", "chunk", "of", "label", "n", "tokens", "keys"))
    join = lambda labels, sets, extra: verified(labels, sets, np.stack(extra[0]), percent)
    edges = shared_table(in_chunks(sets, join, ["keys"]))
    many = sets.where("of > 1")
    if not many.isEmpty():
        more = across(many, edges, keys.select("s", "node"), join, ["keys"], chunk_tokens, chunk_docs, trace)
        edges = shared_table(edges.unionByName(more))
    forget(sets, members, hubs, keys)
    edges = edges.unionByName(named.where("id <> node").select(F.col("id").alias("a"), F.col("node").alias("b")))
    found = components(edges)
    out = seen.select("id", "n").join(found, seen["id"] == found["node"], "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
