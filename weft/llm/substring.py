"""Removal of long repeated spans by compaction of the de Bruijn graph of token windows.

Windows of `window` consecutive words are the graph's edges, a document is a walk. Every window has an anchor, its
leftmost least k-mer (k = `anchor`), and a run of windows with the same anchor occurrence is one piece of the walk: at
most window - anchor + 1 edges, kept as anchor, digest of its words, digests of the pieces before and after it, and
source coordinates (document, first window, number of windows). Equal windows have equal anchors at equal offsets, so:

1. Anchors met in one document only have no repeated edge and drop out.
2. Pieces of equal anchor and digest are one node. A node whose occurrences all have the same successor does not branch
   out, one whose occurrences all have the same predecessor does not branch in. Repeated nodes that follow each other
   without branching are compacted to one path, named by its coordinates in its first document.
3. Occurrences of a path in later documents are joined to it, piece by piece, and compacted to spans. A span is verified:
   the words at its source coordinates in the path's first document and its own words have to give the same 128-bit
   digest, each read from its text. Only then it is cut.
4. Anchors with several nodes may share single edges. One piece of each node (in its first document) is read again at
   its source coordinates and split into its edges, which are joined one by one to their first document by a second
   hash. Other occurrences of that node under the same id take over its covered edges.

A window is covered if its word sequence also starts in a document with a smaller id; covered words are cut out.
The number of rows is a small share of the words (two anchors for every window - anchor + 2 words). First documents are
partial minima; only the pieces of one document are ever ordered or gathered. Lists of paths and covers grow with the
corpus, so texts always meet them by sort-merge joins.

Defined results: a null text has no words and stays null; a row with a null id is returned as it is and is no source;
rows that repeat an id never remove each other; texts shorter than a window are returned as they are; ties go to
the smallest id; an empty table gives no rows; other columns are kept (names with `_weft_` are reserved).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BASE, Rolling, WordHashes, forget, give_back, in_batches, mixed, renamed, shared_table, slices

#: Windows whose k-mers are compared at once; numpy copies them, 8 * (window - anchor + 1) bytes each.
STEP = 1 << 13
_PIECES = "anchor long, digest long, before long, after long, id long, tag long, start int, n int"
_READ = "anchor long, edge long, id long, tag long, start int, bit int, n int, check binary"


def anchors_of(h: np.ndarray, rolling: Rolling, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """First window, number of windows and anchor hash of each piece."""
    grams = rolling.windows(h, anchor)
    width, n = window - anchor + 1, len(h) - window + 1
    view = np.lib.stride_tricks.sliding_window_view(grams, width)
    at = np.concatenate([view[i : i + STEP].argmin(1) for i in range(0, n, STEP)]) + np.arange(n)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return first, np.diff(np.r_[first, n]), grams[at[first]]


class Words:
    """A text's words, joined by one blank, and where each begins there."""

    def __init__(self, text: str):
        self.list = text.encode().split()
        self.joined = b" ".join(self.list)
        self.ends = np.cumsum(np.fromiter(map(len, self.list), np.int64, len(self.list)) + 1)

    def between(self, first: np.ndarray, last: np.ndarray) -> Iterator[bytes]:
        """The words from each first to each last, both included."""
        a, b = np.r_[0, self.ends][first].tolist(), (self.ends[last] - 1).tolist()
        return (self.joined[i:j] for i, j in zip(a, b, strict=True))


def _batch(columns: list[list[np.ndarray]], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    types = [pa.int64() if k == "long" else pa.int32() for k in kinds]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(c)).cast(t) for c, t in zip(columns, types, strict=True)], list(names)
    )


def _pieces(window: int, anchor: int):
    def of(doc: int, text: str, memo: WordHashes, rolling: Rolling) -> tuple | None:
        words = Words(text)
        if len(words.list) < window:
            return None
        first, n, grams = anchors_of(memo.of(words.list), rolling, window, anchor)
        digest = np.fromiter(map(xxhash.xxh64_intdigest, words.between(first, first + n + window - 2)), np.uint64, len(n))
        name = mixed(grams * np.uint64(BASE) + digest)  # of pieces, to tell whether neighbours differ
        before, after = np.r_[np.uint64(0), name[:-1]], np.r_[name[1:], np.uint64(0)]
        hashes = (x.view(np.int64) for x in (grams, digest, before, after))
        return *hashes, np.full(len(n), doc), np.full(len(n), zlib.crc32(text.encode())), first, n

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, rolling = WordHashes(), Rolling()
        for batch in batches:
            for part in slices(batch):
                pairs = zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True)
                found = [p for i, t in pairs if (p := of(i, t, memo, rolling)) is not None]
                if found:
                    yield _batch(list(zip(*found, strict=True)), _PIECES)

    return read


def _read_again(window: int):
    """Rows of id, tag, text, asked to edges of pieces (with an anchor) and digests of spans (without)."""

    def edges(row: dict, words: Words, asked: list[dict], memo: WordHashes, rolling: Rolling) -> pa.RecordBatch:
        hashes = rolling.windows(memo.of(words.list), window)
        n = np.array([p["n"] for p in asked])
        bit = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = np.repeat(np.array([p["start"] for p in asked]), n)
        anchor = np.repeat(np.array([p["anchor"] for p in asked], np.int64), n)
        one = lambda x, t: pa.array(np.full(len(bit), x), t)
        columns = [
            pa.array(anchor), pa.array(hashes[start + bit].view(np.int64)), one(row["id"], pa.int64()),
            one(row["tag"], pa.int64()), pa.array(start, pa.int32()), pa.array(bit, pa.int32()), pa.nulls(len(bit), pa.int32()),
            pa.nulls(len(bit), pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _READ.split(", ")])

    def digests(row: dict, words: Words, asked: list[dict]) -> pa.RecordBatch:
        start, n = (np.array([p[k] for p in asked]) for k in ("start", "n"))
        check = [xxhash.xxh3_128_digest(s) for s in words.between(start, start + n + window - 2)]
        rows = [(None, None, row["id"], row["tag"], int(s), None, int(k), c) for s, k, c in zip(start, n, check, strict=True)]
        types = [pa.int64()] * 4 + [pa.int32()] * 3 + [pa.binary()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _READ.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, rolling = WordHashes(), Rolling()
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("id", "tag", "text", "asked")}
                words = Words(row["text"])
                if split := [p for p in row["asked"] if p["anchor"] is not None]:
                    yield edges(row, words, split, memo, rolling)
                if spans := [p for p in row["asked"] if p["anchor"] is None]:
                    yield digests(row, words, spans)

    return read


def _compacted(nodes: DataFrame) -> DataFrame:
    """anchor, digest, low, low_tag, path, at: the path that a repeated node is part of, and where it begins."""
    here = Window.partitionBy("first.id", "first.tag").orderBy("first.start")
    follows = (F.lag(F.col("first.start") + F.col("first.n")).over(here) == F.col("first.start")) & F.lag(
        F.col("out_low") == F.col("out_high")
    ).over(here) & (F.col("in_low") == F.col("in_high"))
    begins = F.when(~F.coalesce(follows, F.lit(False)), F.col("first.start"))
    path = F.max("begins").over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return nodes.where("first.id < last").withColumn("begins", begins).select(
        "anchor", "digest", F.col("first.id").alias("low"), F.col("first.tag").alias("low_tag"), path.alias("path"),
        F.col("first.start").alias("at"),
    )


def covers_of(docs: DataFrame, window: int = 50, anchor: int = 16) -> DataFrame:
    """id, tag, start, n, mask, check: a span of n windows whose words have to give the digest `check`, or single
    windows start + i with bit i of mask set; docs: id, text."""
    docs = docs.where(F.col("id").isNotNull() & F.col("text").isNotNull()).withColumn("id", F.col("id").cast("long"))
    every = shared_table(in_batches(docs, _pieces(window, anchor), _PIECES))
    repeated = every.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    # written, so that the join has plain exchanges on both sides and hot anchors can be split
    repeated = shared_table(repeated.select("anchor"))
    pieces = shared_table(every.join(repeated, "anchor"))
    forget(every, repeated)
    nodes = shared_table(
        pieces.groupBy("anchor", "digest").agg(
            F.min(F.struct("id", "tag", "start", "n")).alias("first"), F.max("id").alias("last"),
            F.count(F.lit(1)).alias("times"), F.min("before").alias("in_low"), F.max("before").alias("in_high"),
            F.min("after").alias("out_low"), F.max("after").alias("out_high"),
        )
    )
    paths = shared_table(_compacted(nodes))
    met = pieces.join(paths, ["anchor", "digest"]).where("id > low")
    spans = met.groupBy("id", "tag", "low", "low_tag", "path", (F.col("start") - F.col("at")).alias("shift")).agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.col("n")).alias("end")
    )
    spans = spans.select("id", "tag", "low", "low_tag", "start", (F.col("end") - F.col("start")).alias("n"), "shift")
    spans = shared_table(spans.withColumn("source", F.col("start") - F.col("shift")).drop("shift"))
    branching = nodes.groupBy("anchor").agg(F.count(F.lit(1)).alias("ways")).where("ways > 1").select("anchor")
    branching = shared_table(branching)
    split = nodes.join(branching, "anchor").select("anchor", "first.*")
    asked = spans.select(
        F.lit(None).cast("long").alias("anchor"), F.col("low").alias("id"), F.col("low_tag").alias("tag"),
        F.col("source").alias("start"), "n",
    ).distinct()
    asked = asked.unionByName(split).groupBy("id", "tag").agg(F.collect_list(F.struct("anchor", "start", "n")).alias("asked"))
    asked = shared_table(asked)
    text = docs.withColumn("tag", F.crc32(F.col("text")))
    found = text.join(asked.hint("merge"), ["id", "tag"]).select("id", "tag", "text", "asked")
    found = shared_table(in_batches(found, _read_again(window), _READ))
    forget(paths, branching, asked)

    checks = found.where("check is not null").groupBy("id", "tag", "start", "n").agg(F.min("check").alias("check"))
    checks = shared_table(checks.toDF("low", "low_tag", "source", "n", "check"))
    spans_checked = spans.join(checks, ["low", "low_tag", "source", "n"])
    edges = found.where("anchor is not null")
    seen = edges.groupBy("anchor", "edge").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    seen = shared_table(seen.select("anchor", "edge", "low"))
    hit = edges.join(seen, ["anchor", "edge"]).where("id > low")
    part = shared_table(hit.groupBy("id", "tag", "start").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask")))
    # a node that its first document holds again: equal words, so equal masks
    again = nodes.where("times > 1").select("anchor", "digest", "first.id", "first.tag", "first.start")
    again = shared_table(again.join(part, ["id", "tag", "start"]).withColumnsRenamed({"tag": "own", "start": "at"}))
    same = pieces.join(again, ["anchor", "digest", "id"]).where("tag <> own or start <> at")
    single = part.unionByName(same.select("id", "tag", "start", "mask"))
    covers = spans_checked.select("id", "tag", "start", "n", "check").unionByName(single, allowMissingColumns=True)
    covers = shared_table(covers)
    forget(pieces, nodes, spans, found, checks, seen, part, again)
    return covers


def cut_words(text: str | None, covers: list[dict] | None, window: int) -> tuple[str | None, int, int]:
    """The text without covered words, its words before, and those cut."""
    if text is None:
        return None, 0, 0
    if not covers:
        return text, len(text.encode().split()), 0
    words = Words(text)
    mark = np.zeros(len(words.list) + 1, np.int64)
    for c in covers:
        start, n, mask = c["start"], c["n"], c["mask"]
        if mask is None:
            own = next(words.between(np.array([start]), np.array([start + n + window - 2])))
            if xxhash.xxh3_128_digest(own) == c["check"]:
                mark[start] += 1
                mark[start + n + window - 1] -= 1
        while mask:
            low = (mask & -mask).bit_length() - 1
            run = ((mask >> low) ^ ((mask >> low) + 1)).bit_length() - 1
            mark[start + low] += 1
            mark[start + low + run + window - 1] -= 1
            mask &= ~(((1 << run) - 1) << low)
    gone = np.cumsum(mark)[:-1] > 0
    data = text.encode()
    raw = np.frombuffer(data, np.uint8)
    space = np.zeros(len(raw) + 2, bool)
    space[0] = space[-1] = True
    space[1:-1] = (raw == 32) | ((raw >= 9) & (raw <= 13))
    begin = np.flatnonzero(space[:-1] & ~space[1:])
    end = np.flatnonzero(~space[:-1] & space[1:])
    first = np.flatnonzero(gone & ~np.r_[False, gone[:-1]])
    last = np.flatnonzero(gone & ~np.r_[gone[1:], False])
    out, at = [], 0
    for i, j in zip(begin[first].tolist(), end[last].tolist(), strict=True):
        out.append(data[at:i])
        at = j
    return b"".join([*out, data[at:]]).decode(), len(words.list), int(gone.sum())


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, anchor: int = 16
) -> DataFrame:
    """docs with repeated spans cut from the text, and _weft_words, _weft_removed."""
    covers = covers_of(renamed(docs, id=id_col, text=text_col), window, anchor)
    gathered = covers.groupBy("id", "tag").agg(F.collect_list(F.struct("start", "n", "mask", "check")).alias("_weft_covers"))
    gathered = shared_table(gathered.toDF("_weft_id", "_weft_tag", "_weft_covers"))
    forget(covers)
    text = F.col(f"`{text_col}`")

    @F.arrow_udf("text string, words long, removed long")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        try:
            for texts, found in batches:
                rows = [cut_words(t.as_py(), c.as_py(), window) for t, c in zip(texts, found, strict=True)]
                types = [pa.string(), pa.int64(), pa.int64()]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 3, types, strict=True)]
                yield pa.StructArray.from_arrays(columns, ["text", "words", "removed"])
        finally:
            give_back()

    keys = (F.col(f"`{id_col}`") == F.col("_weft_id")) & (F.crc32(text) == F.col("_weft_tag"))
    out = docs.join(gathered.hint("merge"), keys, "left").withColumn("_weft_cut", cut(text, F.col("_weft_covers")))
    columns = [
        F.col("_weft_cut.text").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns
    ]
    return out.select(
        *columns, F.col("_weft_cut.words").alias("_weft_words"), F.col("_weft_cut.removed").alias("_weft_removed")
    )
