"""How sources of a language differ in their words: systolic rotation of compressed term vectors.

1. Terms are counted in each partition by (lang, source), with the number of documents that hold them, and added up. A language
   keeps the terms in at least `least_docs` of its documents. A group's probability of a kept term is smoothed and scaled:
   p = 1 + floor(SCALE * (count + 2) / (N + 2 V)), all in whole numbers.
2. Kept terms are dealt to shards by hash and numbered there, in the order of their bytes. A group's vector in a shard is a row
   of compressed bytes: numbers of its terms and counts. Shards bound each vector and what a station holds, at any vocabulary.
3. The groups of a language are dealt to stations. A station's partition (by language and shard) keeps its own groups; the vectors of
   other stations travel through it one at a time, in the rounds of a round-robin tournament (circle method), so that any two stations
   meet once, at one of the two. A meeting evaluates both directions of each pair of groups. Terms that neither has are one
   product. All rounds are one shuffle; a station reads its visitors sorted by round, so a lost executor costs its own stations only.
4. The language's own vector visits every station too: against it each group ranks its excess terms in a local heap.
   The heaps of a group's shards and the sums of its pairs over shards are merged, then ranked.

A hot source is one vector a shard, never longer than the shard's terms. Divergence of p and q: sum of floor((p-q)^2/(p+q)).

Defined results: null text, lang and source are ''; repeated rows count each; groups without terms take part, with
values of zero where the language keeps no term; a language of one source has no pairs; ties go to the smaller item by bytes; an
empty table gives no rows; other columns are ignored. Texts of any length are read in pieces that end between terms.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, in_batches, shared_table, slices, small_side

SCALE = 10**9
#: A station's groups are about so many, and stations of a language at most MOST_STATIONS; more groups share them.
STATION_GROUPS, MOST_STATIONS = 4, 16

#: ASCII but letters ends a term; A-Z are lower-cased; other bytes are parts of longer characters.
_FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)).lower()
_LETTERS = pa.binary()


def pieces(text: bytes, size: int = 1 << 22) -> Iterator[list[bytes]]:
    """Terms of a text, by pieces that end between terms."""
    at = 0
    while at < len(text):
        piece = text[at : at + size].translate(_FOLD)
        if at + size < len(text) and (end := piece.rfind(b" ")) >= 0:
            piece = piece[: end + 1]
        elif at + size < len(text):  # one term longer than a piece
            piece = text[at:].translate(_FOLD)
            piece = piece[: piece.find(b" ", size) + 1 or len(piece)]
        yield piece.split()
        at += len(piece)


_COUNTS = "lang binary, source binary, term binary, n long, docs long"


def _count(limit: int):
    """Rows of lang, source, text to counts of terms by group; at most about `limit` terms are held at once."""

    def rows(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = [b"", *n]  # the empty term stands for the group itself
            kinds = [_LETTERS, _LETTERS, _LETTERS, pa.int64(), pa.int64()]
            columns = [[lang] * len(terms), [source] * len(terms), terms, [0, *n.values()], [0, *map(docs.__getitem__, n)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [c.split()[0] for c in _COUNTS.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in batches:
            for part in slices(batch):
                columns = [part.column(c).cast(_LETTERS).to_pylist() for c in ("lang", "source", "text")]
                for lang, source, text in zip(*columns, strict=True):
                    n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                    size -= len(n)
                    own = set()
                    for terms in pieces(text):
                        n.update(terms)
                        own.update(terms)
                    docs.update(own)
                    size += len(n)
                    if size >= limit:
                        yield from rows(held)
                        held, size = {}, 0
        yield from rows(held)

    return read


def probabilities(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / total), total being N + 2 V."""
    if len(counts) and int(counts.max()) + 2 > (2**63 - 1) // SCALE:
        return np.array([1 + SCALE * (c + 2) // total for c in counts.tolist()], np.int64)
    return 1 + SCALE * (counts + 2) // total


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class Vector:
    """A group's probabilities in a shard: numbers of the terms it has, their p, and the p of all others."""

    def __init__(self, name: bytes, at: bytes, counts: bytes, total: int):
        self.name = name
        self.at = np.cumsum(np.frombuffer(zlib.decompress(at), "<u4"), dtype=np.int64)
        self.p = probabilities(np.frombuffer(zlib.decompress(counts), "<i8"), total) if total else np.empty(0, np.int64)
        self.none = int(probabilities(np.zeros(1, np.int64), total)[0]) if total else 0


def meeting(a: Vector, b: Vector, terms: int) -> int:
    """The sum of gaps over a shard's terms."""
    if not terms:
        return 0
    place = np.searchsorted(a.at, b.at)
    both = np.zeros(len(b.at), bool)
    inside = place < len(a.at)
    both[inside] = a.at[place[inside]] == b.at[inside]
    shared = a.p[place[both]]
    p = np.full(len(b.at), a.none)
    p[both] = shared
    alone = gap(np.array([a.none]), np.array([b.none]))[0] * (terms - len(a.at) - len(b.at) + len(shared))
    return int(gap(p, b.p).sum() + gap(a.p, np.int64(b.none)).sum() - gap(shared, np.int64(b.none)).sum() + alone)


_VECTOR = "lang binary, shard int, peer int, source binary, ats binary, counts binary"
_MET = "lang binary, shard int, source binary, item binary, at long, value long"


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of lang, shard, peer, source, at, n, sorted, to one row a vector."""

    def packed(key: tuple, ats: list, counts: list) -> tuple:
        at, n = np.concatenate(ats), np.concatenate(counts)
        return *key, zlib.compress(np.diff(at, prepend=0).astype("<u4").tobytes(), 1), zlib.compress(n.astype("<i8").tobytes(), 1)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [_LETTERS, pa.int32(), pa.int32(), _LETTERS, _LETTERS, _LETTERS]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in _VECTOR.split(", ")])

    now, ats, counts = None, [], []
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("lang", "shard", "peer", "source")), strict=True))
        at, n = (batch.column(c).to_numpy() for c in ("at", "n"))
        i = 0
        while i < len(keys):
            j = i + 1
            while j < len(keys) and keys[j] == keys[i]:
                j += 1
            if keys[i] != now and ats:
                yield batch_of([packed(now, ats, counts)])
                ats, counts = [], []
            now = keys[i]
            ats.append(at[i:j])
            counts.append(n[i:j])
            i = j
    if ats:
        yield batch_of([packed(now, ats, counts)])


def _rotate(top: int):
    """Rows sorted by lang, shard, station, round: the language (-2), the station's groups (-1), its visitors."""

    class Station:
        def __init__(self, lang: bytes, shard: int):
            self.lang, self.shard, self.whole, self.own, self.out = lang, shard, None, [], []

        def terms(self) -> int:
            return len(self.whole.at) if self.whole else 0

        def emit(self, source: bytes, item: bytes | None, at: int | None, value: int) -> None:
            self.out.append((self.lang, self.shard, source, item, at, value))

        def meet(self, a: Vector, b: Vector) -> None:
            value = meeting(a, b, self.terms())  # the gap is symmetric: both directions at once
            self.emit(a.name, b.name, None, value)
            self.emit(b.name, a.name, None, value)

        def arrive(self, round_: int, v: Vector) -> None:
            if round_ == -2:
                self.whole = v
                return
            for other in self.own:
                self.meet(other, v)
            if round_ == -1:
                self.own.append(v)
                if self.whole:
                    self.excess(v)

        def excess(self, v: Vector) -> None:
            q = self.whole.p[v.at]
            over = np.flatnonzero(v.p > q)
            value = gap(v.p[over], q[over])
            if len(value) > top:
                keep = value >= np.partition(value, -top)[-top]
                over, value = over[keep], value[keep]
            heap = heapq.nsmallest(top, zip((-value).tolist(), v.at[over].tolist(), strict=True))
            for less, at in heap:
                self.emit(v.name, None, at, -less)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [_LETTERS, pa.int32(), _LETTERS, _LETTERS, pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in _MET.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, station = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c, i=i, batch=batch: batch.column(c)[i].as_py()
                key = get("lang"), get("shard"), get("station")
                if key != now:
                    if station and station.out:
                        yield batch_of(station.out)
                    now, station = key, Station(*key[:2])
                station.arrive(get("round"), Vector(get("source"), get("ats"), get("counts"), get("total")))
                if len(station.out) >= 10_000:
                    yield batch_of(station.out)
                    station.out = []
        if station and station.out:
            yield batch_of(station.out)

    return read


def tournament(stations: int) -> list[tuple[int, int, int]]:
    """(round, host, guest) of the circle method: every two stations meet once, no station twice in a round."""
    n = stations + stations % 2
    out = []
    for r in range(n - 1):
        for k in range(n // 2):
            a, b = (n - 1, r) if k == 0 else ((r + k) % (n - 1), (r - k) % (n - 1))
            if max(a, b) < stations:  # by parity each hosts about half of its meetings
                out.append((r, min(a, b), max(a, b)) if (a + b) % 2 else (r, max(a, b), min(a, b)))
    return out


def _schedule(spark: SparkSession) -> DataFrame:
    rows = [(s, *m) for s in range(1, MOST_STATIONS + 1) for m in tournament(s)]
    return F.broadcast(spark.createDataFrame(rows, "stations int, round int, host int, guest int"))


def source_divergence(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 10,
    top: int = 10, shard_terms: int = 100_000, station_terms: int = 1_000_000, held_terms: int = 300_000,
) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: all pairs of a language's sources, and each one's top terms."""
    asked = {"lang": lang_col, "source": source_col, "text": text_col}
    rows = docs.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(name) for name, c in asked.items()])
    counts = in_batches(rows, _count(held_terms), _COUNTS)
    counts = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # a term's rows of one language, one a source, decide on it; the empty term stays for each group
    one = Window.partitionBy("lang", "term")
    kept = counts.withColumn("held", F.sum("docs").over(one)).withColumn("all", F.sum("n").over(one))
    kept = kept.withColumn("first", F.row_number().over(one.orderBy("source")) == 1)
    named = F.length("term") > 0
    kept = shared_table(kept.where(~named | (F.col("held") >= least_docs)).drop("docs", "held"))

    first = named & F.col("first")
    langs = kept.groupBy("lang").agg(
        F.count_if(~named).alias("groups"), F.count_if(first).alias("v"), F.count_if(named).alias("cells"),
        F.coalesce(F.sum(F.when(first, F.col("all"))), F.lit(0)).alias("whole"),
    )
    langs = langs.withColumn("stations", F.least(F.lit(MOST_STATIONS), F.ceil(F.col("groups") / STATION_GROUPS)).cast("int"))
    by_cells = F.ceil(F.col("cells") / (F.col("stations") * station_terms))
    langs = langs.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("v") / shard_terms), by_cells).cast("int"))
    langs = small_side(shared_table(langs))

    shard = F.pmod(F.xxhash64("term"), F.col("shards")).cast("int")
    at = F.dense_rank().over(Window.partitionBy("lang", "shard").orderBy("term")).cast("long") - 1
    numbered = kept.where(named).join(langs.select("lang", "shards"), "lang").withColumn("shard", shard).withColumn("at", at)
    numbered = shared_table(numbered.drop("shards"))
    own = numbered.select("lang", "shard", F.lit(1).alias("peer"), "source", "at", "n")
    whole = numbered.where("first").select("lang", "shard", F.lit(0).alias("peer"), F.lit(b"").alias("source"), "at", F.col("all").alias("n"))
    key = ["lang", "shard", "peer", "source"]
    vectors = own.unionByName(whole).repartition(*key).sortWithinPartitions(*key, "at")
    vectors = shared_table(in_batches(vectors, _compress, _VECTOR))

    # N by group; every group is present in every shard, with or without terms
    facts = kept.groupBy("lang", "source").agg(F.sum("n").alias("own")).join(langs, "lang")
    total = (F.col("own") + 2 * F.col("v")).alias("total")
    every = facts.select("lang", "source", "stations", total, F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    empty = F.lit(zlib.compress(b""))
    filled = [F.coalesce(c, empty).alias(c) for c in ("ats", "counts")]
    every = every.join(vectors.where("peer = 1").drop("peer"), ["lang", "source", "shard"], "left")
    every = every.select("lang", "shard", "source", "stations", "total", *filled)
    every = shared_table(every.withColumn("station", F.pmod(F.xxhash64("source"), F.col("stations")).cast("int")))
    # a language's vector goes to each station, a station's groups to its hosts
    peers = vectors.where("peer = 0").drop("peer").join(langs, "lang").select(
        "lang", "shard", "source", (F.col("whole") + 2 * F.col("v")).alias("total"), "ats", "counts",
        F.explode(F.sequence(F.lit(0), F.col("stations") - 1)).alias("station"), F.lit(-2).alias("round"),
    )
    home = every.drop("stations").withColumn("round", F.lit(-1))
    trips = every.withColumnRenamed("station", "guest").join(_schedule(docs.sparkSession), ["stations", "guest"])
    trips = trips.drop("stations", "guest").withColumnRenamed("host", "station")
    place = ["lang", "shard", "station"]
    cells = peers.unionByName(home).unionByName(trips).repartition(*place).sortWithinPartitions(*place, "round", "source")
    met = shared_table(in_batches(cells, _rotate(top), _MET))

    pairs = met.where("item is not null").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    terms = met.where("item is null").select("lang", "shard", "source", "at", "value")
    names = numbered.where("first").select("lang", "shard", "at", F.col("term").alias("item"))
    terms = names.join(small_side(terms), ["lang", "shard", "at"])
    both = pairs.withColumn("part", F.lit("pair")).unionByName(
        terms.select("lang", "source", "item", "value", F.lit("term").alias("part"))
    )
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = both.withColumn("rank", F.row_number().over(order).cast("int")).where((F.col("part") == "pair") | (F.col("rank") <= top))
    text = lambda c: F.col(c).cast("string").alias(c)
    out = shared_table(ranked.select(text("lang"), text("source"), "part", text("item"), "value", "rank"))
    forget(kept, numbered, vectors, every, met)
    return out
