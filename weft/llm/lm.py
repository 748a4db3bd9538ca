"""Language-model scores from a weighted backoff automaton of smoothed n-grams up to three words.

Blocks. Documents are read once, into blocks of about `block_tokens` tokens: local word numbers, most frequent first, and the
words' 64-bit hashes. Blocks are a written table, so that all later steps see the same ones.

Counting. Each block deals its distinct words, and its distinct pairs and triples of consecutive words, to buckets: words
by their hash, pairs and triples by their own hash, whatever words they hold, so that a frequent word or pair fills no
bucket. Lists are sorted and sent as differences. A bucket adds up the counts in training documents and returns to each
block the totals of what it sent. Every n-gram met in training is in the model, once or more, so it grows with the
corpus; no process ever holds more of it than one block or one bucket needs, and the driver only sees N and V.

Automaton. States are the empty context and the words and pairs met in training. The probability of w in state h, with
the shorter context h', is (c(hw) + s p(w | h')) / (c(h) + s), s = `strength` of h's length (Dirichlet smoothing). So an
arc (h, w) carries the log of that for each n-gram hw that was met, h's failure arc carries log s / (c(h) + s) and leads
to h', and the empty context has an arc for every word, p(w) = (c + delta) / (N + delta (V + 1)), c = 0 for unknown
words. Probabilities add up to one in every state.

Traversal. From left to right, a token takes its state's arc, or failure arcs until a state has one. The state after a
token is the longest of its pair with the token before and the token alone that is a state, else the empty context; a
document begins in the empty context. As two tokens fix a state, all positions of a block take each step at once.

Words are identified by 64-bit hashes, pairs and triples by as many bits as make a clash improbable (one in 2**20 for
each, by the number of tokens; whole bytes, at most 64). Defined results: null text: the end token alone; null id: held
out (text ''); repeated rows count and are scored each; without training rows counts are 0 and every token has
probability 1; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, WordHashes, in_batches, mixed, renamed, shared_table, slices

END = b"\n"  # no word holds white space
#: Buckets hold about this many tokens' n-grams.
BUCKET_TOKENS, LEAST_BUCKETS = 4_000_000, 64


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def tokens_of(texts: list[str | None], memo: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the texts one after the other, and each text's number of tokens."""
    words = [[*(t or "").encode().lower().split(), END] for t in texts]
    return memo.of([w for ws in words for w in ws]), np.array([len(ws) for ws in words], np.int64)


def pack(x: np.ndarray, width: int | None = None) -> bytes:
    """The lowest `width` bytes of all values, byte by byte, compressed."""
    if not len(x):
        return b""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1)[:, :width]
    return zstandard.ZstdCompressor(level=1).compress(planes.T.tobytes())


def unpack(data: bytes, dtype, width: int | None = None) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    if not data:
        return np.empty(0, dtype)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width or size, -1)
    out = np.zeros((planes.shape[1], size), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view(dtype).ravel()


def pack_ascending(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=np.zeros(1, x.dtype)))


def unpack_ascending(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


_BLOCKS = "block long, size long, ids array<long>, lengths binary, tokens binary, counts binary, words binary"


def _encode(size: int):
    def row(block: int, ids: list, hashes: list, lengths: list) -> pa.RecordBatch:
        words, tokens, counts = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        place = np.empty(len(words), np.uint32)
        place[np.argsort(-counts, kind="stable")] = np.arange(len(words))
        blobs = (
            pack(np.concatenate(lengths).astype(np.uint32)), pack(place[tokens]), pack(counts.astype(np.uint32)),
            pack_ascending(words),
        )
        columns = [pa.array([block]), pa.array([len(tokens)]), pa.array([ids], pa.list_(pa.int64()))]
        names = ["block", "size", "ids", "lengths", "tokens", "counts", "words"]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array([b], pa.binary()) for b in blobs)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, block = WordHashes(), TaskContext.get().partitionId() << 32
        ids, hashes, lengths, held = [], [], [], 0
        for batch in batches:
            for part in slices(batch):
                h, n = tokens_of(part.column("text").to_pylist(), memo)
                ids += part.column("id").to_pylist()
                hashes.append(h)
                lengths.append(n)
                held += len(h)
                if held >= size:
                    yield row(block, ids, hashes, lengths)
                    block, ids, hashes, lengths, held = block + 1, [], [], [], 0
        if ids:
            yield row(block, ids, hashes, lengths)

    return read


class Block:
    """A decoded block; tokens are positions in words, which ascend."""

    def __init__(self, ids: list, lengths: bytes, tokens: bytes, counts: bytes, words: bytes):
        self.ids = ids
        self.lengths = unpack(lengths, np.uint32).astype(np.int64)
        self.words = unpack_ascending(words)
        self.counts = unpack(counts, np.uint32).astype(np.int64)
        self.tokens = np.argsort(-self.counts, kind="stable").astype(np.int32)[unpack(tokens, np.uint32)]
        self.held = np.array([held_out(i) for i in ids], bool)
        self.starts = np.cumsum(self.lengths) - self.lengths
        place = np.arange(len(self.tokens)) - np.repeat(self.starts, self.lengths)
        #: positions that have one, and two, tokens of their document before them
        self.second, self.third = np.flatnonzero(place >= 1), np.flatnonzero(place >= 2)

    def grams(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of pairs and triples, ascending, and the place of those at `second`, then at `third`."""
        h, drop = self.words[self.tokens], np.uint64(64 - bits)
        pair = mixed(mixed(h[:-1]) * np.uint64(BASE) + h[1:])
        triple = mixed(pair[:-1] * np.uint64(BASE) + h[2:] + np.uint64(3))
        keys = np.concatenate([pair[self.second - 1], triple[self.third - 2]]) >> drop
        order = np.argsort(keys)
        keys = keys[order]
        new = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.empty(0, bool)
        at = np.empty(len(keys), np.int32)
        at[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
        return keys[new], at

    def trained(self, at: np.ndarray, n: int) -> np.ndarray:
        """How often each of n keys occurs in training documents."""
        held = np.repeat(self.held, self.lengths)
        train = np.concatenate([~held[self.second], ~held[self.third]])
        return np.bincount(at[train], minlength=n)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, Block]]:
    for i in range(batch.num_rows):
        block, *parts = (batch.column(c)[i].as_py() for c in ("block", "ids", "lengths", "tokens", "counts", "words"))
        yield block, Block(*parts)


def cuts(ascending: np.ndarray, buckets: int, bits: int = 64) -> np.ndarray:
    """Where each bucket's equal share of the key range begins among ascending keys, and the end."""
    edges = [np.uint64((q << bits) // buckets) for q in range(buckets)]
    return np.r_[np.searchsorted(ascending, np.array(edges, np.uint64)), len(ascending)]


_DEALT = "bucket long, block long, words binary, word_n binary, keys binary, key_n binary"


def _deal(buckets: int, bits: int):
    names = [c.split()[0] for c in _DEALT.split(", ")]
    types = [pa.int64()] * 2 + [pa.binary()] * 4

    def dealt(number: int, x: Block) -> pa.RecordBatch:
        keys, at = x.grams(bits)
        key_n = x.trained(at, len(keys)).astype(np.uint32)
        del at
        word_n = np.bincount(x.tokens[~np.repeat(x.held, x.lengths)], minlength=len(x.words)).astype(np.uint32)
        w, k = cuts(x.words, buckets), cuts(keys, buckets, bits)
        rows = [
            (
                q, number, pack_ascending(x.words[w[q] : w[q + 1]]), pack(word_n[w[q] : w[q + 1]]),
                pack_ascending(keys[k[q] : k[q + 1]]), pack(key_n[k[q] : k[q + 1]]),
            )
            for q in np.flatnonzero(np.diff(w) + np.diff(k)).tolist()
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, x in _blocks(batch):
                yield dealt(number, x)

    return read


_KNOWN = "block long, bucket long, words binary, keys binary, v long, n long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket to the totals of each block's words and keys, and, without block, the bucket's V and N."""
    names = [c.split()[0] for c in _KNOWN.split(", ")]
    types = [pa.int64()] * 2 + [pa.binary()] * 2 + [pa.int64()] * 2

    def totals(keys: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
        keys = [unpack_ascending(k) for k in keys]
        ends = np.cumsum([len(k) for k in keys])[:-1]
        joined = np.concatenate(keys)
        del keys
        order = np.argsort(joined, kind="stable")
        joined = joined[order]
        new = np.r_[True, joined[1:] != joined[:-1]] if len(joined) else np.empty(0, bool)
        del joined
        n = np.concatenate([unpack(c, np.uint32) for c in counts]).astype(np.int64)[order]
        sums = np.add.reduceat(n, np.flatnonzero(new)) if len(n) else n
        back = np.empty(len(n), np.uint32 if sums.max(initial=0) < 2**32 else np.uint64)
        back[order] = sums[np.cumsum(new) - 1] if len(n) else n
        return sums, np.split(back.astype(np.uint64), ends)

    def settled(bucket: int, parts: list[tuple]) -> pa.RecordBatch:
        block, words, word_n, keys, key_n = zip(*parts, strict=True)
        sums, own = totals(words, word_n)
        grams = totals(keys, key_n)[1]
        rows = [(b, bucket, pack(w), pack(k), None, None) for b, w, k in zip(block, own, grams, strict=True)]
        rows.append((None, bucket, None, None, int((sums > 0).sum()), int(sums.sum())))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    now, parts = None, []
    for batch in batches:
        columns = [c.split()[0] for c in _DEALT.split(", ")]
        for bucket, *part in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            if bucket != now and parts:
                yield settled(now, parts)
                parts = []
            now = bucket
            parts.append(tuple(part))
    if parts:
        yield settled(now, parts)


class Automaton:
    """The part of the automaton that a block's tokens reach, by position."""

    def __init__(self, x: Block, word_n: np.ndarray, key_n: np.ndarray, at: np.ndarray, n: int, v: int, delta: float, strength: tuple[float, float]):
        self.block, size = x, len(x.tokens)
        count = word_n[x.tokens].astype(np.float64)
        self.known = count > 0
        empty = (count + delta) / (n + delta * (v + 1))
        pair, triple = np.zeros(size), np.zeros(size)  # counts of the n-grams that end here
        pair[x.second], triple[x.third] = key_n[at[: len(x.second)]], key_n[at[len(x.second) :]]
        one, two = np.zeros(size), np.zeros(size)  # counts of the contexts of one and two tokens before
        one[x.second], two[x.third] = count[x.second - 1], pair[x.third - 1]
        #: order of the state before each token: 2 and 1 where such contexts were met in training, else 0
        self.state = np.where(two > 0, 2, np.where(one > 0, 1, 0)).astype(np.int8)
        arcs, fails, below = [np.log10(empty)], [np.zeros(size)], empty
        self.has = [np.ones(size, bool), pair > 0, triple > 0]
        for c, met, s in ((one, pair, strength[0]), (two, triple, strength[1])):
            below = np.where(c > 0, (met + s * below) / (c + s), below)
            arcs.append(np.log10(below))
            fails.append(np.log10(s / (c + s)))
        self.arcs, self.fails = arcs, fails

    def traverse(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known tokens, base weights and collected weights of each document."""
        state, weight = self.state.copy(), np.zeros(len(self.state))
        for order in (2, 1, 0):
            here = np.flatnonzero(state == order)
            takes = self.has[order][here]
            arc, fail = here[takes], here[~takes]
            weight[arc] += self.arcs[order][arc]
            weight[fail] += self.fails[order][fail]
            state[arc], state[fail] = -1, order - 1
        total = lambda y: np.add.reduceat(y, self.block.starts)
        return total(self.known.astype(np.int64)), total(self.arcs[0]), total(weight)


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(bits: int, n: int, v: int, delta: float, strength: tuple[float, float]):
    names = [c.split()[0] for c in _SCORES.split(", ")]

    def scored(x: Block, known: list[tuple]) -> pa.RecordBatch:
        word_n, key_n = (np.concatenate([unpack(k[i], np.uint64) for k in known]).astype(np.int64) for i in (0, 1))
        at = x.grams(bits)[1]
        found, base, score = Automaton(x, word_n, key_n, at, n, v, delta, strength).traverse()
        return pa.RecordBatch.from_arrays(
            [
                pa.array(x.ids, pa.int64()), pa.array(x.held), pa.array(x.lengths), pa.array(found),
                pa.array(np.full(len(x.ids), n, np.int64)), pa.array(base), pa.array(score),
            ],
            names,
        )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c, i=i, batch=batch: batch.column(c)[i].as_py()
                if get("bucket") >= 0:
                    known.append((get("words"), get("keys")))
                    continue
                if now is not None:
                    yield scored(Block(*now), known)
                now, known = tuple(map(get, ("ids", "lengths", "tokens", "counts", "words"))), []
        if now is not None:
            yield scored(Block(*now), known)

    return read


def score_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = 2_000_000,
    buckets: int | None = None, delta: float = 0.1, strength: tuple[float, float] = (50.0, 5.0),
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = renamed(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    blocks = shared_table(in_batches(docs, _encode(block_tokens), _BLOCKS))
    size = blocks.agg(F.coalesce(F.sum("size"), F.lit(0))).collect()[0][0]
    buckets = buckets or max(LEAST_BUCKETS, size // BUCKET_TOKENS)
    bits = min(64, -(-(int(size).bit_length() + 21) // 8) * 8)
    dealt = in_batches(blocks, _deal(buckets, bits), _DEALT).repartition("bucket").sortWithinPartitions("bucket")
    known = shared_table(in_batches(dealt, _count, _KNOWN))
    v, n = known.where("v is not null").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in "vn")).collect()[0]
    own = blocks.drop("size").withColumn("bucket", F.lit(-1).cast("long"))
    # the blocks' lists of words are `words` in both
    back = known.where("block is not null").select("block", "bucket", "words", "keys")
    rows = own.unionByName(back, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "bucket")
    return in_batches(rows, _score(bits, n, v, delta, strength), _SCORES)
