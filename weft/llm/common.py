"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

from ..tables import forget, shared_table  # noqa: F401  the operators take them from here

#: A side of a join is broadcast when it has at most this many narrow rows; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Odd multiplier of the rolling hash; 5 modulo 8, so that powers differ in all but a few low bits.
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 2**64)


def in_batches(df: DataFrame, read: Callable[[Iterator], Iterator], schema: str, size: str = "4m") -> DataFrame:
    """df.mapInArrow(read) over batches of bounded bytes; a worker gives free memory back when its partition ends."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from read(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Returns this process' free memory to the system."""
    pa.default_memory_pool().release_unused()
    if hasattr(ctypes.CDLL(None), "malloc_trim"):
        ctypes.CDLL(None).malloc_trim(0)


def small_side(df: DataFrame) -> DataFrame:
    """Marks df for broadcast if its rows, counted here, are few enough."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


class WordHashes(dict):
    """Word bytes to 8-byte digest; remembers a bounded number of words."""

    def __init__(self, limit: int = 100_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> bytes:
        digest = xxhash.xxh3_64_digest(word)
        if len(self) < self.limit:
            self[word] = digest
        return digest

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, words)), "<u8")


class Rolling:
    """Hashes of all windows of k consecutive word hashes, modulo 2**64."""

    def __init__(self):
        self.grow(4096)

    def grow(self, n: int) -> None:
        self.up = np.cumprod(np.r_[np.uint64(1), np.full(n, BASE, np.uint64)], dtype=np.uint64)
        self.down = np.cumprod(np.r_[np.uint64(1), np.full(n, _INVERSE, np.uint64)], dtype=np.uint64)

    def windows(self, h: np.ndarray, k: int) -> np.ndarray:
        n = len(h) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        if len(h) >= len(self.up):
            self.grow(2 * len(h))
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * self.up[: len(h)], out=total[1:])
        return mixed((total[k:] - total[:-k]) * self.down[:n])


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the entropy of 64-bit values over all their bits (a bijection)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def slices(batch: pa.RecordBatch, rows: int = 256, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A record batch in slices of at most so many rows and bytes of text (or one row), so that few texts are objects."""
    lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    i = 0
    while i < batch.num_rows:
        room = int(ends[i] - lengths[i]) + size
        j = max(i + 1, min(i + rows, int(np.searchsorted(ends, room, "right"))))
        yield batch.slice(i, j - i)
        i = j


def renamed(df: DataFrame, **columns: str) -> DataFrame:
    """Only the columns asked for, under fixed names; other columns can't clash."""
    from pyspark.sql import functions as F

    return df.select(*[F.col(f"`{c}`").alias(name) for name, c in columns.items()])
