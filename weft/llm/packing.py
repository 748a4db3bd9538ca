"""Packing token sequences into windows by the sum-of-squares rule.

Each document's tokens (ids and an end id) fill whole windows first; its rest is placed online: of all fill levels that
have a partly filled window and room, and a new window, it goes where the sum of squared counts of partly filled
windows by level grows least. The counts are one array of `size` levels. When a task's rows end, or when it holds
`max_open` open windows, the fullest open windows are topped up with pieces cut from the emptiest, and a last
remainder is cut into sequences of power-of-two lengths, which need no padding. Tasks pack their own rows: there is
no shuffle, and a task holds the ids of its open windows alone.

Defined results: a null or empty text is the end id alone; a null id is carried; repeated rows are packed each; an
empty table gives no rows; other columns are ignored. Sequence ids are unique, not dense.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import renamed, slices

_OTHER_SPACE = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_DOUBLE = ("  ", "\n\n", " \n", "\n ")
_CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s")
_UNLIKE = re.compile(r"[\x1c-\x1f]")  # white space to Python, not to the tokenizer


class _Memo(dict):
    def __init__(self, short):
        super().__init__()
        self.short = short

    def __missing__(self, chunk: str) -> bytes:
        self[chunk] = ids = array("I", self.short(chunk)).tobytes()
        return ids


class Encoder:
    """Ids of texts as little-endian 32-bit bytes, from remembered ids of their space-separated chunks.

    A byte-level BPE of this family never merges across a blank before a word, so a text's ids are its chunks' ids.
    """

    def __init__(self, path: str, limit: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo = _Memo(self._same_merges(path))
        self.limit = limit

    def _same_merges(self, path: str):
        """The same vocabulary in tiktoken, quick on short strings, if its merges are in the order of their ids."""
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], model["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        if any(vocab.get(x + y) != 256 + i for i, (x, y) in enumerate(pairs)):
            return lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        # byte-level vocabularies write printable bytes as themselves, others as code points from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [x for x in range(256) if x not in plain]
        byte = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(others)}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if i < 256 + len(pairs)}
        encoding = tiktoken.Encoding(
            path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        return encoding.encode_ordinary

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def chunks(self, text: str) -> list[str] | None:
        if any(s in text for s in self.special):
            return None
        ends = text[:1] + text[-1:]
        if " " not in ends and "\n" not in ends and not any(d in text for d in _DOUBLE) and not _OTHER_SPACE.search(text):
            parts = text.replace("\n", " \n").split(" ")
            return [parts[0], *[p if p[0] == "\n" else " " + p for p in parts[1:]]] if text else []
        return None if _UNLIKE.search(text) else _CHUNK.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.memo) > self.limit:
            self.memo.clear()
        parts = [self.chunks(t) for t in texts]
        apart = iter(self.whole([t for t, ps in zip(texts, parts, strict=True) if ps is None]))
        get = self.memo.__getitem__
        return [next(apart) if ps is None else b"".join(map(get, ps)) for ps in parts]


class Packer:
    """A piece is (document, start, ids); pieces of closed sequences are given to emit."""

    def __init__(self, size: int, emit, max_open: int = 4096):
        self.size, self.emit, self.max_open = size, emit, max_open
        self.level = np.zeros(size + 1, np.int64)  # partly filled windows by fill
        self.open: dict[int, list[list]] = {}

    def add(self, doc, ids: bytes) -> None:
        n, size = len(ids) // 4, self.size
        for start in range(0, n - size + 1, size):
            self.emit([(doc, start, ids[4 * start : 4 * (start + size)])])
        if rest := n % size:
            self.place((doc, n - rest, ids[4 * (n - rest) :]), rest)

    def place(self, piece: tuple, s: int) -> None:
        count, size = self.level, self.size
        before, after = count[1 : size - s + 1], count[1 + s : size + 1]
        grow = 2 * (after - before) + 2
        if len(grow):
            grow[-1] = 1 - 2 * before[-1]  # a full window is no partly filled one
        grow = np.where(before > 0, grow, np.iinfo(np.int64).max)
        best = len(grow) - int(np.argmin(grow[::-1])) if len(grow) else 0  # ties: the fullest
        if not best or grow[best - 1] >= 2 * count[s] + 1:
            self.put(s, [piece])
            if int(count.sum()) > self.max_open:
                self.top_up(self.max_open // 2)
            return
        self.put(best + s, [*self.take(best), piece])

    def take(self, level: int) -> list:
        self.level[level] -= 1
        return self.open[level].pop()

    def put(self, level: int, pieces: list) -> None:
        if level == self.size:
            self.emit(pieces)
            return
        self.level[level] += 1
        self.open.setdefault(level, []).append(pieces)

    def top_up(self, most: int) -> None:
        """Fills the fullest open windows from the emptiest until at most `most` are open."""
        fills = [(f, p) for f in range(1, self.size) for p in self.open.get(f, [])]
        self.open, low, high = {}, 0, len(fills) - 1
        while high - low + 1 > most and low < high:
            f, pieces = fills[high]
            g, donor = fills[low]
            doc, start, ids = donor.pop()
            cut = min(self.size - f, len(ids) // 4)
            left = len(ids) // 4 - cut
            pieces = [*pieces, (doc, start + left, ids[4 * left :])]
            if left:
                donor.append((doc, start, ids[: 4 * left]))
            fills[low], fills[high] = (g - cut, donor), (f + cut, pieces)
            low += not donor
            if f + cut == self.size:
                self.emit(pieces)
                high -= 1
        self.level[:] = 0
        for f, pieces in fills[low : high + 1]:
            self.put(f, pieces)

    def finish(self) -> None:
        self.top_up(1)
        for f in list(self.open):
            for pieces in self.open.pop(f):
                for bit in range(f.bit_length() - 1, -1, -1):
                    if f >> bit & 1:
                        self.emit(self.cut(pieces, 1 << bit))

    @staticmethod
    def cut(pieces: list, n: int) -> list:
        out = []
        while n:
            doc, start, ids = pieces.pop(0)
            m = min(n, len(ids) // 4)
            out.append((doc, start, ids[: 4 * m]))
            if 4 * m < len(ids):
                pieces.insert(0, (doc, start + m, ids[4 * m :]))
            n -= m
        return out


def pack_documents(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 1
) -> DataFrame:
    """One row per piece. tokenizer: name for public_tokenizers.path, or a path that all executors can open."""
    docs = renamed(docs, doc_id=id_col, text=text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    end = np.array([end_id], "<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer
        if not os.path.exists(path):
            import public_tokenizers

            path = public_tokenizers.path(tokenizer)
        encoder, rows, next_id = Encoder(path), [], TaskContext.get().partitionId() << 36

        def emit(pieces: list) -> None:
            nonlocal next_id
            offset = 0
            for (doc, total), start, ids in pieces:
                n = len(ids) // 4
                rows.append((doc, start, n, zlib.crc32(ids), total, next_id, offset))
                offset += n
            next_id += 1

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            rows.clear()
            types = [id_type, *[pa.int64()] * 6]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        packer, id_type = Packer(size, emit), pa.int64()
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for part in slices(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                for doc, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                    packer.add((doc, len(ids) // 4 + 1), ids + end)
                if len(rows) >= 4096:
                    yield flushed()
        packer.finish()
        if rows:
            yield flushed()

    return docs.mapInArrow(pack, schema)
