"""URL filter over a sorted digest array.

Rules are kept in one file: ascending 64-bit xxhash keys of the rule strings, string offsets, verdicts and the strings
themselves. Workers memory-map that file, probe whole batches of candidate strings by binary search, and compare the
stored strings of equal keys, so that hash collisions can't decide. The file reaches executors through addFile, so an
executor that is started later gets it too; it is mapped, not loaded, so its size is bounded by local disk alone.

A rule is host + path (``example.net/en/``; a rule without ``/`` has an empty path). It fits its host and all
subdomains if the url's path starts with the rule's. The longest rule wins; of rules of equal length the one with the
longer host. A rule listed as both allow and block blocks. Without a fitting rule the verdict is allow.

Defined results: null or no ``://``: empty host and path, which no rule fits; repeated rows are judged alike; an empty
table gives no rows; other columns are kept. Columns named host, path, rule or verdict are replaced.
"""

from __future__ import annotations

import hashlib
import os
import tempfile

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_OPEN: dict[str, RuleIndex] = {}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    slash = rest.find("/", 0, end)
    slash = end if slash < 0 else slash
    return rest[:slash].translate(_LOWER), rest[slash:end]


class RuleIndex:
    """The memory-mapped file."""

    @staticmethod
    def write(rules: dict[str, str], path: str) -> None:
        names = sorted(rules, key=lambda r: (xxhash.xxh64_intdigest(r), r))
        blobs = [r.encode() for r in names]
        with open(path, "wb") as f:
            f.write(np.array([len(names)], "<u8").tobytes())
            f.write(np.array([xxhash.xxh64_intdigest(r) for r in names], "<u8").tobytes())
            f.write(np.cumsum([0, *map(len, blobs)]).astype("<u8").tobytes())
            f.write(bytes(rules[r] == "block" for r in names))
            f.write(b"".join(blobs))

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        n = int(data[:8].view("<u8")[0])
        self.keys = data[8 : 8 + 8 * n].view("<u8")
        self.offsets = data[8 + 8 * n : 16 + 16 * n].view("<u8")
        self.block = data[16 + 16 * n : 16 + 17 * n]
        self.blob = data[16 + 17 * n :]

    def probe(self, strings: list[str]) -> list[int]:
        """Position of each string, or -1."""
        hashes = np.array([xxhash.xxh64_intdigest(s) for s in strings], "<u8")
        low, high = (np.searchsorted(self.keys, hashes, side) for side in ("left", "right"))
        found = [-1] * len(strings)
        for i in np.flatnonzero(low < high):
            own = strings[i].encode()
            for j in range(low[i], high[i]):
                if self.blob[self.offsets[j] : self.offsets[j + 1]].tobytes() == own:
                    found[i] = j
        return found


def judge_urls(df: DataFrame, rules: dict[str, str], url_col: str = "url") -> DataFrame:
    """df with host, path, rule (null if none fits) and verdict. rules: rule string to allow or block."""
    if bad := [v for v in rules.values() if v not in ("allow", "block")]:
        raise ValueError(f"unknown verdict {bad[0]!r}")
    lengths = sorted({len(r) - len(r.partition("/")[0]) for r in rules})
    digest = hashlib.sha256(repr(sorted(rules.items())).encode()).hexdigest()[:24]
    name = f"weft-rules-{digest}.bin"
    path = os.path.join(tempfile.gettempdir(), name)
    RuleIndex.write(rules, f"{path}.{os.getpid()}")
    os.replace(f"{path}.{os.getpid()}", path)
    df.sparkSession.sparkContext.addFile(os.path.abspath(path))

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def verdicts(urls: pd.Series) -> pd.DataFrame:
        if name not in _OPEN:
            _OPEN[name] = RuleIndex(SparkFiles.get(name))
        index = _OPEN[name]
        parts = [split_url(u) for u in urls]
        owner, size, keys = [], [], []
        for i, (host, path) in enumerate(parts):
            suffix = host
            while suffix:
                for n in lengths:
                    if n <= len(path):
                        owner.append(i)
                        size.append((len(suffix) + n, len(suffix)))
                        keys.append(suffix + path[:n])
                suffix = suffix.partition(".")[2]
        best: dict[int, tuple] = {}
        for i, s, key, j in zip(owner, size, keys, index.probe(keys), strict=True):
            if j >= 0 and (i not in best or s > best[i][0]):
                best[i] = (s, key, "block" if index.block[j] else "allow")
        none = (None, None, "allow")
        return pd.DataFrame(
            [(*p, *best.get(i, none)[1:]) for i, p in enumerate(parts)], columns=["host", "path", "rule", "verdict"]
        )

    kept = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    judged = df.select(*[F.col(f"`{c}`") for c in kept], verdicts(F.col(f"`{url_col}`")).alias("_weft_judged"))
    return judged.select(*[F.col(f"`{c}`") for c in kept], "_weft_judged.*")
