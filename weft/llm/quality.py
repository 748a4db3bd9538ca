"""Quality rules for documents and for the hosts they come from.

Each text is measured and held against document rules (`RULES`). Base rules reject a document by themselves; the failures
of every rule are counted by host (the column `source` here). A host's failure rate under a rule is shrunk towards an
empirical beta prior, fitted to all hosts by the method of moments (mean m over documents, strength by the variance of
the hosts' rates). A host is rejected with all its documents if, under any rule, its posterior mean less `sure` posterior
standard deviations is above both `multiple` times m and `least`: so it fails far more often than others, in most of
its documents, and has enough documents to say so. Counts are partial sums before the shuffle, so a host with a third
of all rows costs no task more than another.

Defined results: a null text has no words (and so fails); a null host counts as a host of its own; repeated rows count
each; fewer than two hosts, or rates that don't vary, give a prior of one pseudo-document at the mean rate; an empty
table gives no rows; other columns are kept (names with `_weft_` are reserved).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Rolling, WordHashes, give_back, shared_table

SPACE, SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes], hashes: np.ndarray, rolling: Rolling, k: int) -> int:
    """Words in k-word windows found twice or more."""
    windows = rolling.windows(hashes, k)
    if len(windows) < 2 or len(np.unique(windows)) == len(windows):
        return 0  # equal windows have equal hashes, so none repeat
    number: dict[bytes, int] = {}
    name = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    ids = np.zeros(len(windows), np.int64)
    for i in range(k):  # exact names of windows, word by word
        ids = np.unique(ids * len(number) + name[i : i + len(ids)], return_inverse=True)[1]
    covered = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(np.bincount(ids)[ids] > 1)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + k, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def measure(text: str | None, memo: WordHashes, rolling: Rolling) -> tuple[int, ...]:
    data = (text or "").encode()
    words = data.split()
    if not words:
        return 0, 0, len(data) - len(data.translate(None, SYMBOLS)), 0, 0
    chars = len(text) - (len(data) - len(data.translate(None, SPACE)))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    repeats = repeated_words(words, memo.of(words), rolling, 8)
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeats


def measures(text: Column) -> Column:
    @F.arrow_udf(", ".join(f"{c} long" for c in COUNTS))
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo, rolling = WordHashes(), Rolling()
        try:
            for texts in batches:
                rows = np.array([measure(t.as_py(), memo, rolling) for t in texts], np.int64).reshape(-1, len(COUNTS))
                yield pa.StructArray.from_arrays([pa.array(c) for c in rows.T.copy()], list(COUNTS))
        finally:
            give_back()

    return of(text)


def rules(counts: str = "") -> dict[str, Column]:
    """Failed document rules by name; `counts` is the prefix of the columns of counts."""
    c = {name: F.col(f"{counts}{name}") for name in COUNTS}
    return {
        "short": c["n_words"] < 20,
        "repeats": 100 * c["n_repeat_words"] > 30 * c["n_words"],
        "symbols": c["n_symbols"] > 4 * c["n_words"],
        "lines": 5 * c["n_dup_lines"] > c["n_words"],
        "lengths": (c["word_chars"] < 2 * c["n_words"]) | (c["word_chars"] > 20 * c["n_words"]),
    }


#: Rules by which a document is rejected itself; the others count against its host only.
BASE = ("short", "repeats")
RULES = ("short", "repeats", "symbols", "lines", "lengths")


def document_rules(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with the struct `_weft_rules` of the counts, `base_failed` and a boolean `failed_` for each rule."""
    m = df.withColumn("_weft_counts", measures(F.col(f"`{text_col}`")))
    failed = rules("_weft_counts.")
    flags = [failed[r].alias(f"failed_{r}") for r in RULES]
    base = (failed[BASE[0]] | failed[BASE[1]]).alias("base_failed")
    return m.withColumn("_weft_rules", F.struct("_weft_counts.*", base, *flags)).drop("_weft_counts")


def host_rates(judged: DataFrame, prior_floor: float = 1.0) -> DataFrame:
    """host, rule, docs, failed, mean (of the prior), rate (posterior mean), sd; judged: host, failed_ of each rule."""
    sums = [F.sum(F.col(f"failed_{r}").cast("long")).alias(r) for r in RULES]
    hosts = judged.groupBy("host").agg(F.count(F.lit(1)).alias("docs"), *sums)
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("failed")) for r in RULES]))
    hosts = shared_table(hosts.select("host", "docs", pairs.alias("r")).select("host", "docs", "r.*"))
    raw = F.col("failed") / F.col("docs")
    moments = hosts.groupBy("rule").agg(
        (F.sum("failed") / F.sum("docs")).alias("mean"), F.avg(raw).alias("mid"), F.var_samp(raw).alias("var")
    )
    # beta moments: strength = m (1 - m) / var - 1
    strength = F.when(F.col("var") > 0, F.col("mid") * (1 - F.col("mid")) / F.col("var") - 1)
    strength = F.greatest(F.lit(prior_floor), F.coalesce(strength, F.lit(prior_floor)))
    prior = F.broadcast(moments.select("rule", "mean", strength.alias("strength")))  # one row a rule
    rate = (F.col("failed") + F.col("mean") * F.col("strength")) / (F.col("docs") + F.col("strength"))
    spread = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("docs") + F.col("strength") + 1))
    return hosts.join(prior, "rule").withColumn("rate", rate).withColumn("sd", spread)


def rejected_hosts(judged: DataFrame, multiple: float, least: float, sure: float) -> DataFrame:
    """_weft_host: the hosts that are rejected, each once; written, so that joins with it can split a hot host."""
    bad = F.col("rate") - sure * F.col("sd") > F.greatest(multiple * F.col("mean"), F.lit(least))
    return shared_table(host_rates(judged).where(bad).select(F.col("host").alias("_weft_host")).distinct())


def quality_table(
    df: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", multiple: float = 3.0,
    least: float = 0.5, sure: float = 2.0,
) -> DataFrame:
    """id, the counts, base_failed, kept; texts are measured once."""
    named = df.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{host_col}`").alias("host"), F.col(f"`{text_col}`").alias("text")
    )
    m = shared_table(document_rules(named).select("id", "host", "_weft_rules.*"))
    bad = rejected_hosts(m, multiple, least, sure).withColumn("_weft_hit", F.lit(True))
    kept = ~F.col("base_failed") & F.col("_weft_hit").isNull()
    out = m.join(bad, m["host"].eqNullSafe(bad["_weft_host"]), "left")
    return out.select(F.col("id").alias(id_col), *COUNTS, "base_failed", kept.alias("kept"))


def quality_filter(
    df: DataFrame, host_col: str = "source", text_col: str = "text", multiple: float = 3.0, least: float = 0.5,
    sure: float = 2.0,
) -> DataFrame:
    """The rows of df that pass, with df's columns; texts are measured once, with the rows written beside their rules."""
    judged = shared_table(document_rules(df, text_col))
    host = F.col(f"`{host_col}`")
    flags = [F.col(f"_weft_rules.failed_{r}") for r in RULES]
    bad = rejected_hosts(judged.select(host.alias("host"), *flags), multiple, least, sure)
    kept = judged.where(~F.col("_weft_rules.base_failed"))
    return kept.join(bad, host.eqNullSafe(bad["_weft_host"]), "left_anti").drop("_weft_rules")
