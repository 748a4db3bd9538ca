"""Mixing sources to target weights by temperature, with DataFrame and SQL functions only.

Source s has the token share p_s; its weight is p_s ** a / sum p ** a. The exponent a in [0, 1] is bisected: the
smallest a (flattest mix) at which no source has to be repeated more than `max_repeats` times as often as the least
repeated one, or, with `target_entropy` (a share of ln(sources)), the a whose mix has that entropy if that is larger.
The budget is the least number of tokens at which every source is used once at least, so a document of the input is
never dropped: source s is used r_s = budget * w_s / tokens_s times, 1 <= r_s <= max_repeats.

Weights become documents as budgeted block permutations. A source's documents are dealt to blocks of about
`block_docs` rows by hash. A block has a budget of r_s times its tokens: floor(r_s) whole rounds, then documents in the
block's order (a permutation by hash, another for each seed) while the remaining budget covers at least half of the
document. Blocks bound each window, also for a source with a third of all rows.

Defined results: null texts have no words; documents without words are used once; a null source is a source; repeated
rows count each; an empty table gives no rows; columns of the input are kept, whatever their names (names that
start with `_weft_` are reserved).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, shared_table

WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_weights(
    counted: DataFrame, max_repeats: float, target_entropy: float | None = None, steps: int = 60
) -> DataFrame:
    """source, docs, tokens, weight, repeats from rows of source, tokens."""
    sources = counted.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"))
    sources = shared_table(sources)  # read twice; texts are counted once
    # the bisection sees only the numbers of tokens by source: two columns of one row
    total = sources.where(F.col("tokens") > 0).agg(F.collect_list(F.col("tokens").cast("double")).alias("all"))
    total = total.withColumn("shares", F.transform("all", lambda t: t / F.aggregate("all", F.lit(0.0), _add)))

    def entropy(a: Column) -> Column:
        z = F.aggregate("shares", F.lit(0.0), lambda s, p: s + F.pow(p, a))
        return F.aggregate("shares", F.lit(0.0), lambda s, p: s - F.pow(p, a) / z * F.ln(F.pow(p, a) / z))

    def too_flat(a: Column) -> Column:
        ratio = F.pow(F.array_max("shares") / F.array_min("shares"), F.lit(1.0) - a)
        flat = ratio > max_repeats
        if target_entropy is not None:
            flat = flat | (entropy(a) > target_entropy * F.ln(F.size("shares").cast("double")))
        return flat

    def halve(range_: Column, _: Column) -> Column:
        mid = (range_["low"] + range_["high"]) / 2
        flat = too_flat(mid)
        return F.struct(
            F.when(flat, mid).otherwise(range_["low"]).alias("low"),
            F.when(flat, range_["high"]).otherwise(mid).alias("high"),
        )

    start = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve)["high"]
    total = total.select(
        F.aggregate("all", F.lit(0.0), _add).alias("sum"), F.array_max("shares").alias("most"),
        F.when(too_flat(F.lit(0.0)), found).otherwise(F.lit(0.0)).alias("a"), "shares",
    ).withColumn("z", F.aggregate("shares", F.lit(0.0), lambda s, p: s + F.pow(p, F.col("a")))).drop("shares")
    row = total.collect()  # one row of four numbers
    whole, most, a, z = (row[0]["sum"], row[0]["most"], row[0]["a"], row[0]["z"]) if row else (None,) * 4
    share = F.col("tokens") / F.lit(whole)
    # budget = max tokens_s / w_s, reached by the largest share as a <= 1
    weight = F.when(F.col("tokens") > 0, F.pow(share, F.lit(a)) / F.lit(z)).otherwise(0.0)
    repeats = F.when(F.col("tokens") > 0, F.pow(share / F.lit(most), F.lit(a) - 1.0)).otherwise(1.0)
    return sources.withColumn("weight", weight).withColumn("repeats", F.greatest(repeats, F.lit(1.0)))


def _add(s: Column, x: Column) -> Column:
    return s + x


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    max_repeats: float = 2.0, target_entropy: float | None = None, block_docs: int = 2048, seed: int = 17,
    keep_text: bool = True,
) -> DataFrame:
    """docs once for each use, with _weft_source, _weft_tokens, _weft_block, _weft_rank and _weft_round (from 0)."""
    source, text = F.col(f"`{source_col}`"), F.col(f"`{text_col}`")
    tokens = words_of(text)
    weights = shared_table(source_weights(docs.select(source.alias("source"), tokens.alias("tokens")), max_repeats, target_entropy))
    dealt = F.greatest(F.lit(1), F.ceil(F.col("docs") / block_docs)).cast("long")
    weights = weights.select(F.col("source").alias("_weft_key"), F.col("repeats").alias("_weft_repeats"), dealt.alias("_weft_blocks"))
    if weights.count() <= BROADCAST_ROWS:
        weights = F.broadcast(weights)
    kept = docs if keep_text else docs.select(F.col(f"`{id_col}`"), source, F.length(text).alias("_weft_chars"), text)
    rows = kept.withColumn("_weft_tokens", tokens)
    if not keep_text:
        rows = rows.drop(text_col)
    rows = rows.join(weights, source.eqNullSafe(F.col("_weft_key")), "inner")
    rows = rows.withColumn("_weft_block", F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.lit(seed)), F.col("_weft_blocks")))
    ident = [F.xxhash64(F.lit(seed + 1), F.col(f"`{id_col}`")), F.col(f"`{id_col}`"), F.col("_weft_tokens")]
    order = Window.partitionBy(source, "_weft_block").orderBy(*ident)
    block = Window.partitionBy(source, "_weft_block")
    spent = F.sum("_weft_tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    part = F.col("_weft_repeats") - F.floor("_weft_repeats")
    rows = rows.withColumn("_weft_rank", F.row_number().over(order).cast("long"))
    extra = (spent - F.col("_weft_tokens") / 2 <= part * F.sum("_weft_tokens").over(block)) & (F.col("_weft_tokens") > 0)
    rounds = F.when(F.col("_weft_tokens") > 0, F.floor("_weft_repeats") + (extra & (part > 0)).cast("long")).otherwise(F.lit(1))
    rows = rows.withColumn("_weft_rounds", rounds.cast("int"))
    rows = rows.withColumn("_weft_round", F.explode(F.sequence(F.lit(0), F.col("_weft_rounds") - 1)))
    return rows.withColumn("_weft_source", source).drop("_weft_key", "_weft_repeats", "_weft_blocks", "_weft_rounds", "_weft_chars")
