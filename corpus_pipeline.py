"""Training-data pipeline over documents: quality, near copies, repeated spans, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import jaccard, mixing, packing, quality, substring
from weft.llm.common import shared_table
from weft.llm.queries import TOKENIZER


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the document and host rules; null and empty texts fail, null hosts are a host."""
    return quality.quality_filter(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the smallest id; rows without id or words stay, repeated ids stay together."""
    return jaccard.one_of_each(docs)


def cut_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without words that a smaller id has in a passage of 50 words; null texts stay null, n_chars follows."""
    cut = substring.remove_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as their source is used, once at least; null sources are a source."""
    return mixing.mix_sources(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows; a null or empty text is its end id alone."""
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [
    ("quality_rules", reject_low_quality),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", cut_repeated_spans),
    ("temperature_mixing", mix_to_weights),
    ("sum_of_squares_packing", pack_sequences),
]

#: No SQL: packing depends on the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = shared_table(docs)
    return docs
