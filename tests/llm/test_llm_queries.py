"""The registered queries against their SQL, and the pipeline's stages."""

from __future__ import annotations

import pytest
from compare import differences, duck

import corpus_pipeline
from weft.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    got = queries.queries()[name](spark, SF).toPandas()
    assert not differences(got, duck(SF).execute(queries.oracle_sql()[name]).fetchdf())


def test_pipeline_keeps_what_it_should(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert now <= ids and (now == ids or name in ("quality_rules", "ngram_jaccard_join"))
        ids = now
    assert 0 < len(ids) < n
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == ids
