"""Edge cases on small frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import text
from weft.operators import panel, records, stats
from weft.sources import io
from weft.streaming import jobs


def test_weighted_percentile_is_a_step(spark):
    df = spark.createDataFrame([("a", 99.0, 0.0), ("a", 10.0, 1.0), ("a", -99.0, 0.0), ("a", 20.0, 3.0)], "k string, v double, w double")
    at = lambda p: panel.weighted_percentile(df, ["k"], "v", "w", p).collect()[0]["value"]
    assert [at(0.0), at(0.5), at(1.0)] == [10.0, 20.0, 20.0]


def test_pair_bounds_are_invalid(spark):
    flags = panel.pair_flags()
    df = spark.createDataFrame([(0.5,), (2.5,), (1.0,), (None,)], "gap_years double").withColumns(flags)
    rows = {r["gap_years"]: (r["is_first"], r["too_close"], r["too_far"]) for r in df.collect()}
    assert rows == {0.5: (False, True, False), 2.5: (False, False, True), 1.0: (False,) * 3, None: (True, False, False)}


def test_growth_needs_positive_levels(spark):
    df = spark.createDataFrame([(0.0, 1.0, 1.0), (110.0, 100.0, 1.0), (110.0, -1.0, 1.0)], "a double, b double, g double")
    got = [r[0] for r in df.select(F.round(panel.annualised_growth(F.col("a"), F.col("b"), F.col("g")), 6)).collect()]
    assert got == [None, 10.0, None]


def test_suppression_hides_small_cells(spark):
    df = spark.createDataFrame([(4, 10), (0, 10), (5, 10), (1, 4)], "n long, d long")
    cols = stats.suppressed_rate(F.col("n"), F.col("d"))
    got = [tuple(r) for r in df.select(cols["num"], cols["den"], cols["suppressed"]).collect()]
    assert got == [(None, 10, True), (0, 10, False), (5, 10, False), (None, None, True)]


def test_fusion_keeps_two_shots(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 100.0), (2, 1.0), (2, 1.1), (2, 9.0)], "k int, v double")
    got = {r["k"]: (r["fused"], r["used"]) for r in stats.robust_fusion(df, ["k"], "v", 0.3, 2.5).collect()}
    assert got[1] == (50.0, 2) and got[2][1] == 2


def test_second_delivery_changes_nothing(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, None)], "k int, seq int, v string")
    got = {r["k"]: r["v"] for r in records.upsert_once(df, ["k"], ["seq"]).collect()}
    assert got == {1: "a", 2: None}


def test_text_functions(spark):
    df = spark.createDataFrame([(" ab--12/c ", "Élan vital!", 0.94)], "c string, t string, p double")
    row = df.select(text.norm_code(F.col("c")), text.slug(F.col("t")), text.status_of(F.col("p"), 0.35, 0.95)).collect()[0]
    assert tuple(row) == ("AB-12-C", "elan-vital", "review")


def test_canonical_text_has_no_length_limit(spark, tmp_path):
    from weft import registry

    spark.createDataFrame([(1, "x" * 300 + "ÉTÉ", "a")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["text_canonical"](spark, str(tmp_path)).collect()
    assert [r["plain"] for r in got] == ["x" * 300 + "ete"]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "x", y\nz', "2024-02-29"), (2, None, "2024-02-31")], "id int, t string, d string")
    io.write_csv(df, str(tmp_path / "out"))
    got = io.read_csv(spark, str(tmp_path / "out"), "id int, t string, d string", {"t": "words"}, ("d",))
    rows = {r["id"]: (r["words"], str(r["d"])) for r in got.collect()}
    assert rows == {1: ('say "x", y\nz', "2024-02-29"), 2: (None, "None")}


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "event_type", "value")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    counted = jobs.tumbling_counts(stream, "ts", "1 hour", "event_type")
    job = counted.writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    job.awaitTermination()
    key = lambda df: sorted((str(r["start"]), r["event_type"], r["n"]) for r in df.collect())
    assert key(spark.table("tumbled")) == key(jobs.tumbling_counts(events, "ts", "1 hour", "event_type"))
