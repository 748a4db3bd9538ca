"""Marks on small pages: ties, nulls, free callouts, empty tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import drawings

_LINE = "page int, id int, text string, x0 double, y0 double, x1 double, y1 double, way int, conf double"


def test_bands_need_different_texts(spark):
    data = [(1, 1, "A", 0.0), (1, 2, "B", 3.0), (1, 3, "C", 6.0), (1, 4, "D", 20.0), (1, 5, "D", 21.0), (1, 6, "D", 22.0)]
    df = spark.createDataFrame(data, "page int, id int, text string, pos double")
    assert {r["id"] for r in drawings.bands(df, ["page"], F.lit(3.0)).collect()} == {1, 2, 3}


def test_grid_needs_both_families_and_drops_what_disagrees(spark):
    letters = [(1, i, c, 8.0, 50.0 * i, 10.0) for i, c in enumerate("ABCD")]
    numbers = [(1, 10 + i, str(i), 8.0, 5.0, 40.0 * i) for i in range(1, 5)]
    far = [(1, 20, "A", 8.0, 120.0, 11.0), (1, 21, "B'", 8.0, 54.0, 11.0), (1, 22, "9", 2.0, 5.0, 200.0), (1, 23, None, 8.0, 0.0, 0.0)]
    alone = [(2, i, c, 8.0, 50.0 * i, 10.0) for i, c in enumerate("ABCD")]
    df = spark.createDataFrame(letters + numbers + far + alone, "page int, id int, text string, size double, x double, y double")
    found = {(r["axis"], r["label"]): r["position"] for r in drawings.grid_axes(df).collect()}
    assert found == {("vertical", "B"): 52.0, ("vertical", "C"): 100.0, ("vertical", "D"): 150.0} | {("horizontal", str(i)): 40.0 * i for i in range(1, 5)}
    assert not drawings.grid_axes(df.where("false")).count()


def test_owner_is_near_or_heads_the_band(spark):
    labels = [(1, i, c, 100.0 * i, 0.0, 10.0) for i, c in enumerate("ABC")] + [(1, 9, "Z", 210.0, 330.0, 10.0), (1, 10, None, 0.0, 0.0, 1.0)]
    bars = [(1, 1, 105.0, 60.0), (1, 2, 200.0, 320.0), (1, 3, 900.0, 900.0), (2, 4, 0.0, 0.0), (1, 5, None, 0.0)]
    found = drawings.owners(
        spark.createDataFrame(bars, "page int, id int, x double, y double"),
        spark.createDataFrame(labels, "page int, id int, text string, x double, y double, height double"), 40.0,
    ).collect()
    assert {r["id"]: (r["label"], round(r["cost"], 6)) for r in found} == {1: (1, 5 + 0.35 * 60), 2: (9, round((36 + 100) ** 0.5, 6))}


def test_spacing_takes_the_nearest_free_callout(spark):
    lines = [
        (1, 1, "8-15M", 0.0, 0.0, 50.0, 10.0, 0, 0.9), (1, 2, "@300", 0.0, 12.0, 30.0, 22.0, 0, 0.5), (1, 3, "@200", 20.0, 13.0, 60.0, 23.0, 0, 0.8),
        (1, 4, "4-10M", 0.0, 100.0, 10.0, 150.0, -1, 1.0), (1, 5, "12@100", -14.0, 100.0, -4.0, 140.0, -1, None), (1, 6, "title", 0.0, 0.0, 50.0, 10.0, 0, 1.0),
        (None, 7, "@300", 0.0, 12.0, 30.0, 22.0, 0, 0.5), (1, 8, None, 0.0, 12.0, 30.0, 22.0, 0, 0.5),
    ]
    df = spark.createDataFrame(lines, _LINE)
    found = {r["id"]: (r["text"], r["conf"]) for r in drawings.with_spacings(df, F.col("text").rlike("M$")).collect()}
    assert len(found) == 8 and found[1] == ("8-15M @300", 0.5)  # the second spacing finds it taken
    assert found[4] == ("4-10M 12@100", 1.0) and found[3] == ("@200", 0.8) and found[8] == (None, 0.5)
    assert not drawings.with_spacings(df.where("false"), F.lit(True)).count()


def test_cells_ties_and_edges(spark):
    runs = [(1, 1, 16.0, 10.0), (1, 2, 15.9, 10.0), (1, 3, 86.0, 10.0), (1, 4, 85.9, 24.0), (1, 5, 3.0, 0.0), (1, 6, 50.0, 60.0), (2, 7, 50.0, 0.0)]
    rows = spark.createDataFrame([(1, "a", 0.0), (1, "b", 20.0), (1, None, 10.0)], "page int, row string, y double")
    heads = spark.createDataFrame([(1, "p", 16.0), (1, "q", 100.0)], "page int, head string, x double")
    found = drawings.table_cells(spark.createDataFrame(runs, "page int, id int, x double, y double"), rows, heads).collect()
    assert {r["id"]: (r["row"], r["head"]) for r in found} == {1: ("a", "p"), 2: ("a", "p"), 3: ("a", "q"), 4: ("b", "p")}
