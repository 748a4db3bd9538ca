"""Operators without SQL against brute force, and edge cases of joins and sources."""

from __future__ import annotations

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.functions import rules as R
from weft.operators import estimates, linking, memory, models, panel
from weft.plans import linking as queries
from weft.sources import io

SF = "/root/testdata/sf0.001"


def test_codes_equal_a_scan_of_the_registry(spark):
    rnd = random.Random(3)
    registry = list({"AB-" + "".join(rnd.choice("0157O8BS") for _ in range(5)): rnd.randrange(3) for _ in range(60)}.items())
    codes = [(c.replace("0", "O")[: rnd.choice([7, 8, 8])], rnd.choice([None, 0, 1, 2])) for c, _ in registry[:25]] + [("ZZZZZZZZ", 1)]
    codes = list(dict(codes).items())
    df = lambda rows: spark.createDataFrame(rows, "code string, fact int")
    got = {r["code"]: (r["first"], r["second"], r["question"]) for r in linking.linked_codes(df(codes), df(registry), ["fact"]).collect()}
    for code, fact in codes:
        found = []
        for name, theirs in registry:
            cost = linking.reading_cost(code, name)
            if cost <= 2:
                agree, clash = (fact is not None and fact == theirs), (fact is not None and fact != theirs)
                found.append((round(-(0.8 * agree - clash - cost), 6), name, cost, clash))
        best = sorted(found)[:2]
        alone = len(best) == 1 or best[1][0] - best[0][0] > 1 if best else False
        kind = "NO_MATCH" if not best else "CONFIRM" if best[0][2] == 0 and not best[0][3] and alone else "CHOOSE"
        assert got[code] == (*[b[1] for b in best], *[None] * (2 - len(best)), kind), code
    assert linking.reading_cost("5A", "SB") == 1.4 and linking.reading_cost("", "AB") == 2
    near = linking.near_codes(df([("X", 1), (None, 1)]), df([("Y", 1), (None, 2)]).toDF("name", "f"), "code", "name", 1)
    assert [tuple(r) for r in near.collect()] == [("X", "Y", 1)]


def test_boxes_equal_brute_force(spark):
    boxes = [tuple(r) for r in queries._boxes(spark, SF).select("page", "id", "x0", "y0", "x1", "y1", "text").collect()]
    kept = []
    for b in sorted(boxes, key=lambda b: (-len(b[6]), b[1])):
        area = (b[4] - b[2]) * (b[5] - b[3])
        cover = lambda c, b=b: max(0, min(b[4], c[4]) - max(b[2], c[2])) * max(0, min(b[5], c[5]) - max(b[3], c[3]))
        if not any(c[0] == b[0] and cover(c) > 0.6 * area for c in kept):
            kept.append(b)
    assert {(r["page"], r["id"]) for r in queries.box_dedup(spark, SF).collect()} == {b[:2] for b in kept}
    pairs = []
    for a in boxes:
        for b in boxes:
            if a[0] == b[0] and a[1] % 2 == 0 and b[1] % 2 and min(a[4], b[4]) > max(a[2], b[2]) and min(a[5], b[5]) > max(a[3], b[3]):
                pairs.append((a[0], abs(a[2] - b[2]) + abs(a[3] - b[3]), a[1], b[1]))
    left, right, taken = set(), set(), set()
    for page, cost, a, b in sorted(pairs):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            taken.add((page, a, b, cost))
    assert {(r["page"], r["a"], r["b"], r["cost"]) for r in queries.greedy_assign(spark, SF).collect()} == taken


def test_repeat_index_equals_weighted_least_squares(spark):
    rnd = random.Random(6)
    rows = []
    for _ in range(400):
        a = rnd.randrange(2000, 2004)
        b = rnd.randrange(a + 1, 2006)
        rows.append((a, b, float(b - a), 0.03 * (b - a) + rnd.gauss(0, 0.02 * (b - a))))
    years = list(range(2000, 2006))
    got = [r["growth_pct"] for r in models.repeat_index(spark.createDataFrame([*rows, (1990, 2001, 1.0, 9.0), (2000, 2001, 1.0, None)], "year0 int, year1 int, gap double, y double"), years).orderBy("year").collect()]
    x = np.array([[(b == y) - (a == y) for y in years[1:]] for a, b, _, _ in rows], float)
    y, gap = np.array([r[3] for r in rows]), np.array([r[2] for r in rows])
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    square = (y - x @ beta) ** 2
    w = np.sqrt(1 / np.maximum(np.polyval(np.polyfit(gap, square, 1), gap), square.min() + 1e-9))
    beta = np.linalg.lstsq(x * w[:, None], y * w, rcond=None)[0]
    assert np.allclose(got, np.expm1(np.diff(np.r_[0, beta])) * 100)
    assert models.repeat_index(spark.createDataFrame([], "year0 int, year1 int, gap double, y double"), years).count() == 0


def test_asof_joins_nothing_on_nulls(spark):
    at = lambda d: datetime.datetime(2024, 1, d)
    left = spark.createDataFrame([(1, "a", at(2)), (2, None, at(2)), (3, "a", None), (4, "b", at(2))], "id int, k string, t timestamp")
    right = spark.createDataFrame([("a", at(1), 10), (None, at(1), 11), ("b", None, 12), ("a", None, 13)], "k string, u timestamp, v int")
    got = {r["id"]: r["r_v"] for r in panel.asof_backward(left, right, ["k"], "t", "u", ["v"]).collect()}
    assert got == {1: 10, 2: None, 3: None, 4: None}


def test_weights_must_be_valid(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 0.0), ("a", 3.0, 3.0)], "g string, x double, w double")
    assert [r["value"] for r in panel.weighted_percentile(df, ["g"], "x", "w", 0.25).collect()] == [1.0]
    for bad in (None, -1.0):
        with pytest.raises(Exception, match="weights must not be"):
            panel.weighted_percentile(df.unionByName(spark.createDataFrame([("a", 4.0, bad)], df.schema)), ["g"], "x", "w", 0.5).collect()


def test_anova_without_enough_levels_gives_no_row(spark):
    df = spark.createDataFrame([("a", "x", 1, 1.0), ("a", "y", 2, None)], "a string, b string, o int, y double")
    assert models.variance_components(df, "a", "b", ["o"], "y").count() == 0
    assert models.variance_components(df.limit(0), "a", "b", ["o"], "y").count() == 0


def test_rules_on_nulls(spark):
    row = spark.range(1).select(
        R.tri_state(F.lit(None).cast("int"), F.lit(1)).alias("tri"), R.nearest_of(F.lit(9.0), [6.0, 12.0]).alias("near"),
        R.nearest_of(F.lit(None).cast("double"), [6.0]).alias("none"), R.first_of((F.lit(None).cast("boolean"), "a"), other="b").alias("first"),
        R.repaired_digits(F.lit("I0 OS SO5")).alias("fixed"), R.least_subset(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), F.lit(3.0)).alias("mask"),
    ).collect()[0]
    assert tuple(row) == ("?", 6.0, None, "b", "10 OS S05", 4)


def test_replay_doesnt_depend_on_the_order_of_rows(spark):
    rows = [("s", i, datetime.datetime(2024, 1, 1 + i % 5), "decision" if i % 3 else "note", i % 4 == 0, f"st{i}") for i in range(40)]
    base = spark.createDataFrame([("s", "old"), ("t", "kept")], "subject string, status string")
    schema = "subject string, event_id int, record_time timestamp, kind string, ambiguous boolean, status string"
    results = []
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        results.append(sorted(tuple(r) for r in memory.applied(base, spark.createDataFrame(rows, schema).repartition(3), ["note"]).collect()))
    assert results[0] == results[1] and results[0][1] == ("t", "kept", "kept", None, 0, False)
    state = "old"
    for _, _, _, kind, unsure, status in sorted(rows, key=lambda r: (r[2], r[1])):
        state = state if kind == "note" or unsure else status
    assert results[0][0][2] == state


def test_sources_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a;"b"\nc'), (2, "é")], "id int, text string")
    io.write_csv(df.coalesce(1), str(tmp_path / "csv"), ";", mark=True)
    data = b"".join(p.read_bytes() for p in (tmp_path / "csv").glob("*.csv"))
    assert data.startswith(b"\xef\xbb\xbf") and b";" in data
    io.write_csv(df.coalesce(1), str(tmp_path / "plain"))
    ok = {"id": F.col("id") > 0}
    assert io.read_checked_csv(spark, str(tmp_path / "plain"), "id int, text string", 2, ok).count() == 2
    with pytest.raises(ValueError, match="2 rows instead of 3; id: 1 rows"):
        io.read_checked_csv(spark, str(tmp_path / "plain"), "id int, text string", 3, {"id": F.col("id") > 1})
    with pytest.raises(ValueError, match="columns"):
        io.read_checked_csv(spark, str(tmp_path / "plain"), "key int, text string", 2, ok)
    (tmp_path / "json").mkdir()
    for n in (3, 12):
        (tmp_path / "json" / f"page_{n}.json").write_text(f'{{"a": {n},\n "b": "x"}}')
    assert {(r["a"], r["page"]) for r in io.read_documents(spark, str(tmp_path / "json"), "a int, b string").collect()} == {(3, 3), (12, 12)}
    (tmp_path / "lines.json").write_text('{"id": "x", "v": 1}\n{"id": "x", "v": 2}\n{"id": "y", "v": 3}\n')
    first, twice = io.read_jsonl_first(spark, str(tmp_path / "lines.json"), "id string, v int", "id")
    assert {(r["id"], r["v"]) for r in first.collect()} == {("x", 1), ("y", 3)} and [r["id"] for r in twice.collect()] == ["x"]
    raw = spark.createDataFrame([(b"\xef\xbb\xbfa\xc3\xa9",), (b"caf\xe9 \x80",), (None,), (b"",)], "b binary")
    assert [r[0] for r in raw.select(io.decoded(F.col("b"))).collect()] == ["aé", "café €", None, ""]
    assert io.payload(df, "id").where("id = 2").collect()[0]["payload"] == '[{"text":"é"}]'
    assert io.trim_headers(spark.createDataFrame([(1,)], "`size (mm)` int")).columns == ["size"]
    assert len(spark.range(1).select(io.config_key(F.lit(1), F.lit(None))).collect()[0][0]) == 40


def test_short_quotes_are_found(spark):
    quotes = spark.createDataFrame([(1, "two words"), (2, "One"), (3, "five words of a quote and more"), (4, "absent")], "q int, t string")
    docs = spark.createDataFrame([(10, "here are two  WORDS"), (11, "one"), (12, "five words of a quote\nand more or less"), (13, "")], "d int, x string")
    got = {r["q"]: (r["n_sources"], r["first_source"]) for r in estimates.quoted_sources(quotes, docs, "q", "t", "d", "x").collect()}
    assert got == {1: (1, 10), 2: (1, 11), 3: (1, 12), 4: (0, None)}


def test_fragments_of_equal_place_keep_their_gap_before_them(spark, tmp_path):
    rows = [(1, 5.0, 1, 9), (1, 9.0, 2, 9), (1, 9.0, 2, 9), (2, 3.0, 4, 1), (2, 3.0, 4, 1)]
    df = spark.createDataFrame(rows, "l_orderkey long, l_quantity double, l_linenumber int, l_partkey long")
    df.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r["l_orderkey"]: (r["run"], r["text"], r["pieces"]) for r in queries.join_fragments(spark, str(tmp_path)).collect()}
    assert got == {1: (1, "1 22", 3), 2: (1, "44", 2)}


def test_near_codes_leave_out_names_behind_the_best(spark):
    names = spark.createDataFrame([("ABCD",), ("ABCE",), ("ABFE",), ("ABCF",)], "name string")
    codes = spark.createDataFrame([("ABCD",)], "code string")
    near = lambda best: {(r["name"], r["distance"]) for r in linking.near_codes(codes, names, "code", "name", 2, best).collect()}
    assert near(1) == {("ABCD", 0)} and near(2) == {("ABCD", 0), ("ABCE", 1), ("ABCF", 1)} and len(near(None)) == 4


def test_nearest_hashes_meet_in_small_cells(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice([rnd.getrandbits(64) - 2**63, rnd.randrange(8)])) for i in range(300)] + [(7, 1), (7, 2), (20, 5), (None, 1), (400, None)]
    hashes = spark.createDataFrame(rows, "id long, h long")
    expected = []
    known = [(i, h) for i, h in rows if i is not None and h is not None]
    for i in {i for i, _ in known if i % 10 == 0}:
        found = sorted(((x ^ y) & (2**64 - 1)).bit_count() * 1000 + j for k, x in known if k == i for j, y in known if j != i)
        expected += [(i, f % 1000, f // 1000) for f in found[:3]]
    order = lambda r: (r["id"], r["distance"], r["other"])
    for rows_, questions in ((40, 6), (10**6, 10**6)):
        got, best = linking.nearest_hashes(hashes, F.col("id") % 10 == 0, 3, rows_, questions).collect(), {}
        for r in sorted(got, key=order):
            best.setdefault(r["id"], []).append((r["id"], r["other"], r["distance"]))
        assert sorted(expected) == sorted(x for own in best.values() for x in own[:3])
        assert len(got) <= 3 * 31 * (-(-len(known) // rows_))  # what a cell leaves, not its pairs
    assert linking.nearest_hashes(hashes.limit(0), F.col("id") % 10 == 0, 3).count() == 0


@pytest.mark.parametrize("finish", [0, 10**6])
def test_nearest_corners_equal_a_pass_in_order(spark, monkeypatch, finish):
    rnd = random.Random(5)

    def some(n, first, spread):
        at = lambda: rnd.choice([rnd.randrange(spread), rnd.randrange(spread), round(rnd.uniform(-spread, spread), 3)]) * 1.0
        rows = [(rnd.randrange(2), first + i, at(), at()) for i in range(n)]
        return [(p, i, x, y, x + rnd.randrange(4), y + rnd.randrange(1, 6)) for p, i, x, y in rows]

    taken = []
    one_to_one = linking.one_to_one
    monkeypatch.setattr(linking, "one_to_one", lambda pairs, f: taken.append(pairs.count()) or one_to_one(pairs, f))
    for again in (finish > 0,):
        a, b = some(90, 0, 6), some(80, 50, 6)
        if again:  # an id on two corners is one end
            a, b = [*a, (0, 3, 0.0, 0.0, 3.0, 3.0), (0, 3, 9.0, 9.0, 12.0, 12.0)], [*b, (0, 60, 9.5, 9.0, 12.0, 12.0)]
        pairs = {}
        for p, i, x0, y0, x1, y1 in a:
            for q, j, u0, v0, u1, v1 in b:
                if p == q and max(x0, u0) < min(x1, u1) and max(y0, v0) < min(y1, v1):
                    cost = abs(x0 - u0) + abs(y0 - v0)
                    pairs[p, i, j] = min(cost, pairs.get((p, i, j), cost))
        left, right, expected = set(), set(), set()
        for cost, p, i, j in sorted((c, *k) for k, c in pairs.items()):
            if (p, i) not in left and (p, j) not in right:
                left.add((p, i))
                right.add((p, j))
                expected.add((p, i, j, cost))
        schema = "page int, id long, x0 double, y0 double, x1 double, y1 double"
        odd = [(None, 1, 0.0, 0.0, 9.0, 9.0), (0, None, 0.0, 0.0, 9.0, 9.0), (0, 999, 0.0, None, 9.0, 9.0)]
        df = [spark.createDataFrame([*rows, *odd], schema) for rows in (a, b)]
        got = [tuple(r) for r in linking.nearest_corners(*df, finish=finish).collect()]
        assert len(got) == len(expected) and set(got) == expected and expected
        assert linking.nearest_corners(df[0], df[1].limit(0)).count() == 0
    # a hundred copies of two boxes over each other: the pairs on a corner are never made
    taken.clear()
    copies = lambda first: spark.createDataFrame([(0, 2 * i + first, 9.0 * (i % 2), 0.0, 9.0 * (i % 2) + 4, 4.0) for i in range(200)], schema)
    assert {(r["a"] + 1, r["cost"]) for r in linking.nearest_corners(copies(0), copies(1)).collect()} == {(2 * i + 1, 0.0) for i in range(200)}
    assert sum(taken) == 0


@pytest.mark.parametrize("few", [0, 2000])
def test_codes_and_registry_with_repeated_names_equal_a_scan(spark, few):
    rnd = random.Random(8)
    some = lambda chars, n: "".join(rnd.choice(chars) for _ in range(n))
    registry = [(some("0157468", rnd.choice([3, 4])), rnd.choice([None, 0, 1, 2, 3, 4])) for _ in range(60)] + [("77", f) for f in (None, 0, 1, 2, 3, 4)]
    codes = [(some("0157OIS8X", rnd.choice([3, 4, 5])), rnd.choice([None, 0, 1, 2])) for _ in range(40)] + [("77", 0), ("77", 1), ("7", None), ("", 3), ("XYXYXYX", 1)]
    registry, codes = [*registry, ("ABABABßß", 1), ("QQQQQQ", 2), (None, 1)], [*codes, ("ABABAB", 1), ("QQQQQQ", 2), (None, 1)]
    df = lambda rows: spark.createDataFrame(rows, "code string, fact int")
    expected = {}
    for code in {c for c, _ in codes if c is not None}:
        found = []
        for fact in {f for c, f in codes if c == code}:
            for name, theirs in {r for r in registry if r[0] is not None}:
                cost = linking.reading_cost(code, name)
                if cost <= 2:
                    known = fact is not None and theirs is not None
                    found.append((round(-(0.8 * (known and fact == theirs) - (known and fact != theirs) - cost), 6), name, cost, known and fact != theirs))
        best = sorted(found)[:2]
        alone = len(best) == 1 or best[1][0] - best[0][0] > 1 if best else False
        kind = "NO_MATCH" if not best else "CONFIRM" if best[0][2] == 0 and not best[0][3] and alone else "CHOOSE"
        expected[code] = (*[b[1] for b in best], *[None] * (2 - len(best)), kind)
    got = linking.linked_codes(df(codes), df([*registry, *registry]), ["fact"], few=few).where("code is not null").collect()
    assert {r["code"]: (r["first"], r["second"], r["question"]) for r in got} == expected and len(got) == len(expected)
    assert expected["ABABAB"][0] == "ABABABßß" and {k[2] for k in expected.values()} == {"CONFIRM", "CHOOSE", "NO_MATCH"}


def test_codes_that_fold_alike_are_not_all_weighed(spark, monkeypatch):
    names = [(f"R-{a}{b}{c}{d}",) for a in "4569" for b in "4569" for c in "4569" for d in "4569"]
    weighed, reading_cost = spark.sparkContext.accumulator(0), linking.reading_cost

    def counted(a, b):
        weighed.add(1)
        return reading_cost(a, b)

    monkeypatch.setattr(linking, "reading_cost", counted)
    df = spark.createDataFrame(names, "code string")
    got = linking.linked_codes(df, df, []).collect()
    assert len(got) == 256 and all(r["first"] == r["code"] and r["question"] == "CHOOSE" for r in got)
    assert 256 <= weighed.value <= 16 * 256  # the square is 65,536
