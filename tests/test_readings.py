"""Labels by dictionary and grammars of readings against brute force."""

from __future__ import annotations

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from weft.operators import dictionary, grammar
from weft.operators.linking import CONFUSABLE
from weft.plans import readings as queries

SF = "/root/testdata/sf0.001"


def places(words, labels, longest, before=(), after=()):
    found = []
    for i in range(len(words)):
        for n in range(len(words) - i, 0, -1):
            label = " ".join(words[i : i + n])
            stopped = (i and words[i - 1] in before) or (i + n < len(words) and words[i + n] in after)
            if label in labels and not stopped:
                found.append((i, n, label))
    if not longest:
        return [(i, label) for i, _, label in found]
    out, free = [], 0
    for i, n, label in found:
        if i >= free:
            out.append((i, label))
            free = i + n
    return out


@pytest.mark.parametrize("longest", [True, False])
def test_labels_equal_brute_force(spark, longest):
    rnd = random.Random(1)
    labels = [(f"k{i % 3}", " ".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 4)))) for i in range(12)] + [("k9", "b"), ("k8", "é x")]
    texts = [(i, rnd.choice([" ", "\n", "  \t"]).join(rnd.choice(["A", "b", "c", "é", "x", "stop"]) for _ in range(rnd.randrange(0, 30)))) for i in range(60)]
    vocabulary = spark.createDataFrame(labels, "kind string, label string")
    df = spark.createDataFrame([*texts, (100, None), (None, "b")], "id_ long, body string").withColumn("label", F.lit("x")).withColumn("text", F.lit("y"))
    got = dictionary.find_labels(df, "id_", "body", vocabulary, longest, after=["stop"], before=["é"]).collect()
    expected = set()
    for i, t in [*texts, (None, "b")]:
        for word, label in places(t.lower().split(), {x for _, x in labels}, longest, {"é"}, {"stop"}):
            expected |= {(i, k, label, word) for k, x in labels if x == label}
    assert len(got) == len(expected) and {tuple(r) for r in got} == expected
    assert dictionary.find_labels(df, "id_", "body", vocabulary.limit(0)).count() == 0
    with pytest.raises(ValueError, match="labels"):
        dictionary.find_labels(df, "id_", "body", vocabulary, most=2)


def test_vocabulary_counts_labels_of_each_kind(spark):
    rows = spark.createDataFrame([("a", "Two  Words"), ("a", " two words "), ("b", "two words"), (None, "x"), ("a", None), ("a", " ")], "t string, name string")
    assert {tuple(r) for r in dictionary.vocabulary(rows, "t", "name").collect()} == {("a", "two words", 2), ("b", "two words", 1)}
    assert {tuple(r) for r in dictionary.vocabulary(rows, "t", "name", 2).collect()} == {("a", "two words", 2)}


def test_label_spans_of_the_query_equal_brute_force(spark):
    labels = [(r["kind"], r["label"]) for r in queries._opening_words(spark, SF).collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    names = {x for _, x in labels}
    expected = set()
    for doc, t in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        starts = {x.split()[0] for x in names}
        free = 0
        for i, w in enumerate(words):
            own = [" ".join(words[i : i + n]) for n in (3, 2) if i + n <= len(words)] if w in starts and i >= free else []
            label = next((x for x in own if x in names and words[i + x.count(" ") + 1 : i + x.count(" ") + 2] not in (["the"], ["of"])), None)
            if label:
                expected |= {(doc, k, label, i) for k, x in labels if x == label}
                free = i + label.count(" ") + 1
    assert {tuple(r) for r in queries.label_spans(spark, SF).collect()} == expected and expected


PAIRS = {p for x in CONFUSABLE for p in (x, x[::-1])}


def edit_cost(a, b):
    row = [10 * j for j in range(len(b) + 1)]
    for i, x in enumerate(a):
        new = [10 * (i + 1)]
        for j, y in enumerate(b):
            change = 0 if x == y else 4 if y + x in PAIRS else 10
            new.append(min(row[j] + change, row[j + 1] + 10, new[j] + 10))
        row = new
    return row[-1]


@pytest.mark.parametrize("seed", range(4))
def test_grammars_equal_patterns_and_repairs_equal_a_scan(seed):
    rnd = random.Random(seed)
    g = grammar

    def some(depth):
        kind = rnd.randrange(5) if depth else 0
        if kind == 0:
            c = "".join(sorted(set(rnd.choice("01OB8") for _ in range(2))))
            return g.chars(c), f"[{c}]"
        parts = [some(depth - 1) for _ in range(2)]
        if kind == 1:
            return g.any_of(*[p for p, _ in parts]), "(" + "|".join(x for _, x in parts) + ")"
        if kind == 2:
            low, high = rnd.choice([(0, 1), (0, None), (1, 2), (2, 2)])
            return g.times(parts[0][0], low, high), f"(?:{parts[0][1]}){{{low},{'' if high is None else high}}}"
        return g.seq(*[p for p, _ in parts]), "".join(x for _, x in parts)

    every = ["".join(c) for n in range(6) for c in itertools.product("01OB8", repeat=n)]
    for _ in range(12):
        pieces, pattern = some(3)
        table = g.Grammar(pieces)
        accepted = table.accepts([*every, None, "01z"])
        good = [t for t in every if re.fullmatch(pattern, t)]
        assert [t for t, ok in zip(every, accepted, strict=False) if ok] == good and not accepted[-2:].any()
        if not good:
            continue
        for reading in ("", "0", "O1", "l80", "B8O"):
            cost, fixed = table.repair(reading)
            best = min((edit_cost(reading, t), len(t), t) for t in good)
            if cost < 10 * (6 - len(reading)):  # no longer text can be as cheap
                assert (cost, fixed) == (best[0], best[2]), (pattern, reading)
            assert table.repair(reading, cost) == (cost, fixed) and (cost == 0 or table.repair(reading, cost - 1) is None)


def test_readings_are_named_and_repaired(spark):
    df = spark.createDataFrame([(1, "Custorner#000000017"), (2, "2O24-01-31"), (3, "12.5"), (4, None), (5, "??????????"), (6, "Supplier#00000001")], "cost int, r string")
    got = {r["r"]: (r["grammar"], r["repaired"], r["cost"]) for r in grammar.read_by(df, "r", queries.grammars()).collect()}
    assert got["Custorner#000000017"] == ("code", "Customer#000000017", 20) and got["2O24-01-31"] == ("day", "2024-01-31", 4)
    assert got["12.5"] == ("amount", "12.5", 0) and got[None] == got["??????????"] == (None, None, None)
    assert got["Supplier#00000001"] == ("code", "Supplier#000000001", 10)
    fixed = [r for r in queries.grammar_repair(spark, SF).collect() if r["t"] == "o" and r["id"] % 9 == 1]
    assert fixed and all(r["cost"] % 4 == 0 and r["repaired"] == r["reading"].replace("O", "0") for r in fixed)


def test_repairs_of_many_readings_share_the_work(monkeypatch):
    rnd, g = random.Random(7), queries.grammars()["code"]
    readings = [f"Customer#{i:09d}"[i % 3 :] + "l" * (i % 2) for i in range(2000)] + ["", "x" * 40]
    steps = []
    step = grammar.Grammar._step
    monkeypatch.setattr(grammar.Grammar, "_step", lambda self, x: steps.append(x) or step(self, x))
    costs = g.costs(readings)
    assert 0 < len(steps) < 10_000  # by places and characters, not by readings (some 36,000 characters)
    fixed = g.repairs(readings)
    assert [f[0] for f in fixed] == costs.tolist()
    for k in rnd.sample(range(2000), 30):
        assert g.accepts([fixed[k][1]])[0] and edit_cost(readings[k], fixed[k][1]) == costs[k]
    assert fixed[-2] == (180, "Customer#000000000") and g.repair("x" * 40, 20) is None
    assert grammar.Grammar(grammar.chars("")).repairs(["a"]) == [None]
