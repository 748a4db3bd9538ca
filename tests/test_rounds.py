"""Greedy rounds, the comparison cascade and content matches against sequential passes."""

from __future__ import annotations

import itertools
import random

import pytest

from weft.operators import cascade, rounds
from weft.plans import linking as queries

SF = "/root/testdata/sf0.001"


def greedy(pairs):
    left, right, taken = set(), set(), []
    for page, cost, a, b in sorted(pairs):
        if (page, a) not in left and (page, b) not in right:
            left.add((page, a))
            right.add((page, b))
            taken.append((page, a, b, cost))
    return taken


@pytest.mark.parametrize("finish", [0, 40, 10**6])
def test_rounds_equal_a_pass_in_order(spark, finish):
    rnd = random.Random(finish)
    pairs = list({(rnd.randrange(2), rnd.randrange(5), rnd.randrange(25), rnd.randrange(25)) for _ in range(250)})
    least = {}
    for page, cost, a, b in pairs:
        least[page, a, b] = min(cost, least.get((page, a, b), cost))
    schema = "page int, cost int, a int, b int"
    df = spark.createDataFrame([*pairs, (None, 0, 1, 1), (0, None, 1, 1), (0, 0, None, 1)], schema)
    got = [(r["page"], r["a"], r["b"], r["cost"]) for r in rounds.one_to_one(df, finish).collect()]
    assert sorted(got) == sorted(greedy([(p, c, a, b) for (p, a, b), c in least.items()]))
    assert rounds.one_to_one(df.limit(0), finish).count() == 0


@pytest.mark.parametrize("finish", [0, 30, 10**6])
def test_falling_items_equal_a_pass_in_order(spark, finish):
    rnd = random.Random(finish)
    over = [(rnd.randrange(2), i, by) for i in range(1, 60) for by in rnd.sample(range(i), min(i, rnd.randrange(3)))]
    fell = set()
    for page, i in sorted({(p, i) for p, i, _ in over}, key=lambda x: x[1]):
        if any((p, by) not in fell for p, j, by in over if (p, j) == (page, i)):
            fell.add((page, i))
    got = [(r["page"], r["id"]) for r in rounds.dropped(spark.createDataFrame(over, "page int, id int, by int"), finish).collect()]
    assert len(got) == len(set(got)) and set(got) == fell


def relation(a, b):
    return "?" if a is None or b is None else "=" if a == b else "!"


def sequential_cascade(plan, shop):
    """The tiers one after the other, each a pass over sorted candidates."""
    out = {}
    for el in {p[0] for p in plan} | {s[0] for s in shop}:
        mine = {p[1]: p[2:] for p in plan if p[0] == el}
        theirs = {s[1]: s[2:] for s in shop if s[0] == el}
        everything, free = dict(theirs), set(theirs)
        open_ = set(mine)
        rel = lambda i, j, mine=mine, theirs=everything: [relation(mine[i][k], theirs[j][k]) for k in (1, 2)]

        def take(tier, candidates, open_=open_, free=free, el=el):
            for _, i, j, differs in sorted(candidates):
                if i in open_ and j in free:
                    open_.discard(i)
                    free.discard(j)
                    out[el, i] = (tier(i, j) if callable(tier) else tier, (j,), differs)

        same = lambda i, j, rel=rel: "!" not in rel(i, j) and "=" in rel(i, j)
        sized = [(i, j) for i in mine for j in everything if mine[i][0] is not None and mine[i][0] == everything[j][0]]
        take("exact", [(rel(i, j).count("?"), i, j, ()) for i, j in sized if same(i, j)])
        for i in sorted(open_):
            found = [j for k, j in sized if k == i and same(i, j)]
            if mine[i][1] is None and found:
                open_.discard(i)
                free.discard(min(found))
                out[el, i] = ("exact", (min(found),), ())
        for i in sorted(open_):
            pool = [j for j in sorted(free) if everything[j][0] == mine[i][0] is not None and (everything[j][1] or 0) > 0]
            sets = [c for n in range(2, len(pool) + 1) for c in itertools.combinations(pool, n) if sum(everything[j][1] for j in c) == mine[i][1]]
            if mine[i][1] is not None and sets:
                n = len(sets[0])
                out[el, i] = ("split", {c for c in sets if len(c) == n}, ())
                open_.discard(i)
                free.difference_update(cascade_choice(pool, everything, mine[i][1]))

        def times(i, j, mine=mine, theirs=everything, rel=rel):
            r = rel(i, j)
            return r[0] == "!" != r[1] and mine[i][1] > 0 and theirs[j][1] % mine[i][1] == 0 and 2 <= theirs[j][1] // mine[i][1] <= 12

        def worst(i, j, mine=mine, theirs=everything, rel=rel):
            gap = [abs(theirs[j][k] - mine[i][k]) / max(mine[i][k], 1) if r == "!" else 0.0 for k, r in zip((1, 2), rel(i, j), strict=True)]
            return rel(i, j).count("!"), sum(gap)

        names = lambda i, j, rel=rel, times=times: () if times(i, j) else tuple(n for n, r in zip(("qty", "gap"), rel(i, j), strict=True) if r == "!")
        take(lambda i, j, times=times: "multiple" if times(i, j) else "differs", [(worst(i, j), i, j, names(i, j)) for i, j in sized if i in open_ and j in free and "!" in rel(i, j)])
        for i in sorted(open_):
            if any(k == i and j in free for k, j in sized):
                out[el, i] = ("unknown", (), ())
                open_.discard(i)
        other = [(i, j) for i in open_ for j in free if None not in (mine[i][0], everything[j][0]) and mine[i][0] != everything[j][0] and same(i, j)]
        take("swapped", [(rel(i, j).count("?"), i, j, ("size",)) for i, j in other])
        for i in open_:
            out[el, i] = ("unknown" if mine[i][1] is None else "absent", (), ())
        for j in free:
            out[el, None, j] = ("added", (j,), ())
    return out


def cascade_choice(pool, theirs, target):
    return [pool[k] for k in cascade.least_parts([theirs[j][1] for j in pool], target)]


def compared(got, expected):
    assert len(got) == len(expected)
    for r in got:
        ids, key = tuple(r["shop_ids"]), (r["el"], r["plan_id"])
        tier, wanted, differs = expected[key if r["plan_id"] is not None else (*key, ids[0])]
        assert r["tier"] == tier and tuple(r["differs"]) == differs, (r, tier, wanted)
        assert ids in wanted if tier == "split" else ids == wanted, (r, wanted)


SCHEMA = "el long, id long, size long, qty long, gap long"


@pytest.mark.parametrize("finish", [0, 10**6])
def test_cascade_equals_sequential_tiers(spark, finish):
    rnd = random.Random(9)
    some = lambda values: rnd.choice([None, *values])
    part = lambda el, i, q: (el, i, some([1, 1, 1, 2]), some(q), some([100, 150]))
    plan = [part(el, i, [2, 3, 7, 9, 11]) for el in range(60) for i in range(rnd.randrange(5))]
    shop = [part(el, 10 * i, [2, 4, 5, 6]) for el in range(61) for i in range(rnd.randrange(8))]
    expected = sequential_cascade(plan, shop)
    assert {t for t, _, _ in expected.values()} == {"exact", "split", "differs", "multiple", "unknown", "swapped", "absent", "added"}
    got = cascade.compare_parts(spark.createDataFrame(plan, SCHEMA), spark.createDataFrame(shop, SCHEMA), finish).collect()
    compared(got, expected)


def test_cascade_of_the_query_and_of_empty_sides(spark):
    plan, shop = (df.collect() for df in queries._versions(spark, SF))
    compared(cascade.compare_parts(*queries._versions(spark, SF)).collect(), sequential_cascade([tuple(r) for r in plan], [tuple(r) for r in shop]))
    empty, one = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, 1, 1, 1, None), (None, 2, 1, 1, 1)], SCHEMA)
    assert [r["tier"] for r in cascade.compare_parts(one, empty).collect()] == ["absent"]
    assert [r["tier"] for r in cascade.compare_parts(empty, one).collect()] == ["added"]


def versions(seed, sizes=(1, 1, 1, 2)):
    """Parts of elements of which some hold more than 12, with all kinds of changes and zero and negative numbers."""
    rnd = random.Random(seed)
    some = lambda values: rnd.choice([None, *values])
    part = lambda el, i, q: (el, i, some(sizes), some(q), some([100, 150]))
    plan = [part(el, i, [2, 3, 7, 9, 11]) for el in range(-5, 60) for i in range(rnd.randrange(9 if el % 4 else 4))]
    return plan, [part(el, 10 * i, [-1, 0, 2, 4, 5, 6]) for el in range(-4, 61) for i in range(rnd.randrange(9 if el % 4 else 5))]


def one_tier(monkeypatch):
    """Lets no pair be chosen by rounds of joins."""
    monkeypatch.setattr(cascade, "one_to_one", lambda *_: pytest.fail("rounds of joins"))


@pytest.mark.parametrize("small", [0, 6, 100])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_small_and_large_elements_go_through_the_same_tiers(spark, monkeypatch, small, kind):
    plan, shop = versions(small, "aab" if kind == "string" else (1, 1, 1, 2))
    if small == 100:
        one_tier(monkeypatch)
    schema = f"el long, id long, size {kind}, qty long, gap int"
    rows = lambda parts: spark.createDataFrame([*parts, *parts[::3], (None, 1, None, 1, 1), (1, None, None, 1, 1)], schema)
    compared(cascade.compare_parts(rows(plan), rows(shop), small=small).collect(), sequential_cascade(plan, shop))


def test_small_elements_need_no_rounds_of_joins(spark, monkeypatch):
    one_tier(monkeypatch)
    assert queries.version_cascade(spark, SF).count() > 0


def test_numbers_that_are_not_whole_are_compared_too(spark):
    plan, shop = ([(el, i, size, None if qty is None else qty + 0.5, gap) for el, i, size, qty, gap in parts if size] for parts in versions(5))
    schema = "el long, id long, size long, qty double, gap long"
    got = cascade.compare_parts(*(spark.createDataFrame(p, schema) for p in (plan, shop))).where("tier = 'exact'").collect()
    expected = {k: v for k, v in sequential_cascade(plan, shop).items() if v[0] == "exact"}
    assert {(r["el"], r["plan_id"]): (r["tier"], tuple(r["shop_ids"]), ()) for r in got} == expected


@pytest.mark.parametrize("step", [1, 7, 10**6])
def test_elements_go_on_in_the_next_batch(step):
    import pyarrow as pa

    plan, shop = versions(step)
    sides = sorted(((el, side, *rest) for side, parts in enumerate((plan, shop)) for el, *rest in parts), key=lambda r: r[:3])
    rows = pa.RecordBatch.from_pylist([dict(zip(("el", "side", "id", "size", "qty", "gap"), r, strict=True)) for r in sides])
    got = cascade._small_elements(rows.slice(i, step) for i in range(0, rows.num_rows, step))
    compared([r for batch in got for r in batch.to_pylist()], sequential_cascade(plan, shop))
    assert not list(cascade._small_elements(iter([rows.slice(0, 0)])))


@pytest.mark.parametrize("finish", [0, 10**6])
def test_content_matches_equal_a_pass_in_order(spark, finish):
    rnd = random.Random(2)
    elements = [(i, rnd.choice("ab"), float(rnd.randrange(60)), {f"p{rnd.randrange(30)}" for _ in range(rnd.randrange(1, 5))}) for i in range(60)]
    others = [(100 + i, k, at + rnd.randrange(-3, 4), set(rnd.sample(sorted(p), max(1, len(p) - rnd.randrange(2))))) for i, k, at, p in elements[:50]]
    rows = lambda side: spark.createDataFrame([(i, k, at, p) for i, k, at, ps in side for p in [*sorted(ps), None]], "el long, kind string, place double, part string")
    pairs = [(0, (len(p - q) > 0, len(p - q), abs(x - y)), i, j) for i, k, x, p in elements for j, m, y, q in others if k == m and p & q and abs(x - y) <= 5]
    taken = {a: (b, cost) for _, a, b, cost in greedy(pairs)}
    got = {r["el"]: r for r in cascade.match_content(rows(elements), rows(others), 5.0, finish).collect()}
    assert set(got) == {e[0] for e in elements}
    for i, r in got.items():
        b, cost = taken.get(i, (None, None))
        assert (r["other"], r["distance"]) == (b, cost and cost[2])
        assert r["verdict"] == (None if b is None else "differs" if cost[0] else "same")


def test_content_match_finds_the_versions_of_orders(spark):
    got = queries.content_match(spark, SF).collect()
    right = [r for r in got if r["other"] is not None and r["other"] == 3 * r["el"] + 1]
    assert len(right) > 0.8 * sum(r["other"] is not None for r in got)
    assert {r["verdict"] for r in got} == {"same", "differs", None}


@pytest.mark.parametrize("finish", [0, 10**6])
def test_revisions_equal_tiers_in_order(spark, finish):
    import math

    old, new = ([tuple(r) for r in df.collect()] for df in queries._revisions(spark, SF))
    old += [(10**7, 1, "L5", 0, None, None), (10**7 + 1, None, "L5", 0, 1.0, 1.0), (10**7 + 2, 1, None, None, 1.0, 1.0)]
    schema = "id long, kind int, label string, page long, x double, y double"
    got = cascade.pair_revisions(spark.createDataFrame([*old, (None, 1, "L5", 0, 1.0, 1.0)], schema), spark.createDataFrame(new, schema), 40.0, finish).collect()
    free, left, expected = {o[0]: o for o in old}, {n[0]: n for n in new}, set()
    apart = lambda o, n: math.inf if None in (*o[4:], *n[4:]) else math.hypot(o[4] - n[4], o[5] - n[5])
    same = lambda o, n, *at: all(o[i] is not None and o[i] == n[i] for i in at)
    tiers = {"page": lambda o, n: same(o, n, 1, 2, 3), "label": lambda o, n: same(o, n, 1, 2),
             "place": lambda o, n: same(o, n, 1, 3) and None in (o[2], n[2]) and apart(o, n) <= 40}
    for tier, fits in tiers.items():
        for d, i, j in sorted((apart(o, n), o[0], n[0]) for o in free.values() for n in left.values() if fits(o, n)):
            if i in free and j in left:
                del free[i], left[j]
                expected.add((i, j, tier))
    expected |= {(i, None, "removed") for i in free} | {(None, j, "added") for j in left}
    assert {t for _, _, t in expected} == {"page", "label", "place", "removed", "added"}
    assert len(got) == len(expected) and {(r["old_id"], r["new_id"], r["tier"]) for r in got} == expected


@pytest.mark.parametrize("near", [0.0, 2.5])
def test_content_meets_across_slots(spark, near):
    step = 2.5 / 4
    mine = [(i, "k", (i - 40) * 2 * step, f"p{i % 5}") for i in range(80)]
    theirs = [(100 + i, "k", (i - 40) * step * 2 + step * (i % 3), f"p{i % 5}") for i in range(80)]
    schema = "el long, kind string, place double, part string"
    pairs = [(0, abs(x - y), a, b) for a, _, x, p in mine for b, _, y, q in theirs if p == q and abs(x - y) <= near]
    got = cascade.match_content(spark.createDataFrame(mine, schema), spark.createDataFrame(theirs, schema), near).collect()
    assert {(r["el"], r["other"], r["distance"]) for r in got if r["other"] is not None} == {(a, b, c) for _, a, b, c in greedy(pairs)} and pairs
