"""Source divergence, SuperMinHash near copies, Drake clustering; joins of large canopies; columns of clashing names."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import documents, words

from weft.llm import chat, clusters, divergence, extract, jaccard, lm, mixing, nearcopies, packing, quality, substring, topk, urlfilter

CLASH = "id text tokens label n bucket host tag blocks repeats source_ at s d node canopy chunk keys block rows lang_ shard round item value all first v".split()


def clashing(df, *taken):
    """df with further columns of names that operators use inside."""
    return df.withColumns({c: F.lit("x") for c in CLASH if c not in df.columns and c not in taken})


# divergence ---------------------------------------------------------------------------------------------------------


def brute_divergence(rows, least=10, top=10):
    rows = [tuple(x or "" for x in r) for r in rows]
    fold = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    terms = [(lang, source, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", fold(t))) for lang, source, t in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [(s, t) for la, s, t in terms if la == lang]
        docs = collections.Counter(w for _, t in own for w in set(t))
        kept = sorted(w for w, n in docs.items() if n >= least)
        count = collections.defaultdict(collections.Counter)
        for s, t in own:
            count[s].update(w for w in t if docs[w] >= least)
        whole = sum(count.values(), collections.Counter())

        def p(c, kept=kept):
            total = sum(c.values()) + 2 * len(kept)
            return {w: 1 + 10**9 * (c[w] + 2) // total for w in kept}

        ps, q = {s: p(c) for s, c in count.items()}, p(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in ps:
            pairs = [(-sum(f(ps[s][w], ps[o][w]) for w in kept), o.encode(), o) for o in ps if o != s]
            found = [(-f(ps[s][w], q[w]), w.encode(), w) for w in kept if count[s][w] and ps[s][w] > q[w]]
            for part, list_ in (("pair", sorted(pairs)), ("term", sorted(found)[:top])):
                out += [(lang, s, part, item, -v, i) for i, (v, _, item) in enumerate(list_, 1)]
    return sorted(out)


@pytest.mark.parametrize("settings", [{}, {"shard_terms": 7, "station_terms": 20, "held_terms": 30}])
def test_divergence_equals_brute_force(spark, settings):
    rnd = random.Random(4)
    rows = [(rnd.choice(["en", "fr", None]), rnd.choice(["a", "B", "é", None, "", "x1", "x2", "x3", "x4", "x5", "x6"]),
             " ".join(rnd.choice(["Ab", "ab", "é1x", "Ünd", "c-d", f"w{rnd.randrange(40)}", "q" * rnd.randrange(1, 9)]) for _ in range(rnd.randrange(60))))
            for _ in range(400)]
    rows += [("en", "a", None), ("xx", "only", "one two"), ("yy", "p", ""), ("yy", "r", "few words"), *rows[:30]]
    docs = clashing(spark.createDataFrame(rows, "lang string, source string, text string"))
    got = divergence.source_divergence(docs, **settings)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == brute_divergence(rows)


def test_divergence_of_an_empty_table_and_of_long_texts(spark):
    docs = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.source_divergence(docs).count() == 0
    text = b"ab Cd" * 7 + b" " + b"x" * 50 + b"-y z"
    for size in (1, 3, 8, 20, 1000):
        assert [w for p in divergence.pieces(text, size) for w in p] == re.findall(rb"[a-z]+", text.lower())


@pytest.mark.parametrize("n", range(1, 17))
def test_tournament_lets_all_meet_once(n):
    games = divergence.tournament(n)
    assert sorted(tuple(sorted(g[1:])) for g in games) == [(a, b) for a in range(n) for b in range(a + 1, n)]
    for r in {g[0] for g in games}:
        playing = [x for g in games if g[0] == r for x in g[1:]]
        assert len(set(playing)) == len(playing)
    hosted = collections.Counter(g[1] for g in games)
    assert n < 3 or max(hosted.values()) - min(hosted[i] for i in range(n)) <= 1


def test_probabilities_of_counts_beyond_64_bits():
    counts = np.array([0, 5, 10**13])
    total = 2 * 10**13
    assert divergence.probabilities(counts, total).tolist() == [1 + 10**9 * (c + 2) // total for c in counts.tolist()]


# near copies --------------------------------------------------------------------------------------------------------


def sequential_signature(elements, m, seed=1):
    """SuperMinHash as published, an element after the other, with the same random numbers."""
    from weft.llm.common import mixed

    h = [2**64 - 1] * m
    for e in elements:
        place = list(range(m))
        for j in range(m):
            r = int(mixed(np.array([(int(e) + (2 * j + seed) * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0])
            k = j + ((r & 0xFFFFFFFF) * (m - j) >> 32)
            place[j], place[k] = place[k], place[j]
            h[place[j]] = min(h[place[j]], j << 56 | r >> 8)
    return h


def test_signatures_equal_sequential_ones_and_stop_early():
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (1, 2, 7, 300, 0, 9000)]
    ranks = []
    got = nearcopies.signatures(sets, 24, ranks=ranks)
    for s, row in zip(sets[:4], got, strict=False):
        assert row.tolist() == sequential_signature(s, 24)
    assert (got[4] == 2**64 - 1).all()
    long = []
    nearcopies.signatures([sets[5][:8000]], 24, ranks=long)
    assert max(long) == 1  # thousands of elements settle all components by their first ranks


@pytest.mark.parametrize("size", [20, 200])
def test_signatures_estimate_with_less_variance_than_independent_minima(size):
    rng = np.random.default_rng(size)
    found, shared = [], []
    for _ in range(300):
        u = rng.integers(0, 2**63, size, dtype=np.uint64)
        cut = size * 85 // 100
        half = cut + (size - cut) // 2
        s = nearcopies.signatures([u[:half], np.r_[u[:cut], u[half:]]], nearcopies.BANDS * nearcopies.ROWS)
        found.append((s[0] == s[1]).mean())
        keys = nearcopies.band_keys(s, nearcopies.ROWS)
        shared.append((keys[0] == keys[1]).sum())
    j = cut / size
    independent = (j * (1 - j) / s.shape[1]) ** 0.5
    assert abs(np.mean(found) - j) < 4 * independent / 300**0.5
    assert np.std(found) < independent
    assert min(shared) >= 3  # of 42 bands about 16; none would be a lost link


def brute_components(texts, percent, k=5):
    sets = {}
    for i, t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.setdefault(i, []).append({tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
    label = {i: i for i in sets}
    links = [(i, j) for i in sets for j in sets if i < j and any(100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j] if a and b)]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            changed |= (label[i], label[j]) != (low, low)
            label[i] = label[j] = low
    return label, sets


def near_texts(rnd):
    texts = []
    for _ in range(12):
        base = words(rnd.randrange(3, 120), rnd.random(), 4000)
        for _ in range(rnd.randrange(1, 12)):
            w = list(base)
            for _ in range(rnd.randrange(0, 4)):
                if len(w) > 5:
                    w[rnd.randrange(len(w))] = f"new{rnd.randrange(9)}"
            texts.append((len(texts), " ".join(w)))
    return texts


@pytest.mark.parametrize("settings", [{}, {"chunk_docs": 8}, {"chunk_tokens": 300}])
def test_near_copies_equal_brute_force(spark, settings):
    texts = near_texts(random.Random(7))
    texts += [(900, None), (901, " \t\n"), (902, "one two"), (903, "ONE two"), (904, "one two three"), (905, texts[0][1]), (904, "x y z x y z")]
    docs = clashing(documents(spark, texts).drop("id", "tokens", "label"), "text")
    got = nearcopies.near_copies(docs, **settings).collect()
    label, sets = brute_components(texts, 85)
    assert len(got) == len(texts)
    for r in got:
        assert r["component_id"] == label[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    assert sorted((r["doc_id"], r["n_shingles"]) for r in got) == sorted((i, len(s)) for i, own in sets.items() for s in own)


def test_near_copies_of_null_ids_and_an_empty_table(spark):
    rows = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c")], "doc_id long, text string")
    got = sorted((tuple(r) for r in nearcopies.near_copies(rows).collect()), key=str)
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (None, 1, None, True)]
    assert nearcopies.near_copies(rows.limit(0)).count() == 0


def test_verification_leaves_sets_of_one_group():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 100, dtype=np.uint64)
    sets = [np.unique(np.r_[base[:98], rng.integers(0, 2**63, 2, dtype=np.uint64)]) for _ in range(200)]
    keys = nearcopies.band_keys(nearcopies.signatures(sets, 252), 6)
    pairs = []
    assert len(set(nearcopies.verified(np.arange(200), sets, keys, 85, pairs).tolist())) == 1
    assert sum(pairs) < 400  # of 19,900 pairs


@pytest.mark.parametrize("operator", ["near_copies", "jaccard"])
def test_a_giant_canopy_with_few_links_takes_linear_work(spark, operator):
    """A ring of documents, each sharing half of its words with its neighbours: one canopy, hardly a link."""
    run = nearcopies.near_copies if operator == "near_copies" else jaccard.link_components
    settings = {"percent": 80, "reach": 0.9} if operator == "jaccard" else {"bands": 84, "rows": 2}
    n = 200
    part = [[f"p{i}w{j}" for j in range(40)] for i in range(n)]
    texts = [(i, " ".join(part[i] + part[(i + 1) % n])) for i in range(n)]
    texts.append((n, " ".join([*part[5], *part[6][:-1], "other"])))
    trace = []
    got = run(documents(spark, texts), chunk_docs=8, chunk_tokens=10**6, trace=trace, **settings).collect()
    assert [r["doc_id"] for r in got if r["component_id"] != r["doc_id"]] == [n]
    all_to_all, by_keys = map(sum, zip(*trace, strict=True))
    assert all_to_all > n * n / 4 and sum(min(t) for t in trace) < 40 * n, (all_to_all, by_keys)


# clusters -----------------------------------------------------------------------------------------------------------


def brute_clusters(rows, k, rounds, dims, scale=1024):
    x = [(i, [int(np.floor(scale * float(c))) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and np.isfinite(c) for c in v)]
    hashed = sorted(x, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = np.array([v for _, v in hashed[:k]])
    v = np.array([v for _, v in x])
    for i in range(rounds + 1):
        d = ((v[:, None] - c[None]) ** 2).sum(2)
        own = d.argmin(1)
        if i < rounds:
            for j in range(len(c)):
                if (own == j).any():
                    c[j] = [int(s) // int((own == j).sum()) for s in v[own == j].sum(0)]
    least = d.min(1)
    sha = [hashlib.sha256(",".join(map(str, one.tolist())).encode()).hexdigest() for one in c]
    return [(i, int(o), int(m), int(least[own == o].sum()), int(least.sum()), sha[o]) for (i, _), o, m in zip(x, own, least, strict=True)]


@pytest.mark.parametrize(("k", "bounds", "block"), [(8, 3, 50), (8, 1, 7), (8, 7, 1000), (1, 3, 50), (20, 4, 64)])
def test_clusters_equal_brute_force(spark, k, bounds, block):
    rnd = random.Random(k)
    grid = lambda: [rnd.randrange(-2, 3) / 1024 for _ in range(4)]  # noqa: E731  small whole numbers: many ties
    rows = [(i, grid()) for i in range(300)] + [(7, grid()), (7, grid()), (None, grid()), (900, None), (901, [1.0] * 3)]
    rows += [(902, [1.0, None, 0.0, 0.0]), (903, [float("nan"), 0.0, 0.0, 0.0]), (904, [float("inf"), 0.0, 0.0, 0.0]), (905, [])]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    trace = []
    got = clusters.cluster_vectors(df, dims=4, k=k, rounds=4, bounds=bounds, block_rows=block, trace=trace).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_clusters(rows, k, 4, 4)))
    assert len(trace) == 5


def test_bounds_save_distances_and_shrink(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16)) * 4
    rows = [(i, (centres[i % 30] + rng.normal(size=16) * 0.05).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    trace = []
    got = clusters.cluster_vectors(df, dims=16, k=30, rounds=8, bounds=8, trace=trace).collect()
    assert sorted(map(tuple, got)) == sorted(brute_clusters([(i, np.float32(v).tolist()) for i, v in rows], 30, 8, 16))
    assert trace[0][2] == 90_000 and trace[-1][2] < 9_000 and trace[-1][0] < 8


def test_clusters_of_few_or_no_vectors_and_of_large_components(spark):
    df = spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0])], "vec_id long, embedding array<double>")
    got = clusters.cluster_vectors(df, dims=2)
    assert sorted((r["vec_id"], r["cluster"], r["distance"], r["inertia"]) for r in got.collect()) == [(1, 1, 0, 0), (2, 1, 0, 0)] or len(got.collect()) == 2
    empty = clusters.cluster_vectors(df.limit(0), dims=2)
    assert empty.count() == 0 and empty.columns == got.columns
    wide = spark.createDataFrame([(1, [-1e5, 0.0]), (2, [1e5, 0.0]), (3, [1e5, 1.0])], "vec_id long, embedding array<double>")
    assert {r["inertia"] for r in clusters.cluster_vectors(wide, dims=2).collect()} == {0}
    with pytest.raises(Exception, match="64-bit distances"):
        clusters.cluster_vectors(spark.createDataFrame([(1, [-1e300, 0.0])], "vec_id long, embedding array<double>"), dims=2).collect()


# all operators ------------------------------------------------------------------------------------------------------


def test_topk_refuses_components_that_64_bits_cannot_hold(spark):
    for bad in (-1e300, 1e300, -2e17):
        df = spark.createDataFrame([(20, [1.0, 1.0]), (1, [bad, 1.0])], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="64-bit scores"):
            topk.exact_topk(df).collect()


def test_columns_of_any_name_may_come_along(spark):
    docs = spark.createDataFrame(
        [(i, " ".join(words(40 + i, i)), "en", f"s{i % 3}", i) for i in range(12)], "doc_id long, text string, lang string, source string, n_chars long"
    )
    docs = clashing(docs)
    rows = lambda df: df.count()
    assert rows(mixing.mix_sources(docs)) >= 12 and {"blocks", "repeats"} <= set(mixing.mix_sources(docs).columns)
    assert rows(quality.quality_filter(docs)) <= 12 and rows(jaccard.one_of_each(docs)) == 12
    assert rows(substring.remove_repeats(docs)) == 12 and rows(lm.score_documents(docs)) == 12
    assert rows(packing.pack_documents(docs, "byte_bpe_50k.json")) >= 12
    assert rows(nearcopies.near_copies(docs)) == 12 and rows(divergence.source_divergence(docs)) >= 6
    vectors = clashing(spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "vec_id long, embedding array<float>"))
    assert rows(topk.exact_topk(vectors)) == 40 and rows(clusters.cluster_vectors(vectors, dims=2)) == 40
    pages = clashing(spark.createDataFrame([(1, "http://a.net/x", "<p>Some words here.</p>")], "page_id long, url string, html string"))
    assert rows(urlfilter.judge_urls(pages, {"net/": "block"})) == 1
    assert rows(pages.select(extract.extract(F.col("html")))) == 1
    talk = clashing(spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "ho")], "conv_id long, turn int, role string, text string"))
    assert rows(chat.read_back(chat.format_conversations(talk))) == 1
