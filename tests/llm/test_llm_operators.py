"""Operators for training data: brute force, round trips, edge cases."""

from __future__ import annotations

import collections
import math
import random
import time
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weft.llm import chat, extract, graph, jaccard, lm, mixing, packing, quality, substring, topk, urlfilter

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, source="s"):
    """(id, text) rows with further columns of names that operators use inside."""
    rows = [(i, t, "en", source, len(t or ""), i, "x", "y") for i, t in texts]
    return spark.createDataFrame(rows, DOC + ", id long, tokens string, label string")


def words(n, seed, size=50):
    rnd = random.Random(seed)
    return [f"w{rnd.randrange(size)}" for _ in range(n)]


def test_chat_reads_back_exactly(spark):
    texts = ["</s>[INST] ok [/INST]", "<\\s>", "[\\\\AND]", "a[ROLE]b", None, "", "<s", "s>[", "é😀\n[AND]"]
    rows = [(1, i, "assistant" if i % 3 else "user", t) for i, t in enumerate(texts)]
    rows += [(2, None, None, "x"), (2, 0, "as[ROLE]sistant", "y"), (2, 0, "user", "y"), (2, 0, "user", "y"), (None, 0, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(r, t or "") for _, _, r, t in rows[: len(texts)]]
    assert got[1]["loss_text"] == "".join(t or "" for _, _, r, t in rows[: len(texts)] if r == "assistant")
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("", "x"), ("as[ROLE]sistant", "y"), ("user", "y"), ("user", "y")]
    assert len(got[None]["turns"]) == 1
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_ties_sort_by_raw_text_and_mask_what_is_read_back(spark):
    rows = [(1, 0, "assistant", "<s>"), (1, 0, "assistant", "<a"), (1, 0, "[ROLE]", "</s>"), (1, 0, "[AND]", None), (2, 1, None, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn int, role string, text string, turns string, segments int")
    done = chat.format_conversations(df)
    got = {r["conv_id"]: r for r in chat.read_back(done).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("[AND]", ""), ("[ROLE]", "</s>"), ("assistant", "<a"), ("assistant", "<s>")]
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("", "")]
    for r in done.collect():
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        masked = "".join(s["text"] for s in r["segments"] if s["loss"])
        assert masked == {1: "<a<\\s>", 2: ""}[r["conv_id"]] and got[r["conv_id"]]["loss_text"] == masked.replace("\\", "")


def test_extract_keeps_the_article_only():
    html = (
        "<html><head><title>T</title><script>var a='<p>no</p>'</script></head><body><header>Site</header>"
        "<nav><ul><li><a href=/>Home</a><li>More</ul></nav><div class='cookie-banner'>We use cookies</div>"
        "<article><h1>Big&amp;  news</h1><p>One.<p><b>Two\n<i>x</i>.<br>Three<div class=ad>Buy</div><form>f<input></form>"
        "<footer>tags</footer></article><aside>side</aside><section id=comments><p>Nice article, thanks a lot!</p></section>"
        "<footer>&copy; us</footer></body></html>"
    )
    assert extract.main_text(html) == "Big& news\nOne.\nTwo x.\nThree"
    assert extract.main_text(None) == extract.main_text("") == extract.main_text("<nav>x</nav>") == ""
    long = "word " * 40
    plain = f"<body><div><a href=/>A</a> | <a href=/b>B</a></div><h2>Head</h2><p>{long}</p><p>{long}</p><div>x</div></body>"
    assert extract.main_text(plain).startswith("Head\nword") and " | " not in extract.main_text(plain)


def test_extract_weighs_containers_by_their_text():
    long = ("word " * 40).strip()
    cards = "".join(f"<article><h3><a href=/{i}>Other story</a></h3><p>Short.</p></article>" for i in range(3))
    body = f"<body><div><h1>Head</h1><p>{long}</p><p>{long}</p></div><div>{cards}</div></body>"
    assert extract.main_text(body) == f"Head\n{long}\n{long}"
    links = "".join(f"<li><a href=/{i}>Some other page {i}</a></li>" for i in range(5))
    main = f"<main><h1><a href=/>Head</a></h1><p>{long}</p><p><a href=/s>See the source</a>.</p><p>Short.</p><ul>{links}</ul></main>"
    assert extract.main_text(f"<body>{main}<div>Made by us</div></body>") == f"Head\n{long}\nSee the source.\nShort."


def brute_text(lines, window, threshold, lone):
    """Surge and dive by definition, line by line, for lines of (text, letters outside less inside links, in main)."""
    weigh = lambda p: max(0, p)
    inside = sum(weigh(p) for _, p, m in lines if m)
    lone = lone and any(m and p > 0 for _, p, m in lines)
    decide = any(m for _, _, m in lines) and (lone or 2 * inside >= sum(weigh(p) for _, p, _ in lines))
    w = [0 if t is None or decide and not m else weigh(p) + decide * (threshold // 2) for t, p, m in lines]
    total = lambda i: sum(w[j] for j in range(i, min(i + window, len(w))) if all(lines[k][2] == lines[i][2] for k in range(i, j + 1)))
    least = min(threshold, max(map(total, range(len(w))), default=0))
    out, on = [], False
    for i, (text, _, m) in enumerate(lines):
        if i and m != lines[i - 1][2]:
            on = False
        end = next((j for j in range(i, len(lines)) if lines[j][2] != m), len(lines))
        on = (any(w[i:end]) if decide and m else total(i) > 0) if on else bool(w[i]) and total(i) >= least
        if on and text is not None and (w[i] or m):
            out.append(text)
    return "\n".join(out)


def test_extract_equals_brute_force_and_its_settings_matter():
    rnd = random.Random(8)
    changed = collections.Counter()
    for page in range(300):
        lines, html = [], ""
        for part in range(rnd.randrange(1, 4)):
            main = rnd.random() < 0.5
            own = []
            for _ in range(rnd.randrange(1, 9)):
                text = ("x" * rnd.choice([1, 9, 30, 100]))
                kind = rnd.choice("pppaab")
                own.append((f"<p>{text}</p>", (text, len(text), main)) if kind == "p" else
                           (f"<p><a href=/>{text}</a></p>", (text, -len(text), main)) if kind == "a" else ("<nav>menu</nav>", (None, 0, main)))
            html += ("<main>" if main else "<div>") + "".join(h for h, _ in own) + ("</main>" if main else "</div>")
            lines += [x for _, x in own]
        clean = []
        for x in lines:
            if x[0] is None:
                if clean and clean[-1][0] is not None:
                    clean.append((None, 0, clean[-1][2]))
            else:
                clean.append(x)
        texts = {}
        for window, threshold in ((3, 80), (1, 80), (3, 20)):
            texts[window, threshold] = extract.main_text(f"<body>{html}</body>", window, threshold)
            assert texts[window, threshold] == brute_text(clean, window, threshold, html.count("<main>") == 1), html
        kind = "main" if "<main>" in html else "plain"
        changed[kind, "window"] += texts[3, 80] != texts[1, 80]
        changed[kind, "threshold"] += texts[3, 80] != texts[3, 20]
    assert all(changed[k, x] > 5 for k in ("main", "plain") for x in ("window", "threshold")), changed


def test_extract_keeps_whole_articles():
    terms = "<div>Terms and conditions apply to all of the pages here. Read them before you go on, please.</div>"
    assert extract.main_text(f"<article><p>Short news item.</p></article>{terms}") == "Short news item."
    assert extract.main_text(f"{terms}<h1>Head</h1><main><p>Short news item.</p></main>{terms}") == "Head\nShort news item."
    prose = "The ministry said on Monday that the bridge will open in spring, after years of work."
    source = "<p><a href=/s>Source report of the ministry, with all tables and a list of names</a></p>"
    assert extract.main_text(f"<article><p>{prose}</p>{source}</article>").endswith("all tables and a list of names")
    links = "".join(f"<li><a href=/{i}>Part {i} of the report</a></li>" for i in range(4))
    text = extract.main_text(f"<article><p>{prose}</p><ul>{links}</ul><p>{prose}</p></article>")
    assert text.split("\n") == [prose, *[f"Part {i} of the report" for i in range(4)], prose]
    work = f"<div class=related-work><h2>Related work</h2><p>{prose}</p></div>"
    assert extract.main_text(f"<article><p>{prose}</p>{work}<p>End.</p></article>") == f"{prose}\nRelated work\n{prose}\nEnd."
    more = f"<div class='related share'>More:<ul>{links}</ul></div>"
    assert extract.main_text(f"<article><p>{prose}</p>{more}<p>End.</p></article>") == f"{prose}\nEnd."
    assert extract.main_text(f"<article><p>{prose}</p>{more.removesuffix('</div>')}") == prose
    assert extract.main_text(f"<article><p>{prose}</p></article><div>{prose} {prose}</div>") == prose


def test_extract_hostile_and_short_pages(spark):
    assert extract.main_text("<body><h1>Title</h1><p>Short news of forty letters in all here.</p></body>") == "Title\nShort news of forty letters in all here."
    assert extract.main_text("<article><p class=notice>Notice of the court, in an article.</p><p>More.</p></article>").startswith("Notice")
    for odd in ("<![foo[ x>", "<![%x]>", "<!x", "<", "<!--", "<![CDATA[", "</", "<a href='", "&#x110000;&#0;", "<?x"):
        assert extract.main_text(f"<article><p>Before it.</p></article>{odd}").startswith("Before it.")
    began = time.time()
    for n in (60_000,):
        extract.main_text("<b>" * n + "x" + "</i>" * n)
        extract.main_text("<i>" + "<p>" + "<b>" * n + "</i><hr>" * n)
        extract.main_text("<ul>" + "<b>" * n + "<li>" * n)
        extract.main_text("<div>" * n + "x" + "</p>" * n)
    assert time.time() - began < 30
    rows = [(1, None, 0), (2, "", 0), (3, "<p>x</p>", 0), (3, "<p>x</p>", 0), (4, "<p>" + "word " * 400_000, 1)]
    df = spark.createDataFrame(rows, "page_id long, html string, text int")
    got = df.select("page_id", extract.extract(F.col("html")).alias("out")).collect()
    assert sorted((r["page_id"], len(r["out"])) for r in got) == [(1, 0), (2, 0), (3, 1), (3, 1), (4, 1_999_999)]
    assert df.limit(0).select(extract.extract(F.col("html"))).count() == 0


def test_packing_covers_every_id_once_without_padding(spark):
    texts = [(i, " ".join(words(random.Random(i).randrange(0, 900), i))) for i in range(60)]
    texts += [(100, None), (101, ""), (102, "a<|endoftext|>b \t c"), (103, "big " * 9000), (7, "again"), (None, "no id")]
    df = documents(spark, texts)
    rows = packing.pack_documents(df, "byte_bpe_50k.json", size=256).collect()
    own = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    expected = {(i, zlib.crc32(b + np.array([1], "<u4").tobytes())): len(b) // 4 + 1 for (i, _), b in zip(texts, own.whole([t or "" for _, t in texts]), strict=True)}
    fills, total = collections.defaultdict(list), 0
    for r in rows:
        fills[r["sequence_id"]].append((r["offset"], r["length"]))
        total += r["length"]
    assert total == sum(expected.values())
    for parts in fills.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 256 or at & (at - 1) == 0
    for i in {i for i, _ in texts} - {7}:
        parts = sorted((r["start"], r["length"]) for r in rows if r["doc_id"] == i)
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False))
        assert sum(n for _, n in parts) == next(n for (j, _), n in expected.items() if j == i)
    assert packing.pack_documents(df.limit(0), "byte_bpe_50k.json").count() == 0


def test_packed_ids_are_those_of_the_tokenizer(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, given = packing.Encoder(path), Tokenizer.from_file(path)
    texts = [t for (t,) in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet' limit 300").fetchall()]
    rnd = random.Random(11)
    alphabet = " \n\t\r\x0b\x1c\u00a0\u3000aZ9é😀'.,<|endoftext|>\u200d'sdm\x00"
    texts += ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(3000)]
    for text, ids in zip(texts, own.whole([t or "" for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == given.encode(text or "", add_special_tokens=False).ids, text
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts[:400])], "doc_id long, text string, length int, start string")
    for r in packing.pack_documents(df, "byte_bpe_50k.json").collect():
        ids = [*given.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 1]
        piece = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert (zlib.crc32(piece), len(ids)) == (r["ids_crc32"], r["doc_tokens"])


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.125, (300, 16))
    x[200:260] = x[20]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(400, None), (420, [None] * 16), (440, [math.nan] * 16), (460, [math.inf] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.exact_topk(df, group_rows=70, slice_rows=4, part_rows=40, at_once=3, k=7).collect()}
    q = np.floor(64 * x).astype(int)
    for i in range(0, 300, 20):
        best = sorted((-int(q[i] @ q[j]), j) for j in range(300) if j != i)[:7]
        assert [got[i, r + 1] for r in range(7)] == [(j, -s) for s, j in best]
    assert len(got) == 15 * 7
    few = topk.exact_topk(df.where("vec_id in (0, 1, 2)")).collect()
    assert sorted((r["rank"], r["query_id"]) for r in few) == [(1, 0), (2, 0)]
    assert topk.exact_topk(df.limit(0)).count() == 0


def test_topk_stops_early_on_proof():
    rows = duckdb.sql("select vec_id, embedding from '/root/testdata/sf0.1/embeddings.parquet' where embedding is not null").fetchall()
    rows = [(i, v) for i, v in rows if None not in v and np.isfinite(v).all()]
    ids, x = np.array([i for i, _ in rows]), np.floor(64 * np.array([v for _, v in rows], np.float64)).astype(np.int64)
    asks = np.flatnonzero(ids % 20 == 0)
    seen, best = [], topk.Best(len(asks), 20)
    for i in range(0, len(ids), 500):
        topk.search_part(topk.Part(ids[i : i + 500], x[i : i + 500], topk.LEVELS), ids[asks], x[asks], best, seen)
    assert all(done < of for done, of, _ in seen)  # no part was read to its last segment
    assert seen[-1][2] < 500 * len(asks) / 4
    for row, a in enumerate(asks[:40]):
        expected = sorted((-int(x[a] @ x[j]), int(ids[j])) for j in range(len(ids)) if ids[j] != ids[a])[:20]
        assert [(-s, i) for s, i in expected] == list(zip(best.score[row].tolist(), best.id[row].tolist(), strict=True))
    far = topk.Best(1, 1)
    far.add(0, np.array([10**9]), np.array([5]))
    unread = []
    topk.search_part(topk.Part(ids, x, topk.LEVELS), ids[asks[:1]], x[asks[:1]], far, unread)
    assert not unread and far.id.tolist() == [[5]]


def test_topk_ties_repeats_lengths_and_large_numbers(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.5, 0.5]), (3, [1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (1, [1.0, 1.0]), (20, [2.0]), (40, []), (5, [])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, x int, id string")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.exact_topk(df, k=3).collect()}
    assert [got[0, r] for r in (1, 2, 3)] == [(1, 4096), (2, 4096), (2, 4096)]  # of 0's vectors the smaller one asks
    assert got[20, 1] == (3, 128 * 64) and got[40, 1] == (5, 0) and len(got) == 5
    big = spark.createDataFrame([(0, [2.0**24, 3.0]), (1, [2.0**24, 5.0])], "vec_id long, embedding array<double>")
    assert topk.exact_topk(big).collect()[0]["score"] == 2**60 + 15 * 64 * 64
    with pytest.raises(Exception, match="beyond"):
        topk.exact_topk(spark.createDataFrame([(0, [2.0**40])], "vec_id long, embedding array<double>")).collect()


def test_url_rules(spark):
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    urls = {
        "http://A.Example.NET/en/x?q": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "https://notexample.net/en/": ("notexample.net", "/en/", "net/", "block"),
        "http://x.net": ("x.net", "", None, "allow"), "http://example.com/de/#a": ("example.com", "/de/", "example.com/de/", "block"),
        "no scheme": ("", "", None, "allow"), "http://org/fr/": ("org", "/fr/", "org/fr/", "allow"), None: ("", "", None, "allow"),
        "http://a?b/c": ("a", "", None, "allow"), "": ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(u, "h") for u in urls], "url string, host string")
    got = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge_urls(df, rules).collect()}
    assert got == urls
    assert urlfilter.judge_urls(df.limit(0), rules).count() == 0


def test_index_confirms_stored_strings(tmp_path, monkeypatch):
    monkeypatch.setattr(urlfilter.xxhash, "xxh64_intdigest", lambda s: 7)
    urlfilter.RuleIndex.write({"a/": "block", "b/": "allow"}, str(tmp_path / "i"))
    index = urlfilter.RuleIndex(str(tmp_path / "i"))
    at = index.probe(["a/", "b/", "c/"])
    assert at[2] == -1 and [index.block[j] for j in at[:2]] == [1, 0]


def test_mixing_budgets(spark):
    rows = [(i, "x " * 20, "en", "big" if i % 10 else "small", 40, 0, "", "") for i in range(4000)]
    rows += [(None, None, None, None, None, 0, "", ""), (9000, "", "en", "small", 0, 0, "", ""), (0, "x " * 20, "en", "small", 40, 0, "", "")]
    df = spark.createDataFrame(rows, DOC + ", id long, tokens string, label string")
    out = mixing.mix_sources(df, max_repeats=3.0, block_docs=128)
    uses = {(r["doc_id"], r["source"]): r["count"] for r in out.groupBy("doc_id", "source").count().collect()}
    assert len(uses) == 4002 and min(uses.values()) == 1 and set(df.columns) <= set(out.columns)
    assert uses[9000, "small"] == 1 and uses[None, None] == 1
    by = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert by["big"] == 3600 and abs(by["small"] - 1203) < 10
    again = mixing.mix_sources(df, max_repeats=3.0, block_docs=128).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in again} == by
    flat = mixing.source_weights(df.select("source", mixing.words_of(F.col("text")).alias("tokens")), 100.0, 0.8).collect()
    w = [r["weight"] for r in flat if r["weight"]]
    assert abs(-sum(x * math.log(x) for x in w) / math.log(2) - 0.8) < 1e-6 and abs(sum(w) - 1) < 1e-9
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_mixing_equals_brute_force(spark):
    rnd = random.Random(2)
    rows = [(i, "x " * rnd.randrange(1, 60), "en", rnd.choice("aaaaaabbc"), 1) for i in range(600)]
    df = spark.createDataFrame(rows, DOC)
    out = mixing.mix_sources(df, max_repeats=2.5, block_docs=10**6).collect()
    total = collections.Counter()
    for _, t, _, s, _ in rows:
        total[s] += len(t.split())
    low, high = 0.0, 1.0  # the flattest exponent under the limit
    for _ in range(100):
        a = (low + high) / 2
        low, high = (a, high) if (max(total.values()) / min(total.values())) ** (1 - a) > 2.5 else (low, a)
    order = collections.defaultdict(list)
    for r in out:
        order[r["source"]].append((r["_weft_rank"], r["doc_id"], r["_weft_tokens"]))
    uses = collections.Counter(r["doc_id"] for r in out)
    for source, docs in order.items():
        repeats = (total[source] / max(total.values())) ** (high - 1)
        spent = 0
        for _, doc, tokens in sorted(set(docs)):
            spent += tokens
            extra = spent - tokens / 2 <= (repeats - math.floor(repeats)) * total[source]
            assert uses[doc] == math.floor(repeats) + (extra and repeats > math.floor(repeats)), (source, doc)
        assert sorted(d for _, d, _ in set(docs)) == sorted(i for i, _, _, s, _ in rows if s == source)


def brute_spans(texts, window):
    first, out = {}, {}
    split = {i: (t or "").encode().split() for i, t in texts if i is not None}
    for i in sorted(split):
        for at in range(len(split[i]) - window + 1):
            first.setdefault(tuple(split[i][at : at + window]), i)
    for i, ws in split.items():
        gone = set()
        for at in range(len(ws) - window + 1):
            if first[tuple(ws[at : at + window])] < i:
                gone |= set(range(at, at + window))
        out[i] = [w for k, w in enumerate(ws) if k not in gone]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_spans_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    shared = [words(rnd.randrange(15, 80), 100 * seed + k, 400) for k in range(4)]
    texts = []
    for i in range(60):
        parts = [words(rnd.randrange(0, 40), 1000 * seed + i, 400)]
        for _ in range(rnd.randrange(3)):
            p = rnd.choice(shared)
            a = rnd.randrange(len(p))
            parts += [p[a:], words(rnd.randrange(9), rnd.random(), 400)]
        texts.append((i, rnd.choice([" ", "\n", "  "]).join(w for p in parts for w in p)))
    texts += [(70, None), (71, ""), (72, texts[5][1]), (None, texts[5][1]), (73, "a " * 60), (74, "a " * 90)]
    out = substring.remove_repeats(documents(spark, texts), window=12, anchor=5)
    got = {r["doc_id"]: r for r in out.collect()}
    for i, kept in brute_spans(texts, 12).items():
        assert (got[i]["text"] or "").encode().split() == kept, i
        assert got[i]["_weft_words"] - got[i]["_weft_removed"] == len(kept)
    assert got[None]["text"] == texts[5][1] and got[70]["text"] is None and got[70]["lang"] == "en"
    assert substring.remove_repeats(documents(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("n", [13, 16, 40])
def test_spans_repeated_within_their_first_document(spark, n):
    a, b, p, q, s = (words(n if k == 2 else 30, 50 + k, 10**6) for k in range(5))
    twice = [*q, *p, *s, *q, *p, *s]
    texts = [(1, " ".join([*a, *p, *b])), (2, " ".join(twice)), (3, " ".join([*s, *q])), (3, " ".join([*b, *twice]))]
    texts += [(4, " ".join(twice)), (4, " ".join([*a, *twice]))]
    rows = substring.remove_repeats(documents(spark, texts), window=12, anchor=5).collect()
    kept = brute_spans(texts[:2], 12)
    assert [r["text"].split() for r in rows if r["doc_id"] == 2] == [[w.decode() for w in kept[2]]]
    assert len(kept[2]) == 120
    rows = substring.remove_repeats(documents(spark, [texts[0], (2, texts[1][1]), (2, texts[1][1] + " end")]), window=12, anchor=5)
    assert sorted(len(r["text"].split()) for r in rows.collect() if r["doc_id"] == 2) == [120, 121]


def brute_links(texts, k):
    sets = {}
    for i, t in texts:
        ws = (t or "").encode().lower().split()
        own = {tuple(ws[a : a + k]) for a in range(len(ws) - k + 1)} if len(ws) >= k else {tuple(ws)} if ws else set()
        sets[i] = own
    label = {i: i for i in sets}
    for i in sets:
        for j in sets:
            o = len(sets[i] & sets[j])
            if i < j and o and 180 * o >= 80 * (len(sets[i]) + len(sets[j])):
                a, b = label[i], label[j]
                label = {x: min(a, b) if y in (a, b) else y for x, y in label.items()}
    return label, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("limits", [{}, {"chunk_tokens": 60, "chunk_docs": 5}])
def test_links_equal_brute_force(spark, limits):
    rnd = random.Random(4)
    base = [words(rnd.randrange(6, 90), k, 500) for k in range(6)]
    texts = []
    for i in range(110):
        ws = list(base[i % 6])
        for _ in range(rnd.randrange(4)):
            ws[rnd.randrange(len(ws))] = f"e{rnd.randrange(99)}"
        texts.append((i, " ".join(ws[: len(ws) - rnd.randrange(3)])))
    texts += [(200, None), (201, ""), (202, "One two"), (203, "one TWO"), (204, "one two three"), (205, texts[3][1].upper())]
    label, size = brute_links(texts, 5)
    df = documents(spark, [*texts, (None, texts[3][1])])
    rows = jaccard.link_components(df, **limits).collect()
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in rows}
    assert {i: g for i, g in got.items() if i is not None} == {i: (label[i], size[i]) for i in label}
    assert got[None][0] is None and len(rows) == len(texts) + 1
    kept = {r["doc_id"] for r in jaccard.one_of_each(df, **limits).collect()}
    assert kept == {*label.values(), None}


def test_tree_leaves_subtrees_without_open_sets():
    rng = np.random.default_rng(1)
    base = [np.unique(rng.integers(0, 2**63, 40).astype(np.uint64)) for _ in range(12)]
    sets = []
    for i in range(240):
        own = base[i % 12].copy()
        own[: rng.integers(0, 9)] = i
        sets.append(np.unique(own))
    expected = np.arange(240)
    for i in range(240):
        for j in range(i):
            o = len(np.intersect1d(sets[i], sets[j]))
            if 180 * o >= 80 * (len(sets[i]) + len(sets[j])):
                expected[expected == expected[i]] = expected[j]
    visited = []
    got = jaccard.tree_join(sets, np.arange(240), visited=visited)
    same = lambda x: np.unique(x, return_inverse=True)[1]
    first = lambda x: [int(np.flatnonzero(x == v)[0]) for v in x]
    assert first(same(got)) == first(same(expected))
    bounded = jaccard.tree_join(sets, np.arange(240), step=3)
    assert first(same(bounded)) == first(same(expected))
    singles = sum(high - low == 1 for low, high in visited)
    assert singles < 240  # sets in subtrees that were left, or whose pairs were closed above
    every = []
    jaccard.tree_join(sets, np.zeros(240, int), visited=every)
    assert not every  # one group: nothing is open


def test_chain_of_links(spark):
    n = 2000
    chain = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["component"] for r in graph.components(chain).collect()} == {0}
    calls = []
    hooks = graph._hooks
    graph._hooks = lambda *a: calls.append(1) or hooks(*a)
    try:
        mixed = spark.range(n).select((F.col("id") * 7919 % 5003).alias("a"), ((F.col("id") + 1) * 7919 % 5003).alias("b"))
        out = graph.components(mixed.unionByName(spark.createDataFrame([(9000, 9001), (None, 1)], "a long, b long")))
    finally:
        graph._hooks = hooks
    assert {r["component"]: r["count"] for r in out.groupBy("component").count().collect()} == {0: n + 1, 9000: 2}
    assert len(calls) <= 15


def test_a_common_line_ties_no_canopy_of_documents_that_cannot_link(spark):
    rng = np.random.default_rng(5)
    line = [" ".join(f"l{j}x{i}" for i in range(34)) for j in range(2)]
    own = lambda i, n: " ".join(f"d{i}x{w}" for w in rng.integers(0, 10**6, n))
    texts = [(i, f"{line[i % 2]} {own(i, 50)}") for i in range(240)]
    texts += [(1000 + i, texts[i][1] + " more") for i in range(0, 240, 40)]
    trace = []
    got = {r["doc_id"]: r["component_id"] for r in jaccard.link_components(documents(spark, texts), chunk_docs=16, chunk_tokens=10**6, trace=trace).collect()}
    assert got == brute_links(texts, 5)[0] and got[1040] == 40
    assert sum(min(x) for x in trace) < 240  # hardly a row meets between chunks


def test_links_of_an_empty_table(spark):
    assert jaccard.link_components(documents(spark, [(1, "x")]).limit(0)).count() == 0


def test_quality_counts_and_hosts(spark):
    good, bad = " ".join(f"w{i}" for i in range(30)), "a b c d e f g h " * 5
    texts = [(1, good), (2, bad), (3, None), (4, ""), (5, "#a\n \n#a\n" + good), (6, good), (6, good)]
    got = {r["doc_id"]: r for r in quality.quality_table(documents(spark, texts, None)).collect()}
    assert (got[1]["kept"], got[2]["kept"], got[3]["kept"], got[4]["kept"]) == (True, False, False, False)
    assert got[2]["n_repeat_words"] == 40 and got[5]["n_dup_lines"] == 1 and got[5]["n_symbols"] == 2
    assert got[5]["word_chars"] == 4 + len(good.replace(" ", ""))
    hosts = documents(spark, [(i, bad) for i in range(200)], "junk").unionByName(
        documents(spark, [(999, good)], "junk")).unionByName(documents(spark, [(1000 + i, good) for i in range(200)], "fine"))
    kept = {r["doc_id"] for r in quality.quality_filter(hosts).collect()}
    assert kept == {999, *range(1000, 1200)}  # with two hosts, one bad, the mean rate is a half
    assert quality.quality_table(hosts.limit(0)).count() == 0


def test_a_bad_host_among_others(spark):
    good, bad, odd = " ".join(f"w{i}" for i in range(30)), "a b c d e f g h " * 5, "## $$ %% && ** " * 8
    odd = " ".join(f"{x}{i}%%%%%" for i, x in enumerate(odd.split()))
    rows, at = [], 0
    shares = {f"h{k}": (60, 0.05 + k / 200) for k in range(18)} | {"bad": (80, 0.85), "small": (2, 0.5), None: (30, 0.1)}
    for host, (n, share) in shares.items():
        for i in range(n):
            rows.append((at, bad if i < n * share else good, "en", host, 1))
            at += 1
    rows += [(10_000 + i, odd, "en", "symbols", 1) for i in range(40)]
    df = spark.createDataFrame(rows, DOC)
    kept = collections.Counter(r["source"] for r in quality.quality_filter(df).collect())
    assert "bad" not in kept and "symbols" not in kept and kept["small"] == 1 and kept[None] == 27
    assert all(kept[f"h{k}"] == 60 - math.ceil(60 * (0.05 + k / 200)) for k in range(18))
    table = quality.quality_table(df).collect()
    assert sum(not r["kept"] and not r["base_failed"] for r in table) == 12 + 40


def test_scores_equal_a_sequential_automaton(spark):
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(12)]
    docs = [(i, " ".join(rnd.choice(vocab[: int(2 + rnd.random() * 10)]) for _ in range(rnd.randrange(60)))) for i in range(120)]
    docs += [(500, None), (501, ""), (502, "unseen words only W1"), (503, "w1 w2"), (None, "w1")]
    df = documents(spark, docs).repartition(3)
    got = {r["doc_id"]: r for r in lm.score_documents(df, block_tokens=300, buckets=5).collect()}
    tokens = {i: (t or "").lower().split() + ["\n"] for i, t in docs}
    train = [t for i, t in tokens.items() if not lm.held_out(i)]
    uni = collections.Counter(w for t in train for w in t)
    n, v = sum(uni.values()), len(uni)
    count = {(w,): c for w, c in uni.items()}
    for k in (2, 3):
        count |= collections.Counter(tuple(x[i : i + k]) for x in train for i in range(len(x) - k + 1))

    def p(context, word):
        if not context:
            return (uni[word] + 0.1) / (n + 0.1 * (v + 1))
        if context not in count:  # no such state
            return p(context[1:], word)
        s = (50.0, 5.0)[len(context) - 1]
        return (count.get((*context, word), 0) + s * p(context[1:], word)) / (count[context] + s)

    arcs = {}  # of each state: arcs by word, and the failure arc
    for g in count:
        arcs.setdefault(g[:-1], {})[g[-1]] = math.log10(p(g[:-1], g[-1]))
    fails = {h: math.log10((50.0, 5.0)[len(h) - 1] / (count[h] + (50.0, 5.0)[len(h) - 1])) for h in arcs if h}
    assert len([h for h in arcs if len(h) == 2]) > 100
    for h in [("w0",), ("w0", "w1"), ("w1", "w0")]:
        assert abs(sum(p(h, w) for w in [*uni, "other"]) - 1) < 1e-9

    def traversed(ws):
        state, total = (), 0.0
        for w in ws:
            while state and w not in arcs[state]:
                total += fails[state]
                state = state[1:]
            total += arcs[state][w] if w in arcs[state] else math.log10(p((), w))
            state = next((h for h in ((*state[-1:], w), (w,)) if len(h) < 3 and h in arcs), ())
        return total

    for i, t in tokens.items():
        score = sum(math.log10(p(tuple(t[max(0, k - 2) : k]), w)) for k, w in enumerate(t))
        base = sum(math.log10(p((), w)) for w in t)
        assert abs(score - traversed(t)) < 1e-6
        assert abs(got[i]["score"] - score) < 1e-6 and abs(got[i]["base_score"] - base) < 1e-6
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(t), sum(uni[w] > 0 for w in t), n)
    out = {r["doc_id"]: r for r in lm.score_documents(documents(spark, [d for d in docs if lm.held_out(d[0])])).collect()}
    assert all(r["train_tokens"] == 0 and r["score"] == r["base_score"] == 0 for r in out.values())
    assert lm.score_documents(df.limit(0)).count() == 0
