"""Radius joins, polygon measures, resampling, lookups, splits, tiered matches and quoted sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def neighbours_within(points: DataFrame, key: str, x: str, y: str, radius: float) -> DataFrame:
    """key, n_near: other points within radius. Equal places are joined once, over a grid of cells as wide as the radius."""
    at = points.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    cell = lambda c: F.floor(F.col(c) / radius)
    steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    left = at.select("x", "y", F.explode(F.transform(steps, lambda i: cell("x") + i)).alias("cx"), cell("y").alias("ry"))
    left = left.select("x", "y", "cx", F.explode(F.transform(steps, lambda i: F.col("ry") + i)).alias("cy"))
    right = at.select(F.col("x").alias("x2"), F.col("y").alias("y2"), "n", cell("x").alias("cx"), cell("y").alias("cy"))
    dx, dy = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
    near = left.join(right, ["cx", "cy"]).where(dx * dx + dy * dy <= radius * radius)
    near = near.groupBy("x", "y").agg((F.sum("n") - 1).alias("n_near"))
    return points.select(key, F.col(x).alias("x"), F.col(y).alias("y")).join(near, ["x", "y"]).select(key, "n_near")


def polygon_measures(shape: str, digits: int) -> list[Column]:
    """Signed area, outline length, width and height of a closed polygon: an array of structs of x and y."""
    s, n = F.col(shape), F.size(shape)
    corners = F.transform(s, lambda p, i: F.struct(p.alias("a"), F.get(s, (i + 1) % n).alias("b")))

    def total(term) -> Column:
        return F.aggregate(F.transform(corners, lambda c: term(c["a"], c["b"])), F.lit(0.0), lambda t, v: t + v)

    def span(c: str) -> Column:
        return F.array_max(s[c]) - F.array_min(s[c])

    measures = {
        "signed_area": total(lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]) / 2,
        "outline": total(lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"])), "width": span("x"), "height": span("y"),
    }
    return [F.round(c, digits).alias(name) for name, c in measures.items()]


def centred_cosine(a: str, b: str) -> Column:
    def centred(c: str) -> Column:
        v = F.transform(c, lambda e: e.cast("double"))
        mean = F.aggregate(v, F.lit(0.0), lambda t, e: t + e) / F.size(c)
        return F.transform(v, lambda e: e - mean)

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda t, e: t + e)

    x, y = centred(a), centred(b)
    return dot(x, y) / F.sqrt(dot(x, x) * dot(y, y))


def bootstrap_median(values: DataFrame, group: str, order: str, value: str, draws: int, digits: int) -> DataFrame:
    """5 % and 95 % points of the median over hashed draws with replacement, by group; a group is an array of a few values."""
    s = values.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(order, value)))[value].alias("all"))
    s = s.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    slot = F.explode(F.sequence(F.lit(1), F.size("all"))).alias("i")
    s = s.select(group, "draw", "all", slot)
    u = F.conv(F.substring(F.md5(F.concat_ws("-", group, "draw", "i")), 1, 8), 16, 10).cast("long")
    s = s.withColumn("v", F.get("all", F.floor(u * F.size("all") / F.lit(2.0**32)).cast("int")))
    m = s.groupBy(group, "draw").agg(F.median("v").alias("med"))
    return m.groupBy(group).agg(*[F.round(F.percentile("med", p), digits).alias(n) for n, p in (("low", 0.05), ("high", 0.95))])


def hashed_split(key: str, test_share: float) -> Column:
    """train or test by the key's md5, so that a group never falls into both."""
    h = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 4), 16, 10).cast("long")
    return F.when(h < int(test_share * 65536), "test").otherwise("train")


def piecewise_linear(p: Column, knots: list[tuple[float, float]]) -> Column:
    """Linear between knots, clipped outside."""
    out = F.when(p <= knots[0][0], F.lit(knots[0][1]))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:], strict=False):
        out = out.when(p <= x1, y0 + (p - x0) / (x1 - x0) * (y1 - y0))
    return out.otherwise(F.lit(knots[-1][1]))


def pooled_rate(df: DataFrame, group: str, hit: str, least: int, digits: int) -> DataFrame:
    """A group's own rate from `least` rows on, else the rate of all."""
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(hit).cast("int")).alias("hits"))
    whole = g.agg((F.sum("hits") / F.sum("n")).alias("pooled")).collect()[0][0]  # one number
    rate = F.when(F.col("n") >= least, F.col("hits") / F.col("n")).otherwise(F.lit(whole))
    return g.select(group, "n", F.round(rate, digits).alias("rate"), (F.col("n") < least).alias("is_pooled"))


def tiered_match(left: DataFrame, right: DataFrame, target: str, tiers: list[tuple[list[str], float]]) -> DataFrame:
    """left with the smallest target of the first tier of keys that has one, and that tier's confidence."""
    hits = []
    for i, (keys, _) in enumerate(tiers):
        left = left.join(right.groupBy(*keys).agg(F.min(target).alias(f"_t{i}")), keys, "left")
        hits.append(F.col(f"_t{i}"))
    sure = F.coalesce(*[F.when(h.isNotNull(), F.lit(c)) for h, (_, c) in zip(hits, tiers, strict=True)])
    return left.withColumn(target, F.coalesce(*hits)).withColumn("confidence", sure)


def background_mean(base: Column, values: list[float], slope: float) -> Column:
    """Mean logistic score when one feature takes each background value."""
    scores = F.transform(F.array(*map(F.lit, values)), lambda v: 1 / (1 + F.exp(-(base + slope * v))))
    return F.aggregate(scores, F.lit(0.0), lambda t, s: t + s) / len(values)


def quoted_sources(quotes: DataFrame, docs: DataFrame, quote_id: str, quote: str, doc_id: str, text: str) -> DataFrame:
    """Quotes with the number of documents that hold them word for word, case and white space aside.

    A quote's first five words (all, if it has fewer) are looked up among the documents' windows of as many words; whole
    quotes are then compared. Null quotes and texts are left out by the caller."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), "[ \\t\\n\\r]+", " "))
    gram = lambda w, i, k: F.xxhash64(F.array_join(F.slice(w, i, k), " "))
    q = quotes.select(quote_id, plain(quote).alias("quote")).withColumn("w", F.split("quote", " "))
    q = q.withColumn("k", F.least(F.size("w"), F.lit(5)))
    lengths = [r["k"] for r in q.select("k").distinct().collect()]  # at most five
    q = q.select(quote_id, "quote", gram(F.col("w"), F.lit(1), F.col("k")).alias("g"))
    d = docs.select(doc_id, plain(text).alias("body")).withColumn("w", F.split("body", " "))
    none = F.array().cast("array<long>")

    def windows(k: int) -> Column:
        starts = F.sequence(F.lit(1), F.size("w") - (k - 1))
        return F.when(F.size("w") >= k, F.transform(starts, lambda i: gram(F.col("w"), i, F.lit(k)))).otherwise(none)

    grams = d.select(doc_id, F.explode(F.array_distinct(F.concat(none, *map(windows, lengths)))).alias("g"))
    may = grams.join(q, "g").select(quote_id, "quote", doc_id)
    pad = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    held = may.join(d.select(doc_id, "body"), doc_id).where(F.contains(pad("body"), pad("quote")))
    counts = held.groupBy(quote_id).agg(F.count(F.lit(1)).alias("n_sources"), F.min(doc_id).alias("first_source"))
    out = q.select(quote_id).join(counts, quote_id, "left")
    return out.withColumn("n_sources", F.coalesce("n_sources", F.lit(0).cast("long")))
