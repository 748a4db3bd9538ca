"""Queries of booklets, hulls, curves and maps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import booklets, geometry
from ..registry import query
from ..sources.io import table


def _fields(spark, sf_dir):
    """Orders as booklets, the days of their lines in order as fields, some misread by a hundred days."""
    day = F.datediff("l_shipdate", F.lit("1992-01-01"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", day.alias("day"))
    order = Window.partitionBy("l_orderkey").orderBy("day")
    lines = lines.withColumn("at", F.row_number().over(order))
    off = F.when((F.col("l_orderkey") * 7 + F.col("at") * 3) % 6 == 0, 100).when((F.col("l_orderkey") + F.col("at")) % 11 == 0, -100).otherwise(0)
    read = (F.col("day") + off).cast("double")
    option = lambda by, cost: F.struct((read + by).alias("reading"), F.lit(cost).cast("long").alias("cost"))
    return lines.select("l_orderkey", "at", F.array(option(0, 0), option(-100, 3), option(100, 3), option(-10, 4)).alias("options"))


@query()
def booklet_repair(spark, sf_dir):
    """The cheapest days of each order's lines that never go back and never skip more than sixty days."""
    out = booklets.repaired(_fields(spark, sf_dir), "l_orderkey", "at", "options", 0, 60, 5, 9)
    shown = lambda c: F.array_join(F.transform(c, lambda x: x.cast("int").cast("string")), ",", "-")
    return out.select("l_orderkey", "cost", shown("chosen").alias("chosen"), shown("readings").alias("readings"), "flagged")


def _marks(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").where(F.size("embedding") >= 2)
    at = lambda i: F.floor(F.get("embedding", i).cast("double") * 1000)
    return e.select("vec_id", "label", at(0).alias("x"), at(1).alias("y")).dropna(subset=["x", "y"])


@query("""
with p as (select distinct label, floor(embedding[1]::double * 1000) as x, floor(embedding[2]::double * 1000) as y from embeddings where embedding[1] is not null and embedding[2] is not null),
s as (select a.label, a.x, a.y, b.x - a.x as dx, b.y - a.y as dy from p a join p b on a.label is not distinct from b.label and (a.x <> b.x or a.y <> b.y)),
h as (select s.label, s.x, s.y, dx, dy, min(dx * (p.y - s.y) - dy * (p.x - s.x)) as least, max(dx * (p.y - s.y) - dy * (p.x - s.x)) as high,
  max(dx * p.x + dy * p.y) - min(dx * p.x + dy * p.y) as wide from s join p on s.label is not distinct from p.label group by all having min(dx * (p.y - s.y) - dy * (p.x - s.x)) >= 0)
select label, count(distinct (x, y))::int as corners, round(min(high * wide / (dx * dx + dy * dy)), 3) as area from (
  select *, row_number() over (partition by label, x, y order by dx * dx + dy * dy desc) as k from h) where k = 1 group by label
""")
def least_rectangles(spark, sf_dir):
    """Hulls of the first two components of each label's vectors, and the least rectangles around them."""
    out = geometry.rectangles(_marks(spark, sf_dir), "label", "x", "y")
    return out.select("label", "corners", F.round("area", 3).alias("area"))


_SAMPLES, _HARMONICS = 64, 4


def _curves(spark, sf_dir):
    """Each user's events around a centre: the value is the distance, the hour of the event's number the angle."""
    e = table(spark, sf_dir, "events").where("value is not null").select("user_id", "event_id", "value")
    turn = F.col("event_id") * 0.37
    return e.select("user_id", "event_id", (F.col("value") * F.cos(turn)).alias("x"), (F.col("value") * F.sin(turn)).alias("y"))


@query(f"""
with p as (select user_id, event_id, value * cos(event_id * 0.37::double) as x, value * sin(event_id * 0.37::double) as y from events where value is not null),
g as (select *, lag(x) over w as bx, lag(y) over w as by_, lead(x) over w as ax, lead(y) over w as ay from p window w as (partition by user_id order by event_id)),
k as (select * from g where not coalesce(sqrt((x - (bx + ax) / 2) ** 2 + (y - (by_ + ay) / 2) ** 2) > 40 and sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) <= 40, false)),
s as (select user_id, event_id, x, y, coalesce(lead(x) over w, first_value(x) over w) as nx, coalesce(lead(y) over w, first_value(y) over w) as ny,
  row_number() over w as i, count(*) over (partition by user_id) as n from k window w as (partition by user_id order by event_id)),
l as (select *, sqrt((nx - x) ** 2 + (ny - y) ** 2) as len from s),
r as (select *, sum(len) over (partition by user_id order by i) as upto, sum(len) over (partition by user_id) as whole from l),
t as (select *, (upto - len) / whole * {_SAMPLES} as low, upto / whole * {_SAMPLES} as high from r where whole > 0),
e as (select *, unnest(range((case when i = 1 then 0 else ceil(round(low, 9)) end)::bigint, (case when i = n then {_SAMPLES} else ceil(round(high, 9)) end)::bigint)) as j from t),
f as (select user_id, j, x + least(greatest((j - low) / {_SAMPLES} * whole / nullif(len, 0), 0), 1) * (nx - x) as x, y + least(greatest((j - low) / {_SAMPLES} * whole / nullif(len, 0), 0), 1) * (ny - y) as y from e)
select user_id, k, round(sum(x * cos(2 * pi() * k * j / {_SAMPLES})), 3) as xc, round(sum(y * sin(2 * pi() * k * j / {_SAMPLES})), 3) as ys from f, (select unnest(range({_HARMONICS + 1})) as k)
group by user_id, k""")
def curve_harmonics(spark, sf_dir):
    """Terms of each user's closed curve without spikes, at equal arc lengths."""
    smooth = geometry.resampled(geometry.without_spikes(_curves(spark, sf_dir), "user_id", ["event_id"], "x", "y", 40.0), "user_id", "event_id", "x", "y", _SAMPLES)
    each = smooth.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_HARMONICS).cast("long"))))
    turn = 2 * F.pi() * F.col("k") * F.col("j") / _SAMPLES
    return each.groupBy("user_id", "k").agg(F.round(F.sum(F.col("x") * F.cos(turn)), 3).alias("xc"), F.round(F.sum(F.col("y") * F.sin(turn)), 3).alias("ys"))


@query()
def curve_low_pass(spark, sf_dir):
    """The smoothed curves themselves."""
    found = geometry.resampled(_curves(spark, sf_dir), "user_id", "event_id", "x", "y", _SAMPLES)
    return geometry.low_pass(found, "user_id", _SAMPLES, _HARMONICS).select("user_id", "j", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query()
def planted_map(spark, sf_dir):
    """The projective map planted between two views of all vectors' marks, a quarter of which went elsewhere."""
    m = _marks(spark, sf_dir).select("vec_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    px, py = geometry.mapped(F.lit(PLANTED), F.col("x"), F.col("y"))
    wrong = F.xxhash64(F.lit("wrong"), "vec_id") % 4 == 0
    seen = m.withColumn("u", F.when(wrong, F.col("y") * 3 + 70).otherwise(px)).withColumn("v", F.when(wrong, F.col("x") - 500).otherwise(py))
    found, n = geometry.consensus_map(seen, "vec_id", reach=0.5)
    return spark.createDataFrame([(i, round(h, 6), n) for i, h in enumerate(found)], "place int, number double, pairs long")


PLANTED = [1.2, -0.3, 40.0, 0.25, 0.9, -15.0, 0.0002, -0.0001]
