"""Queries that draw units anew, summarise draws by segment, and try every combination of settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models, panel, ranks, resampling
from ..registry import query
from ..sources.io import table
from .models import _COHORT, _POOLS, _cohort
from .panel import _PAIRS

DRAWS = 20
_POISSON = " + ".join(f"(x >= {c!r}::double)::int" for c in resampling.POISSON)
_GROWTH = _PAIRS + """,
g as (select o_custkey, year(o_orderdate)::int as year, gap_years, prev_o_totalprice as weight,
  (power(o_totalprice / prev_o_totalprice, 1 / gap_years) - 1) * 100 as growth from p where gap_years > 0 and prev_o_totalprice > 0 and o_totalprice > 0)"""


def _growth(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    o = panel.consecutive_pairs(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_totalprice"], "o_orderdate")
    g = panel.annualised_growth(F.col("o_totalprice"), F.col("prev_o_totalprice"), F.col("gap_years"))
    return o.select("o_custkey", F.year("o_orderdate").alias("year"), "gap_years", F.col("prev_o_totalprice").alias("weight"), g.alias("growth")).where("growth is not null")


@query(_GROWTH + f""",
b as (select * from g where gap_years > 0.5 and gap_years < 2.5),
u as (select o_custkey, draw, ('0x' || md5('unit-' || draw || '-' || o_custkey)[1:8])::bigint / 4294967296.0::double as x
  from (select distinct o_custkey from b), range(0, {DRAWS + 1}) t(draw)),
m as (select o_custkey, draw, case when draw = 0 then 1 else {_POISSON} end as w from u),
c as (select year, draw, growth, sum(w) over (partition by year, draw order by growth) as upto, sum(w) over (partition by year, draw) as total
  from b join m using (o_custkey)),
d as (select year, draw, min(growth) filter (where 2 * upto >= total and total > 0) as med from c group by all)
select year, round(max(med) filter (where draw = 0), 6) as median, round(quantile_cont(med, 0.05) filter (where draw > 0), 6) as low,
  round(quantile_cont(med, 0.95) filter (where draw > 0), 6) as high from d group by 1""")
def cluster_bootstrap(spark, sf_dir):
    """Median growth by year, with bounds from draws of whole customers."""
    rows = _growth(spark, sf_dir).where("gap_years > 0.5 and gap_years < 2.5")
    d = resampling.bootstrap_medians(rows, ["year"], "o_custkey", "growth", DRAWS)
    drawn = F.array_sort(F.collect_list(F.when(F.col("draw") > 0, F.col("median"))))  # a number a draw
    at = lambda p: (F.size("s") - 1) * F.lit(p)
    low = lambda p: F.get("s", F.floor(at(p)).cast("int"))
    between = lambda p: low(p) + (F.get("s", F.ceil(at(p)).cast("int")) - low(p)) * (at(p) - F.floor(at(p)))
    out = d.groupBy("year").agg(F.max(F.when(F.col("draw") == 0, F.col("median"))).alias("m"), drawn.alias("s"))
    return out.select("year", F.round("m", 6).alias("median"), F.round(between(0.05), 6).alias("low"), F.round(between(0.95), 6).alias("high"))


@query()
def index_bootstrap(spark, sf_dir):
    """Repeat-sales index with bounds by refits over draws of customers; held against refits of copied rows by a test."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    o = panel.consecutive_pairs(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_totalprice"], "o_orderdate").where("gap_years > 0.5 and gap_years < 2.5")
    days = F.round(F.col("gap_years") * panel.YEAR_DAYS).cast("int")
    pairs = o.select(
        "o_custkey", F.year(F.date_sub("o_orderdate", days)).alias("year0"), F.year("o_orderdate").alias("year1"), F.col("gap_years").alias("gap"),
        F.ln(F.col("o_totalprice") / F.col("prev_o_totalprice")).alias("y"),
    )
    first, last = pairs.agg(F.min("year0"), F.max("year1")).collect()[0]
    drawn = resampling.index_draws(pairs, "o_custkey", list(range(first, last + 1)) if first else [0, 1], DRAWS)
    g = F.col("growth_pct")
    own = drawn.groupBy("year").agg(F.max(F.when(F.col("draw") == 0, g)).alias("growth_pct"), F.stddev_samp(F.when(F.col("draw") > 0, g)).alias("error"))
    return own.join(ranks.quantiles(drawn.where("draw > 0"), ["year"], "growth_pct", {"low": 0.05, "high": 0.95}), "year")


@query(_COHORT + f""",
d as (select unnest(range(1, {DRAWS + 1})) as draw),
x as (select draw, o_custkey, u.c_nationkey, greatest(c_acctbal, 1) as w, ('0x' || md5('r-' || draw || '-' || o_custkey)[1:8])::bigint / 4294967296.0::double < chance as renews,
  ('0x' || md5('p-' || draw || '-' || o_custkey)[1:8])::bigint / 4294967296.0::double as v from u join customer on o_custkey = c_custkey, d),
g as (select *, (case when renews then least(2.5 + [-4.0, -1, 0, 2, 3][floor(v * 5)::int + 1], 5.0) else 4.0 + [-9.0, -2, 1, 5][floor(v * 4)::int + 1] end)::double as growth from x),
s as (select draw, null as c_nationkey, true as whole, count(*) as units, median(growth) as m, sum(growth * w) / sum(w) as a from g group by 1
  union all select draw, c_nationkey, false, count(*), median(growth), sum(growth * w) / sum(w) from g group by 1, 2)
select whole, c_nationkey, max(units)::bigint as units, round(quantile_cont(m, 0.05), 6)::double as median_low, round(quantile_cont(m, 0.5), 6)::double as median_mid,
  round(quantile_cont(m, 0.95), 6)::double as median_high, round(quantile_cont(a, 0.05), 6)::double as weighted_low, round(quantile_cont(a, 0.95), 6)::double as weighted_high
from s group by 1, 2""")
def cohort_segments(spark, sf_dir):
    """Percentiles over simulated draws, of the whole cohort and of each nation."""
    rows = [(1 - k, i, r, len(pool)) for k, pool in enumerate(_POOLS) for i, r in enumerate(pool)]
    pools = spark.createDataFrame(rows, "renews int, at long, residual double, n int")
    units = _cohort(spark, sf_dir).withColumn("center1", F.lit(2.5)).withColumn("center0", F.lit(4.0))
    drawn = models.simulated_cohort(units, F.broadcast(pools), "o_custkey", DRAWS, 5.0)  # nine rows
    weight = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", F.greatest("c_acctbal", F.lit(1.0)).alias("w"))
    s = resampling.summarised_draws(drawn.join(weight, "o_custkey"), ["c_nationkey"], "growth", "w")
    by, wide = ["whole", "c_nationkey"], {}
    for name, points in (("median", {"median_low": 0.05, "median_mid": 0.5, "median_high": 0.95}), ("weighted", {"weighted_low": 0.05, "weighted_high": 0.95})):
        wide[name] = ranks.quantiles(s, by, name, points, {f"units_{name}": F.lit(0)})
    units = s.groupBy(*by).agg(F.max("units").alias("units"))
    same = lambda a, b: (a.whole == b.whole) & a.c_nationkey.eqNullSafe(b.c_nationkey)
    m, a = wide["median"], wide["weighted"]
    out = units.join(m, same(units, m)).drop(m.whole, m.c_nationkey).join(a, same(units, a)).drop(a.whole, a.c_nationkey)
    return out.select(*by, "units", *[F.round(c, 6).alias(c) for c in ("median_low", "median_mid", "median_high", "weighted_low", "weighted_high")])


WINDOWS = {"narrow": (0.75, 1.25), "base": (0.5, 2.5), "wide": (0.25, 4.0)}


@query(_GROWTH + f""",
x as (select gap_window, year, growth, weight from g join (values {", ".join(f"('{k}', {a}::double, {b}::double)" for k, (a, b) in WINDOWS.items())}) t(gap_window, a, b)
  on gap_years > a and gap_years < b),
q as (select gap_window, quantile_cont(growth, 0.05) as lo, quantile_cont(growth, 0.95) as hi from x group by 1),
y as (select gap_window, year, policy, weight, case policy when 'keep' then growth when 'winsorise' then least(greatest(growth, lo), hi)
  else case when growth between lo and hi then growth end end as v from x join q using (gap_window), (values ('keep'), ('winsorise'), ('trim')) t(policy))
select gap_window, policy, year, count(*) as n, round(median(v), 6) as median, round(avg(v), 5) as mean, round(sum(v * weight) / sum(weight), 5) as weighted
from y where v is not null group by all""")
def sensitivity_cube(spark, sf_dir):
    """Growth by gap window, outlier policy, aggregator and year."""
    s = resampling.sensitivity(_growth(spark, sf_dir), WINDOWS, "gap_years", "year", "growth", "weight", 0.05)
    return s.select("gap_window", "policy", "year", "n", F.round("median", 6).alias("median"), F.round("mean", 5).alias("mean"), F.round("weighted", 5).alias("weighted"))
