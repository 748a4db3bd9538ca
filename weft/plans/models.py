"""Queries of estimates, errors, cohorts, trends and model checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import models, panel, stats
from ..registry import query
from ..sources.io import table
from .records import _SCORED, _scored
from .rules import _ERRORS, _errors


@query(_SCORED + """,
b as (select least(floor(p * 10), 9) as bin, count(*) as n, avg(p) as conf, avg(quality) as acc from s group by 1)
select round(sum(n * abs(conf - acc)) / sum(n), 6) as ece, count(*) as bins, sum(n)::bigint as n from b""")
def calibration_error(spark, sf_dir):
    b = stats.calibration_bins(_scored(spark, sf_dir), "p", "quality")
    return b.agg(
        F.round(F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n"), 6).alias("ece"),
        F.count(F.lit(1)).alias("bins"), F.sum("n").alias("n"),
    )


@query(_SCORED + """,
m as (select lang, count(*) as n, avg(((p >= 0.5)::int = quality)::int) as acc, avg((p - quality) * (p - quality)) as brier,
  avg(-case when quality = 1 then ln(least(greatest(p, 1e-6), 1 - 1e-6)) else ln(1 - least(greatest(p, 1e-6), 1 - 1e-6)) end) as log_loss,
  count(*) filter (where p >= 0.5 and quality = 1) as tp, count(*) filter (where p < 0.5 and quality = 0) as tn,
  count(*) filter (where p >= 0.5) as said, count(*) filter (where quality = 1) as pos from s group by 1)
select lang, n, round(acc, 6) as accuracy, round((acc + 1.9208 / n - 1.96 * sqrt(acc * (1 - acc) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 6) as low,
  round((acc + 1.9208 / n + 1.96 * sqrt(acc * (1 - acc) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 6) as high, round(brier, 6) as brier, round(log_loss, 6) as log_loss,
  round((case when tp > 0 then 2 * tp / (said + pos) else 0 end + case when tn > 0 then 2 * tn / (n - said + n - pos) else 0 end) / 2, 6) as macro_f1 from m""")
def classification_report(spark, sf_dir):
    p, y = F.col("p"), F.col("quality")
    m = _scored(spark, sf_dir).groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.avg(((p >= 0.5).cast("int") == y).cast("double")).alias("acc"), F.avg((p - y) * (p - y)).alias("brier"),
        models.log_loss(p, y).alias("log_loss"), ((models.f1(p, y, 1) + models.f1(p, y, 0)) / 2).alias("macro_f1"),
    )
    a, n = F.col("acc"), F.col("n")
    half = 1.96 * F.sqrt(a * (1 - a) / n + 0.9604 / (n * n))
    edge = lambda s: F.round((a + 1.9208 / n + s * half) / (1 + 3.8416 / n), 6)
    r = lambda c: F.round(c, 6).alias(c)
    return m.select("lang", "n", F.round("acc", 6).alias("accuracy"), edge(-1).alias("low"), edge(1).alias("high"), r("brier"), r("log_loss"), r("macro_f1"))


@query(_SCORED + """,
g as (select lang, count(*) as n, avg((p >= 0.5)::int) as granted, avg((p >= 0.5)::int) filter (where quality = 1) as tpr from s group by 1)
select lang, n, round(granted, 6) as granted, round(tpr, 6) as tpr, round((select max(tpr) - min(tpr) from g), 6) as gap from g""")
def parity_gap(spark, sf_dir):
    yes = (F.col("p") >= 0.5).cast("double")
    g = _scored(spark, sf_dir).groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(yes), 6).alias("granted"), F.avg(F.when(F.col("quality") == 1, yes)).alias("tpr")
    )
    gap = F.broadcast(g.agg(F.round(F.max("tpr") - F.min("tpr"), 6).alias("gap")))  # one row
    return g.withColumn("tpr", F.round("tpr", 6)).join(gap)


@query(_SCORED + """,
g as (select lang = 'en' as a, sum((p >= 0.5)::int * p) / sum(p) as t, sum(p * (1 - p) * (p >= 0.5)::int) as vf, sum(p * (1 - p)) as v, sum(p) as s from s group by 1)
select round(max(t) filter (where a) - max(t) filter (where not a), 6) as gap, round(sqrt(sum((vf * (1 - 2 * t) + v * t * t) / (s * s))), 6) as sd from g""")
def expected_gap(spark, sf_dir):
    """Expected difference of true positive rates under probabilities, with its delta-method deviation."""
    p, f = F.col("p"), (F.col("p") >= 0.5).cast("double")
    g = _scored(spark, sf_dir).groupBy((F.col("lang") == "en").alias("a")).agg(
        (F.sum(f * p) / F.sum(p)).alias("t"), F.sum(p * (1 - p) * f).alias("vf"), F.sum(p * (1 - p)).alias("v"), F.sum(p).alias("s")
    )
    t = F.col("t")
    var = (F.col("vf") * (1 - 2 * t) + F.col("v") * t * t) / (F.col("s") * F.col("s"))  # as f is 0 or 1
    gap = F.max(F.when(F.col("a"), t)) - F.max(F.when(~F.col("a"), t))
    return g.withColumn("var", var).agg(F.round(gap, 6).alias("gap"), F.round(F.sqrt(F.sum("var")), 6).alias("sd"))


@query(_SCORED + """,
v as (select doc_id, lang, (p >= 0.4)::int + (p >= 0.5)::int + (p >= 0.6)::int as votes from s)
select lang, count(*) as n, count(*) filter (where votes in (0, 3)) as unanimous, count(*) filter (where votes in (1, 2)) as split,
  sum(case when votes >= 2 then 3 - votes else votes end)::bigint as flips from v group by 1""")
def decision_stability(spark, sf_dir):
    votes = sum(((F.col("p") >= t).cast("int") for t in (0.4, 0.5, 0.6)), F.lit(0))
    v = _scored(spark, sf_dir).withColumn("votes", votes)
    flips = F.when(F.col("votes") >= 2, 3 - F.col("votes")).otherwise(F.col("votes"))
    return v.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("votes").isin(0, 3)).alias("unanimous"),
        F.count_if(F.col("votes").isin(1, 2)).alias("split"), F.sum(flips).alias("flips"),
    )


@query(_ERRORS + """,
c as (select l_suppkey, l_returnflag, count(*) as n from e group by 1, 2),
f as (select l_suppkey, min(n) as n from c group by 1 having count(*) = (select count(distinct l_returnflag) from e)),
k as (select count(*) as a, (select count(distinct l_returnflag) from e) as b, min(n) as n from f),
y as (select e.*, row_number() over (partition by e.l_suppkey, l_returnflag order by l_orderkey, l_linenumber, error) as i from e join f using (l_suppkey)),
t as (select * from y where i <= (select n from k)), g as (select avg(error) as m from t),
sa as (select sum(power(x - m, 2)) as q from (select avg(error) as x from t group by l_suppkey), g),
sb as (select sum(power(x - m, 2)) as q from (select avg(error) as x from t group by l_returnflag), g),
st as (select sum(power(error - m, 2)) as q from t, g),
ms as (select a, b, n, b * n * sa.q / (a - 1) as ms_a, a * n * sb.q / (b - 1) as ms_b, (st.q - b * n * sa.q - a * n * sb.q) / (a * b * n - a - b + 1) as ms_e from k, sa, sb, st)
select a::int as n_a, b::int as n_b, n::int as n_cell, round(greatest(0, (ms_a - ms_e) / (b * n)), 3) as var_a, round(greatest(0, (ms_b - ms_e) / (a * n)), 3) as var_b,
  round(ms_e, 3) as var_rest, round(greatest(0, (ms_a - ms_e) / (b * n)) / (greatest(0, (ms_a - ms_e) / (b * n)) + greatest(0, (ms_b - ms_e) / (a * n)) + ms_e), 6) as share_a from ms""")
def anova_2way(spark, sf_dir):
    v = models.variance_components(_errors(spark, sf_dir), "l_suppkey", "l_returnflag", ["l_orderkey", "l_linenumber", "error"], "error")
    r = lambda c, n: F.round(c, n).alias(c)
    return v.select("n_a", "n_b", "n_cell", r("var_a", 3), r("var_b", 3), r("var_rest", 3), r("share_a", 6))


@query(_ERRORS + """
select year, count(*) filter (where abs(error) < 20000) as measured, round(avg(case when abs(error) < 20000 then abs(error) end), 6) as mae,
  count(*) filter (where abs(error) <= 500) as within_500, count(*) filter (where abs(error) <= 1000) as within_1000,
  count(*) filter (where abs(error) >= 20000) as empty from e group by 1""")
def bench_rates(spark, sf_dir):
    e = F.when(F.abs("error") < 20000, F.abs("error"))
    return _errors(spark, sf_dir).groupBy("year").agg(
        F.count(e).alias("measured"), F.round(F.avg(e), 6).alias("mae"), F.count_if(e <= 500).alias("within_500"),
        F.count_if(e <= 1000).alias("within_1000"), F.count_if(e.isNull()).alias("empty"),
    )


@query("""
with k as (select event_type, avg(value) as m, stddev_pop(value) as sd, count(*)::double as w from events group by 1),
c as (select sum(w * m) / sum(w) as centre, sum(w) as w from k)
select round(c.centre, 6) as centre, round(sqrt(sum(k.w * sd * sd) / c.w), 6) as within_sd, round(sqrt(sum(k.w * power(m - c.centre, 2)) / c.w), 6) as between_sd,
  round(sqrt(sum(k.w * (sd * sd + power(m - c.centre, 2) + 1)) / c.w), 6) as predictive_sd from k, c group by c.centre, c.w""")
def scenario_spread(spark, sf_dir):
    """Spread within and between weighted scenarios, and with a model error of deviation 1 added."""
    k = table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.avg("value").alias("m"), F.var_pop("value").alias("v"), F.count(F.lit(1)).cast("double").alias("w")
    )
    mean = lambda c: F.sum(F.col("w") * c) / F.sum("w")
    s = k.agg(mean(F.col("m")).alias("c"), mean(F.col("v")).alias("inner"), mean(F.col("m") * F.col("m")).alias("mm"))
    outer = F.greatest(F.lit(0.0), F.col("mm") - F.col("c") * F.col("c"))
    r = lambda c, name: F.round(c, 6).alias(name)
    return s.select(r("c", "centre"), r(F.sqrt("inner"), "within_sd"), r(F.sqrt(outer), "between_sd"), r(F.sqrt(F.col("inner") + outer + 1), "predictive_sd"))


@query("""
with y as (select year(o_orderdate)::int as year, avg(o_totalprice) as m from orders group by 1),
d as (select *, m - lag(m) over (order by year) as step from y),
t as (select *, avg(step) over (order by year rows between 2 preceding and current row) as trend,
  (select sum(m2 * power(0.5, d.year - y2)) / sum(power(0.5, d.year - y2)) from (select year as y2, m as m2 from y) where y2 <= d.year) as decayed from d)
select year, round(m + step, 4) as next_step, round(m + trend, 4) as next_trend, round(m + 0.5 * trend, 4) as damped, round(decayed, 4) as decayed from t""")
def trend_rules(spark, sf_dir):
    """Last step, mean step, damped step and decayed mean over a table with one row a year."""
    y = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.avg("o_totalprice").alias("m"))
    w = Window.orderBy("year")
    d = y.withColumn("step", F.col("m") - F.lag("m").over(w)).withColumn("trend", F.avg("step").over(w.rowsBetween(-2, 0)))
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    scale = F.pow(F.lit(2.0), F.col("year") - 1990)
    decayed = F.sum(F.col("m") * scale).over(past) / F.sum(scale).over(past)
    r = lambda c, name: F.round(c, 4).alias(name)
    return d.select("year", r(F.col("m") + F.col("step"), "next_step"), r(F.col("m") + F.col("trend"), "next_trend"), r(F.col("m") + 0.5 * F.col("trend"), "damped"), r(decayed, "decayed"))


@query(_SCORED + """,
b as (select floor(p * 20) / 20.0 as bin, lang = 'en' as en, count(*) as n, sum(quality) as pos from s group by 1, 2),
g as (select t, o, sum(case when bin + case when en then o else 0 end >= t then pos else n - pos end) / sum(n) as acc
  from b, (select unnest([0.3, 0.4, 0.5, 0.6, 0.7]) as t), (select unnest([-0.1, 0, 0.1]) as o) group by 1, 2)
select t::double as t, o::double as o, round(acc, 6) as acc from g""")
def grid_search(spark, sf_dir):
    """Accuracy for each cut and offset of a stated grid, over counts by score bin."""
    en = F.col("lang") == "en"
    b = _scored(spark, sf_dir).groupBy((F.floor(F.col("p") * 20) / 20).alias("bin"), en.alias("en")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("quality").alias("pos")
    )
    each = lambda values: F.explode(F.array(*[F.lit(float(v)) for v in values]))
    g = b.withColumn("t", each((0.3, 0.4, 0.5, 0.6, 0.7))).withColumn("o", each((-0.1, 0, 0.1)))
    score = F.round(F.col("bin") + F.when(F.col("en"), F.col("o")).otherwise(0.0), 6)
    right = F.when(score >= F.col("t"), F.col("pos")).otherwise(F.col("n") - F.col("pos"))
    return g.groupBy("t", "o").agg(F.round(F.sum(right) / F.sum("n"), 6).alias("acc"))


@query("""
with m as (select o_custkey, ln(o_totalprice) as y, datediff('day', date '1992-01-01', o_orderdate::date) / 365.25 as x from orders where o_totalprice > 0),
d as (select y - avg(y) over (partition by o_custkey) as y, x - avg(x) over (partition by o_custkey) as x from m)
select round(sum(x * y) / sum(x * x), 8) as slope, count(*) as n from d""")
def fe_slope(spark, sf_dir):
    """Growth a year from orders, with an effect for each customer."""
    x = F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")) / 365.25
    o = table(spark, sf_dir, "orders").where("o_totalprice > 0").select("o_custkey", F.ln("o_totalprice").alias("y"), x.alias("x"))
    x, y = F.col("x"), F.col("y")
    by = o.groupBy("o_custkey").agg(F.covar_pop("x", "y").alias("xy"), F.var_pop("x").alias("xx"), F.count(F.lit(1)).alias("n"))
    return by.agg(F.round(F.sum(F.col("xy") * F.col("n")) / F.sum(F.col("xx") * F.col("n")), 8).alias("slope"), F.sum("n").alias("n"))


def _order_pairs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    o = panel.consecutive_pairs(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_totalprice"], "o_orderdate")
    return o.where("gap_years > 0.5 and gap_years < 2.5")


@query()
def repeat_index(spark, sf_dir):
    o = _order_pairs(spark, sf_dir)
    days = F.round(F.col("gap_years") * 365.25).cast("int")
    pairs = o.select(
        F.year(F.date_sub("o_orderdate", days)).alias("year0"), F.year("o_orderdate").alias("year1"), F.col("gap_years").alias("gap"),
        F.ln(F.col("o_totalprice") / F.col("prev_o_totalprice")).alias("y"),
    )
    bounds = pairs.agg(F.min("year0"), F.max("year1")).collect()[0]
    return models.repeat_index(pairs, list(range(bounds[0], bounds[1] + 1))) if bounds[0] else models.repeat_index(pairs, [0, 1])


_COHORT = """
with l as (select o_custkey, max(o_orderdate)::date as last_start from orders group by 1),
c as (select o_custkey, c_nationkey, last_start, last_start + 365 as next_start from l join customer on o_custkey = c_custkey),
p as (select *, o_orderdate::date - lag(o_orderdate::date) over (partition by o_custkey order by o_orderdate, o_orderkey) as gap from orders),
r as (select c_nationkey, count(*) as n, avg((gap < 200)::int) as rate from p join customer on o_custkey = c_custkey where gap is not null group by 1),
a as (select avg((gap < 200)::int) as pooled from p where gap is not null),
u as (select o_custkey, c_nationkey, next_start, case when n >= 500 then rate else pooled end as chance from c left join r using (c_nationkey), a
  where year(next_start) = (select max(year(last_start + 365)) - 1 from l))"""


def _cohort(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("d"))
    nation = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    last = o.groupBy("o_custkey").agg(F.max("d").alias("last_start")).withColumn("next_start", F.date_add("last_start", 365))
    gap = F.datediff("d", F.lag("d").over(Window.partitionBy("o_custkey").orderBy("d", "o_orderkey")))
    p = o.withColumn("gap", gap).where("gap is not null").join(nation, "o_custkey")
    by = p.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gap") < 200).alias("k"))
    pooled = by.agg((F.sum("k") / F.sum("n")).alias("pooled"), F.lit(1).alias("one"))
    year = last.agg((F.max(F.year("next_start")) - 1).alias("year"))
    u = last.join(F.broadcast(year), F.year("next_start") == F.col("year")).join(nation, "o_custkey").join(by, "c_nationkey", "left").join(F.broadcast(pooled))
    chance = F.when(F.col("n") >= 500, F.col("k") / F.col("n")).otherwise(F.col("pooled"))
    return u.select("o_custkey", "c_nationkey", "next_start", chance.alias("chance"))


@query(_COHORT + """
select o_custkey, next_start, round(chance, 6) as chance from u""")
def cohort_next(spark, sf_dir):
    """Customers whose next term begins in the year before the last, with their chance of renewal, pooled for small nations."""
    return _cohort(spark, sf_dir).select("o_custkey", "next_start", F.round("chance", 6).alias("chance"))


_POOLS = ((-4.0, -1.0, 0.0, 2.0, 3.0), (-9.0, -2.0, 1.0, 5.0))


@query(_COHORT + """,
d as (select unnest(range(1, 21)) as draw),
x as (select draw, o_custkey, c_nationkey, ('0x' || md5('r-' || draw || '-' || o_custkey)[1:8])::bigint / 4294967296.0::double < chance as renews,
  ('0x' || md5('p-' || draw || '-' || o_custkey)[1:8])::bigint / 4294967296.0::double as v from u, d),
g as (select draw, c_nationkey, case when renews then least(2.5 + [-4.0, -1, 0, 2, 3][floor(v * 5)::int + 1], 5.0) else 4.0 + [-9.0, -2, 1, 5][floor(v * 4)::int + 1] end as growth from x),
s as (select draw, avg(growth) as m, count(*) as n from g group by 1)
select draw::int as draw, n, round(m, 6)::double as mean_growth from s""")
def cohort_mc(spark, sf_dir):
    rows = [(1 - k, i, r, len(pool)) for k, pool in enumerate(_POOLS) for i, r in enumerate(pool)]
    pools = spark.createDataFrame(rows, "renews int, at long, residual double, n int")
    units = _cohort(spark, sf_dir).withColumn("center1", F.lit(2.5)).withColumn("center0", F.lit(4.0))
    drawn = models.simulated_cohort(units, F.broadcast(pools), "o_custkey", 20, 5.0)
    return drawn.groupBy("draw").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("growth"), 6).alias("mean_growth"))


@query("""
with y as (select year(o_orderdate)::int as year, avg(o_totalprice) as m from orders group by 1),
g as (select year, (m / lag(m) over (order by year) - 1) * 100 as growth from y),
b as (select year, growth, lag(growth) over (order by year) as persist, avg(growth) over (order by year rows between unbounded preceding and 1 preceding) as mean from g),
e as (select 'persist' as rule, year, growth - persist as error from b union all select 'mean', year, growth - mean from b),
w as (select rule, avg(abs(error)) as mae, count(error) as n from e where error is not null group by 1)
select rule, n, round(mae, 6) as mae, round((1 / mae) / (select sum(1 / mae) from w), 6) as weight from w""")
def backtest_rules(spark, sf_dir):
    """Errors of simple rules, each year forecast from earlier years alone, and weights by inverse error; a row a year."""
    y = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.avg("o_totalprice").alias("m"))
    w = Window.orderBy("year")
    g = y.withColumn("growth", (F.col("m") / F.lag("m").over(w) - 1) * 100)
    rules = {"persist": F.lag("growth").over(w), "mean": F.avg("growth").over(w.rowsBetween(Window.unboundedPreceding, -1))}
    b = g.select("growth", *[v.alias(k) for k, v in rules.items()])
    e = b.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), (F.col("growth") - F.col(k)).alias("error")) for k in rules])).alias("r")).select("r.*")
    s = e.where("error is not null").groupBy("rule").agg(F.avg(F.abs("error")).alias("mae"), F.count(F.lit(1)).alias("n"))
    total = F.broadcast(s.agg(F.sum(1 / F.col("mae")).alias("all")))  # one row
    return s.join(total).select("rule", "n", F.round("mae", 6).alias("mae"), F.round(1 / F.col("mae") / F.col("all"), 6).alias("weight"))


@query("""
with y as (select distinct year(o_orderdate)::int as year from orders), p as (select * from (values (1993, 2.5), (1995, 1.8)) t(year, published))
select y.year, coalesce(p.published, case when y.year < 1997 then 1.0 + (y.year - 1990) * 0.1 end, 1.8)::double as anchor from y left join p using (year)""")
def policy_anchors(spark, sf_dir):
    """Published rate, else a formula where it holds, else the last known rate."""
    published = F.create_map(*[F.lit(x) for x in (1993, 2.5, 1995, 1.8)])
    formula = F.when(F.col("year") < 1997, 1.0 + (F.col("year") - 1990) * 0.1)
    y = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    return y.select("year", F.round(F.coalesce(published[F.col("year")], formula, F.lit(1.8)), 6).alias("anchor"))


@query("""
with k as (select * from (values ('base', 0.5, 1.96), ('strict', 0.7, 1.96), ('loose', 0.3, 1.96)) t(setting, cut, z)),
s as (select quality, ((doc_id * 7919) % 10007) / 10007.0 as p from labels)
select setting, count(*) filter (where p >= cut) as taken, round(avg(quality) filter (where p >= cut), 6) as rate from s, k group by 1""")
def robustness_sweep(spark, sf_dir):
    """One result for each setting that replaces one value of the base."""
    settings = {"base": 0.5, "strict": 0.7, "loose": 0.3}
    s = table(spark, sf_dir, "labels").select("quality", (F.col("doc_id") * 7919 % 10007 / F.lit(10007.0)).alias("p"))
    taken = [F.struct(F.lit(k).alias("setting"), F.when(F.col("p") >= v, F.col("quality")).alias("q")) for k, v in settings.items()]
    rows = s.select(F.explode(F.array(*taken)).alias("r")).select("r.*")
    return rows.groupBy("setting").agg(F.count("q").alias("taken"), F.round(F.avg("q"), 6).alias("rate"))


@query(_ERRORS + """,
s as (select l_suppkey % 5 as fold, abs(error) as raw, abs(error - 0.9 * l_suppkey) as fixed from e),
f as (select fold, avg(raw) as raw, avg(fixed) as fixed from s group by 1)
select fold, round(raw, 6) as raw, round(fixed, 6) as fixed, (select avg(fixed) < avg(raw) from f) as accepted from f""")
def accept_correction(spark, sf_dir):
    """A correction is taken only if it lowers the mean error of groups held out."""
    s = _errors(spark, sf_dir).select((F.col("l_suppkey") % 5).alias("fold"), F.abs("error").alias("raw"), F.abs(F.col("error") - 0.9 * F.col("l_suppkey")).alias("fixed"))
    f = s.groupBy("fold").agg(F.avg("raw").alias("raw"), F.avg("fixed").alias("fixed"))
    verdict = F.broadcast(f.agg((F.avg("fixed") < F.avg("raw")).alias("accepted")))  # one row
    return f.select("fold", F.round("raw", 6).alias("raw"), F.round("fixed", 6).alias("fixed")).join(verdict)


@query("""
with r as (select o_custkey, o_orderdate, o_orderkey, o_totalprice, lag(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey) as a,
  lag(o_totalprice) over (partition by o_custkey % 50, o_orderpriority order by o_orderdate, o_orderkey) as b,
  lag(o_custkey) over (partition by o_custkey % 50, o_orderpriority order by o_orderdate, o_orderkey) as other from orders)
select count(a) as right_pairs, count(b) as wrong_pairs, count(*) filter (where other <> o_custkey) as fake, round(avg(ln(o_totalprice / b)) - avg(ln(o_totalprice / a)), 6) as bias from r""")
def key_trap(spark, sf_dir):
    """What a wrong key does to pairs: those that join different customers, and the bias of growth."""
    own = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    wrong = Window.partitionBy(F.col("o_custkey") % 50, "o_orderpriority").orderBy("o_orderdate", "o_orderkey")
    r = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_totalprice", F.lag("o_totalprice").over(own).alias("a"), F.lag("o_totalprice").over(wrong).alias("b"), F.lag("o_custkey").over(wrong).alias("other")
    )
    growth = lambda c: F.avg(F.ln(F.col("o_totalprice") / F.col(c)))
    return r.agg(F.count("a").alias("right_pairs"), F.count("b").alias("wrong_pairs"), F.count_if(F.col("other") != F.col("o_custkey")).alias("fake"), F.round(growth("b") - growth("a"), 6).alias("bias"))


@query(_COHORT + """,
d as (select unnest(range(1, 11)) as draw), k as (select * from (values ('low', 0.25, 1.5), ('mid', 0.5, 2.5), ('high', 0.25, 4.5)) t(scenario, prior, center)),
x as (select scenario, prior, center, draw, o_custkey, ('0x' || md5('r-' || draw || '-' || o_custkey)[1:8])::bigint / 4294967296.0::double < chance as renews,
  ('0x' || md5('p-' || draw || '-' || o_custkey)[1:8])::bigint / 4294967296.0::double as v from u, d, k),
g as (select scenario, prior, case when renews then least(center + [-4.0, -1, 0, 2, 3][floor(v * 5)::int + 1], 5.0) else 4.0 + [-9.0, -2, 1, 5][floor(v * 4)::int + 1] end as growth from x),
s as (select scenario, any_value(prior) as prior, avg(growth) as m, count(*) as n from g group by 1)
select scenario, n, round(m, 6)::double as mean_growth, round((select sum(prior * m) from s), 6)::double as mixture from s""")
def scenario_mixture(spark, sf_dir):
    """Scenarios on common random numbers, and their mean by prior weights."""
    rows = [(1 - k, i, r, len(pool)) for k, pool in enumerate(_POOLS) for i, r in enumerate(pool)]
    pools = F.broadcast(spark.createDataFrame(rows, "renews int, at long, residual double, n int"))
    units, parts = _cohort(spark, sf_dir).withColumn("center0", F.lit(4.0)), []
    for name, prior, center in (("low", 0.25, 1.5), ("mid", 0.5, 2.5), ("high", 0.25, 4.5)):
        drawn = models.simulated_cohort(units.withColumn("center1", F.lit(center)), pools, "o_custkey", 10, 5.0)
        parts.append(drawn.select(F.lit(name).alias("scenario"), F.lit(prior).alias("prior"), "growth"))
    s = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("scenario", "prior").agg(F.count(F.lit(1)).alias("n"), F.avg("growth").alias("m"))
    whole = F.broadcast(s.agg(F.round(F.sum(F.col("prior") * F.col("m")), 6).alias("mixture")))  # one row
    return s.select("scenario", "n", F.round("m", 6).alias("mean_growth")).join(whole)


@query(_SCORED + """,
b as (select floor(p * 1000) as bin, count(*) as n, sum(quality) as pos from s group by 1),
c as (select *, sum(n) over (order by bin desc) as taken, sum(pos) over (order by bin desc) as hits, sum(n) over () as all_ from b),
k as (select unnest([0.39, 0.4, 0.41]) as budget)
select budget::double as budget, max(taken)::bigint as taken, max(hits)::bigint as hits, min(bin) / 1000.0::double as cut from c join k on taken <= budget * all_ group by 1""")
def policy_variants(spark, sf_dir):
    """What budgets of a share of all rows take by score, over counts in a thousand score bins."""
    b = _scored(spark, sf_dir).groupBy(F.floor(F.col("p") * 1000).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("pos"))
    w = Window.orderBy(F.desc("bin"))  # at most a thousand rows
    c = b.select("bin", F.sum("n").over(w).alias("taken"), F.sum("pos").over(w).alias("hits"), F.sum("n").over(Window.partitionBy()).alias("all"))
    c = c.withColumn("budget", F.explode(F.array(*[F.lit(x) for x in (0.39, 0.4, 0.41)]))).where("taken <= budget * all")
    return c.groupBy("budget").agg(F.max("taken").alias("taken"), F.max("hits").alias("hits"), (F.min("bin") / 1000).alias("cut"))
