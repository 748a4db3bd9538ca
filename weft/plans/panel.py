"""Panel, aggregation, window, top-k and set queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import panel, ranks
from ..registry import query
from ..sources.io import table
from ..tables import shared_table

_PAIRS = """
with p as (
  select *, lag(o_totalprice) over w as prev_o_totalprice,
    date_diff('day', lag(o_orderdate) over w, o_orderdate) / 365.25 as gap_years
  from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)
)"""


def _pairs(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    o = panel.consecutive_pairs(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_totalprice"], "o_orderdate")
    flags = panel.pair_flags()
    o = o.withColumns(flags)
    return o.withColumn("is_valid", ~F.greatest(*[F.col(c) for c in flags]))


@query(_PAIRS + """
select year(o_orderdate)::int as year, count(*) as n,
  round(median((power(o_totalprice / prev_o_totalprice, 1 / gap_years) - 1) * 100), 6) as median_pct
from p where gap_years > 0.5 and gap_years < 2.5 group by 1""")
def pairs_growth(spark, sf_dir):
    o = _pairs(spark, sf_dir).where("is_valid")
    g = panel.annualised_growth(F.col("o_totalprice"), F.col("prev_o_totalprice"), F.col("gap_years"))
    o = o.select(F.year("o_orderdate").alias("year"), g.alias("g"))
    q = ranks.quantiles(o, ["year"], "g", {"median": 0.5}, {"n": F.lit(1)})
    return q.select("year", "n", F.round("median", 6).alias("median_pct"))


@query(_PAIRS + """
select count(*) as n_rows, count(*) filter (where gap_years is null) as is_first,
  count(*) filter (where gap_years <= 0.5) as too_close, count(*) filter (where gap_years >= 2.5) as too_far,
  count(*) filter (where gap_years > 0.5 and gap_years < 2.5) as is_valid from p""")
def pairs_funnel(spark, sf_dir):
    names = ["is_first", "too_close", "too_far", "is_valid"]
    return _pairs(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(c).alias(c) for c in names])


_ASOF = """
with p as (select event_id, user_id, ts, value from events where event_type = 'purchase'),
c as (select user_id, ts, max(event_id) as event_id from events where event_type = 'click' group by 1, 2)
select p.event_id, p.user_id, {} as r_event_id from p asof left join c on p.user_id = c.user_id and p.ts >= c.ts"""


def _asof(spark, sf_dir, tolerance):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    bought = e.where("event_type = 'purchase'").drop("event_type")
    clicked = e.where("event_type = 'click'").drop("event_type")
    hit = panel.asof_backward(bought, clicked, ["user_id"], "ts", "ts", ["event_id"], tolerance, "event_id")
    return hit.select("event_id", "user_id", "r_event_id")


@query(_ASOF.format("c.event_id"))
def asof_purchase_click(spark, sf_dir):
    return _asof(spark, sf_dir, None)


@query(_ASOF.format("case when p.ts - c.ts <= interval 2 hour then c.event_id end"))
def asof_tolerance(spark, sf_dir):
    return _asof(spark, sf_dir, 7200)


def _lines(spark, sf_dir) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select(
        F.year("l_shipdate").alias("year"), "l_partkey", "l_returnflag", "l_linestatus", "l_quantity",
        "l_extendedprice", "l_discount", "l_shipdate",
    )
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_retailprice")
    return line.join(part, "l_partkey")


@query("""
with s as (
  select year(l_shipdate) as year, l_returnflag as f, p_brand as b, count(*) as n, sum(l_extendedprice) as v
  from lineitem join part on l_partkey = p_partkey group by all
), t as (select *, n / sum(n) over (partition by year) as share, v / n as mean from s),
j as (
  select coalesce(a.year, b.year + 1) as year, coalesce(a.share, 0) as s1, coalesce(b.share, 0) as s0,
    coalesce(a.mean, 0) as m1, coalesce(b.mean, 0) as m0, a.mean is not null and b.mean is not null as both_,
    a.mean is not null as here, b.mean is not null as there
  from t a full join t b on a.year = b.year + 1 and a.f = b.f and a.b = b.b
)
select year::int as year, round(sum(case when both_ then (s1 + s0) / 2 * (m1 - m0) else 0 end), 6) as within,
  round(sum(case when both_ then (s1 - s0) * (m1 + m0) / 2 else 0 end), 6) as recomposition,
  round(sum(case when both_ then 0 else s1 * m1 - s0 * m0 end), 6) as entry, round(sum(s1 * m1), 6) as mean,
  round(sum(s0 * m0), 6) as mean_before
from j group by year having count(*) filter (where here) > 0 and count(*) filter (where there) > 0""")
def mix_decomposition(spark, sf_dir):
    out = panel.mix_decomposition(_lines(spark, sf_dir), "year", ["l_returnflag", "p_brand"], "l_extendedprice")
    return out.select("year", *[F.round(c, 6).alias(c) for c in out.columns if c != "year"])


@query("""
with s as (
  select year(l_shipdate) as year, p_brand as b, sum(l_extendedprice) / sum(l_quantity) as p, sum(l_quantity) as q
  from lineitem join part on l_partkey = p_partkey group by all)
select a.year::int as year, count(*) as segments,
  round((sqrt(sum(a.p * b.q) / sum(b.p * b.q) * sum(a.p * a.q) / sum(b.p * a.q)) - 1) * 100, 6) as fisher_pct
from s a join s b on a.year = b.year + 1 and a.b = b.b group by a.year""")
def fisher_index(spark, sf_dir):
    lines = _lines(spark, sf_dir).withColumn("price", F.col("l_extendedprice") / F.col("l_quantity"))
    out = panel.fisher_index(lines, "year", ["p_brand"], "price", "l_quantity")
    return out.select("year", "segments", F.round("fisher_pct", 6).alias("fisher_pct"))


@query("""
with q as (
  select year(l_shipdate) as year, quantile_cont(l_extendedprice, 0.05) as lo, quantile_cont(l_extendedprice, 0.95) as hi
  from lineitem group by 1
), x as (
  select q.year, pol, case pol when 'keep' then l_extendedprice when 'winsorise' then
    least(greatest(l_extendedprice, lo), hi) else case when l_extendedprice between lo and hi then l_extendedprice end end as v
  from lineitem join q on q.year = year(l_shipdate), (values ('keep'), ('winsorise'), ('trim')) t(pol)
)
select year::int as year, pol as policy, round(avg(v), 6) as mean, round(median(v), 6) as median, count(v) as n
from x group by all""")
def winsor_sensitivity(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("year"), F.col("l_extendedprice").alias("v"))
    x = x.groupBy("year", "v").agg(F.count("v").alias("k"))  # 0 for null
    run = shared_table(ranks.running_sums(x, ["year"], [F.col("v")], ["k"]))
    bounds = ranks.between(run, ["year"], "v", "k", {"lo": (0.05, F.lit(0), "k_all"), "hi": (0.95, F.lit(0), "k_all")})
    x = run.join(F.broadcast(bounds), "year")  # a row a year
    v, k, inside = F.col("v"), F.col("k"), F.col("v").between(F.col("lo"), F.col("hi"))
    clipped = F.least(F.greatest(v, "lo"), "hi")
    sums = x.groupBy("year").agg(
        F.sum(v * k).alias("s_keep"), F.sum(clipped * k).alias("s_winsorise"), F.sum(F.when(inside, v * k)).alias("s_trim"),
        F.sum(k).alias("n_keep"), F.sum(k).alias("n_winsorise"), F.sum(F.when(inside, k).otherwise(0)).alias("n_trim"),
        F.sum(F.when(v < F.col("lo"), k).otherwise(0)).alias("below"),
    )
    x = x.join(F.broadcast(sums.select("year", "below", "n_trim")), "year").withColumn("clipped", clipped)
    mid = {"m_keep": (0.5, F.lit(0), "k_all"), "m_trim": (0.5, F.col("below"), "n_trim")}
    m = ranks.between(x, ["year"], "v", "k", mid)
    m = m.join(ranks.between(x, ["year"], "clipped", "k", {"m_winsorise": (0.5, F.lit(0), "k_all")}), "year")
    rows = F.explode(F.array(*[
        F.struct(F.lit(p).alias("policy"), *[F.col(f"{c}_{p}").alias(c) for c in "smn"]) for p in ("keep", "winsorise", "trim")
    ]))
    return sums.join(m, "year").select("year", rows.alias("r")).select(
        "year", "r.policy", F.round(F.col("r.s") / F.when(F.col("r.n") > 0, F.col("r.n")), 6).alias("mean"),
        F.round("r.m", 6).alias("median"), "r.n",
    )


@query("""
select year(l_shipdate)::int as year, round(avg((l_discount > 0)::int), 6) as penetration,
  round(avg(case when l_discount > 0 then l_discount end), 6) as depth, round(avg(l_discount), 6) as drag,
  count(*) filter (where l_linestatus = 'F') as "F", count(*) filter (where l_linestatus = 'O') as "O"
from lineitem group by 1""")
def concession_profile(spark, sf_dir):
    x, pos = table(spark, sf_dir, "lineitem"), F.col("l_discount") > 0
    return x.groupBy(F.year("l_shipdate").alias("year")).agg(
        F.round(F.avg(pos.cast("double")), 6).alias("penetration"),
        F.round(F.avg(F.when(pos, F.col("l_discount"))), 6).alias("depth"), F.round(F.avg("l_discount"), 6).alias("drag"),
        F.count_if(F.col("l_linestatus") == "F").alias("F"), F.count_if(F.col("l_linestatus") == "O").alias("O"),
    )


@query("""
with s as (select l_orderkey, sum(l_extendedprice * (1 + l_tax) * (1 - l_discount)) as t from lineitem group by 1)
select count(*) as n, round(avg((abs(coalesce(t, 0) - o_totalprice) <= 1)::int), 6) as share_within,
  count(*) filter (where t is null) as without_lines from orders left join s on l_orderkey = o_orderkey""")
def reconstruct_share(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    t = F.sum(F.col("l_extendedprice") * (1 + F.col("l_tax")) * (1 - F.col("l_discount"))).alias("t")
    both = table(spark, sf_dir, "orders").join(
        line.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(t), "o_orderkey", "left"
    )
    near = F.abs(F.coalesce("t", F.lit(0.0)) - F.col("o_totalprice")) <= 1
    return both.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(near.cast("double")), 6).alias("share_within"),
                    F.count_if(F.col("t").isNull()).alias("without_lines"))


@query("""
with q as (select year(l_shipdate) as y, quarter(l_shipdate) as q, avg(l_discount) as m from lineitem group by all),
y as (select y, avg(m) as m, stddev_samp(m) as s from q group by y)
select round(avg(s), 9) as within_std, round(stddev_samp(m), 9) as between_std from y""")
def within_between_std(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    q = x.groupBy(F.year("l_shipdate").alias("y"), F.quarter("l_shipdate").alias("q")).agg(F.avg("l_discount").alias("m"))
    y = q.groupBy("y").agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("s"))
    return y.agg(F.round(F.avg("s"), 9).alias("within_std"), F.round(F.stddev_samp("mean"), 9).alias("between_std"))


@query("""select l_returnflag, count(*) as n, round(median(l_extendedprice), 6) as median,
  round(avg(l_extendedprice), 6) as mean, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 6) as weighted
  from lineitem group by 1""")
def weighted_mean(spark, sf_dir):
    v, w = F.col("l_extendedprice"), F.col("l_quantity")
    sums = {"n": F.lit(1), "met": v.isNotNull().cast("long"), "s": v, "vw": v * w, "w": w}
    q = ranks.quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", {"median": 0.5}, sums)
    return q.select(
        "l_returnflag", "n", F.round("median", 6).alias("median"),
        F.round(F.when(F.col("met") > 0, F.col("s") / F.col("met")), 6).alias("mean"),
        F.round(F.when(F.col("w") != 0, F.col("vw") / F.col("w")), 6).alias("weighted"),
    )


@query("""
with v as (select l_returnflag, l_extendedprice as x, sum(l_quantity) as w from lineitem where l_quantity > 0 group by 1, 2),
c as (select *, sum(w) over (partition by l_returnflag order by x) as c, sum(w) over (partition by l_returnflag) as t from v)
select l_returnflag, min(x) filter (where c >= 0.9 * t - 1e-9) as value from c group by 1""")
def weighted_percentile(spark, sf_dir):
    return panel.weighted_percentile(
        table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity", 0.9
    )


_MONTHS = """
with o as (select date_trunc('month', o_orderdate)::date as m, sum(o_totalprice) as y, count(*) as n from orders group by 1)"""


def _months(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("m"))
    return o.agg(F.sum("o_totalprice").alias("y"), F.count(F.lit(1)).alias("n"))


@query(_MONTHS + ", t as (select y / n as s, n, sum(y / n) over () as total, count(*) over () as k, y from o)" + """
select round(avg(abs(s - (total - s) / (k - 1))), 6) as loo_mae, round(sum(n * y) / sum(n * n), 6) as origin_slope,
  round(corr(n, y), 6) as corr from t""")
def loo_mae(spark, sf_dir):
    every = Window.partitionBy()  # a row a month
    t = _months(spark, sf_dir).withColumn("s", F.col("y") / F.col("n"))
    t = t.withColumns({"total": F.sum("s").over(every), "k": F.count("s").over(every)})
    rest = (F.col("total") - F.col("s")) / (F.col("k") - 1)
    return t.agg(
        F.round(F.avg(F.abs(F.col("s") - rest)), 6).alias("loo_mae"),
        F.round(F.sum(F.col("n") * F.col("y")) / F.sum(F.col("n") * F.col("n")), 6).alias("origin_slope"),
        F.round(F.corr("n", "y"), 6).alias("corr"),
    )


@query(_MONTHS + """
select m, round(y / lag(y) over (order by m) - 1, 9) as change, round(avg(y) over (order by m rows between 3 preceding and
  1 preceding), 4) as trailing, round((y + lag(y) over (order by m)) / 2, 4) as moving,
  round(0.25 * lag(y) over (order by m) + 0.75 * y, 4) as blend, round(sum(y) over (order by m), 4) as running from o""")
def trailing_rules(spark, sf_dir):
    w = Window.orderBy("m")  # a row a month
    y, before = F.col("y"), F.lag("y").over(w)
    return _months(spark, sf_dir).select(
        "m", F.round(y / before - 1, 9).alias("change"), F.round(F.avg(y).over(w.rowsBetween(-3, -1)), 4).alias("trailing"),
        F.round((y + before) / 2, 4).alias("moving"), F.round(0.25 * before + 0.75 * y, 4).alias("blend"),
        F.round(F.sum(y).over(w), 4).alias("running"),
    )


@query("""
with t as (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rank from orders)
select o_custkey, o_orderkey, rank::int as rank from t where rank <= 2""")
def latest_per_key(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return panel.first_k(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 2).drop("o_orderdate")


@query("""
with d as (select year(o_orderdate) as y, ln(o_totalprice) - avg(ln(o_totalprice)) over (partition by o_custkey) as x from orders)
select y::int as year, count(*) as n, round(avg(x), 6) as effect from d group by 1""")
def demeaned_fe(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    x = F.ln("o_totalprice") - F.avg(F.ln("o_totalprice")).over(Window.partitionBy("o_custkey"))
    o = o.select(F.year("o_orderdate").alias("year"), x.alias("x"))
    return o.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 6).alias("effect"))


@query("""
with a as (select *, coalesce((ts - lag(ts) over w > interval 30 minute)::int, 0) as n from events
  window w as (partition by user_id order by ts, event_id)),
b as (select *, sum(n) over (partition by user_id order by ts, event_id) as session from a)
select user_id, session::bigint as session, count(*) as n, min(event_id) as first_event from b group by all""")
def gap_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    e = panel.sessions(e, ["user_id"], "ts", ["ts", "event_id"], 1800)
    return e.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query("""
with s as (select year(o_orderdate) as y, o_orderpriority as p, median(o_totalprice) as m, count(*) as n from orders group by all),
t as (select year(o_orderdate) as y, median(o_totalprice) as m from orders group by all),
d as (select s.y, p, s.m - t.m as d from s join t using (y) where n >= 15)
select a.y::int as year, a.p as o_orderpriority, round(a.d, 6) as deviation, round(a.d - b.d, 6) as change
from d a left join d b on a.y = b.y + 1 and a.p = b.p""")
def shift_self_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), "o_orderpriority", "o_totalprice")
    s = ranks.quantiles(o, ["year", "o_orderpriority"], "o_totalprice", {"m": 0.5}, {"n": F.lit(1)})
    t = ranks.quantiles(o, ["year"], "o_totalprice", {"t": 0.5})
    d = s.where("n >= 15").join(F.broadcast(t), "year").withColumn("d", F.col("m") - F.col("t"))  # a row a year
    before = d.select((F.col("year") + 1).alias("year"), "o_orderpriority", F.col("d").alias("d0"))
    return d.join(before, ["year", "o_orderpriority"], "left").select(
        "year", "o_orderpriority", F.round("d", 6).alias("deviation"), F.round(F.col("d") - F.col("d0"), 6).alias("change")
    )


@query("""select c_custkey, c_acctbal from customer order by c_acctbal desc, c_custkey
  limit (select round_even(0.4 * count(*), 0)::bigint from customer)""")
def topk_budget(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return panel.top_budget(c, 0.4, [F.desc("c_acctbal"), F.asc("c_custkey")])


@query("""with y as (select year(o_orderdate)::int as y, sum(o_totalprice) as t from orders group by 1)
select arg_max(y, t) as best_year, arg_min(y, t) as worst_year from y""")
def argmax_year(spark, sf_dir):
    y = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("t"))
    return y.agg(F.max_by("y", "t").alias("best_year"), F.min_by("y", "t").alias("worst_year"))


@query("""
select 'no_orders' as kind, c_custkey as key from customer where c_custkey not in (select o_custkey from orders)
union all select 'same_text', doc_id from documents where md5(text) in
  (select md5(text) from documents group by 1 having count(*) > 1)""")
def set_diff_manifest(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"))
    c = table(spark, sf_dir, "customer").select(F.lit("no_orders").alias("kind"), F.col("c_custkey").alias("key"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    twice = d.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    same = d.join(twice, "h", "left_semi").select(F.lit("same_text").alias("kind"), F.col("doc_id").alias("key"))
    return c.join(o, "key", "left_anti").select("kind", "key").unionByName(same)


@query(_MONTHS + """, p as (select year(m)::int as year, m, y, (last_day(m) + interval 20 day)::date as published_on from o)
select year, arg_max(m, published_on) as m, round(arg_max(y, published_on), 4) as y, max(published_on) as published_on
from p where published_on <= make_date(year, 12, 31) group by 1""")
def keep_last_published(spark, sf_dir):
    p = _months(spark, sf_dir).withColumn("published_on", F.date_add(F.last_day("m"), 20))
    p = p.withColumn("year", F.year("m")).where(F.col("published_on") <= F.make_date("year", F.lit(12), F.lit(31)))
    best = p.groupBy("year").agg(F.max(F.struct("published_on", "m", "y")).alias("b"))
    return best.select("year", "b.m", F.round("b.y", 4).alias("y"), "b.published_on")


@query("""with d as (select year(o_orderdate)::int as year, o_totalprice as x, ntile_ from (
  select *, (('0x' || substr(md5('7-' || o_orderkey::varchar), 1, 8))::bigint / 4294967296.0) as ntile_ from orders))
select year, round(avg(x) filter (where ntile_ < 0.5), 6) as half_mean, count(*) filter (where ntile_ < 0.5) as n from d group by 1""")
def hashed_sample_mean(spark, sf_dir):
    from ..functions.text import uniform

    o = table(spark, sf_dir, "orders").withColumn("u", uniform(F.lit(7), F.col("o_orderkey")))
    half = F.when(F.col("u") < 0.5, F.col("o_totalprice"))
    return o.groupBy(F.year("o_orderdate").alias("year")).agg(
        F.round(F.avg(half), 6).alias("half_mean"), F.count(half).alias("n")
    )
