"""Spatial, geometry, resampling, calibration, split and tiered-match queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import estimates
from ..registry import query
from ..sources.io import table

_POINTS = "with p as (select vec_id, embedding[1]::double as x, embedding[2]::double as y from embeddings where embedding is not null)"


def _points(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where("embedding is not null")
    return e.select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


@query(_POINTS + """
select a.vec_id, count(*) - 1 as n_near from p a join p b on (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.01 * 0.01
group by 1""")
def spatial_radius(spark, sf_dir):
    return estimates.neighbours_within(_points(spark, sf_dir), "vec_id", "x", "y", 0.01)


@query(_POINTS + """, b as (
  select floor(x / 0.1)::bigint as bx, floor(y / 0.1)::bigint as by_, count(*) as n, round(avg(x), 6) as mean_x, round(avg(y), 6) as mean_y
  from p group by 1, 2
) select bx, by_, n, mean_x, mean_y from b where n >= greatest(3, 0.004 * (select count(*) from p))
qualify row_number() over (order by n desc, bx, by_) <= 5""")
def bin_modes(spark, sf_dir):
    p = _points(spark, sf_dir)
    cell = [F.floor(F.col("x") / 0.1).alias("bx"), F.floor(F.col("y") / 0.1).alias("by_")]
    mean = [F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("x", "y")]
    bins = p.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), *mean)
    least = F.greatest(F.lit(3), F.lit(0.004 * p.count()))
    return bins.where(F.col("n") >= least).orderBy(F.desc("n"), "bx", "by_").limit(5)


@query("""
with p as (
  select vec_id, list_transform(range(1, 64, 2), lambda i: embedding[i]::double) as xs,
    list_transform(range(1, 64, 2), lambda i: embedding[i + 1]::double) as ys from embeddings where len(embedding) = 64
)
select vec_id,
  round(list_sum(list_transform(range(1, 33), lambda i: xs[i] * ys[i % 32 + 1] - xs[i % 32 + 1] * ys[i])) / 2, 6) as signed_area,
  round(list_sum(list_transform(range(1, 33), lambda i: sqrt(power(xs[i % 32 + 1] - xs[i], 2) + power(ys[i % 32 + 1] - ys[i], 2)))), 6)
    as outline, round(list_max(xs) - list_min(xs), 6) as width, round(list_max(ys) - list_min(ys), 6) as height
from p""")
def polygon_measures(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64)
    at = F.sequence(F.lit(0), F.lit(31))
    point = F.transform(at, lambda i: F.struct(*[F.get("embedding", i * 2 + k).cast("double").alias(c) for k, c in enumerate("xy")]))
    return e.select("vec_id", point.alias("shape")).select("vec_id", *estimates.polygon_measures("shape", 6))


@query("""
with first as (select label, min_by(embedding, vec_id) as e0 from embeddings where embedding is not null group by 1)
select vec_id, round(list_cosine_similarity(
  list_transform(embedding, lambda v: v::double - list_avg(embedding::double[])),
  list_transform(e0, lambda v: v::double - list_avg(e0::double[]))), 6) as similarity
from embeddings join first using (label) where embedding is not null""")
def cosine_to_first(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", "label", "embedding")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("e0"))
    return e.join(first, "label").select("vec_id", F.round(estimates.centred_cosine("embedding", "e0"), 6).alias("similarity"))


@query("""
with m as (
  select year(o_orderdate)::int as year, month(o_orderdate)::int as month, sum(o_totalprice)::double as total from orders group by 1, 2
), s as (select year, list(total order by month) as all_ from m group by 1
), d as (select year, all_, unnest(range(1, 201)) as draw from s
), r as (
  select year, list_median(list_transform(range(1, len(all_) + 1), lambda i:
    all_[(('0x' || substr(md5(year || '-' || draw || '-' || i), 1, 8))::bigint * len(all_)) // 4294967296 + 1])) as med from d
)
select year, round(quantile_cont(med, 0.05), 4) as low, round(quantile_cont(med, 0.95), 4) as high from r group by 1""")
def bootstrap_median(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), "o_totalprice")
    m = o.groupBy("year", "month").agg(F.sum("o_totalprice").cast("double").alias("total"))
    return estimates.bootstrap_median(m, "year", "month", "total", 200, 4)


@query("""
with q as (
  select item_id, trim(regexp_replace(lower(text), '[ \\t\\n\\r]+', ' ', 'g')) as quote from benchmark where text is not null
), d as (select doc_id, trim(regexp_replace(lower(text), '[ \\t\\n\\r]+', ' ', 'g')) as body from documents where text is not null)
select item_id, count(doc_id) as n_sources, min(doc_id) as first_source
from q left join d on contains(' ' || body || ' ', ' ' || quote || ' ') group by 1""")
def evidence_check(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").where("text is not null").select("item_id", "text")
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    return estimates.quoted_sources(q, d, "item_id", "text", "doc_id", "text")


@query("""
select case when ('0x' || substr(md5(o_custkey::varchar), 1, 4))::bigint < 13107 then 'test' else 'train' end as split,
  count(*) as n_rows, count(distinct o_custkey) as n_groups from orders group by 1""")
def group_split(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey")
    by = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).withColumn("split", estimates.hashed_split("o_custkey", 0.2))
    return by.groupBy("split").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_groups"))


@query("""
with m as (select date_trunc('month', o_orderdate) as m, sum(o_totalprice)::double as t, count(*)::double as n from orders group by 1),
l as (select *, lag(t, 1) over w as l1, lag(t, 2) over w as l2 from m window w as (order by m))
select round(corr(t, l1), 6) as corr_1, round(corr(t, l2), 6) as corr_2, round(sum(t * n) / sum(n * n), 4) as origin_slope from l""")
def corr_lag(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.trunc("o_orderdate", "month").alias("m"), "o_totalprice")
    m = o.groupBy("m").agg(F.sum("o_totalprice").cast("double").alias("t"), F.count(F.lit(1)).cast("double").alias("n"))
    w = Window.orderBy("m")  # a row a month
    m = m.withColumns({f"l{i}": F.lag("t", i).over(w) for i in (1, 2)})
    lags = [F.round(F.corr(F.when(F.col(f"l{i}").isNotNull(), F.col("t")), f"l{i}"), 6).alias(f"corr_{i}") for i in (1, 2)]
    return m.agg(*lags, F.round(F.sum(F.col("t") * F.col("n")) / F.sum(F.col("n") * F.col("n")), 4).alias("origin_slope"))


@query("""
select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey)::int as k from orders
qualify k <= 3""")
def first_k(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return o.withColumn("k", k).where("k <= 3").drop("o_orderdate")


@query("""
with s as (select doc_id, ((doc_id * 7919) % 10007) / 10007.0::double as p from labels)
select doc_id, round(case when p <= 0.1 then 0.05 when p <= 0.4 then 0.05 + (p - 0.1) / 0.3 * 0.25
  when p <= 0.8 then 0.3 + (p - 0.4) / 0.4 * 0.5 when p <= 0.95 then 0.8 + (p - 0.8) / 0.15 * 0.15 else 0.95 end, 6) as calibrated from s""")
def isotonic_lookup(spark, sf_dir):
    p = ((F.col("doc_id") * 7919) % 10007) / F.lit(10007.0)
    knots = [(0.1, 0.05), (0.4, 0.3), (0.8, 0.8), (0.95, 0.95)]
    return table(spark, sf_dir, "labels").select("doc_id", F.round(estimates.piecewise_linear(p, knots), 6).alias("calibrated"))


@query("""
with c as (select o_custkey as grp, count(*) as n, avg((o_orderstatus = 'F')::int) as own from orders group by 1),
pool as (select avg((o_orderstatus = 'F')::int) as pooled from orders)
select grp, n, round(case when n >= 15 then own else pooled end, 6) as rate, n < 15 as is_pooled from c, pool""")
def pooled_rate(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("grp"), (F.col("o_orderstatus") == "F").alias("hit"))
    return estimates.pooled_rate(o, "grp", "hit", 15, 6)


@query("""
with y as (select distinct o_custkey, year(o_orderdate)::int as year from orders)
select a.year, count(*) as n, round(avg((b.year is not null)::int), 6) as coverage
from y a left join y b on b.o_custkey = a.o_custkey and b.year = a.year + 1 group by 1""")
def cohort_coverage(spark, sf_dir):
    y = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("year")).distinct()
    again = F.lead("year").over(Window.partitionBy("o_custkey").orderBy("year")) == F.col("year") + 1
    y = y.withColumn("hit", F.coalesce(again, F.lit(False)).cast("int"))
    return y.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("hit"), 6).alias("coverage"))


@query("""
with s as (select s_suppkey, s_nationkey as n, floor(s_acctbal)::bigint as b from supplier),
t1 as (select n, floor(b / 100.0)::bigint as k, min(s_suppkey) as s1 from s group by 1, 2),
t2 as (select n, floor(b / 1000.0)::bigint as k, min(s_suppkey) as s2 from s group by 1, 2),
t3 as (select n, min(s_suppkey) as s3 from s group by 1)
select c_custkey, coalesce(s1, s2, s3) as s_suppkey,
  case when s1 is not null then 1.0 when s2 is not null then 0.8 when s3 is not null then 0.5 end::double as confidence
from (select c_custkey, c_nationkey, floor(c_acctbal)::bigint as b from customer) c
left join t1 on t1.n = c_nationkey and t1.k = floor(b / 100.0)::bigint left join t2 on t2.n = c_nationkey and t2.k = floor(b / 1000.0)::bigint
left join t3 on t3.n = c_nationkey""")
def tiered_match(spark, sf_dir):
    def keyed(name, p):
        d = table(spark, sf_dir, name)
        b = F.floor(f"{p}_acctbal").cast("double")
        return d.select(F.col(f"{p}_{'cust' if p == 'c' else 'supp'}key"), F.col(f"{p}_nationkey").alias("n"),
            F.floor(b / 100).alias("k1"), F.floor(b / 1000).alias("k2"))

    tiers = [(["n", "k1"], 1.0), (["n", "k2"], 0.8), (["n"], 0.5)]
    found = estimates.tiered_match(keyed("customer", "c"), keyed("supplier", "s"), "s_suppkey", tiers)
    return found.select("c_custkey", "s_suppkey", "confidence")


@query("""
with b as (select list(c_acctbal::double / 10000) as bs from (
  select c_acctbal from customer order by md5(c_custkey::varchar), c_custkey limit 64))
select c_custkey, round(list_avg(list_transform(bs, lambda v: 1 / (1 + exp(-(c_nationkey / 25.0::double - 0.5 + 2 * v))))), 6) as score
from customer, b""")
def counterfactual_score(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    near = c.orderBy(F.md5(F.col("c_custkey").cast("string")), "c_custkey").limit(64)  # 64 background rows, by definition
    values = [float(r[0]) / 10000 for r in near.select("c_acctbal").collect()]
    score = estimates.background_mean(F.col("c_nationkey") / 25.0 - 0.5, values, 2.0)
    return c.select("c_custkey", F.round(score, 6).alias("score"))
