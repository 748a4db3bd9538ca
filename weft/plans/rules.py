"""Queries of decision rules, checks of readings, labels, dates and numbers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..registry import query
from ..sources.io import table


@query("""
with o as (select l_orderkey, max(l_quantity) filter (where l_linenumber = 1) as q1, max(l_quantity) filter (where l_linenumber = 2) as q2,
  max(l_extendedprice) filter (where l_linenumber = 1) as p1, max(l_extendedprice) filter (where l_linenumber = 2) as p2
  from lineitem group by 1)
select l_orderkey, case when q1 is null or q2 is null then '?' when abs(q1 - q2) <= 2 then '=' else '!' end as quantity,
  case when p1 is null or p2 is null then '?' when abs(p1 - p2) <= greatest(500, round(abs(p1) * 0.1)) then '=' else '!' end as price
from o""")
def tri_state_relations(spark, sf_dir):
    line = lambda n, c: F.max(F.when(F.col("l_linenumber") == n, F.col(c)))
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        line(1, "l_quantity").alias("q1"), line(2, "l_quantity").alias("q2"), line(1, "l_extendedprice").alias("p1"),
        line(2, "l_extendedprice").alias("p2"),
    )
    price = R.tri_state(F.col("p1"), F.col("p2"), R.mixed_tolerance(F.col("p1"), 500, 0.1))
    return o.select("l_orderkey", R.tri_state(F.col("q1"), F.col("q2"), 2).alias("quantity"), price.alias("price"))


@query("""
select list_min(list_transform([6.0, 12, 18, 24], lambda b: {'d': abs(l_quantity - b), 'v': b})).v::double as bucket, count(*) as n
from lineitem group by 1""")
def nearest_bucket(spark, sf_dir):
    b = R.nearest_of(F.col("l_quantity"), [6.0, 12.0, 18.0, 24.0])
    return table(spark, sf_dir, "lineitem").groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("""
with s as (select doc_id, case quality when 1 then 'VALID' else 'REVIEW' end as status, ((doc_id * 7919) % 10007) / 10007.0 as p,
  ((doc_id * 31) % 1009) / 1009.0 as score from labels)
select doc_id, case when score < 0.45 then 'REJECTED' when score < 0.7 then 'REVIEW' else status end as status,
  round(least(p, case when score < 0.45 then 0.3 when score < 0.7 then 0.6 else 1 end), 6)::double as confidence from s""")
def verdict_demotion(spark, sf_dir):
    status = F.when(F.col("quality") == 1, "VALID").otherwise("REVIEW")
    p, score = F.col("doc_id") * 7919 % 10007 / F.lit(10007.0), F.col("doc_id") * 31 % 1009 / F.lit(1009.0)
    cols = R.demoted(status, p, score, [(0.45, 0.3, "REJECTED"), (0.7, 0.6, "REVIEW")])
    return table(spark, sf_dir, "labels").select("doc_id", *cols).withColumn("confidence", F.round("confidence", 6))


@query("""
with f as (select l_orderkey as page, l_linenumber as field, case when l_quantity >= 10 then l_quantity end as value, l_returnflag from lineitem),
x as (select distinct page from f where field = 1 and l_returnflag = 'R')
select case when value is not null then 'VALID' when field > 1 and x.page is not null then 'NOT_APPLICABLE' else 'MISSING' end as status,
  count(*) as n from f left join x on f.page = x.page group by 1""")
def skip_logic(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("field"), "l_returnflag",
        F.when(F.col("l_quantity") >= 10, F.col("l_quantity")).alias("value"),
    )
    excludes = f.where("field = 1 and l_returnflag = 'R'").select("page").distinct().withColumn("out", F.lit(True))
    status = R.first_of(
        (F.col("value").isNotNull(), "VALID"), ((F.col("field") > 1) & F.col("out"), "NOT_APPLICABLE"), other="MISSING"
    )
    return f.join(excludes, "page", "left").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("""
select user_id, event_type, case count(*) filter (where value > 90) when 0 then 'MISSING' when 1 then 'VALID' else 'REVIEW' end as state
from events group by 1, 2""")
def exclusive_groups(spark, sf_dir):
    ticked = F.count_if(F.col("value") > 90)
    state = F.when(ticked == 0, "MISSING").when(ticked == 1, "VALID").otherwise("REVIEW")
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(state.alias("state"))


@query("""
with f as (unpivot (select l_quantity as quantity, l_discount as discount, l_tax as tax, l_extendedprice as price from lineitem)
  on quantity, discount, tax, price into name field value reading),
r as (select * from (values ('quantity', 2.0, 45.0), ('discount', 0.0, 0.08), ('tax', 0.01, 0.07), ('price', 1000.0, 90000.0)) t(field, low, high))
select field, count(*) as n, count(*) filter (where not reading between low and high) as flagged from f join r using (field) group by 1""")
def plausibility(spark, sf_dir):
    ranges = {"quantity": (2.0, 45.0), "discount": (0.0, 0.08), "tax": (0.01, 0.07), "price": (1000.0, 90000.0)}
    columns = {"quantity": "l_quantity", "discount": "l_discount", "tax": "l_tax", "price": "l_extendedprice"}
    rows = [F.struct(F.lit(f).alias("field"), F.col(columns[f]).alias("reading"), F.lit(a).alias("low"), F.lit(b).alias("high")) for f, (a, b) in ranges.items()]
    long = table(spark, sf_dir, "lineitem").select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    out = ~F.col("reading").between(F.col("low"), F.col("high"))
    return long.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.count_if(out).alias("flagged"))


_ERRORS = """
with e as (select year(l_shipdate)::int as year, l_suppkey, l_returnflag, l_orderkey, l_linenumber, l_extendedprice / l_quantity - p_retailprice as error
  from lineitem join part on l_partkey = p_partkey where l_quantity > 0)"""


def _errors(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").where("l_quantity > 0").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    error = F.col("l_extendedprice") / F.col("l_quantity") - F.col("p_retailprice")
    return e.select(F.year("l_shipdate").alias("year"), "l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber", error.alias("error"))


@query(_ERRORS + """
select l_suppkey, round(avg(abs(error)), 6) as mae, round(greatest(0, least(30, 30 * (4000 - avg(abs(error))) / 3000)), 6) as points
from e group by 1""")
def rubric_score(spark, sf_dir):
    e = _errors(spark, sf_dir).groupBy("l_suppkey").agg(F.avg(F.abs("error")).alias("mae"))
    return e.select("l_suppkey", F.round("mae", 6).alias("mae"), F.round(R.rubric(F.col("mae"), 1000, 4000, 30), 6).alias("points"))


@query(_ERRORS + """
select year, count(*) as n, round(avg(abs(error)), 6) as mae, round(avg(error), 6) as bias, round(max(abs(error)), 6) as worst,
  round(min(error), 6) as least, round(max(error), 6) as most from e group by 1""")
def error_summary(spark, sf_dir):
    r = lambda c, name: F.round(c, 6).alias(name)
    e = F.col("error")
    return _errors(spark, sf_dir).groupBy("year").agg(
        F.count(F.lit(1)).alias("n"), r(F.avg(F.abs(e)), "mae"), r(F.avg(e), "bias"), r(F.max(F.abs(e)), "worst"),
        r(F.min(e), "least"), r(F.max(e), "most"),
    )


@query("""
select case when quality = 1 and doc_id % 3 <> 0 then 'both' when quality = 1 then 'classic' when doc_id % 5 <> 0 then 'model' else 'none' end as outcome,
  count(*) as n, count(*) filter (where toxic = 1) as toxic from labels group by 1""")
def fallback_outcome(spark, sf_dir):
    classic, model = F.col("quality") == 1, F.col("doc_id")
    name = R.first_of((classic & (model % 3 != 0), "both"), (classic, "classic"), (model % 5 != 0, "model"), other="none")
    return table(spark, sf_dir, "labels").groupBy(name.alias("outcome")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("toxic") == 1).alias("toxic")
    )


@query(r"""
select page_id, case when regexp_matches(coalesce(url, ''), '^https?://[^/]*\.org') then 'public'
  when regexp_matches(coalesce(url, ''), '/(de|fr|es)/') then 'translated' when regexp_matches(coalesce(url, ''), '[0-9]{3,}') then 'numbered'
  else 'other' end as class from pages""")
def source_class(spark, sf_dir):
    patterns = [(r"^https?://[^/]*\.org", "public"), (r"/(de|fr|es)/", "translated"), (r"[0-9]{3,}", "numbered")]
    return table(spark, sf_dir, "pages").select("page_id", R.by_pattern(F.col("url"), patterns, "other").alias("class"))


@query("""
with a as (select l_orderkey, l_linenumber, date_diff('day', o_orderdate::date, l_shipdate::date) as days, l_quantity from lineitem join orders on l_orderkey = o_orderkey)
select case when days is null then 'unknown' when days between 0 and 20 then 'newborn' when abs(days) > 400 and l_quantity > 25 then 'other' else 'mother' end as type,
  count(*) as n, count(distinct l_orderkey) as orders from a group by 1""")
def twin_type(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    days = F.datediff("l_shipdate", "o_orderdate")
    kind = F.when(days.isNull(), "unknown").when(days.between(0, 20), "newborn").when((F.abs(days) > 400) & (F.col("l_quantity") > 25), "other").otherwise("mother")
    return a.groupBy(kind.alias("type")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_orderkey").alias("orders"))


@query("""
select (year(o_orderdate) - (month(o_orderdate) * 100 + day(o_orderdate) < 402)::int)::int as window, count(*) as n,
  min(make_date(year(o_orderdate), 1, 1)) as year_begins, max(make_date(year(o_orderdate), 12, 31)) as year_ends,
  round(avg(greatest(0.0::double, least(1.0::double, date_diff('day', o_orderdate::date, date '1996-03-31') / 365.0::double))), 6) as before_reform
from orders group by 1""")
def policy_windows(spark, sf_dir):
    d = F.col("o_orderdate")
    early = R.previous_window(d, 4, 2).cast("int")
    share = R.window_share(d.cast("date"), F.date_add(d.cast("date"), 365), F.lit("1996-03-31").cast("date"))
    return table(spark, sf_dir, "orders").groupBy((F.year(d) - early).alias("window")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.make_date(F.year(d), F.lit(1), F.lit(1))).alias("year_begins"),
        F.max(F.make_date(F.year(d), F.lit(12), F.lit(31))).alias("year_ends"), F.round(F.avg(share), 6).alias("before_reform"),
    )


@query("""
select p_brand, p_type, p_size, count(*) as rows from part group by 1, 2, 3 having count(*) > 1""")
def repeated_feature_rows(spark, sf_dir):
    """Only columns that are no identifiers may be features; their repeated rows have to stay on one side of a split."""
    part = table(spark, sf_dir, "part")
    names = spark.createDataFrame([(c,) for c in part.columns], "name string")
    known = {r["name"] for r in names.where(~R.is_identifier(F.col("name"))).collect()}
    features = [c for c in ("p_brand", "p_type", "p_size") if c in known]
    return part.groupBy(*features).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


@query("""
select year(coalesce(case o_orderpriority when '1-URGENT' then date '1999-12-31' when '5-LOW' then date '2000-06-30' end, o_orderdate::date))::int as year,
  count(*) as n from orders group by 1""")
def date_override(spark, sf_dir):
    own = F.create_map(*[F.lit(x) for x in ("1-URGENT", "1999-12-31", "5-LOW", "2000-06-30")])
    day = F.coalesce(own[F.col("o_orderpriority")].cast("date"), F.col("o_orderdate").cast("date"))
    return table(spark, sf_dir, "orders").groupBy(F.year(day).alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query("""
select c_nationkey, string_agg(distinct c_mktsegment, ', ' order by c_mktsegment) as segments, count(distinct c_mktsegment) as n from customer group by 1""")
def segment_inventory(spark, sf_dir):
    kinds = F.array_sort(F.collect_set("c_mktsegment"))
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(
        F.concat_ws(", ", kinds).alias("segments"), F.size(kinds).cast("long").alias("n")
    )


@query("""
select case when role like 'assist%' then 'answered' when role like 'user%' then 'asked' else 'other' end as measure, count(*) as n,
  count(distinct conv_id) as records, sum(length(coalesce(text, '')))::bigint as chars from conversations group by 1 having count(*) >= 5""")
def nested_indicators(spark, sf_dir):
    turns = F.collect_list(F.struct("role", "text")).alias("turns")
    nested = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns)
    f = nested.select("conv_id", F.explode("turns").alias("t")).select("conv_id", "t.*")
    kind = F.when(F.col("role").like("assist%"), "answered").when(F.col("role").like("user%"), "asked").otherwise("other")
    out = f.groupBy(kind.alias("measure")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("conv_id").alias("records"),
        F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"),
    )
    return out.where("n >= 5")


@query("""
select p_partkey, case p_partkey % 4 when 0 then p_size when 1 then p_size + (p_partkey % 10) / 10 when 2 then p_size + 0.5 end::double as grid from part""")
def grid_numbers(spark, sf_dir):
    """Grid labels made from parts: letters, letters with a tenth, numbers, and names, which are none."""
    k, i = F.col("p_partkey") % 4, F.col("p_size") - 1
    letters = F.concat(F.when(i > 25, F.char(64 + F.floor(i / 26))).otherwise(""), F.char(65 + i % 26))
    label = F.when(k == 0, letters).when(k == 1, F.concat(letters, F.lit("."), (F.col("p_partkey") % 10).cast("string")))
    label = label.when(k == 2, F.concat("p_size", F.lit(".5"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", R.grid_number(label).alias("grid"))


@query(r"""
with n as (select p_partkey, replace(p_name, ' ', '_') || '_' || p_brand || '_' || p_size as name from part)
select p_partkey, regexp_extract(name, '^(.+)_([^_]+)_(\d+)$', 1) as lens, regexp_extract(name, '^(.+)_([^_]+)_(\d+)$', 2) as phone,
  regexp_extract(name, '^(.+)_([^_]+)_(\d+)$', 3)::int as rep from n""")
def name_parts(spark, sf_dir):
    name = F.concat_ws("_", F.replace("p_name", F.lit(" "), F.lit("_")), "p_brand", "p_size")
    part = lambda i: F.regexp_extract(name, r"^(.+)_([^_]+)_(\d+)$", i)
    return table(spark, sf_dir, "part").select("p_partkey", part(1).alias("lens"), part(2).alias("phone"), part(3).cast("int").alias("rep"))


@query("""
select s_suppkey, replace(replace(replace(format('{:,.2f}', s_acctbal), ',', '~'), '.', ','), '~', ' ') as shown from supplier""")
def french_numbers(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", R.french_number(F.col("s_acctbal"), 2).alias("shown"))


@query("select event_id, event_id % 5 < 2 as ok from events")
def zoned_times(spark, sf_dir):
    """Times of events written with a zone, without one, as days alone and with a month that doesn't exist."""
    k, day = F.col("event_id") % 5, F.date_format("ts", "yyyy-MM-dd")
    time = F.date_format("ts", "HH:mm:ss")
    text = F.when(k == 0, F.concat(day, F.lit("T"), time, F.lit("Z"))).when(k == 1, F.concat(day, F.lit("T"), time, F.lit(".25+01:00")))
    text = text.when(k == 2, F.concat(day, F.lit("T"), time)).when(k == 3, day).otherwise(F.concat(F.lit("2024-13-02T"), time, F.lit("Z")))
    return table(spark, sf_dir, "events").select("event_id", R.zoned(text).isNotNull().alias("ok"))


@query("""
with d as (select l_orderkey, l_linenumber, o_orderdate::date as last_period, l_shipdate::date as visit from lineitem join orders on l_orderkey = o_orderkey)
select l_orderkey, l_linenumber, last_period + 287 as due, floor(date_diff('day', last_period, visit) / 7)::bigint as weeks,
  date_diff('day', last_period, visit) not between 0 and 308 as flagged, last_period + 28 * greatest(1, ceil(date_diff('day', last_period, visit) / 28.0))::int as next_visit
from d""")
def due_dates(spark, sf_dir):
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    first, visit = F.col("o_orderdate").cast("date"), F.col("l_shipdate").cast("date")
    days = F.datediff(visit, first)
    return j.select(
        "l_orderkey", "l_linenumber", F.date_add(first, 280 + 7).alias("due"), F.floor(days / 7).alias("weeks"),
        (~days.between(0, 308)).alias("flagged"),
        F.date_add(first, (28 * F.greatest(F.lit(1), F.ceil(days / 28))).cast("int")).alias("next_visit"),
    )


@query("""
with y as (select year(l_shipdate)::int as year, avg((l_discount > 0.05)::int)::double as share, avg(l_discount) as level from lineitem group by 1),
k as (select *, case when share > 0 and share < 1 and level > 0 then -ln(1 - share) / level end as rate from y)
select year, round(rate, 6) as rate, round(1 - exp(-rate * 0.03), 6) as at_three from k""")
def penetration_rate(spark, sf_dir):
    share = F.avg((F.col("l_discount") > 0.05).cast("double"))
    y = table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(share.alias("share"), F.avg("l_discount").alias("level"))
    k = y.select("year", R.saturation_rate(F.col("share"), F.col("level")).alias("rate"))
    return k.select("year", F.round("rate", 6).alias("rate"), F.round(R.saturation(F.lit(0.03), F.col("rate")), 6).alias("at_three"))


@query("""
with s as (select c_nationkey, avg(c_acctbal) as m, stddev_samp(c_acctbal) as sd from customer group by 1)
select c_custkey, round((c_acctbal - m) / sd, 6) as z from customer join s using (c_nationkey) where sd > 0""")
def z_scores(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    s = c.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("m"), F.stddev_samp("c_acctbal").alias("sd")).where("sd > 0")
    return c.join(s, "c_nationkey").select("c_custkey", F.round((F.col("c_acctbal") - F.col("m")) / F.col("sd"), 6).alias("z"))


@query("""
with p as (select vec_id, list_transform(range(1, 16), lambda i: {'x': embedding[2 * i]::double, 'y': embedding[2 * i + 1]::double}) as pts from embeddings
  where embedding is not null and len(list_filter(embedding[2:31], lambda e: e is null or isnan(e) or isinf(e))) = 0),
a as (select vec_id, list_transform(pts, lambda p: p.x * cos(0.5) + p.y * sin(0.5)) as along from p)
select vec_id, round(list_max(along) - list_min(along), 5) as extent, round((list_max(along) - list_min(along)) * 0.9, 5) as in_plane from a""")
def extent_along(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").where("embedding is not null")
    e = e.where(F.forall(F.slice("embedding", 2, 30), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))))
    at = lambda i: F.get("embedding", i).cast("double")
    points = F.transform(F.sequence(F.lit(1), F.lit(15)), lambda i: F.struct(at(2 * i - 1).alias("x"), at(2 * i).alias("y")))
    e = e.select("vec_id", points.alias("p")).withColumn("q", R.seen_from(F.col("p"), 10.0, 1.0))
    return e.select("vec_id", F.round(R.extent(F.col("p"), 0.5), 5).alias("extent"), F.round(R.extent(F.col("q"), 0.5), 5).alias("in_plane"))


@query("""
with q as (select l_orderkey, list(l_quantity order by l_linenumber, l_quantity) as v from lineitem group by 1 having count(*) <= 8),
m as (select l_orderkey, v, unnest(range(1, (2 ** len(v))::bigint)) as mask from q),
s as (select l_orderkey, mask, bit_count(mask::bigint) as n, list_sum(list_filter(v, lambda x, i: (mask >> (i - 1)) & 1 = 1)) as total from m)
select l_orderkey, arg_min(mask, n * 1000 + mask)::int as mask from s where total = 50 group by 1""")
def subset_sum(spark, sf_dir):
    rows = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity")))["l_quantity"]
    q = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(rows.alias("v")).where(F.size("v") <= 8)
    return q.select("l_orderkey", R.least_subset(F.col("v"), F.lit(50.0)).alias("mask")).where("mask is not null")


@query("""
with d as (select l_orderkey, l_linenumber, case l_linestatus when 'F' then 'diameter' else 'quantity' end as attribute,
  l_quantity - 25 as delta, 1 - l_discount as c1, 1 - l_tax as c2 from lineitem)
select case when attribute = 'diameter' and delta <> 0 then 'critical' when attribute = 'quantity' and delta < 0 then 'major' else 'minor' end as severity,
  count(*) as n, round(sum(round(greatest(0.05, least(0.99, least(c1, c2) * case when delta < 0 then 0.9 else 1.0 end)), 2)), 4) as confidence
from d group by 1""")
def finding_severity(spark, sf_dir):
    kind, delta = F.when(F.col("l_linestatus") == "F", "diameter").otherwise("quantity"), F.col("l_quantity") - 25
    levels = {("diameter", 1): "critical", ("diameter", -1): "critical", ("quantity", -1): "major"}
    sure = R.combined_confidence([1 - F.col("l_discount"), 1 - F.col("l_tax")], F.when(delta < 0, 0.9).otherwise(1.0))
    return table(spark, sf_dir, "lineitem").groupBy(R.severity(kind, delta, levels, "minor").alias("severity")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(sure), 4).alias("confidence")
    )


@query("""
with v as (select l_orderkey, l_linenumber, l_returnflag, l_quantity, case when l_linenumber % 4 = 0 then 'rejected' when l_linenumber % 4 = 1 then 'confirmed' end as verdict from lineitem)
select l_returnflag, count(*) as n, count(*) filter (where verdict = 'confirmed') as sure from v where verdict is distinct from 'rejected' group by 1""")
def verdict_overlay(spark, sf_dir):
    found = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    human = found.select("l_linenumber", F.when(F.col("l_linenumber") % 4 == 0, "rejected").when(F.col("l_linenumber") % 4 == 1, "confirmed").alias("verdict")).distinct()
    judged = found.join(human, "l_linenumber", "left").where(~F.col("verdict").eqNullSafe(F.lit("rejected")))
    return judged.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "confirmed").alias("sure"))


@query(r"""
with p as (select page_id, len(regexp_extract_all(regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g'), '[^\x20\x09-\x0D]+'))::bigint as words from pages)
select page_id, words, words < 25 as needs_reading from p""")
def page_needs_reading(spark, sf_dir):
    words = F.regexp_count(F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", " "), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    p = table(spark, sf_dir, "pages").select("page_id", words.alias("words"))
    return p.withColumn("needs_reading", F.col("words") < 25)


@query(r"""
with u as (select page_id, unnest(string_split(regexp_replace(coalesce(html, ''), '<[^>]*>', chr(10), 'g'), chr(10))) as unit,
    unnest(range(1, len(string_split(regexp_replace(coalesce(html, ''), '<[^>]*>', chr(10), 'g'), chr(10))) + 1)) as line from pages)
select page_id, count(*) as units, min(line)::bigint as first_line, sha256(string_agg(line || ':' || trim(unit, ' '), chr(10) order by line)) as digest
from u where trim(unit, ' ') <> '' group by 1""")
def html_units(spark, sf_dir):
    """Text between tags as units with line locators."""
    lines = F.split(F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", "\n"), "\n", -1)
    units = F.filter(F.transform(lines, lambda u, i: F.struct((i + 1).alias("line"), F.trim(u).alias("unit"))), lambda x: x["unit"] != "")
    p = table(spark, sf_dir, "pages").select("page_id", units.alias("u")).where(F.size("u") > 0)
    said = F.array_join(F.transform("u", lambda x: F.concat_ws(":", x["line"], x["unit"])), "\n")
    return p.select("page_id", F.size("u").cast("long").alias("units"), F.get("u", F.lit(0))["line"].cast("long").alias("first_line"), F.sha2(said, 256).alias("digest"))


@query("""
with d as (select o_custkey, o_orderkey, o_totalprice, date_diff('day', lag(o_orderdate::date) over w, o_orderdate::date) as gap,
  date_diff('day', o_orderdate::date, lead(o_orderdate::date) over w) as ahead from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey))
select o_orderkey, gap not between 7 and 120 as from_before, ahead not between 7 and 120 as from_after,
  coalesce(gap not between 7 and 120, false) or coalesce(ahead not between 7 and 120, false) as flagged from d""")
def visit_checks(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", (~F.datediff("o_orderdate", F.lag("o_orderdate").over(w)).between(7, 120)).alias("from_before"),
        (~F.datediff(F.lead("o_orderdate").over(w), "o_orderdate").between(7, 120)).alias("from_after"),
    )
    flagged = F.coalesce("from_before", F.lit(False)) | F.coalesce("from_after", F.lit(False))
    return o.withColumn("flagged", flagged)


@query("""
select o_orderkey, format('NC-{:04d}', row_number() over (partition by o_custkey, o_orderstatus order by o_orderdate, o_orderkey)) as ordinal from orders""")
def ordinal_ids(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("o_custkey", "o_orderstatus").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.format_string("NC-%04d", n).alias("ordinal"))


@query("""
select lower(p_brand) as brand, p_size, max(p_partkey) + 1 as next_number, count(*) as n from part group by 1, 2""")
def next_numbers(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.lower("p_brand").alias("brand"), "p_size").agg(
        (F.max("p_partkey") + 1).alias("next_number"), F.count(F.lit(1)).alias("n")
    )


@query("""
with n as (select p_partkey, p_name || ' ' || p_brand || ' ' || p_type as id, row_number() over (partition by p_name, p_brand, p_type order by p_partkey) as k from part)
select p_partkey, case when k > 1 then id || '-' || k else id end as id from n""")
def unique_ids(spark, sf_dir):
    k = F.row_number().over(Window.partitionBy("p_name", "p_brand", "p_type").orderBy("p_partkey"))
    base = F.concat_ws(" ", "p_name", "p_brand", "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", F.when(k > 1, F.concat_ws("-", base, k)).otherwise(base).alias("id"))


@query("""
with r as (select l_orderkey, list(l_extendedprice / l_quantity order by l_linenumber, l_extendedprice)[1:3] as v from lineitem where l_quantity > 0 group by 1)
select l_orderkey, round(list_median(v), 6) as middle, round(list_max(v) - list_min(v), 6) as spread, list_max(v) - list_min(v) > 200 as inconsistent from r""")
def present_readings(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").where("l_quantity > 0")  # noqa: E741
    by = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_extendedprice", (F.col("l_extendedprice") / F.col("l_quantity")).alias("x"))))
    r = l.groupBy("l_orderkey").agg(F.slice(by, 1, 3)["x"].alias("v")).withColumn("s", F.array_sort("v"))
    n = F.size("s")
    middle = (F.get("s", F.floor((n - 1) / 2).cast("int")) + F.get("s", F.floor(n / 2).cast("int"))) / 2
    spread = F.array_max("v") - F.array_min("v")
    return r.select("l_orderkey", F.round(middle, 6).alias("middle"), F.round(spread, 6).alias("spread"), (spread > 200).alias("inconsistent"))
