"""Statistics, text, privacy, record, state and streaming-equivalent queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import linking, ranks, records, stats
from ..registry import query
from ..sources.io import table
from ..streaming import jobs

_SCORED = """
with s as (select l.doc_id, quality, lang, ((l.doc_id * 7919) % 10007) / 10007.0 as p from labels l join documents d using (doc_id))"""


def _scored(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    p = ((F.col("doc_id") * 7919) % 10007) / F.lit(10007.0)
    return table(spark, sf_dir, "labels").join(d, "doc_id").select("doc_id", "quality", "lang", p.alias("p"))


@query("""
with c as (select event_type, hour(ts)::int as hour, count(*) filter (where value > 50) as num, count(*) as den from events group by all)
select event_type, hour, case when den >= 5 and not (num > 0 and num < 5) then num end as num,
  case when den >= 5 then den end as den, round(case when den >= 5 and not (num > 0 and num < 5) then num / den end, 6) as rate,
  den < 5 or (num > 0 and num < 5) as suppressed from c""")
def kanon_indicators(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("event_type", F.hour("ts").alias("hour"))
    c = e.agg(F.count_if(F.col("value") > 50).alias("num"), F.count(F.lit(1)).alias("den"))
    cols = stats.suppressed_rate(F.col("num"), F.col("den"))
    return c.select("event_type", "hour", *[(F.round(v, 6) if k == "rate" else v).alias(k) for k, v in cols.items()])


@query("""
select case when a is null then 'unknown' when a < 20 then '<20' when a < 35 then '20-34' else '35+' end as band, count(*) as n
from (select case when c_acctbal >= 0 then floor(c_acctbal / 100)::int end as a from customer) group by 1""")
def age_bands(spark, sf_dir):
    a = F.when(F.col("c_acctbal") >= 0, F.floor(F.col("c_acctbal") / 100).cast("int"))
    return table(spark, sf_dir, "customer").groupBy(T.band(a).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query(_SCORED + """
select coalesce(lang, 'all') as lang, count(*) as n, round(avg(((p >= 0.5)::int = quality)::int), 6) as acc,
  round(avg((p >= 0.8)::int), 6) as auto_rate from s group by rollup (lang)""")
def scorecard_rollup(spark, sf_dir):
    hit = ((F.col("p") >= 0.5).cast("int") == F.col("quality")).cast("double")
    return _scored(spark, sf_dir).rollup("lang").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(hit), 6).alias("acc"),
        F.round(F.avg((F.col("p") >= 0.8).cast("double")), 6).alias("auto_rate"),
    ).withColumn("lang", F.coalesce("lang", F.lit("all")))


@query(_SCORED + """
select least(floor(p * 10), 9)::int as bin, count(*) as n, round(avg(p), 6) as conf, round(avg(quality), 6) as acc from s group by 1""")
def ece_bins(spark, sf_dir):
    b = stats.calibration_bins(_scored(spark, sf_dir), "p", "quality")
    return b.select("bin", "n", F.round("conf", 6).alias("conf"), F.round("acc", 6).alias("acc"))


@query(_SCORED + """, d as (select p, count(*) as n, sum(quality) as h from s group by p),
a as (select p, sum(h) over (order by p desc) / sum(n) over (order by p desc) as acc, sum(n) over (order by p desc) as taken from d)
select round(min(p), 6) as tau, max(taken)::bigint as accepted from a where acc >= 0.6""")
def accept_threshold(spark, sf_dir):
    t = stats.accept_threshold(_scored(spark, sf_dir), "p", "quality", 0.6)
    return t.select(F.round("tau", 6).alias("tau"), "accepted")


@query(_SCORED + """, r as (
  select *, rank() over (partition by lang order by p) + (count(*) over (partition by lang, p) - 1) / 2.0 as mid from s),
m as (select lang, count(*) as n, sum(quality) as pos, avg(((p >= 0.5)::int = quality)::int) as acc,
  avg((p - quality) ** 2) as brier, sum(mid * quality) as r from r group by lang)
select lang, n, round(acc, 6) as acc, round(brier, 6) as brier,
  round(case when pos > 0 and pos < n then (r - pos * (pos + 1) / 2) / (pos * (n - pos)) end, 6) as auc,
  round(((acc + 1.96 * 1.96 / (2 * n)) - 1.96 * sqrt(acc * (1 - acc) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) as low
from m""")
def binary_metrics(spark, sf_dir):
    s = _scored(spark, sf_dir)
    hit = ((F.col("p") >= 0.5).cast("int") == F.col("quality")).cast("long")
    m = s.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.sum(hit).alias("hit"), F.avg(F.pow(F.col("p") - F.col("quality"), 2)).alias("brier")
    )
    low, _ = stats.wilson(F.col("hit"), F.col("n"))
    return m.join(stats.rank_auc(s, ["lang"], "p", "quality"), "lang").select(
        "lang", "n", F.round(F.col("hit") / F.col("n"), 6).alias("acc"), F.round("brier", 6).alias("brier"),
        F.round("auc", 6).alias("auc"), F.round(low, 6).alias("low"),
    )


_MEASURED = """
with m as (select l_suppkey % 5 as g, l_partkey, l_extendedprice / l_quantity as x, p_retailprice as r
  from lineitem join part on l_partkey = p_partkey)"""


def _measured(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("r"))
    x = (F.col("l_extendedprice") / F.col("l_quantity")).alias("x")
    return table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).alias("g"), "l_partkey", x).join(p, "l_partkey")


@query(_MEASURED + """
select g, count(*) as n, round(avg(x - r), 5) as bias, round(stddev_samp(x - r), 5) as sd,
  round(avg(x - r) - 1.96 * stddev_samp(x - r), 5) as low, round(avg(x - r) + 1.96 * stddev_samp(x - r), 5) as high,
  round(regr_slope(x - r, (x + r) / 2), 5) as slope from m group by g""")
def bland_altman(spark, sf_dir):
    b = stats.bland_altman(_measured(spark, sf_dir), ["g"], "x", "r")
    return b.select("g", "n", *[F.round(c, 5).alias(c) for c in ("bias", "sd", "low", "high", "slope")])


@query(_MEASURED + """, c as (select g, l_partkey, count(*) as n, var_samp(x) as v from m group by 1, 2 having count(*) > 1)
select round(sqrt(sum(v * (n - 1)) / sum(n - 1)), 5) as repeatability, count(*) as cells from c""")
def repeatability(spark, sf_dir):
    r = stats.pooled_sd(_measured(spark, sf_dir), ["g", "l_partkey"], "x")
    return r.select(F.round("repeatability", 5).alias("repeatability"), "cells")


@query(_MEASURED + """, f as (
  select h.g, regr_slope(m.x, m.r) as slope, regr_intercept(m.x, m.r) as icept
  from (select distinct g from m) h join m on m.g <> h.g group by h.g)
select g, round(any_value(slope), 4) as slope, round(any_value(icept), 3) as intercept,
  round(avg(abs(x - slope * r - icept)), 4) as mae, round(avg(abs(x - r)), 4) as mae_before from m join f using (g) group by g""")
def logo_regression(spark, sf_dir):
    r = stats.leave_group_out(_measured(spark, sf_dir), "g", "r", "x")
    return r.select("g", *[F.round(c, k).alias(c) for c, k in (("slope", 4), ("intercept", 3), ("mae", 4), ("mae_before", 4))])


@query("""
with a as (select l_partkey, l_extendedprice / l_quantity as x, median(l_extendedprice / l_quantity) over (partition by l_partkey) as m,
  count(*) over (partition by l_partkey) as n from lineitem),
b as (select *, abs(x - m) as d, greatest(0.3, 2.5 * median(abs(x - m)) over (partition by l_partkey)) as tol from a)
select l_partkey, round(median(x), 6) as fused, count(*) as used, round(max(x) - min(x), 6) as spread, any_value(n) as shots
from b where n < 3 or d <= tol group by 1""")
def mad_fusion(spark, sf_dir):
    x = (F.col("l_extendedprice") / F.col("l_quantity")).alias("x")
    f = stats.robust_fusion(table(spark, sf_dir, "lineitem").select("l_partkey", x), ["l_partkey"], "x", 0.3, 2.5)
    return f.select("l_partkey", F.round("fused", 6).alias("fused"), "used", F.round("spread", 6).alias("spread"), "shots")


@query("""
with c as (select user_id, event_type, count(*) as n from events group by 1, 2),
r as (select *, row_number() over (partition by user_id order by n desc, event_type) as k from c)
select user_id, event_type, n as votes, n >= 2 as accepted from r where k = 1""")
def majority_vote(spark, sf_dir):
    c = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("votes"))
    best = c.groupBy("user_id").agg(F.min(F.struct((-F.col("votes")).alias("k"), "event_type")).alias("b"))
    votes = -F.col("b.k")
    return best.select("user_id", "b.event_type", votes.alias("votes"), (votes >= 2).alias("accepted"))


@query(rf"""
select doc_id, translate(lower(text), '{T.MARKED}', '{T.PLAIN}') as plain,
  regexp_replace(regexp_replace(upper(source), '[^A-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as code from documents""")
def text_canonical(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.strip_accents(F.col("text")).alias("plain"), T.norm_code(F.col("source")).alias("code"))


@query(rf"""
select doc_id, regexp_matches(text, '{T.EMAIL}') as email, regexp_matches(text, '{T.IP}') as ip,
  regexp_matches(text, '{T.PHONE}') as phone from documents""")
def pii_scan(spark, sf_dir):
    kinds = T.pii_kinds(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", *[F.coalesce(F.array_contains(kinds, k), F.lit(False)).alias(k) for k in ("email", "ip", "phone")]
    )


@query(rf"""
select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '{T.EMAIL}', '[EMAIL]', 'g'), '{T.IP}', '[IP]', 'g'),
  '{T.PHONE}', '[PHONE]', 'g')) as redacted_md5 from documents""")
def pii_redact(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.redact(F.col("text"))).alias("redacted_md5"))


_TERMS = ("license", "apache", "trash", "the")


@query("""
with s as (select doc_id, 10 * ((contains(lower(text), 'license'))::int + (contains(lower(text), 'apache'))::int
  + (contains(lower(text), 'trash'))::int + (contains(lower(text), 'the'))::int)
  + 25 * (contains(lower(text), 'apache license'))::int as score from documents)
select doc_id, score from s where score > 0 order by score desc, doc_id limit 8""")
def keyword_search(spark, sf_dir):
    low = F.lower("text")
    score = sum((F.contains(low, F.lit(t)).cast("int") for t in _TERMS), F.lit(0)) * 10
    score = score + 25 * F.contains(low, F.lit("apache license")).cast("int")
    d = table(spark, sf_dir, "documents").select("doc_id", score.alias("score"))
    return d.where("score > 0").orderBy(F.desc("score"), "doc_id").limit(8)


@query(r"""
with w as (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from documents)
select word, count(*) as n from w group by 1""")
def word_freq(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    w = d.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query(r"""
select event_type, bool_and(regexp_matches(props->>'k', '^-?[0-9]+$')) as is_number, min((props->>'k')::bigint) as low,
  max((props->>'k')::bigint) as high, count(distinct props->>'k') as kinds from events group by 1""")
def kind_inference(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").withColumn("k", k).groupBy("event_type").agg(
        F.bool_and(F.col("k").rlike("^-?[0-9]+$")).alias("is_number"), F.min(F.col("k").cast("long")).alias("low"),
        F.max(F.col("k").cast("long")).alias("high"), F.countDistinct("k").alias("kinds"),
    )


@query("""
select conv_id, turn, conv_id || '-' || row_number() over (partition by conv_id, role order by turn) || '-' || role as unit,
  count(*) over (partition by conv_id, role) > 1 as repeated from conversations""")
def turn_units(spark, sf_dir):
    c, w = table(spark, sf_dir, "conversations"), Window.partitionBy("conv_id", "role")
    unit = F.concat_ws("-", "conv_id", F.row_number().over(w.orderBy("turn")), "role")
    return c.select("conv_id", "turn", unit.alias("unit"), (F.count(F.lit(1)).over(w) > 1).alias("repeated"))


_B = """
with b as (select o_orderkey, case when o_orderkey % 10 = 0 then o_totalprice + 1 else o_totalprice end as o_totalprice,
  case when o_orderkey % 15 = 0 then o_orderpriority || 'XYZ' when o_orderkey % 14 = 0 then o_orderpriority || 'X'
    else o_orderpriority end as o_orderpriority from orders where o_orderkey % 7 <> 0
  union all select -o_orderkey, o_totalprice, o_orderpriority from orders where o_orderkey % 100 = 0)"""


def _version_b(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    k = F.col("o_orderkey")
    price = F.when(k % 10 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    mark = F.when(k % 15 == 0, "XYZ").when(k % 14 == 0, "X").otherwise("")
    b = o.where(k % 7 != 0).select(k, price.alias("o_totalprice"), F.concat("o_orderpriority", mark).alias("o_orderpriority"))
    return o, b.unionByName(o.where(k % 100 == 0).withColumn("o_orderkey", -k))


@query(_B + """
select coalesce(o.o_orderkey, b.o_orderkey) as o_orderkey, case when o.o_orderkey is null then 'new' when b.o_orderkey is null
  then 'removed' when o.o_totalprice = b.o_totalprice then 'same' else 'changed' end as status
from orders o full join b on o.o_orderkey = b.o_orderkey""")
def record_diff(spark, sf_dir):
    o, b = _version_b(spark, sf_dir)
    return records.diff(o, b, ["o_orderkey"], ["o_totalprice"])


@query(_B + """
select b.o_orderkey, case when o.o_orderkey is null then 'new' when o.o_orderpriority = b.o_orderpriority then 'kept'
  when levenshtein(o.o_orderpriority, b.o_orderpriority) <= 2 then 'repaired' else 'conflict' end as verdict,
  case when o.o_orderkey is not null and levenshtein(o.o_orderpriority, b.o_orderpriority) <= 2 then o.o_orderpriority
    else b.o_orderpriority end as value
from b left join orders o on o.o_orderkey = b.o_orderkey""")
def reconcile(spark, sf_dir):
    o, b = _version_b(spark, sf_dir)
    return records.reconcile(o, b, ["o_orderkey"], "o_orderpriority")


@query("""
select 'quantity_range' as rule, l_orderkey || '-' || l_linenumber as row_key from lineitem where not l_quantity between 2 and 49
union all select 'discount_range', l_orderkey || '-' || l_linenumber from lineitem where l_discount > 0.09
union all select 'order_missing', l_orderkey || '-' || l_linenumber from lineitem
  where l_orderkey not in (select o_orderkey from orders where o_orderkey % 50 <> 0)""")
def expectations(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderkey % 50 <> 0")
    known = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.lit(True).alias("known"))
    line = table(spark, sf_dir, "lineitem").join(known, "l_orderkey", "left")
    rules = {"quantity_range": F.col("l_quantity").between(2, 49), "discount_range": F.col("l_discount") <= 0.09,
             "order_missing": F.col("known")}
    return records.expectations(line, F.concat_ws("-", "l_orderkey", "l_linenumber"), rules)


_EDGES = {"signup": {"view", "click", "error"}, "view": {"click", "view", "purchase"}, "click": {"view", "purchase", "error"},
          "purchase": {"view", "click"}, "error": {"view", "signup"}}


@query("""
with e as (select event_id, user_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as before from events)
select event_id, before, before is null or (before || '>' || event_type) in (""" + ", ".join(
    f"'{a}>{b}'" for a, to in _EDGES.items() for b in sorted(to)
) + ") as legal from e")
def lifecycle_check(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    e = records.illegal_transitions(e, ["user_id"], "event_type", ["ts", "event_id"], _EDGES)
    return e.select("event_id", "before", "legal")


@query("""select user_id, arg_max(event_type, (ts, event_id)) as state, count(*) as version from events group by 1""")
def state_replay(spark, sf_dir):
    return records.replay(table(spark, sf_dir, "events"), ["user_id"], "event_type", ["ts", "event_id"])


@query("select event_id, user_id, value from events")
def idempotent_upsert(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    sent = e.withColumn("try", F.lit(0)).unionByName(e.withColumn("value", F.col("value") + 1).withColumn("try", F.lit(1)))
    return records.upsert_once(sent, ["event_id"], ["try"]).select("event_id", "user_id", "value")


@query("""
with r as (select *, case event_type when 'purchase' then 3 when 'signup' then 2 when 'click' then 1 else 0 end as k from events)
select user_id, arg_max(event_id, (k, ts, event_id)) filter (where event_type <> 'error') as event_id,
  arg_max(event_type, (k, ts, event_id)) filter (where event_type <> 'error') as event_type, count(*) as facts from r group by 1""")
def precedence_state(spark, sf_dir):
    k = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "signup", 2)
    k = k.when(F.col("event_type") == "click", 1).otherwise(0)
    e = table(spark, sf_dir, "events").withColumn("k", k)
    return records.precedence(e, "user_id", ["k", "ts", "event_id"], F.col("event_type") != "error", ["event_id", "event_type"])


@query("""
with e as (select *, row_number() over (partition by user_id order by ts, event_id) as n from events where event_type = 'error')
select event_id, least(600, 2 ** least(n, 20))::bigint as wait_s, n > 5 as failed from e""")
def backoff_schedule(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    wait = F.least(F.lit(600.0), F.pow(F.lit(2.0), F.least(n, F.lit(20)))).cast("long")
    return e.select("event_id", wait.alias("wait_s"), (n > 5).alias("failed"))


@query("""
with b as (select user_id, sum(value) as v from events where ts < timestamp '2024-01-16' group by 1),
a as (select user_id, sum(value) as v from events group by 1)
select user_id, case when b.v is null then 'new' when round(a.v, 6) = round(b.v, 6) then 'unchanged' else 'changed' end as effect
from a left join b using (user_id)""")
def event_apply_diff(spark, sf_dir):
    early = F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), F.col("value"))
    a = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum("value").alias("a"), F.sum(early).alias("b"))
    same = F.round("a", 6) == F.round("b", 6)
    return a.select("user_id", F.when(F.col("b").isNull(), "new").when(same, "unchanged").otherwise("changed").alias("effect"))


@query("""select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all""")
def tumbling(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("ts", "event_type", "value")
    return jobs.tumbling_counts(e, "ts", "1 hour", "event_type").withColumn("total", F.round("total", 4))


@query("""select time_bucket(interval 30 minute, ts) - to_minutes(30 * k) as start, event_type, count(*) as n
  from events, (values (0), (1)) t(k) group by all""")
def sliding(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("ts", "event_type")
    return jobs.sliding_counts(e, "ts", "1 hour", "30 minutes", "event_type")


@query("""
with h as (select vec_id, list_transform(range(1, 65), lambda i: coalesce(embedding[i] > 0, false)) as s from embeddings),
d as (select a.vec_id, b.vec_id as other, list_sum(list_transform(range(1, 65), lambda i: (a.s[i] <> b.s[i])::int))::int as distance
  from h a join h b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by vec_id order by distance, other) as rank from d)
select vec_id, other, distance, rank::int as rank from r where rank <= 3""")
def phash_hamming(spark, sf_dir):
    """The three nearest rows by sign bits of each vector whose id is divisible by 50, against all rows in blocks."""
    bits = [F.when(F.get("embedding", F.lit(i)) > 0, F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long") for i in range(64)]
    h = table(spark, sf_dir, "embeddings").select("vec_id", sum(bits[1:], bits[0]).alias("h"))
    near = linking.nearest_hashes(h.withColumnRenamed("vec_id", "id"), F.col("id") % 50 == 0, 3)
    w = Window.partitionBy("id").orderBy("distance", "other")
    best = near.withColumn("rank", F.row_number().over(w)).where("rank <= 3")
    return best.select(F.col("id").alias("vec_id"), "other", "distance", "rank")


@query("""
with f as (select doc_id, lang, row_number() over (partition by lang order by md5('s' || doc_id::varchar), doc_id) as r,
  count(*) over (partition by lang) as n from documents)
select doc_id, case when r <= round(0.2 * n) then 'holdout' else 'development' end as split,
  case when r <= round(0.2 * n) then -1 else ((r - 1) % 5)::int end as cv_fold from f""")
def oof_folds(spark, sf_dir):
    h = F.md5(F.concat(F.lit("s"), F.col("doc_id").cast("string"))).alias("h")
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", h, F.lit(1).alias("r"))
    d = ranks.running_sums(d, ["lang"], [F.col("h"), F.col("doc_id")], ["r"])
    out = F.col("r_upto") <= F.round(0.2 * F.col("r_all"))
    fold = F.when(out, -1).otherwise(((F.col("r_upto") - 1) % 5).cast("int"))
    return d.select("doc_id", F.when(out, "holdout").otherwise("development").alias("split"), fold.alias("cv_fold"))


@query("""
with f as (select coalesce(source, '') || '/' || doc_id as path, octet_length(encode(text)) as bytes, sha256(text) as sha256, doc_id from documents where text is not null and doc_id % 31 <> 0),
m as (select coalesce(source, '') || '/' || doc_id as path, octet_length(encode(text)) + (doc_id % 43 = 0)::int as bytes,
  case when doc_id % 37 = 0 then sha256('x' || text) else upper(sha256(text)) end as sha256 from documents where text is not null and doc_id % 41 <> 0)
select coalesce(f.path, m.path) as path, case when f.path is null then 'missing' when m.path is null then 'extra' when f.bytes <> m.bytes then 'resized'
  when f.sha256 = lower(m.sha256) then 'same' else 'changed' end as status from f full join m on f.path = m.path""")
def manifest_check(spark, sf_dir):
    """Documents as files against a manifest with changed, resized, missing and extra ones."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    path = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string")).alias("path")
    size, k = F.octet_length("text").cast("long"), F.col("doc_id")
    found = d.where(k % 31 != 0).select(path, size.alias("bytes"), F.sha2("text", 256).alias("sha256"))
    listed = F.when(k % 37 == 0, F.sha2(F.concat(F.lit("x"), "text"), 256)).otherwise(F.upper(F.sha2("text", 256)))
    manifest = d.where(k % 41 != 0).select(path, (size + (k % 43 == 0).cast("long")).alias("bytes"), listed.alias("sha256"))
    return records.manifest_diff(found, manifest)


@query(rf"""
with f as (select 'document-' || doc_id as id, 'text' as key, text as value from documents union all select 'document-' || doc_id, 'source', source from documents
  union all select 'page-' || page_id, 'page_url', url from pages),
k as (select id, key, case when value is null then '' else concat_ws(',', case when regexp_matches(value, '{T.EMAIL}') then 'email' end,
  case when key = 'source' then 'identifier_field' end, case when regexp_matches(value, '{T.IP}') then 'ip' end,
  case when key <> 'page_url' and regexp_matches(value, '{T.PHONE}') then 'phone' end) end as kinds from f)
select id, key, kinds from k where kinds <> ''""")
def pii_incidents(spark, sf_dir):
    d, p = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    fields = lambda t, kind, i, **cols: t.select(
        F.concat(F.lit(f"{kind}-"), F.col(i).cast("string")).alias("id"),
        F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).alias("value")) for k, c in cols.items()])).alias("f"),
    ).select("id", "f.*", F.lit("KNOWN").alias("status"))
    rows = fields(d, "document", "doc_id", text="text", source="source").unionByName(fields(p, "page", "page_id", page_url="url"))
    kinds = T.pii_incident(F.col("value"), F.col("key"), {"phone": ("url",)}, ("source",))
    return records.leak_guard(rows, kinds)[1]
