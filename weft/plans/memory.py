"""Queries of event memory, revisions, freshness, access and sessions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import memory, ranks
from ..registry import query
from ..sources.io import table
from ..streaming import jobs

_AS_OF = "2024-01-15 00:00:00"
_EVENTS = """
with e as (select case when event_id % 97 = 0 then event_id - 1 else event_id end as event_id, ts as record_time, user_id as subject, event_type as kind,
    case when event_id % 89 <> 0 then ['supplier', 'committee', 'owner'][event_id % 3 + 1] end as authority, value, value < 5 as ambiguous,
    event_id % 50 = 0 as foreign_subject, event_id as row_id from events),
c as (select *, case when authority is null then 'incomplete' when record_time <= timestamp '2024-01-15' then 'before_baseline'
    when row_number() over (partition by event_id order by record_time, subject) > 1 then 'repeated_id'
    when kind = 'purchase' and authority not in ('committee', 'owner') then 'authority' when foreign_subject then 'other_subject' end as error from e)"""


def _events(spark, sf_dir):
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.when(k % 97 == 0, k - 1).otherwise(k).alias("event_id"), F.col("ts").alias("record_time"), F.col("user_id").alias("subject"),
        F.col("event_type").alias("kind"), F.when(k % 89 != 0, F.get(F.array(*[F.lit(a) for a in ("supplier", "committee", "owner")]), k % 3)).alias("authority"),
        (F.col("value") < 5).alias("ambiguous"), F.when(k % 50 == 0, F.array("user_id", F.lit(-1).cast("long"))).alias("affects"), F.col("event_type").alias("status"),
    )


def _checked(spark, sf_dir):
    as_of = F.lit(_AS_OF).cast("timestamp_ntz")
    return memory.checked_events(_events(spark, sf_dir), as_of, {"purchase": ["committee", "owner"]}, ["authority", "subject", "kind"])


@query(_EVENTS + """
select coalesce(error, 'valid') as verdict, kind, count(*) as n from c group by 1, 2""")
def event_validation(spark, sf_dir):
    return _checked(spark, sf_dir).groupBy(F.coalesce("error", F.lit("valid")).alias("verdict"), "kind").agg(F.count(F.lit(1)).alias("n"))


@query(_EVENTS + """,
b as (select user_id as subject, arg_max(event_type, (ts, event_id)) as before from events where ts <= timestamp '2024-01-15' group by 1),
v as (select * from c where error is null),
a as (select subject, arg_max(kind, (record_time, event_id)) filter (where kind <> 'view' and not ambiguous) as after,
  arg_max(event_id, (record_time, event_id)) filter (where kind <> 'view' and not ambiguous) as event_id,
  count(*) filter (where kind = 'view' or ambiguous) as proposals from v group by 1)
select subject, before, coalesce(after, before) as after, event_id, coalesce(proposals, 0) as proposals, after is not null as changed from b full join a using (subject)""")
def event_apply(spark, sf_dir):
    e = table(spark, sf_dir, "events").where(F.col("ts") <= F.lit(_AS_OF).cast("timestamp_ntz"))
    base = e.groupBy(F.col("user_id").alias("subject")).agg(F.max(F.struct("ts", "event_id", "event_type"))["event_type"].alias("status"))
    return memory.applied(base, _checked(spark, sf_dir).where("error is null"), ["view"])


@query("""
with o as (select year(o_orderdate)::int as year, ('0x' || md5(o_orderkey || '|' || o_orderstatus || '|' || o_orderpriority)[1:8])::bigint as d,
  ('0x' || md5(o_orderkey || '|' || o_orderstatus || '|' || case when o_orderkey % 5000 = 7 then 'changed' else o_orderpriority end)[1:8])::bigint as now from orders)
select year, sum(d)::bigint as recorded, sum(now)::bigint as actual, sum(d) = sum(now) as fresh from o group by 1""")
def frozen_digests(spark, sf_dir):
    """Digests of frozen rows by year against those of rows that may have changed since."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("year"))
    now = F.when(F.col("o_orderkey") % 5000 == 7, "changed").otherwise(F.col("o_orderpriority"))
    a, b = memory.table_digest("o_orderkey", "o_orderstatus", "o_orderpriority"), memory.table_digest("o_orderkey", "o_orderstatus", "now")
    d = o.withColumn("now", now).groupBy("year").agg(a.alias("recorded"), b.alias("actual"))
    return d.withColumn("fresh", F.col("recorded") == F.col("actual"))


@query("""
select n_nationkey, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') as digest from nation""")
def canonical_rows(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", memory.canonical_digest("n_regionkey", "n_nationkey", "n_name").alias("digest"))


@query("""
with l as (select user_id, hour(ts) as slot, case event_type when 'purchase' then 'ack' when 'error' then 'error' when 'click' then 'inflight' else 'queued' end as status from events),
b as (select user_id * 100 + slot as message, count(*) filter (where status = 'ack' and slot % 2 = 0) as acks, count(*) filter (where status = 'error') as failures from l group by 1)
select message, case when acks > 0 then 'sent' when failures >= 5 then 'failed' else 'pending' end as state, failures,
  case when acks = 0 and failures < 5 then least(600.0, power(2, failures))::double end as delay from b""")
def outbox_state(spark, sf_dir):
    kind, slot = F.col("event_type"), F.hour("ts")
    status = F.when((kind == "purchase") & (slot % 2 == 0), "ack").when(kind == "error", "error").when(kind == "click", "inflight").otherwise("queued")
    log = table(spark, sf_dir, "events").select((F.col("user_id") * 100 + slot).alias("message"), status.alias("status"))
    return memory.outbox(log, "message", 5)


@query("""
with v as (select user_id, arg_max(event_id, (ts, event_id)) as latest from events group by 1),
a as (select e.event_type as role, e.event_id = v.latest or e.event_type in ('purchase', 'error') as allowed, e.event_id from events e join v using (user_id))
select role, count(*) as logged, count(*) filter (where allowed) as allowed, max(event_id) filter (where not allowed) as last_denied from a group by 1""")
def access_log(spark, sf_dir):
    """Every access is logged; readers see the latest version, two roles see all."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    v = e.groupBy("user_id").agg(F.max(F.struct("ts", "event_id"))["event_id"].alias("latest"))
    ok = (F.col("event_id") == F.col("latest")) | F.col("event_type").isin("purchase", "error")
    return e.join(v, "user_id").groupBy(F.col("event_type").alias("role")).agg(
        F.count(F.lit(1)).alias("logged"), F.count_if(ok).alias("allowed"), F.max(F.when(~ok, F.col("event_id"))).alias("last_denied")
    )


@query("""
with g as (select user_id, ts, coalesce(ts - lag(ts) over w >= interval 30 minute, true)::int as begins from events window w as (partition by user_id order by ts)),
s as (select *, sum(begins) over (partition by user_id order by ts) as k from g)
select min(ts) as start, user_id, count(*) as n from s group by user_id, k""")
def session(spark, sf_dir):
    return jobs.session_counts(table(spark, sf_dir, "events"), "ts", "30 minutes", "user_id")


@query("""
with p as (select o_custkey as booklet, count(*) as pages, count(distinct o_orderpriority) as kinds, count(*) filter (where o_orderstatus = 'F') as closed from orders group by 1)
select booklet, pages, kinds, kinds >= 3 and closed > 0 as complete from p""")
def booklets(spark, sf_dir):
    p = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("booklet")).agg(
        F.count(F.lit(1)).alias("pages"), F.countDistinct("o_orderpriority").alias("kinds"), F.count_if(F.col("o_orderstatus") == "F").alias("closed")
    )
    return p.select("booklet", "pages", "kinds", ((F.col("kinds") >= 3) & (F.col("closed") > 0)).alias("complete"))


@query("""
select user_id, event_type, arg_min(event_id, (ts, event_id)) as first_id, count(*) - 1 as ignored from events group by 1, 2""")
def first_delivery(spark, sf_dir):
    """One delivery takes effect for each message key, repeated ones are counted and ignored."""
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(
        F.min(F.struct("ts", "event_id"))["event_id"].alias("first_id"), (F.count(F.lit(1)) - 1).alias("ignored")
    )


@query("""
with c as (select l_orderkey, avg((l_linestatus = 'F')::int) as share, count(*) as n from lineitem group by 1)
select case when share >= 0.5 then 'covered' when share > 0 then 'reported' else 'absent' end as verdict, count(*) as orders, sum(n)::bigint as lines,
  sum(case when share >= 0.5 then round(n * (1 - share)) when share > 0 then 1 else 0 end)::bigint as findings from c group by 1""")
def coverage_rules(spark, sf_dir):
    """An order with half of its lines accounted for reports each missing line, one with less reports once."""
    c = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.avg((F.col("l_linestatus") == "F").cast("int")).alias("share"), F.count(F.lit(1)).alias("n"))
    verdict = F.when(F.col("share") >= 0.5, "covered").when(F.col("share") > 0, "reported").otherwise("absent")
    found = F.when(F.col("share") >= 0.5, F.round(F.col("n") * (1 - F.col("share")))).when(F.col("share") > 0, 1).otherwise(0)
    return c.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("orders"), F.sum("n").alias("lines"), F.sum(found).cast("long").alias("findings"))


@query("""
with s as (select distinct user_id, ts::date as day from events where event_type = 'purchase'), n as (select distinct user_id, ts::date as day from events),
m as (select n.* from n anti join s on n.user_id = s.user_id and n.day = s.day)
select m.user_id, count(*) as absent, count(*) filter (where exists (select 1 from s where s.user_id = m.user_id and abs(s.day - m.day) = 1)) as recovered from m group by 1""")
def recovered_absences(spark, sf_dir):
    """Days without a purchase, and those of them with one on the day before or after."""
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_type")
    days = e.groupBy("user_id", "day").agg(F.max(F.col("event_type") == "purchase").alias("has"))
    w = Window.partitionBy("user_id").orderBy("day")
    beside = lambda f, step: F.coalesce((F.datediff(f("day").over(w), "day") == step) & f("has").over(w), F.lit(False))
    d = days.withColumn("near", beside(F.lag, -1) | beside(F.lead, 1)).where("not has")
    return d.groupBy("user_id").agg(F.count(F.lit(1)).alias("absent"), F.count_if("near").alias("recovered"))


@query("""
with a as (select l_orderkey as k, list((l_partkey, l_quantity) order by l_partkey, l_quantity) as sig from lineitem group by 1),
b as (select case when l_orderkey % 19 = 0 then -l_orderkey - 1 else l_orderkey end as k, list((l_partkey, case when l_orderkey % 10 = 0 then l_quantity + 1 else l_quantity end)
  order by l_partkey, l_quantity) as sig from lineitem where l_orderkey % 17 <> 0 group by l_orderkey)
select case when a.k is null then 'added' when b.k is null then 'removed' when a.sig = b.sig then 'unchanged' else 'modified' end as status, count(*) as n from a full join b on a.k = b.k group by 1""")
def revision_diff(spark, sf_dir):
    """Orders of two versions by the signature of their lines, a sorted list of part and quantity."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")  # noqa: E741
    signed = lambda df: df.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("l_partkey", "l_quantity"))).alias("sig"))
    k = F.col("l_orderkey")
    a = signed(l.withColumnRenamed("l_orderkey", "k"))
    changed = F.when(k % 10 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    b = signed(l.where(k % 17 != 0).select(F.when(k % 19 == 0, -k - 1).otherwise(k).alias("k"), "l_partkey", changed.alias("l_quantity")))
    j = a.select("k", F.col("sig").alias("old")).join(b.select("k", F.col("sig").alias("new")), "k", "full")
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "unchanged").otherwise("modified")
    return j.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("""
with f as (select md5(coalesce(text, '')) as h, doc_id % 5 = 0 as held from documents), g as (select h, bool_or(held) as a, bool_or(not held) as b, count(*) as n from f group by 1)
select count(*) filter (where a and b) as shared_texts, coalesce(sum(n) filter (where a and b), 0)::bigint as rows, count(*) filter (where a and b) > 0 as leaks from g""")
def split_leakage(spark, sf_dir):
    """Texts that lie on both sides of a split by id."""
    f = table(spark, sf_dir, "documents").select(F.md5(F.coalesce("text", F.lit(""))).alias("h"), (F.col("doc_id") % 5 == 0).alias("held"))
    g = f.groupBy("h").agg(F.bool_or("held").alias("a"), F.bool_or(~F.col("held")).alias("b"), F.count(F.lit(1)).alias("n"))
    both = F.col("a") & F.col("b")
    return g.agg(F.count_if(both).alias("shared_texts"), F.coalesce(F.sum(F.when(both, F.col("n"))), F.lit(0)).alias("rows"), (F.count_if(both) > 0).alias("leaks"))


@query("""
with k as (select doc_id, quality, toxic from labels), d as (select doc_id, lang, n_chars from documents)
select lang, count(*) as known, count(*) filter (where n_chars > 500) as read, count(*) filter (where n_chars > 500 and (n_chars % 2) = quality) as same_values from k join d using (doc_id) group by 1""")
def known_matches(spark, sf_dir):
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    read = F.col("n_chars") > 500
    return j.groupBy("lang").agg(F.count(F.lit(1)).alias("known"), F.count_if(read).alias("read"), F.count_if(read & (F.col("n_chars") % 2 == F.col("quality"))).alias("same_values"))


@query("""
with a as (select s_suppkey, s_nationkey % 4 as kind, s_suppkey % 7 as free, (s_suppkey * 37 % 101) / 101.0 as score from supplier),
v as (select * from (values (0, 1, 0.30), (0, 2, 0.55), (1, 3, 0.60), (2, 5, 0.20), (2, 6, 0.20)) t(kind, value, score)),
b as (select kind, arg_max(value, (score, -value)) as best, max(score) as best_score from v group by 1)
select s_suppkey, case when exists (select 1 from v where v.kind = a.kind and v.value = a.free) then 'valid' when best is null then 'free'
  when best_score >= a.score - 0.25 then 'replaced' else 'kept' end as verdict,
  case when exists (select 1 from v where v.kind = a.kind and v.value = a.free) or best is null or best_score < a.score - 0.25 then a.free else best end::int as value from a left join b using (kind)""")
def constrained_choice(spark, sf_dir):
    """A free reading outside its kind's vocabulary gives way to the best allowed one unless that scores far less."""
    k = F.col("s_suppkey")
    a = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") % 4).alias("kind"), (k % 7).cast("int").alias("free"), (k * 37 % 101 / 101).alias("score"))
    v = spark.createDataFrame([(0, 1, 0.3), (0, 2, 0.55), (1, 3, 0.6), (2, 5, 0.2), (2, 6, 0.2)], "kind int, value int, alt double")
    best = v.groupBy("kind").agg(F.max(F.struct("alt", -F.col("value"))).alias("m"), F.collect_set("value").alias("allowed"))
    j = a.join(F.broadcast(best), "kind", "left")  # one row a kind
    valid, none = F.coalesce(F.array_contains("allowed", F.col("free")), F.lit(False)), F.col("m").isNull()
    close = F.col("m.alt") >= F.col("score") - 0.25
    verdict = F.when(valid, "valid").when(none, "free").when(close, "replaced").otherwise("kept")
    return j.select("s_suppkey", verdict.alias("verdict"), F.when(verdict == "replaced", -F.col("m.col2")).otherwise(F.col("free")).alias("value"))


@query("""
with p as (select l_quantity as x, l_discount * 100 as y, l_extendedprice as t from lineitem),
s as (select count(*) as n, avg(x) as mx, avg(y) as my, avg(t) as mt, var_pop(x) as xx, var_pop(y) as yy, covar_pop(x, y) as xy, covar_pop(x, t) as xt, covar_pop(y, t) as yt from p),
f as (select *, (xt * yy - yt * xy) / (xx * yy - xy * xy) as a, (yt * xx - xt * xy) / (xx * yy - xy * xy) as b from s)
select n, round(a, 4) as a, round(b, 4) as b, round(mt - a * mx - b * my, 3) as c from f""")
def affine_fit(spark, sf_dir):
    """Least squares of t = a x + b y + c from moments."""
    p = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), F.col("l_extendedprice").alias("t"))
    s = p.agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{c}") for c in "xyt"], F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"),
        F.covar_pop("x", "y").alias("xy"), F.covar_pop("x", "t").alias("xt"), F.covar_pop("y", "t").alias("yt"),
    )
    f = s.withColumns({
        "a": F.expr("(xt * yy - yt * xy) / (xx * yy - xy * xy)"), "b": F.expr("(yt * xx - xt * xy) / (xx * yy - xy * xy)"),
    })
    return f.select("n", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"), F.round(F.expr("mt - a * mx - b * my"), 3).alias("c"))


@query("""
with p as (select a.s_nationkey, abs(a.s_acctbal - b.s_acctbal) as d from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey < b.s_suppkey)
select s_nationkey, count(*) as pairs, round(avg(d), 6) as mean_gap from p group by 1""")
def pair_gaps(spark, sf_dir):
    """Mean gap of all pairs of a nation's suppliers, from ranks alone: no pair is made."""
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", "s_acctbal", "s_suppkey", F.lit(1).cast("long").alias("one"))
    r = ranks.running_sums(rows, ["s_nationkey"], [F.col("s_acctbal"), F.col("s_suppkey")], ["one"])
    n, i = F.count(F.lit(1)), F.col("one_upto")
    g = r.groupBy("s_nationkey").agg(n.alias("n"), F.sum(2 * i * F.col("s_acctbal")).alias("up"), F.sum("s_acctbal").alias("s")).where("n > 1")
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return g.select("s_nationkey", pairs.cast("long").alias("pairs"), F.round((F.col("up") - (F.col("n") + 1) * F.col("s")) / pairs, 6).alias("mean_gap"))
