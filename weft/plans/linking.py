"""Queries of links between records, boxes, lines and codes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import cascade, linking
from ..registry import query
from ..sources.io import table


@query("""
with a as (select distinct replace(s_name, '0', 'O') as code from supplier),
f as (select code, s_name, levenshtein(translate(upper(code), '17OI8B569SZ/', '00003344442-'), translate(upper(s_name), '17OI8B569SZ/', '00003344442-'))::int as distance
  from a, (select distinct s_name from supplier)),
r as (select *, row_number() over (partition by code order by distance, levenshtein(code, s_name), s_name)::int as rank from f where distance <= 2)
select code, s_name, distance, rank from r where rank <= 2""")
def fuzzy_code_join(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_name")
    codes = s.select(F.regexp_replace("s_name", "0", "O").alias("code"))
    w = Window.partitionBy("code").orderBy("distance", F.levenshtein("code", "s_name"), "s_name")
    near = linking.near_codes(codes, s, "code", "s_name", 2, best=2).withColumn("rank", F.row_number().over(w))
    return near.where("rank <= 2")


@query()
def code_questions(spark, sf_dir):
    """Supplier codes misread in places, linked by reading cost and facts."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("code"), F.col("s_nationkey").alias("nation"))
    own = F.when(F.col("nation") % 2 == 0, F.regexp_replace("code", "5", "S")).otherwise(F.regexp_replace("code", "1", "X"))
    read = s.select(own.alias("code"), F.when(F.col("nation") % 3 != 0, F.col("nation")).alias("nation"))
    return linking.linked_codes(read, s, ["nation"])


_BOXES = """
with e as (select vec_id, label, floor(embedding[1]::double * 100) as x, floor(embedding[2]::double * 100) as y from embeddings where embedding is not null
  and not isnan(embedding[1]) and not isnan(embedding[2]) and not isinf(embedding[1]) and not isinf(embedding[2])),
b as (select label as page, vec_id as id, x as x0, y as y0, x + 4 + vec_id % 7 as x1, y + 3 + vec_id % 5 as y1, repeat('t', (vec_id % 11)::int) as text from e)"""


def _boxes(spark, sf_dir):
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    e = table(spark, sf_dir, "embeddings").where("embedding is not null")
    e = e.where(~F.isnan(at(0)) & ~F.isnan(at(1)) & (F.abs(at(0)) != float("inf")) & (F.abs(at(1)) != float("inf")))
    e = e.select("vec_id", "label", F.floor(at(0) * 100).alias("x"), F.floor(at(1) * 100).alias("y"))
    return e.select(
        F.col("label").alias("page"), F.col("vec_id").alias("id"), F.col("x").alias("x0"), F.col("y").alias("y0"),
        (F.col("x") + 4 + F.col("vec_id") % 7).alias("x1"), (F.col("y") + 3 + F.col("vec_id") % 5).alias("y1"),
        F.expr("repeat('t', cast(vec_id % 11 as int))").alias("text"),
    )


@query(_BOXES + """
select a.page, a.id, count(*) as n, min(least(a.x0, c.x0))::bigint as union_x0, max(greatest(a.x1, c.x1))::bigint as union_x1
from b a join b c on a.page = c.page and a.id <> c.id and a.x0 < c.x1 and c.x0 < a.x1 and a.y0 < c.y1 and c.y0 < a.y1 group by 1, 2""")
def box_overlaps(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    pairs = linking.overlapping(b, b, 16.0).where("id <> b_id")
    return pairs.groupBy("page", "id").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.least("x0", "b_x0")).alias("union_x0"), F.max(F.greatest("x1", "b_x1")).alias("union_x1")
    )


@query(_BOXES + """
select a.page, a.id from b a where a.id % 2 = 0 and not exists (select 1 from b c where c.page = a.page and c.id % 2 = 1
  and (a.x0 + a.x1) / 2 between c.x0 - 2 and c.x1 + 2 and (a.y0 + a.y1) / 2 between c.y0 - 2 and c.y1 + 2)""")
def centres_not_covered(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    mid = lambda c: (F.col(f"{c}0") + F.col(f"{c}1")) / 2
    points = b.where("id % 2 = 0").select("page", "id", mid("x").alias("x"), mid("y").alias("y"))
    tiny = points.select("page", "id", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 0.25).alias("x1"), (F.col("y") + 0.25).alias("y1"))
    # centres are multiples of a half, so a centre on the border is inside a box that is wider by a half
    pads = b.where("id % 2 = 1").select("page", "id", *[(F.col(c) + d).alias(c) for c, d in (("x0", -2.0), ("y0", -2.0), ("x1", 2.125), ("y1", 2.125))])
    return points.join(linking.overlapping(tiny, pads, 16.0).select("page", "id").distinct(), ["page", "id"], "left_anti").select("page", "id")


@query()
def box_dedup(spark, sf_dir):
    return linking.longest_texts(_boxes(spark, sf_dir), 16.0).select("page", "id", "text")


@query()
def greedy_assign(spark, sf_dir):
    """Boxes of even ids paired with boxes of odd ids over them, nearest corners first."""
    b = _boxes(spark, sf_dir)
    return linking.nearest_corners(b.where("id % 2 = 0"), b.where("id % 2 = 1"))


@query("""
with l as (select * from (values (1, 'A', 0.0), (2, 'B', 10.0), (3, 'C', 18.0), (4, 'D', 30.0)) t(i, label, pos)),
p as (select p_partkey, p_size::double as x from part),
g as (select p_partkey, x, least(greatest((select count(*) from l where pos <= x), 1), 3) as i from p),
s as (select g.*, (x - a.pos) / (b.pos - a.pos) as share, a.pos as a, b.pos as b, a.label as la, b.label as lb from g join l a on a.i = g.i join l b on b.i = g.i + 1)
select p_partkey, round(case when share between -1.5 and 2.5 then i + share end, 6) as grid,
  case when share <= 0.5 then case when abs(x - a) <= 0.4 * (b - a) then la end else case when abs(x - b) <= 0.4 * (b - a) then lb end end as label from s""")
def bracketing_lines(spark, sf_dir):
    lines = [("A", 0.0), ("B", 10.0), ("C", 18.0), ("D", 30.0)]
    points = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"))
    return linking.bracketed(points, lines, "x").select("p_partkey", F.round("grid", 6).alias("grid"), "label")


@query("""
with p as (select event_id, user_id, ts, value from events where event_type = 'purchase'),
c as (select event_id, user_id, ts, value from events where event_type = 'click')
select p.event_id, count(*) as n, arg_min(c.event_id, abs(epoch_us(p.ts) - epoch_us(c.ts))::hugeint * 1000000 + c.event_id) as closest
from p join c on p.user_id = c.user_id and p.ts::date = c.ts::date group by 1""")
def closest_event(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    bought = e.where("event_type = 'purchase'").select("event_id", "user_id", "day", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    clicked = e.where("event_type = 'click'").select(F.col("event_id").alias("other"), "user_id", "day", F.unix_micros(F.col("ts").cast("timestamp")).alias("then"))
    cost = F.struct(F.abs(F.col("at") - F.col("then")).alias("gap"), "other")
    best = bought.join(clicked, ["user_id", "day"]).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.min(cost).alias("best"))
    return best.select("event_id", "n", F.col("best.other").alias("closest"))


@query("""
with a as (select c_custkey as k from customer), b as (select distinct o_custkey as k from orders),
f as (select a.k as l, b.k as r from a full join b on a.k = b.k)
select count(*) filter (where r is null) as missing, count(*) filter (where l is null) as extra, count(*) filter (where l = r) as both,
  count(*) filter (where l is null or r is null) = 0 as equal, count(*) filter (where l = r) = 0 as disjoint from f""")
def set_equality(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("l")).distinct()
    b = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("r")).distinct()
    missing, extra, both = F.count_if(F.col("r").isNull()), F.count_if(F.col("l").isNull()), F.count_if(F.col("l") == F.col("r"))
    return a.join(b, F.col("l") == F.col("r"), "full").agg(
        missing.alias("missing"), extra.alias("extra"), both.alias("both"), (missing + extra == 0).alias("equal"), (both == 0).alias("disjoint")
    )


@query("""
with r as (select doc_id, case when doc_id % 11 = 0 then null else quality end as answer, case when doc_id % 13 = 0 then 'timeout' end as error from labels),
j as (select r.*, d.lang, d.doc_id is null as unmatched from r left join documents d on d.doc_id = r.doc_id + (r.doc_id % 17 = 0)::int * 100000000)
select coalesce(lang, 'unmatched') as lang, count(*) as n, count(*) filter (where error is not null) as failed,
  count(*) filter (where error is null and answer is null) as empty, round(avg(answer) filter (where error is null), 6) as mean from j group by 1""")
def reference_failures(spark, sf_dir):
    k = F.col("doc_id")
    r = table(spark, sf_dir, "labels").select(
        (k + (k % 17 == 0).cast("int") * 100000000).alias("key"), F.when(k % 11 != 0, F.col("quality")).alias("answer"), F.when(k % 13 == 0, "timeout").alias("error")
    )
    j = r.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "lang"), "key", "left")
    good = F.col("error").isNull()
    return j.groupBy(F.coalesce("lang", F.lit("unmatched")).alias("lang")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~good).alias("failed"), F.count_if(good & F.col("answer").isNull()).alias("empty"),
        F.round(F.avg(F.when(good, F.col("answer"))), 6).alias("mean"),
    )


@query("""
with s as (select l_suppkey, coalesce(list_sort(list_distinct(list(l_returnflag) filter (where l_quantity > 49))), []) as levels from lineitem group by 1),
p as (select l_partkey, any_value(k) as l_suppkey, coalesce(list_sort(list_distinct(list(l_returnflag) filter (where l_quantity > 30))), []) as levels, count(*) as n
  from (select *, min(l_suppkey) over (partition by l_partkey) as k from lineitem) group by 1)
select l_partkey, len(s.levels) = 0 or len(p.levels) = 0 or list_has_any(s.levels, p.levels) as compatible, len(s.levels)::int as left_levels from p join s using (l_suppkey)""")
def level_overlap(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag", "l_quantity")  # noqa: E741
    levels = lambda q: F.collect_set(F.when(F.col("l_quantity") > q, F.col("l_returnflag")))
    s = l.groupBy("l_suppkey").agg(levels(49).alias("a"))
    p = l.groupBy("l_partkey").agg(F.min("l_suppkey").alias("l_suppkey"), levels(30).alias("b"))
    fits = (F.size("a") == 0) | (F.size("b") == 0) | F.arrays_overlap("a", "b")
    return p.join(s, "l_suppkey").select("l_partkey", fits.alias("compatible"), F.size("a").alias("left_levels"))


@query("""
with f as (select l_orderkey, l_linenumber, l_quantity as x, lag(l_quantity) over (partition by l_orderkey order by l_quantity, l_linenumber, l_partkey) as before, l_partkey from lineitem),
g as (select *, sum((before is null or x - before > 6)::int) over (partition by l_orderkey order by x, l_linenumber, l_partkey) as run from f)
select l_orderkey, run::bigint as run, string_agg(l_returnflagged, '' order by x, l_linenumber, l_partkey) as text, count(*) as pieces
from (select *, l_linenumber::varchar || case when lead(x) over (partition by l_orderkey, run order by x, l_linenumber, l_partkey) - x > 2 then ' ' else '' end as l_returnflagged from g)
group by 1, 2""")
def join_fragments(spark, sf_dir):
    """Pieces closer than 6 are one run; a gap of more than 2 within a run is a blank."""
    w = Window.partitionBy("l_orderkey").orderBy("l_quantity", "l_linenumber", "l_partkey")
    f = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey")
    gap = F.col("l_quantity") - F.lag("l_quantity").over(w)
    f = f.withColumn("gap", gap).withColumn("run", F.sum(F.coalesce(gap > 6, F.lit(True)).cast("long")).over(w))
    piece = F.struct("l_quantity", "l_linenumber", "l_partkey")  # gaps follow from the order, also between equal pieces
    runs = f.groupBy("l_orderkey", "run").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    before = lambda i: F.get("p", i - 1)["l_quantity"]
    said = F.transform("p", lambda x, i: F.concat(F.when(x["l_quantity"] - before(i) > 2, " ").otherwise(""), x["l_linenumber"].cast("string")))
    return runs.select("l_orderkey", "run", F.array_join(said, "").alias("text"), F.size("p").cast("long").alias("pieces"))


@query("""
with v as (select p_name as word, count(*) as n from part group by 1), t as (select s_suppkey, 'r?d widg?t' as token from supplier where s_suppkey % 2 = 0
  union all select s_suppkey, 'small ?ing' from supplier where s_suppkey % 2 = 1)
select s_suppkey, arg_min(word, (-n, word)) as repaired from t join v on length(word) = length(token) and word like replace(token, '?', '_') group by 1""")
def vocabulary_repair(spark, sf_dir):
    """Tokens with lost characters take the most frequent word that fits; each distinct token is looked up once."""
    v = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    t = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, "r?d widg?t").otherwise("small ?ing").alias("token"))
    asked = t.select("token").distinct().withColumn("size", F.length("token"))
    fits = asked.join(v.withColumn("size", F.length("word")), "size").where(F.expr("word like replace(token, '?', '_')"))
    best = fits.groupBy("token").agg(F.min(F.struct((-F.col("n")).alias("n"), "word"))["word"].alias("repaired"))
    return t.join(best, "token").select("s_suppkey", "repaired")


@query(r"""
with p as (select p_partkey, p_partkey % 4 as k, p_size, p_name, (p_size + 10)::varchar as q, (100 + p_partkey % 20 * 10)::int as gap from part)
select p_partkey, case k when 3 then 0 when 1 then 2 else 1 end::int as n, case when k in (0, 1) then q::int end as quantity,
  case k when 1 then '20M' when 3 then null else '15M' end as size, case k when 0 then gap when 1 then 300 when 2 then round(p_size * 25.4)::int end as spacing,
  case k when 0 then q || '-15M @ ' || gap || ' B.E.W.' when 1 then q || '-20M@300 TOP, 4-25M' when 2 then '15M @ ' || p_size || '"' else p_name end as text
from p""")
def callout_parse(spark, sf_dir):
    """Callouts of bars, made from parts: quantity, size, spacing in millimetres or inches, after repair of look-alike letters."""
    k, q = F.col("p_partkey") % 4, (F.col("p_size") + 10).cast("string")
    misread = F.concat(F.substring(q, 1, 1), F.translate(F.substring(q, 2, 9), "01", "OI"))
    line = F.when(k == 0, F.concat(q, F.lit("-15M @ "), (100 + F.col("p_partkey") % 20 * 10).cast("string"), F.lit(" B.E.W.")))
    line = line.when(k == 1, F.concat(misread, F.lit("-2OM@30O TOP, 4-25M"))).when(k == 2, F.concat(F.lit("15M @ "), "p_size", F.lit('"'))).otherwise(F.col("p_name"))
    t = R.repaired_digits(F.col("line"))
    one, far = r"(?:(\d+)-)?(\d{2}M)", r"\d{2}M\s*@\s*(\d+)(\"?)"
    got = lambda p, i: F.nullif(F.regexp_extract(t, p, i), F.lit(""))
    inch = F.when(got(far, 2) == '"', F.round(got(far, 1).cast("int") * 25.4)).otherwise(got(far, 1)).cast("int")
    return table(spark, sf_dir, "part").withColumn("line", line).select(
        "p_partkey", F.regexp_count(t, F.lit(one)).alias("n"), got(one, 1).cast("int").alias("quantity"), got(one, 2).alias("size"), inch.alias("spacing"), t.alias("text")
    )


def _versions(spark, sf_dir):
    """Orders as elements and their lines as parts, and a second version of the parts with planted changes."""
    key = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    order = Window.partitionBy("l_orderkey").orderBy(*key)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *key).withColumn("id", F.row_number().over(order).cast("long"))
    gap = F.when(F.col("l_partkey") % 3 > 0, (100 + 10 * (F.col("l_partkey") % 20)).cast("long"))
    qty = F.when(F.col("l_suppkey") % 7 > 0, F.col("l_quantity").cast("long"))
    plan = lines.select(F.col("l_orderkey").alias("el"), "id", (F.col("l_suppkey") % 4).cast("long").alias("size"), qty.alias("qty"), gap.alias("gap"))
    change = (F.col("el") * 31 + F.col("size") * 7 + F.col("id") * 3) % 20
    half = F.floor(F.col("qty") / 2)
    as_is = F.struct(
        (F.col("id") * 10).alias("id"), F.when(change == 4, (F.col("size") + 1) % 4).otherwise(F.col("size")).alias("size"),
        F.when(change == 1, F.col("qty") + 5).when(change == 3, F.col("qty") * 3).otherwise(F.col("qty")).alias("qty"),
        F.when(change == 5, F.col("gap") + 50).otherwise(F.col("gap")).alias("gap"),
    )
    part = lambda i, q: F.struct((F.col("id") * 10 + i).alias("id"), "size", q.alias("qty"), F.lit(None).cast("long").alias("gap"))
    parts = F.when(change == 0, F.array().cast("array<struct<id:long,size:long,qty:long,gap:long>>"))
    parts = parts.when((change == 2) & (F.col("qty") > 1), F.array(part(0, half), part(1, F.col("qty") - half))).otherwise(F.array(as_is))
    return plan, plan.withColumn("s", F.explode(parts)).select("el", "s.*")


@query()
def version_cascade(spark, sf_dir):
    """Lines of all orders compared with their second version, by tiers."""
    out = cascade.compare_parts(*_versions(spark, sf_dir))
    return out.select("el", "plan_id", "tier", F.array_join("shop_ids", ",").alias("shop_ids"), F.array_join("differs", ",").alias("differs"))


@query()
def content_match(spark, sf_dir):
    """Orders found again in a version without keys: by the parts they hold and the nearest day."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.datediff("o_orderdate", F.lit("1992-01-01")).alias("day"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    part = F.concat_ws("/", F.col("l_partkey").cast("string"), F.col("l_quantity").cast("int").cast("string"))
    held = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    plan = held.select(F.col("o_orderkey").alias("el"), F.col("o_orderpriority").alias("kind"), F.col("day").cast("double").alias("place"), part.alias("part"))
    moved = F.col("place") + F.col("el") % 7 - 3
    shop = plan.where((F.col("el") % 11 != 0) & ((F.col("el") + F.hash("part")) % 13 != 0))
    shop = shop.select((F.col("el") * 3 + 1).alias("el"), "kind", moved.alias("place"), "part")
    return cascade.match_content(plan, shop, 30.0)


def _revisions(spark, sf_dir):
    """Marks of all vectors on pages, some labelled, and a revision in which marks moved, lost their label, changed the page, went or came."""
    e = table(spark, sf_dir, "embeddings").where(F.size("embedding") >= 2)
    at = lambda i: F.round(F.get("embedding", i).cast("double") * 1000, 1)
    k = F.col("vec_id")
    label = F.when(k % 3 > 0, F.concat(F.lit("L"), (k % 97).cast("string")))
    old = e.select(k.alias("id"), F.col("label").alias("kind"), label.alias("label"), (k % 4).alias("page"), at(0).alias("x"), at(1).alias("y"))
    moved = lambda c, by: F.round(F.col(c) + (F.col("id") % by) - by / 2, 1).alias(c)
    i = F.col("id")
    new = old.where(i % 13 != 0).select(
        (i * 2 + 1).alias("id"), "kind", F.when(i % 7 > 0, F.col("label")).alias("label"), F.when(i % 11 == 0, (F.col("page") + 1) % 4).otherwise(F.col("page")).alias("page"),
        moved("x", 20), moved("y", 14),
    )
    return old, new.unionByName(new.where(i % 17 == 0).withColumn("id", i + 1_000_000).withColumn("x", F.col("x") + 500))


@query()
def revision_pairs(spark, sf_dir):
    """Marks of two revisions paired by label and page, by label, then by place."""
    return cascade.pair_revisions(*_revisions(spark, sf_dir))
