"""Queries of marks on pages, over pages of sixty customers' marks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drawings
from ..registry import query
from ..sources.io import table

_MARKS = """
with recursive m as (select c_custkey // 60 as page, c_custkey as id, (c_custkey // 4) % 9 as k, c_custkey % 4 as kind, 8.0::double + c_custkey % 3 as size,
  40.0::double * ((c_custkey // 4) % 9) + c_custkey % 3 + case when c_custkey % 17 = 0 then 90 else 0 end as along,
  case when c_custkey % 4 = 2 then 500.0::double else 10.0 end + c_custkey % 5 as across from customer),
l as (select page, id, size, case when kind in (0, 2) then chr((65 + k)::int) || case when kind = 2 and id % 3 = 0 then '''' else '' end
    when kind = 1 then (k + 1)::varchar else 'note 12' end as text,
  case when (page % 2 = 0) = (kind <> 1) then along else across end as x, case when (page % 2 = 0) = (kind <> 1) then across else along end as y from m)"""


def _marks(spark, sf_dir):
    key = F.col("c_custkey")
    k, kind, page = F.floor(key / 4) % 9, key % 4, F.floor(key / 60)
    m = table(spark, sf_dir, "customer").select(
        page.alias("page"), key.alias("id"), k.alias("k"), kind.alias("kind"), (8.0 + key % 3).alias("size"),
        (40.0 * k + key % 3 + F.when(key % 17 == 0, 90).otherwise(0)).alias("along"), (F.when(kind == 2, 500.0).otherwise(10.0) + key % 5).alias("across"),
    )
    letter = F.concat(F.chr(65 + F.col("k")), F.when((F.col("kind") == 2) & (F.col("id") % 3 == 0), "'").otherwise(""))
    text = F.when(F.col("kind").isin(0, 2), letter).when(F.col("kind") == 1, (F.col("k") + 1).cast("string")).otherwise("note 12")
    flat = (F.col("page") % 2 == 0) == (F.col("kind") != 1)
    x, y = F.when(flat, F.col("along")).otherwise(F.col("across")), F.when(flat, F.col("across")).otherwise(F.col("along"))
    return m.select("page", "id", "size", text.alias("text"), x.alias("x"), y.alias("y"))


def _bands_sql(source: str, name: str, by: str, tol: str) -> str:
    return f"""{name}_g as (select *, coalesce((pos - lag(pos) over (partition by {by} order by pos, id) > {tol})::int, 0) as far from {source}),
{name}_n as (select *, sum(far) over (partition by {by} order by pos, id) as band from {name}_g),
{name} as (select * from {name}_n join (select {by}, band from {name}_n group by all having count(distinct text) >= 3) using ({by}, band))"""


@query(_MARKS + rf""", f as (select *, case when regexp_full_match(text, '[A-Z]{{1,2}}(\.\d)?''?') then 'letter' when regexp_full_match(text, '\d{{1,2}}(\.\d)?''?') then 'number' end as family from l),
a as (select *, row_number() over (partition by page order by size desc, id) as rank, count(*) over (partition by page) as n from f where family is not null
  and page in (select page from f group by 1 having count(*) filter (where family = 'letter') >= 3 and count(*) filter (where family = 'number') >= 3)),
b as (select page, median(size) as big from a where rank <= greatest(6, n // 3) group by 1),
p as (select page, id, text, family, big, 'row' as side, y as pos, x as along from a join b using (page) where size >= 0.8 * big
  union all select page, id, text, family, big, 'column', x, y from a join b using (page) where size >= 0.8 * big),
{_bands_sql("p", "d", "page, family, side", "greatest(4, 0.5 * big)")},
o as (select page, count(*) filter (where (family = 'letter') = (side = 'row')) > count(*) filter (where (family = 'letter') <> (side = 'row')) as up from d group by 1)
select page, case when side = 'row' then 'vertical' else 'horizontal' end as axis, rtrim(text, '''') as label, round(avg(along), 6) as position
from d join o using (page) where up = ((family = 'letter') = (side = 'row')) group by all having max(along) - min(along) <= 2 * max(big)""")
def grid_axes(spark, sf_dir):
    return drawings.grid_axes(_marks(spark, sf_dir)).withColumn("position", F.round("position", 6))


@query(_MARKS + f""", t as (select page, id, text, x, y, size as height from l where text <> 'note 12'),
h as (select page, greatest(3, 0.7 * median(height)) as tol from t group by 1),
p as (select page, id, text, 'row' as side, y as pos, x as at_, tol from t join h using (page) union all select page, id, text, 'column', x, y, 12 from t),
{_bands_sql("p", "d", "page, side", "tol")},
s as (select *, at_ - lag(at_) over (partition by page, side, band order by at_, id) as gap from d),
e as (select page, side, band, avg(pos) as pos, min(at_) as lo, max(at_) as hi, median(gap) filter (where gap > 1) as pitch from s group by all having pitch is not null),
bars as (select page, id, x + id % 23 as x, y + id % 31 as y from l where text = 'note 12'),
u as (select b.page, b.id, side, band, pos, pitch, d.id as label, abs(at_ - case when side = 'row' then b.x else b.y end) as off_, case when side = 'row' then b.y else b.x end - pos as away,
    lo, hi, case when side = 'row' then b.x else b.y end as along from bars b join e using (page) join (select page, side, band, id, at_ from d) d using (page, side, band)),
v as (select page, id, label, off_ + least(0.35 * away, 48) as cost, row_number() over (partition by page, id, side, band order by off_, label) as i from u
  where away > 1 and along between lo - 0.6 * pitch and hi + 0.6 * pitch and off_ <= 0.6 * pitch),
n as (select b.page, b.id, t.id as label, sqrt(power(0.6 * (t.x - b.x), 2) + power(case when t.y < b.y then 2.5 else 1 end * (t.y - b.y), 2)) as d from bars b join t using (page)),
w as (select page, id, label, cost from v where i = 1 union all select page, id, label, case when d < 90 then d else 1.3 * d end from n where d <= 40),
z as (select *, row_number() over (partition by page, id order by round(cost, 6), label) as i from w)
select page, id, label, round(cost, 6) as cost from z where i = 1 and cost <= 60""")
def callout_owners(spark, sf_dir):
    l = _marks(spark, sf_dir)  # noqa: E741
    bars = l.where("text = 'note 12'").select("page", "id", (F.col("x") + F.col("id") % 23).alias("x"), (F.col("y") + F.col("id") % 31).alias("y"))
    labels = l.where("text <> 'note 12'").withColumnRenamed("size", "height")
    return drawings.owners(bars, labels, 40.0).withColumn("cost", F.round("cost", 6))


_LINES = """
with recursive l as (select c_custkey // 60 as page, c_custkey as id, (c_custkey // 3) % 5 as k, case when c_custkey % 11 < 8 then 0 when c_custkey % 2 = 0 then 1 else -1 end as way,
  case when c_custkey % 3 = 0 then '8-15M' when c_custkey % 3 = 1 then ' @ ' || (100 + c_custkey % 7 * 50) else 'title' end as text,
  30.0::double * ((c_custkey // 3) % 5) + c_custkey % 13 as x0, 12.0::double * (c_custkey % 8) + c_custkey % 3 as y0, 1.0::double - c_custkey % 10 / 20.0::double as conf from customer),
b as (select *, x0 + case when way = 0 then 40 else 10 end as x1, y0 + case when way = 0 then 10 else 40 end as y1 from l)"""


def _lines(spark, sf_dir):
    key = F.col("c_custkey")
    l = table(spark, sf_dir, "customer").select(  # noqa: E741
        F.floor(key / 60).alias("page"), key.alias("id"), F.when(key % 11 < 8, 0).when(key % 2 == 0, 1).otherwise(-1).alias("way"),
        F.when(key % 3 == 0, "8-15M").when(key % 3 == 1, F.concat(F.lit(" @ "), (100 + key % 7 * 50).cast("string"))).otherwise("title").alias("text"),
        (30.0 * (F.floor(key / 3) % 5) + key % 13).alias("x0"), (12.0 * (key % 8) + key % 3).alias("y0"), (1.0 - (key % 10) / F.lit(20.0)).alias("conf"),
    )
    across = F.col("way") == 0
    return l.withColumn("x1", F.col("x0") + F.when(across, 40).otherwise(10)).withColumn("y1", F.col("y0") + F.when(across, 10).otherwise(40))


@query(_LINES + """,
s as (select *, row_number() over (partition by page order by id) as i, case when way = 0 then y1 - y0 else x1 - x0 end as thick from b where text like ' @ %'),
p as (select s.page, s.i, c.id as f, case s.way when 0 then s.y0 - c.y1 when 1 then s.x0 - c.x1 else c.x0 - s.x1 end as gap, thick from s join b c
  on c.page = s.page and c.text = '8-15M' and (c.way = 0) = (s.way = 0)
  where case when s.way = 0 then least(s.x1, c.x1) > greatest(s.x0, c.x0) else least(s.y1, c.y1) > greatest(s.y0, c.y0) end),
q as (select page, i, f, gap from p where gap between -0.3 * thick and thick),
g(page, i, taken, f) as (select distinct page, 0::bigint, []::bigint[], null::bigint from b union all
  select page, i, case when f is null then taken else list_append(taken, f) end, f from (
    select g.page, s.i, g.taken, arg_min(q.f, q.gap * 1000000 + q.f) filter (where q.f is not null and not list_contains(g.taken, q.f)) as f
    from g join s on s.page = g.page and s.i = g.i + 1 left join q on q.page = s.page and q.i = s.i group by g.page, s.i, g.taken)),
t as (select g.page, g.f as id, trim(s.text) as tail, s.conf as tail_conf from g join s using (page, i) where g.f is not null)
select b.page, b.id, b.text || coalesce(' ' || tail, '') as text, least(conf, coalesce(tail_conf, conf)) as conf from b left join t using (page, id)""")
def stacked_spacings(spark, sf_dir):
    grown = drawings.with_spacings(_lines(spark, sf_dir), F.col("text") == "8-15M")
    return grown.select("page", "id", "text", "conf")


@query("""
with r as (select c_custkey // 60 as page, c_custkey as id, 7.0::double * (c_custkey % 47) as x, 5.0::double * (c_custkey % 53) as y from customer),
rows_ as (select distinct page, 'row ' || k as "row", 22.0::double * k + page % 3 as y from r, (select unnest(range(10)) as k)),
heads as (select distinct page, 'head ' || k as head, 30.0::double + 60 * k + page % 4 as x from r, (select unnest(range(4)) as k)),
c as (select r.page, r.id, r.y, h.head, row_number() over (partition by r.page, r.id order by h.x desc) as i from r join heads h on h.page = r.page and h.x - 14 <= r.x
  where r.x >= (select min(x) - 12 from heads k where k.page = r.page)),
d as (select c.page, c.id, c.head, o."row", row_number() over (partition by c.page, c.id order by abs(o.y - c.y), o.y, o."row") as i from c join rows_ o on o.page = c.page
  where c.i = 1 and abs(o.y - c.y) <= 14)
select page, id, "row", head from d where i = 1""")
def cell_assignment(spark, sf_dir):
    key = F.col("c_custkey")
    r = table(spark, sf_dir, "customer").select(
        F.floor(key / 60).alias("page"), key.alias("id"), (7.0 * (key % 47)).alias("x"), (5.0 * (key % 53)).alias("y")
    )
    pages = r.select("page").distinct()
    many = lambda n: pages.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    rows = many(10).select("page", F.concat(F.lit("row "), "k").alias("row"), (22.0 * F.col("k") + F.col("page") % 3).alias("y"))
    heads = many(4).select("page", F.concat(F.lit("head "), "k").alias("head"), (30.0 + 60 * F.col("k") + F.col("page") % 4).alias("x"))
    return drawings.table_cells(r, rows, heads)
