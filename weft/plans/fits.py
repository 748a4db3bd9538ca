"""Queries of fitted models: each fit's parameters and figures, with the same fit in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fits, forest, splines, stats
from ..registry import query
from ..sources.io import table

_ROWS = """
with recursive r as (select l_orderkey, l_linenumber, l_quantity / 10 as x1, l_discount * 10 as x2, l_tax as x3, l_extendedprice * l_quantity / 50000 as y,
  (l_extendedprice * l_quantity > 1250000)::int as hit, l_linestatus as region, l_orderkey % 5 as fold from lineitem)"""


def _rows(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (c("l_quantity") / 10).alias("x1"), (c("l_discount") * 10).alias("x2"), c("l_tax").alias("x3"),
        (c("l_extendedprice") * c("l_quantity") / 50000).alias("y"), (c("l_extendedprice") * c("l_quantity") > 1250000).cast("int").alias("hit"),
        c("l_linestatus").alias("region"),
        (c("l_orderkey") % 5).alias("fold"),
    )


def _named(spark, names, values, digits=4):
    """A small table of a fit's parameters."""
    return spark.createDataFrame([(n, round(float(v), digits) + 0.0) for n, v in zip(names, values, strict=True)], "term string, value double")


def _sums_sql(terms: list[str], y: str, weight: str = "1") -> str:
    columns = [*terms, y]
    return ", ".join(f"sum(({a}) * ({b}) * {weight}) as a_{i}_{j}" for i, a in enumerate(terms) for j, b in enumerate(columns))


def _solved_sql(source: str, k: int, keep: str = "") -> str:
    """CTEs e0 to ek that eliminate one unknown each from rows a_i_j of k equations; a_i_k of the last is the solution."""
    out = [f"e0 as (select * from {source})"]
    for p in range(k):
        cells = []
        for i in range(k):
            for j in range(k + 1):
                cells.append((f"a_{p}_{j} / a_{p}_{p}" if i == p else f"a_{i}_{j} - a_{i}_{p} * a_{p}_{j} / a_{p}_{p}") + f" as a_{i}_{j}")
        out.append(f"e{p + 1} as (select {keep}{', '.join(cells)} from e{p})")
    return ",\n".join(out)


def _terms_sql(source: str, names: list[str], k: int) -> str:
    return " union all ".join(f"select '{n}' as term, round(a_{i}_{k}, 4) + 0.0 as value from {source}" for i, n in enumerate(names))


_SPLINE = ["1.0", "x1", "greatest(x1 - 1.5, 0)", "greatest(x1 - 3.5, 0)", "x2", "x1 * x2"]
_SPLINE_NAMES = ["constant", "x1", "x1_from_1.5", "x1_from_3.5", "x2", "x1_x2"]


def _spline():
    x1, x2 = F.col("x1"), F.col("x2")
    from_ = lambda k: F.greatest(x1 - k, F.lit(0.0))
    return [F.lit(1.0), x1, from_(1.5), from_(3.5), x2, x1 * x2]


@query(_ROWS + f""", s as (select {_sums_sql(_SPLINE, "y")} from r),
{_solved_sql("s", 6)} {_terms_sql("e6", _SPLINE_NAMES, 6)}""")
def spline_fit(spark, sf_dir):
    """Linear spline of one feature, a second one and their product, by least squares."""
    g = fits.gram(_rows(spark, sf_dir), _spline(), F.col("y"))[()]
    return _named(spark, _SPLINE_NAMES, fits.solve(g))


_GRID = [("linear", 2), ("quadratic", 3), ("spline", 5)]
_GRID_TERMS = ["1.0", "x1", "x1 * x1", "greatest(x1 - 1.5, 0)", "greatest(x1 - 3.5, 0)"]
_RIDGES = [0.0, 10.0, 1000.0]


def _family_sql(family: str, k: int) -> str:
    cells = ", ".join(
        f"t.a_{i}_{j} - f.a_{i}_{j}" + (" + ridge" if i == j and i else "") + f" as a_{i}_{j}" for i in range(k) for j in range(k)
    ) + ", " + ", ".join(f"t.a_{i}_5 - f.a_{i}_5 as a_{i}_{k}" for i in range(k))
    lost = "f.yy" + "".join(f" - 2 * e.a_{i}_{k} * f.a_{i}_5" for i in range(k))
    lost += "".join(f" + e.a_{i}_{k} * e.a_{j}_{k} * f.a_{i}_{j}" for i in range(k) for j in range(k))
    solved = _solved_sql("q", k, "fold, ridge, ")
    return f"""select '{family}' as family, ridge, round(sum({lost}) / any_value(n), 4) as mse from (with
q as (select f.fold, ridge, {cells} from folds f, total t, ridges), {solved} select * from e{k}) e join folds f using (fold), total group by ridge"""


@query(_ROWS + f""", folds as (select fold, sum(y * y) as yy, {_sums_sql(_GRID_TERMS, "y")} from r group by fold),
total as (select sum(a_0_0) as n, {", ".join(f"sum(a_{i}_{j}) as a_{i}_{j}" for i in range(5) for j in range(6))} from folds),
ridges as (select unnest([0.0::double, 10.0, 1000.0]) as ridge),
g as ({" union all ".join(_family_sql(f, k) for f, k in _GRID)})
select *, (row_number() over (order by mse, family, ridge))::int as rank from g""")
def grid_refinement(spark, sf_dir):
    """Nested families by ridge, compared on fixed folds; every fit comes from one pass of sums."""
    x1 = F.col("x1")
    basis = [F.lit(1.0), x1, x1 * x1, F.greatest(x1 - 1.5, F.lit(0.0)), F.greatest(x1 - 3.5, F.lit(0.0))]
    found = fits.cross_validated(_rows(spark, sf_dir), basis, F.col("y"), F.col("fold"), {f: range(k) for f, k in _GRID}, _RIDGES)
    rows = sorted((round(m, 4), f, r) for f, r, m in found)
    return spark.createDataFrame([(f, r, m, i) for i, (m, f, r) in enumerate(rows, 1)], "family string, ridge double, mse double, rank int")


@query(_ROWS + f""", u as (select r.*, m, ('0x' || md5('bag-' || m || '-' || l_orderkey || '-' || l_linenumber)[1:8])::bigint / 4294967296.0::double as u
  from r, (select unnest(range(8)) as m)),
b as (select *, (u >= exp(-1.0::double))::int + (u >= 2 * exp(-1.0::double))::int + (u >= 2.5 * exp(-1.0::double))::int + (u >= exp(-1.0::double) * 16 / 6)::int
  + (u >= exp(-1.0::double) * 65 / 24)::int + (u >= exp(-1.0::double) * 326 / 120)::int + (u >= exp(-1.0::double) * 1957 / 720)::int as often from u),
s as (select m, {_sums_sql(["1.0", "x1", "x2"], "y", "often")} from b group by m),
{_solved_sql("s", 3, "m, ")},
k as (select 'member ' || m as member, a_0_3 as constant, a_1_3 as x1, a_2_3 as x2 from e3)
select member, round(constant, 4) as constant, round(x1, 4) as x1, round(x2, 4) as x2 from k
union all select 'mean', round(avg(constant), 4), round(avg(x1), 4), round(avg(x2), 4) from k""")
def bagged_fit(spark, sf_dir):
    """Members fitted on bootstrap samples, and their mean."""
    basis = [F.lit(1.0), F.col("x1"), F.col("x2")]
    w = fits.bagged(_rows(spark, sf_dir), basis, F.col("y"), [F.col("l_orderkey"), F.col("l_linenumber")], 8)
    rows = [(f"member {m}", *map(float, c.round(4))) for m, c in enumerate(w)] + [("mean", *map(float, w.mean(axis=0).round(4)))]
    return spark.createDataFrame(rows, "member string, constant double, x1 double, x2 double")


def _likelihood_sql(rows: str, x: str, y: str, floor: float, strength: float, probit: bool, steps: int = 60) -> str:
    """CTEs c, f and w: counted rows, the steps, and the constant a and slope b at the last."""
    z = f"(a + b * {x})"
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    density = f"(exp(-{z} * {z} / 2) / sqrt(2 * pi()))"
    tail = f"({density} * {t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"
    clean = f"(case when {z} < 0 then {tail} else 1 - {tail} end)" if probit else f"(1 / (1 + exp(-{z})))"
    slope = density if probit else "(s * (1 - s))"
    return f"""c as materialized (select {x}, {y}, count(*)::double as n from {rows} group by all),
f(step, a, b) as (select 0, 0.0::double, 0.0::double union all
  select step + 1, a + (i11 * g0 - i01 * g1) / (i00 * i11 - i01 * i01), b + (i00 * g1 - i01 * g0) / (i00 * i11 - i01 * i01) from (
    select step, a, b, sum(n * ({y} - p) * d / v) as g0, sum(n * ({y} - p) * d / v * {x}) - b / {strength} as g1,
      sum(n * d * d / v) as i00, sum(n * d * d / v * {x}) as i01, sum(n * d * d / v * {x} * {x}) + 1 / {strength}::double as i11 from (
      select *, p * (1 - p) as v from (select *, least(greatest({floor} + (1 - 2 * {floor}) * s, 1e-12), 1 - 1e-12) as p, (1 - 2 * {floor}) * {slope} as d from (
        select step, a, b, n, {x}, {y}, {clean} as s from f, c where step < {steps}))) group by step, a, b)),
w as (select a, b from f where step = {steps})"""


@query(_ROWS + f""", {_likelihood_sql("r", "x1", "hit", 0.0, 3.0, True)}
select 'constant' as term, round(a, 4) as value from w union all select 'x1', round(b, 4) from w""")
def probit_fit(spark, sf_dir):
    return _named(spark, ["constant", "x1"], fits.likelihood(_rows(spark, sf_dir), ["x1"], "hit", "probit"))


@query(_ROWS + f""", {_likelihood_sql("r", "x1", "hit", 0.05, 3.0, False)}
select 'constant' as term, round(a, 4) as value from w union all select 'x1', round(b, 4) from w""")
def noisy_logistic_fit(spark, sf_dir):
    return _named(spark, ["constant", "x1"], fits.likelihood(_rows(spark, sf_dir), ["x1"], "hit", floor=0.05))


_MEMBERS = ["1 / (1 + exp(3 - x1))", "least(greatest(x1 / 5 - 0.1, 0.02), 0.98)", "0.2 + 0.05 * x2"]


@query(_ROWS + f""", q as materialized (select count(*)::double as n,
  case when hit = 1 then p1 else 1 - p1 end as q1, case when hit = 1 then p2 else 1 - p2 end as q2, case when hit = 1 then p3 else 1 - p3 end as q3
  from (select hit, {", ".join(f"{m} as p{i}" for i, m in enumerate(_MEMBERS, 1))} from r) group by all),
f(step, w1, w2, w3) as (select 0, 1 / 3.0::double, 1 / 3.0::double, 1 / 3.0::double union all
  select step + 1, sum(n * w1 * q1 / (w1 * q1 + w2 * q2 + w3 * q3)) / sum(n), sum(n * w2 * q2 / (w1 * q1 + w2 * q2 + w3 * q3)) / sum(n),
    sum(n * w3 * q3 / (w1 * q1 + w2 * q2 + w3 * q3)) / sum(n) from f, q where step < 3000 group by step)
select unnest(['p1', 'p2', 'p3']) as term, unnest([round(w1, 3), round(w2, 3), round(w3, 3)]) as value from f where step = 3000""")
def mixture_weights(spark, sf_dir):
    """Weights of three members' probabilities by least log-loss; the SQL takes 3000 expectation steps to the same point."""
    rows = _rows(spark, sf_dir).selectExpr("hit", *[f"{m} as p{i}" for i, m in enumerate(_MEMBERS, 1)])
    names = ["p1", "p2", "p3"]
    return _named(spark, names, fits.simplex_weights(rows, names, "hit"), 3)


@query(_ROWS + """, t as (select region, avg(x1) as m, greatest(stddev_pop(x1), 1e-8) as s from r where fold <> 0 group by 1)
select region, count(*) as n, round(avg((x1 - m) / s), 6) as mean, round(stddev_pop((x1 - m) / s), 6) as deviation,
  round(regr_slope(y, (x1 - m) / s), 4) as slope from r join t using (region) where fold = 0 group by 1""")
def regional_merit(spark, sf_dir):
    """Held-out rows in their group's training units: mean, deviation and the group's own slope."""
    z = fits.standardised(_rows(spark, sf_dir), "region", ["x1"], F.col("fold") != 0).where("fold = 0")
    return z.groupBy("region").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("x1_z"), 6).alias("mean"), F.round(F.stddev_pop("x1_z"), 6).alias("deviation"),
        F.round(F.regr_slope("y", "x1_z"), 4).alias("slope"),
    )


_FEATURES = ["x1", "x2", "x3"]
_UNPIVOT = "(select {keep}unnest([0, 1, 2]) as feature, unnest([x1, x2, x3]) as value, {sums} from {source})"


def _gate_sql() -> str:
    gini = "(case when {b} + {g} > 0 then {b} / tb_all * ({g} / tg_all) / ({b} / tb_all + {g} / tg_all) else 0 end)"
    loss = f"round({gini.format(b='b', g='g')} + {gini.format(b='(tb - b)', g='(tg - g)')}, 12)"
    where = "case k.feature when 0 then x1 when 1 then x2 else x3 end > k.value"
    out = ["a as (select sum(b)::double as tb_all, sum(g)::double as tg_all from p1)"]
    for level in (1, 2):
        out += [
            f"h{level} as (select node, feature, value, sum(b) as b, sum(g) as g from {_UNPIVOT.format(keep='node, ', sums='b, g', source=f'p{level}')} where node >= {level} group by all)",
            f"u{level} as (select node, feature, value, sum(b) over (partition by node, feature order by value) as b, sum(g) over (partition by node, feature order by value) as g, "
            f"sum(b) over (partition by node, feature) as tb, sum(g) over (partition by node, feature) as tg from h{level})",
            f"k{level} as (select node, feature, value from (select *, row_number() over (partition by node order by {loss}, feature, value) as i "
            f"from u{level}, a where b + g < tb + tg and tb > 0 and tg > 0) where i = 1)",
            f"p{level + 1} as (select x1, x2, x3, b, g, case when k.node is null then p.node else 2 * p.node + ({where})::int end as node from p{level} p left join k{level} k using (node))",
        ]
    return ",\n".join(out)


@query(_ROWS + f""", p1 as (select x1, x2, x3, sum(y < 6) as b, sum(y >= 6) as g, 1 as node from r group by x1, x2, x3),
{_gate_sql()},
l as (select node, sum(b) as b, sum(g) as g, sum(b) / any_value(tb_all) > sum(g) / any_value(tg_all) as bad from p3, a group by node),
x as (select round(sum(case when bad then b else 0 end) / sum(b), 6) as recall, round(sum(case when bad then g else 0 end) / sum(g), 6) as false_rejects from l),
k as (select * from k1 union all select * from k2)
select l.node::int as node, ('x' || (k.feature + 1)) as feature, value, b::bigint as n_bad, g::bigint as n_good, bad, recall, false_rejects
  from (select node, b, g, bad from l union all select k1.node, (select sum(b) from l), (select sum(g) from l), null from k1
        union all select k2.node, sum(b), sum(g), null from k2 join p2 using (node) group by 1) l left join k using (node), x""")
def quality_gate(spark, sf_dir):
    """Depth-two tree that tells cheap lines: nodes, leaves, and the gate's recall and false rejects."""
    rows = _rows(spark, sf_dir).withColumn("bad", F.col("y") < 6)
    splits, leaves = fits.gate_tree(rows, _FEATURES, "bad")
    per = rows.dropna(subset=_FEATURES).groupBy(fits.node_of(splits, 2).alias("leaf")).agg(F.count_if("bad").alias("b"), F.count_if(~F.col("bad")).alias("g")).collect()
    bad, good = sum(r["b"] for r in per), sum(r["g"] for r in per)
    caught = round(sum(r["b"] for r in per if leaves[r["leaf"]]) / bad, 6)
    lost = round(sum(r["g"] for r in per if leaves[r["leaf"]]) / good, 6)
    out = [(r["leaf"], None, None, r["b"], r["g"], leaves[r["leaf"]], caught, lost) for r in per]
    for node, (feature, value) in splits.items():
        below = [r for r in per if r["leaf"] == node or r["leaf"] // 2 == node or r["leaf"] // 4 == node]
        out.append((node, feature, value, sum(r["b"] for r in below), sum(r["g"] for r in below), None, caught, lost))
    return spark.createDataFrame(out, "node int, feature string, value double, n_bad long, n_good long, bad boolean, recall double, false_rejects double")


_ROUNDS, _RATE = 4, 0.5


def _boost_sql() -> str:
    out = []
    for i in range(_ROUNDS):
        source = f"(select x1, x2, x3, n, s - n * pred as e from p{i})"
        out += [
            f"h{i} as materialized (select feature, value, sum(n) as n, sum(e) as e from {_UNPIVOT.format(keep='', sums='n, e', source=source)} group by all)",
            f"u{i} as (select feature, value, sum(n) over w as n, sum(e) over w as e, sum(n) over t as tn, sum(e) over t as te from h{i} "
            "window w as (partition by feature order by value), t as (partition by feature))",
            f"k{i} as materialized (select feature, value, e / n as low, (te - e) / (tn - n) as high from u{i} where n < tn "
            "and [1, -1, 0][feature + 1] * ((te - e) / (tn - n) - e / n) >= 0 order by round(e * e / n + (te - e) * (te - e) / (tn - n), 3) desc, feature, value limit 1)",
            f"p{i + 1} as materialized (select x1, x2, x3, n, s, pred + {_RATE} * case when [x1, x2, x3][feature + 1] <= value then low else high end as pred from p{i}, k{i})",
        ]
    return ",\n".join(out)


@query(_ROWS + f""", p0 as materialized (select x1, x2, x3, count(*)::double as n, sum(y) as s, (select avg(y) from r) as pred from r group by x1, x2, x3),
{_boost_sql()}
{" union all ".join(f"select {i + 1} as round, 'x' || (feature + 1) as feature, value, round(low, 4) as low, round(high, 4) as high from k{i}" for i in range(_ROUNDS))}""")
def boosted_fit(spark, sf_dir):
    """Boosted cuts whose prediction may only rise with quantity and only fall with discount."""
    _, stages = fits.boosted_stumps(_rows(spark, sf_dir), {"x1": 1, "x2": -1, "x3": 0}, "y", _ROUNDS, _RATE)
    rows = [(i, f, v, round(low, 4), round(high, 4)) for i, (f, v, low, high) in enumerate(stages, 1)]
    return spark.createDataFrame(rows, "round int, feature string, value double, low double, high double")


_TAUS = [0.5, 0.8, 0.9, 0.95]
_HELD = "('0x' || md5('cal-' || l_orderkey || '-' || l_linenumber)[1:8])::bigint / 4294967296.0::double"


@query(_ROWS + f""", d as (select *, {_HELD} < 0.7 as train from r),
t as (select * from d where train), {_likelihood_sql("t", "x1", "hit", 0.0, 1.0, False)},
v as (select x1, sum(hit * n) as h, sum(n) as n from c group by 1),
s as (select x1, sum(h) over (order by x1) as h, sum(n) over (order by x1) as n, sum(h) over (order by x1) - h as h0, sum(n) over (order by x1) - n as n0 from v),
m as (select i.x1 as i, min((j.h - i.h0) / (j.n - i.n0)) over (partition by i.x1 order by j.x1 desc) as low, j.x1 as ends from s i join s j on j.x1 >= i.x1),
o as (select ends as x1, max(low) as p from m group by 1),
e as (select least(floor(o.p * 10), 9) as bin, hit, o.p, least(x1 / 5, 1) as raw from d join o using (x1) where not train),
z as (select (select sum(abs(q)) / sum(n) from (select sum(p - hit) as q, count(*) as n from e group by bin)) as ece,
  (select sum(abs(q)) / sum(n) from (select sum(raw - hit) as q, count(*) as n from e group by least(floor(raw * 10), 9))) as raw)
select tau, round(avg((p >= tau)::int), 6) as accepted, round(avg(hit) filter (where p >= tau), 6) as accuracy,
  round(any_value(z.raw), 6) as ece_raw, round(any_value(z.ece), 6) as ece from e, z, (select unnest([0.5::double, 0.8, 0.9, 0.95]) as tau) group by tau""")
def confidence_calibration(spark, sf_dir):
    """Held-out error of raw scores and of calibrated ones, and what bounds on these accept."""
    rows = _rows(spark, sf_dir)
    train = fits.uniform(F.lit("cal"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")) < 0.7
    held = fits.calibrated(rows.where(train), rows.where(~train), ["x1"], "hit").withColumn("raw", F.least(F.col("x1") / 5, F.lit(1.0)))
    off = lambda p: stats.calibration_bins(held, p, "hit").agg((F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n")).alias(f"off_{p}"))
    bins = off("confidence").crossJoin(off("raw"))  # one row each
    taken = held.withColumn("tau", F.explode(F.array(*map(F.lit, _TAUS)))).groupBy("tau").agg(
        F.round(F.avg((F.col("confidence") >= F.col("tau")).cast("int")), 6).alias("accepted"),
        F.round(F.avg(F.when(F.col("confidence") >= F.col("tau"), F.col("hit"))), 6).alias("accuracy"),
    )
    return taken.crossJoin(bins).select("tau", "accepted", "accuracy", F.round("off_raw", 6).alias("ece_raw"), F.round("off_confidence", 6).alias("ece"))


@query(_ROWS + """, b as (select l_orderkey // 1000 as batch, least(floor(coalesce(x1 / 5, 0) * 20), 19)::int as bin, hit from r),
g as (select batch, bin, coalesce(n, 0) as n, coalesce(h, 0) as h from (select distinct batch from b) cross join (select unnest(range(20))::int as bin)
  left join (select batch, bin, count(*) as n, sum(hit) as h from b group by all) using (batch, bin)),
u as (select batch, bin, sum(n) over w as n, sum(h) over w as h from g window w as (partition by batch order by bin desc)),
s as (select *, sum(n) over w - n as seen, sum(h) over w - h as known from u window w as (partition by bin order by batch)),
k as (select batch, min(bin) filter (where seen > 0 and known >= 0.7 * seen) as bin, max(n) filter (where bin = 0) as rows from s group by 1)
select k.batch, k.rows::bigint as rows, coalesce(s.n, 0)::bigint as taken, coalesce(s.h, 0)::bigint as hits, k.bin from k left join s on s.batch = k.batch and s.bin = k.bin""")
def review_curve(spark, sf_dir):
    """Batches of orders, each passed by the bound that the batches before it set."""
    return fits.reviewed(_rows(spark, sf_dir), F.floor(F.col("l_orderkey") / 1000), F.col("x1") / 5, F.col("hit") == 1, 0.7)


@query("""
with r as (select l_linenumber, l_suppkey % 5 as truth, l_quantity::bigint % 5 as a, case when l_partkey % 3 = 0 then l_suppkey % 5 else l_partkey % 5 end as b,
  case when l_linenumber < 4 then l_suppkey % 5 else l_orderkey % 4 end as c from lineitem),
v as (select l_linenumber, 0 as o, 'a' as variant, count(*) filter (where a = truth) as agreed, count(*) as compared from r group by 1
  union all select l_linenumber, -1, 'b', count(*) filter (where b = truth), count(*) from r group by 1
  union all select l_linenumber, -2, 'c', count(*) filter (where c = truth), count(*) from r group by 1),
k as (select *, row_number() over (partition by l_linenumber order by agreed desc, o desc) as i from v)
select l_linenumber, variant, agreed, compared, compared >= 8 and agreed <= 0.3 * compared as distrusted,
  case when compared >= 8 and agreed <= 0.3 * compared then null when compared >= 8 then least(agreed / compared / 0.9, 1) else 1 end as factor from k where i = 1""")
def reading_choice(spark, sf_dir):
    c = F.col
    own = c("l_suppkey") % 5
    rows = table(spark, sf_dir, "lineitem").select(
        "l_linenumber", own.alias("truth"), (c("l_quantity").cast("long") % 5).alias("a"),
        F.when(c("l_partkey") % 3 == 0, own).otherwise(c("l_partkey") % 5).alias("b"), F.when(c("l_linenumber") < 4, own).otherwise(c("l_orderkey") % 4).alias("c"),
    )
    return fits.best_variant(rows, "l_linenumber", ["a", "b", "c"], "truth", 8, 0.3, 0.9)


@query("""
with recursive r as (select l_returnflag || l_linestatus as kind, l_linenumber as level, ((l_partkey + l_linenumber) % 7 + 1)::int as target, l_suppkey from lineitem),
v as (select kind, level, target, count(*) filter (where l_suppkey % 3 = 0 and abs(level - target) <= 2) as votes from r group by all),
z as (select kind, level, count(*) as size from r group by all),
p(kind, level, target, score, path) as (select kind, 1, target, 100 * votes - abs(target - 1), [target] from v where level = 1 union all
  select p.kind, p.level + 1, v.target, p.score + 100 * v.votes - abs(v.target - v.level) - case when v.target = p.target then 25 * z.size else 0 end, list_prepend(v.target, p.path)
  from p join v on v.kind = p.kind and v.level = p.level + 1 and v.target >= p.target join z on z.kind = p.kind and z.level = v.level),
b as (select kind, path from (select kind, path, row_number() over (partition by kind order by score desc, path desc) as i from p where level = 7) where i = 1)
select kind, (8 - unnest(range(1, 8)))::int as level, unnest(path) as target from b""")
def level_alignment(spark, sf_dir):
    """Levels mapped in order to the targets that they agree with most; the SQL tries every map."""
    c = F.col
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("kind"), c("l_linenumber").alias("level"),
        ((c("l_partkey") + c("l_linenumber")) % 7 + 1).cast("int").alias("target"), "l_suppkey",
    )
    near = (c("l_suppkey") % 3 == 0) & (F.abs(c("level") - c("target")) <= 2)
    votes = rows.groupBy("kind", "level", "target").agg(F.count_if(near).alias("votes"))
    sizes = rows.groupBy("kind", "level").agg(F.count(F.lit(1)).alias("size"))
    return fits.ordered_alignment(votes.join(sizes, ["kind", "level"]))


def _grown(spark, trees, ends):
    rows = []
    for m, t in enumerate(trees):
        rows += [(m, n, f"x{f + 1}", ends[f][b] if b < len(ends[f]) else None, round(gain, 3), None) for n, (f, b, gain) in t.splits.items()]
        rows += [(m, n, None, None, None, round(v, 6)) for n, v in t.values.items()]
    return spark.createDataFrame(rows, "member int, node int, feature string, upto double, gain double, value double")


@query()
def forest_fit(spark, sf_dir):
    """A forest of 20 trees of depth 4 on bootstrap members, rising with quantity and falling with discount: splits and leaves."""
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "x1", "y")
    data = forest.Binned(_rows(spark, sf_dir), ["x1", "x2", "x3"], key, ["y"])
    trees = forest.forest(data, "y", [1, -1, 0])
    data.forget()
    return _grown(spark, trees, data.ends)


@query()
def boosted_trees(spark, sf_dir):
    """Boosted trees of depth 3 under the same directions, and the error that is left after each."""
    data = forest.Binned(_rows(spark, sf_dir), ["x1", "x2", "x3"], F.lit(0), ["y"])
    start, trees = forest.boost(data, "y", [1, -1, 0], 5, 0.3, 3)
    bins = F.col("bins")
    errors = [F.round(F.avg(F.pow(F.col("y") - forest.boosted(start, trees[:i], 0.3, 3, bins), 2)), 4) for i in range(len(trees) + 1)]
    left = data.rows.agg(*[e.alias(str(i)) for i, e in enumerate(errors)]).collect()[0]
    data.forget()
    return spark.createDataFrame([(i, len(t.splits) if t else 0, left[i]) for i, t in enumerate([None, *trees])], "round int, splits int, error double")


_KNOTS = [0.1, 1.0, 2.0, 3.5, 5.0]


def _basis_sql(i: int, p: int, t: list[float]) -> str:
    """A B-spline by its recurrence, in full; the last interval holds its upper end."""
    if p == 0:
        last = t[i + 1] == t[-1] and t[i] < t[i + 1]
        return f"(x1 >= {t[i]} and x1 {'<=' if last else '<'} {t[i + 1]})::int::double"
    parts = [f"(x1 - {t[i]}::double) / ({t[i + p]}::double - {t[i]}) * {_basis_sql(i, p - 1, t)}"] if t[i + p] > t[i] else []
    parts += [f"({t[i + p + 1]}::double - x1) / ({t[i + p + 1]}::double - {t[i + 1]}) * {_basis_sql(i + 1, p - 1, t)}"] if t[i + p + 1] > t[i + 1] else []
    return f"({' + '.join(parts)})"


_AXIS = splines.Axis("x1", _KNOTS)


@query(_ROWS + " union all ".join(["", *[f"select {i}::int as place, round(sum({_basis_sql(i, 3, _AXIS.full)}), 4) as total, round(sum({_basis_sql(i, 3, _AXIS.full)} * y), 2) as with_y from r" for i in range(_AXIS.size)]])[11:])
def spline_basis(spark, sf_dir):
    """Sums of all cubic B-splines of one feature, alone and with the target."""
    g, b, _ = splines.normal_equations(_rows(spark, sf_dir), [_AXIS], "y")
    # the functions add up to one, so that a row of products adds up to the function's own sum
    return spark.createDataFrame([(i, round(float(g[i].sum()), 4), round(float(b[i]), 2)) for i in range(_AXIS.size)], "place int, total double, with_y double")


def _axes(rows):
    return [splines.Axis("x1", splines.quantile_knots(rows, "x1", 5)), splines.Axis("x2", splines.quantile_knots(rows, "x2", 3), 2)]


@query()
def cubic_fit(spark, sf_dir):
    """A cubic spline of one feature with knots at its quantiles, under a difference penalty."""
    rows = _rows(spark, sf_dir)
    axis = _axes(rows)[0]
    c = splines.fitted(rows, [axis], "y", 2.0)
    return spark.createDataFrame([(i, round(float(v), 5)) for i, v in enumerate(c)], "place int, coefficient double")


@query()
def tensor_fit(spark, sf_dir):
    """A tensor product of two splines, and its error beside that of the mean, by fold."""
    rows = _rows(spark, sf_dir)
    axes = _axes(rows)
    out = splines.predicted(rows, axes, splines.fitted(rows, axes, "y", 2.0), "p")
    mean = rows.agg(F.avg("y")).collect()[0][0]
    error = lambda p: F.round(F.avg(F.pow(F.col("y") - p, 2)), 4)
    return out.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), error(F.col("p")).alias("error"), error(F.lit(mean)).alias("of_the_mean"))
