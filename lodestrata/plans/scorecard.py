"""Queries of the market scorecard."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import sales as s
from ..operators import scorecard as sc
from ..sources import surrogates as src
from .registry import query
from .warehouse import rounded, zscores

_SIG = """caps as (select market, period, avg(cap_rate_median) as m from caprate where granularity = 'market' group by 1, 2), rk as (select *, row_number() over (partition by market order by period desc) as r from caps),
bc as (select market, count(*) as years, avg(case when r <= 3 then m end) as cap3, stddev_pop(case when r <= 5 then m end) as vol5 from rk where r <= 12 group by 1),
pp as (select market, max_by(median_ppu, sale_year) as n, min_by(median_ppu, sale_year) as o, count(*) as c from pricing where granularity = 'market' group by 1),
mz as (select market, avg(z_score) as avg_z from zscore join property using (property_id) group by 1),
ok as (select market from caprate where granularity = 'market' intersect select market from sales),
sig as (select market, -cap3 as absorption, case when years >= 5 then vol5 else 0 end as volatility, case when c >= 2 then coalesce((n - o) / nullif(o, 0), 0) else 0 end as rent, coalesce(avg_z, 0) * 0.5 as occ
 from ok join bc using (market) left join pp using (market) left join mz using (market) where years >= 3)"""


def _asym(z, f):
    return f"(case when {f} = 0 then {z} when {z} >= 0 then {z} * {f} else {z} / {f} end)"


_CZ = lambda v: f"(case when sd > 1e-15 then ({v} - mean) / sd else 0 end)"
_B = lambda z, w: f"least(3.0, greatest(0.25, 1 + {w} * {z}))"
_TZ = lambda sgn, vol, cat: f"least(3.0, greatest(-3.0, {_asym(f'({sgn} * {_B(cat, 0.25)})', _B(vol, 0.35))}))"
_SCORES = f"""{_SIG}, m0 as (select *, (2 * absorption + 5 * rent + 3 * occ) / 13 as mean from sig),
m1 as (select *, sqrt((2 * (absorption - mean) ** 2 + 3 * mean ** 2 + 5 * (rent - mean) ** 2 + 3 * (occ - mean) ** 2) / 12) as sd from m0),
m2 as (select market, ({_TZ("absorption", "volatility", _CZ("absorption"))} + {_TZ("0.0", "0.0", _CZ("0.0"))} + {_TZ("absorption", "0.0", _CZ("absorption"))}) / 4.25 as d, least(3.0, greatest(-3.0, occ)) / 3 as o, {_TZ("rent", "0.0", _CZ("rent"))} as r from m1),
plan as (select * from (values ('Annual', 0.10, 0.9838, 0.82, 0.6349), ('2Yr', 0.15, 0.9178, 0.78, 0.6123), ('5Yr', 0.25, 0.8984, 0.70, 0.4409), ('10Yr', 0.50, 0.8695, 0.65, 0.3554)) v(period, weight, a, b, c)),
ps as (select market, period, weight::double as weight, {_asym("d", _B("a::double", "0.2::double"))} as ds, {_asym("o", _B("b::double", "0.2::double"))} as occ_score, {_asym("r", _B("c::double", "0.2::double"))} as rent_score from m2 cross join plan),
pm as (select *, ds * 0.35 + occ_score * 0.25 + rent_score * 0.40 as mf from ps),
ms as (select market, sum(ds * weight) / sum(weight) as ds, sum(occ_score * weight) / sum(weight) as occ_score, sum(rent_score * weight) / sum(weight) as rent_score, sum(mf * weight) / sum(weight) as mf from pm group by 1)"""
_R = lambda cols: ", ".join(f"round({c}, 6) as {c}" for c in cols)
_C = ("ds", "occ_score", "rent_score", "mf")


def _signals(spark, d):
    t = src.sales(spark, d)
    return sc.signals(*s.market_medians(t), t, src.properties(spark, d), zscores(spark, d))


@query("scd15_signals", f"with {_SIG} select market, {_R(('absorption', 'volatility', 'rent', 'occ'))} from sig")
def scd15(spark, d):
    return rounded(_signals(spark, d), "absorption", "volatility", "rent", "occ")


@query("set01_scoreable_markets", "select market from caprate where granularity = 'market' and market is not null intersect select market from sales where market is not null")
def set01(spark, d):
    t = src.sales(spark, d)
    return sc.scoreable(s.cap_rate_cube(t), t)


@query("scd12_period_scores", f"with {_SCORES} select market, period, weight, {_R(_C)} from pm")
def scd12(spark, d):
    return rounded(sc.period_scores(_signals(spark, d)), *_C)


@query("scd13_market_scores", f"with {_SCORES} select market, {_R(_C)} from ms")
def scd13(spark, d):
    return rounded(sc.market_scores(sc.period_scores(_signals(spark, d))), *_C)


@query("scd14_rankings", f"with {_SCORES}, t as (select market, 'All' as tier, mf from ms union all select market, '3 Star', mf * 0.5 from ms where market < 'NATION_3') "
       "select market, round(sum(w * mf) / sum(w), 6) as final_score, rank() over (order by round(sum(w * mf) / sum(w), 9) desc)::int as rank from (select *, case tier when 'All' then 0.4::double else 0.25::double end as w from t) group by market")
def scd14(spark, d):
    one = sc.market_scores(sc.period_scores(_signals(spark, d)))
    tiers = one.select("market", F.lit("All").alias("tier"), "mf").union(one.filter("market < 'NATION_3'").select("market", F.lit("3 Star"), F.col("mf") * 0.5))
    return rounded(sc.rankings(tiers), "final_score")


@query("scd18_scenario_compare", f"with {_SCORES} select market, round(mf, 6) as base, round((ds * 0.10 + occ_score * 0.15 + rent_score * 0.75), 6) as rent_heavy from ms")
def scd18(spark, d):
    one = sc.market_scores(sc.period_scores(_signals(spark, d)))
    return one.select("market", F.round("mf", 6).alias("base"), F.round(F.col("ds") * 0.10 + F.col("occ_score") * 0.15 + F.col("rent_score") * 0.75, 6).alias("rent_heavy"))


@query("agg39_momentum_mean", """select market, round(sum((1 + 0.35::double * 2.0::double ** (-(r - 1) / 3.0::double)) * v) / sum(1 + 0.35::double * 2.0::double ** (-(r - 1) / 3.0::double)), 6) as value from
 (select market, avg(sale_price) as v, row_number() over (partition by market order by sale_quarter desc) as r from sales group by market, sale_quarter) group by market""")
def agg39(spark, d):
    q = src.sales(spark, d).groupBy("market", "sale_quarter").agg(F.avg("sale_price").alias("v"))
    rows = q.withColumn("step", F.row_number().over(Window.partitionBy("market").orderBy(F.desc("sale_quarter"))) - 1)
    return rounded(sc.momentum_mean(rows, ["market"], "step", "v", 3.0, 0.35), "value")


@query("win11_cross_market_z", """select market, sale_year, round(case when count(v) over w >= 3 and stddev_samp(v) over w > 0 then (v - avg(v) over w) / stddev_samp(v) over w else 0 end, 6) as signal_z
 from (select market, sale_year, avg(price_per_unit) as v from sales group by 1, 2) window w as (partition by sale_year)""")
def win11(spark, d):
    rows = src.sales(spark, d).groupBy("market", "sale_year").agg(F.avg("price_per_unit").alias("v"))
    return rounded(sc.cross_market_z(rows, "v", ["sale_year"]), "signal_z").drop("v")


@query("scd01_tilt_arithmetic", """select p_partkey, round(case when z >= 0 then z * f else z / f end, 6) as asym, round(least(3.0, greatest(0.25, 1 + 0.25 * z)), 6) as bounded, round(case when t <= 0 then 1 else t ** 0.35 end, 6) as momentum from
 (select p_partkey, (p_size - 25) / 10.0::double as z, 0.5 + p_size / 50.0::double as f, (p_size - 10) / 20.0::double as t from part)""")
def scd01(spark, d):
    p = src.table(spark, d, "part").selectExpr("p_partkey", "(p_size - 25) / 10.0D as z", "0.5D + p_size / 50.0D as f", "(p_size - 10) / 20.0D as t")
    c = F.col
    return rounded(p.select("p_partkey", sc.asymmetric(c("z"), c("f")).alias("asym"), sc.bounded(c("z"), sc.CATEGORY).alias("bounded"), sc.momentum_effective(c("t")).alias("momentum")), "asym", "bounded", "momentum")


@query("win05_latest_12", "select market, sale_quarter, deals from (select *, row_number() over (partition by market order by sale_quarter desc) as r from (select market, sale_quarter, count(*)::bigint as deals from sales group by 1, 2)) where r <= 12")
def win05(spark, d):
    return sc.latest(src.sales(spark, d).groupBy("market", "sale_quarter").agg(F.count("*").alias("deals")), "market", "sale_quarter").drop("_r")
