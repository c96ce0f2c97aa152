"""Queries of lease pricing."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import leases as lp
from ..sources import surrogates as src
from .registry import query
from .warehouse import rounded

AS_OF, MONTH = date(1999, 6, 30), 7
_D = "date '1999-06-30'"

_GAPS = """gaps as (select property_id, unit_type, (lease_start - e)::double as gap from
  (select *, lag(lease_exp) over (partition by property_id, unit order by lease_start, lease_id, line) as e from leases) where not is_renewal and e is not null and lease_start - e between -30 and 540)"""


def _down(by: str) -> str:
    return f"""select {by}, median(gap) as median_days, avg(gap) as mean_days, quantile_cont(gap, 0.75) as p75_days, quantile_cont(gap, 0.9) as p90_days, count(*)::bigint as n_turns,
  avg(case when r > c and r <= n - c then gap end) as trimmed_mean from (select *, case when n >= 4 then greatest(1, floor(n * 0.1)) else 0 end as c from
  (select *, row_number() over (partition by {by} order by gap) as r, count(*) over (partition by {by}) as n from gaps)) group by {by}"""


_CASES = lambda x, tiers: "case " + " ".join(f"when {x} <= {b!r} then '{n}'" for n, b, _ in tiers[:-1]) + f" else '{tiers[-1][0]}' end"
_MULT = lambda x, tiers: "case " + " ".join(f"when {x} = '{n}' then {m!r}" for n, _, m in tiers) + " else 1.0 end"

_FLOORS = f"""own as ({_down("property_id, unit_type")}), whole as ({_down("property_id")}),
base as (select property_id, unit_type, avg(effective_rent) as inplace_rent, median(case when term_months between 6 and 24 then term_months end) as term, min(general_type) as general_type from leases group by 1, 2),
floors as (select *, inplace_rent + total_cost / term_months as floor from (select property_id, unit_type, inplace_rent, coalesce(term, 12.0)::double as term_months, coalesce(own.median_days, whole.median_days, 30.0) as downtime_days,
 case general_type when 'Studio' then 900.0 when '1BR' then 1400.0 when '2BR' then 1800.0 else 1500.0 end::double as make_ready,
 inplace_rent / 30.4::double * coalesce(own.median_days, whole.median_days, 30.0) + case general_type when 'Studio' then 900.0 when '1BR' then 1400.0 when '2BR' then 1800.0 else 1500.0 end::double + 450.0::double as total_cost
 from base left join own using (property_id, unit_type) left join whole using (property_id)) where inplace_rent > 0)"""
_AVAIL = """free as (select property_id, unit_type, sum(f)::bigint as ut_avail, count(*)::bigint as ut_total, min(floorplan) as floorplan from
 (select *, (lower(status) in ('vacant', 'notice', 'available', 'model'))::int as f from units) group by 1, 2)"""
_EXPO = f"""ends as (select property_id, unit_type, {", ".join(f"count(case when lease_exp - {_D} > 0 and lease_exp - {_D} <= {h} then 1 end) as e{h}" for h in (30, 60, 90, 180))} from leases group by 1, 2),
expo as (select *, (current_exposed * 0.4::double + exp_30 * 0.25::double + exp_60 * 0.2::double + exp_90 * 0.1::double + exp_180 * 0.05::double) / greatest(ut_total, 1) as exposure_pct from (select property_id, unit_type, ut_total, ut_avail as current_exposed,
 {", ".join(f"least(ut_avail + coalesce(e{h}, 0), ut_total)::bigint as exp_{h}" for h in (30, 60, 90, 180))} from free left join ends using (property_id, unit_type)))"""
_VELO = f"""velo as (select property_id, unit_type, leases_signed, m as monthly_absorption, {_CASES("m", lp.VELOCITY)} as velocity_tier from (select property_id, unit_type, coalesce(s, 0)::bigint as leases_signed,
 coalesce(s, 0) / (90 / 30.4::double) / greatest(ut_total, 1) as m from free left join (select property_id, unit_type, count(*) as s from leases where not is_renewal and lease_start between {_D} - 90 and {_D} group by 1, 2) using (property_id, unit_type)))"""


def _gap(by: str) -> str:
    return f"""select {by}, n, gap_pct, trend, {_CASES("round(gap_pct, 9)", lp.GAP_LEVEL)} as gap_level, {_CASES("round(trend, 9)", lp.GAP_TREND)} as gap_trend from (select {by}, n, coalesce(a, 0) as gap_pct, coalesce(a, 0) - coalesce(b, coalesce(a, 0)) as trend from
 (select {by}, avg(case when lease_start between {_D} - 90 and {_D} then g end) as a, avg(case when lease_start >= {_D} - 180 and lease_start < {_D} - 90 then g end) as b,
 count(case when lease_start between {_D} - 90 and {_D} then 1 end)::bigint as n from (select *, greatest(0, (face_rent - effective_rent) / face_rent) as g from leases where not is_renewal and face_rent > 0 and effective_rent <> 0) group by {by}))"""


_SEASON = f"""season as (select property_id, month, n, case when n >= 10 then n / (sum(n) over (partition by property_id) / 12) * 0.7::double + 0.3::double else usual end as multiplier from
 (select p.property_id, m.month, m.usual, coalesce(c.n, 0)::bigint as n from (select distinct property_id from leases) p cross join (select unnest(range(1, 13))::int as month, unnest({list(lp.SEASON)!r})::double as usual) m
 left join (select property_id, month(lease_start) as month, count(*) as n from leases where not is_renewal and lease_start between {_D} - 720 and {_D} group by 1, 2) c using (property_id, month)))"""


def _data(spark, d):
    return src.leases(spark, d), src.units(spark, d)


_DC = ("median_days", "mean_days", "p75_days", "p90_days", "trimmed_mean")
_DS = ", ".join(f"round({c}, 6) as {c}" for c in _DC)


@query("agg24_downtime", f"with {_GAPS} select property_id, unit_type, {_DS}, n_turns from ({_down('property_id, unit_type')})")
def agg24(spark, d):
    return rounded(lp.downtime(lp.gaps(src.leases(spark, d)), lp.KEYS), *_DC)


@query("lp02_downtime_portfolio", f"with {_GAPS} select property_id, {_DS}, n_turns from ({_down('property_id')})")
def lp02(spark, d):
    return rounded(lp.downtime(lp.gaps(src.leases(spark, d)), ["property_id"]), *_DC)


_FC = ("inplace_rent", "term_months", "downtime_days", "make_ready", "total_cost", "floor")


@query("lp04_floors", f"with {_GAPS}, {_FLOORS} select property_id, unit_type, {', '.join(f'round({c}, 4) as {c}' for c in _FC)} from floors")
def lp04(spark, d):
    return rounded(lp.floors(src.leases(spark, d)).filter("feasible").drop("feasible"), *_FC, places=4)


@query("agg25_availability", f"""with {_AVAIL} select property_id, unit_type, ut_avail, ut_total, floorplan, sum(ut_avail) over (partition by property_id, floorplan)::bigint as fp_avail, sum(ut_total) over (partition by property_id, floorplan)::bigint as fp_total,
 sum(ut_avail) over (partition by property_id)::bigint as property_avail, sum(ut_total) over (partition by property_id)::bigint as property_total from free""")
def agg25(spark, d):
    return lp.availability(src.units(spark, d))


@query("agg26_forward_exposure", f"with {_AVAIL}, {_EXPO} select property_id, unit_type, ut_total, current_exposed, exp_30, exp_60, exp_90, exp_180, round(exposure_pct, 6) as exposure_pct from expo")
def agg26(spark, d):
    leases, units = _data(spark, d)
    return rounded(lp.exposure(lp.availability(units), leases, AS_OF), "exposure_pct")


@query("agg27_velocity", f"with {_AVAIL}, {_VELO} select property_id, unit_type, leases_signed, round(monthly_absorption, 6) as monthly_absorption, velocity_tier from velo")
def agg27(spark, d):
    leases, units = _data(spark, d)
    return rounded(lp.velocity(lp.availability(units), leases, AS_OF), "monthly_absorption")


@query("agg28_gap", f"select property_id, unit_type, n, round(gap_pct, 6) as gap_pct, round(trend, 6) as trend, gap_level, gap_trend from ({_gap('property_id, unit_type')})")
def agg28(spark, d):
    return rounded(lp.gap(src.leases(spark, d), AS_OF, lp.KEYS), "gap_pct", "trend")


@query("agg29_seasonality", f"with {_SEASON} select property_id, month, n, round(multiplier, 6) as multiplier from season")
def agg29(spark, d):
    return rounded(lp.seasonality(src.leases(spark, d), AS_OF), "multiplier")


_PC = ("floor", "exposure_pct", "seasonal", "premium", "recommended")


@query("lp08_price_all", f"""with {_GAPS}, {_FLOORS}, {_AVAIL}, {_EXPO}, {_VELO}, {_SEASON}, gu as ({_gap('property_id, unit_type')}), gp as ({_gap('property_id')}),
 p as (select f.property_id, f.unit_type, floor, exposure_pct, velocity_tier, coalesce(gu.gap_level, gp.gap_level) as gap_level, coalesce(multiplier, 1.02) as seasonal,
 greatest(-0.06, least(0.06, (0.1 - coalesce(exposure_pct, 0)) * 0.4 + ({_MULT('velocity_tier', lp.VELOCITY)} - 1) * 0.25 + ({_MULT('coalesce(gu.gap_level, gp.gap_level)', lp.GAP_LEVEL)} - 1) * 0.2 + (coalesce(multiplier, 1.02) - 1) * 0.15)) as premium
 from floors f left join expo using (property_id, unit_type) left join velo using (property_id, unit_type) left join gu using (property_id, unit_type) left join gp using (property_id)
 left join (select * from season where month = 7) s using (property_id))
 select property_id, unit_type, round(floor, 4) as floor, round(exposure_pct, 4) as exposure_pct, velocity_tier, gap_level, round(seasonal, 4) as seasonal, round(premium, 4) as premium, round(floor * (1 + premium), 4) as recommended,
 case when premium >= 0.02 then 'push' when premium <= -0.02 then 'concede' else 'hold' end as posture from p""")
def lp08(spark, d):
    leases, units = _data(spark, d)
    return rounded(lp.price(leases, units, AS_OF, MONTH), *_PC, places=4)


_SC = ("avg_rent", "avg_market_rent", "occupancy_pct")


@query("agg30_rent_summary", """select property_id, count(*)::bigint as units, round(avg(current_rent), 4) as avg_rent, min(current_rent) as min_rent, max(current_rent) as max_rent, round(avg(market_rent), 4) as avg_market_rent,
 round(count(case when status = 'occupied' then 1 end) / count(*) * 100, 4) as occupancy_pct from units group by property_id""")
def agg30(spark, d):
    return rounded(lp.rent_summary(src.units(spark, d)), *_SC, places=4)


@query("sc23_unit_type", """select p_partkey, case when p_size % 5 = 0 then 'Studio' when p_size % 5 < 4 then (p_size % 5) || 'BR' when p_size * 30 < 450 then 'Studio' when p_size * 30 < 700 then '1BR' when p_size * 30 < 1000 then '2BR' else '3BR' end as unit_type,
 case when p_size * 30 between 30 and 900 then round(p_size * 30 / 30.4::double, 1) else 12.0 end::double as term from part""")
def sc23(spark, d):
    beds = F.when(F.col("p_size") % 5 < 4, F.col("p_size") % 5)
    start = F.lit(date(2000, 1, 1))
    return src.table(spark, d, "part").select("p_partkey", lp.unit_type(beds, F.col("p_size") * 30).alias("unit_type"), lp.lease_term(start, F.date_add(start, F.col("p_size") * 30)).alias("term"))


@query("sc24_lease_term", """select lease_id, line, unit, case when date_diff('day', lease_start, lease_exp) between 30 and 900 then round(date_diff('day', lease_start, lease_exp) / 30.4::double, 1) else 12.0 end as months from leases""")
def sc24(spark, d):
    return src.leases(spark, d).select("lease_id", "line", "unit", lp.lease_term(F.col("lease_start"), F.col("lease_exp")).alias("months"))
