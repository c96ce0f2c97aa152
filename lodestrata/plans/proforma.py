"""Queries of the pro forma; every part of the driver table is a scenario."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import proforma as pf
from ..operators import waterfall as wf
from ..session import written
from ..sources import surrogates as src
from .registry import query

def rounded(df, *columns, places):
    """The ten-millionth keeps halves from rounding either way."""
    return df.withColumns({c: F.round(F.col(c) + 1e-7, places) for c in columns})


_PARAMS = """p_partkey as scenario_id, {date} as start, 5 + p_size % 3 as hold_years, {d}(10 + p_size) as units, p_retailprice as rent, {array}({f}0.0, 0.03, 0.025{g}) as inflation, {f}0.02{g} as terminal,
 {f}0.01{g} as l2l, {f}0.05{g} as vacancy, {f}0.005{g} as concessions, {f}0.01{g} as bad_debt, {f}600{g} as other_pupy, {f}0.05{g} as other_y2, {f}5000{g} as opex_pupy, {f}0.03{g} as opex_inflation,
 {array}({f}12000{g}, {f}24000{g}, {f}6000{g}) as capex, {f}20000{g} as equity_reserve, {f}15000{g} as loan_cap, {f}0.06{g} as capex_rate, case p_size % 3 when 0 then 'equity_first' when 1 then 'loan_first' else 'pari_passu' end as funding,
 p_retailprice * 1000 as principal, {f}0.05{g} as rate, 360 as amortization, p_size % 13 as io_months, case when p_size % 2 = 0 then p_retailprice * 900 end as start_balance, {f}0.02{g} as amf_pct, {f}300{g} as reserves_pupy, {f}9000{g} as professional,
 {f}0.0025{g} as mip_pct, {f}5000{g} as surplus_note, p_retailprice * 1500 as cost_basis, {f}0.055{g} as exit_cap, {f}0.02{g} as sale_cost_pct, 5 as sale_year, {array}(p_retailprice * 1400, p_retailprice * 1450) as tmv, {f}0.03{g} as tmv_growth,
 p_retailprice * 1300 as maa_floor, {f}0.0125{g} as class_rate, {f}1.1{g} as capacity_rate, p_retailprice * 5 as base_ntc, {f}0.9{g} as developer_share, {f}0.1{g} as admin_pct, {f}0.0036{g} as osa_pct, 2029 as last_increment_year, p_retailprice * 20 as note_balance, {f}0.055{g} as note_rate"""


def scenarios(spark, d):
    params = _PARAMS.replace("{array}({f}0.0, 0.03, 0.025{g})", "array(0.0D, 0.03D, 0.025D)").format(date="date'2026-04-15'", d="double", array="array", f="cast(", g=" as double)")
    return src.table(spark, d, "part").selectExpr("*").selectExpr(*_split(params))


def _split(text: str) -> list[str]:
    """Top-level commas part the columns."""
    out, depth, last = [], 0, 0
    for k, ch in enumerate(text):
        depth += ch == "("
        depth -= ch == ")"
        if ch == "," and not depth:
            out.append(text[last:k])
            last = k + 1
    return [*out, text[last:]]


_S = "sc as (select " + _PARAMS.replace("{array}({f}0.0, 0.03, 0.025{g})", "[0.0::double, 0.03::double, 0.025::double]").replace("{d}(10 + p_size)", "(10 + p_size)::double").replace("{array}(", "list_value(").format(date="date '2026-04-15'", f="(", g=")::double") + " from part)"
_GRID = """g as (select scenario_id, m::int as month, ((m - 1) // 12 + 1)::int as year, ((m - 1) % 12 + 1)::int as month_of_year, year(date '2026-04-01' + to_months((m - 1)::int))::int as calendar_year, month(date '2026-04-01' + to_months((m - 1)::int))::int as calendar_month
 from (select scenario_id, unnest(range(1, hold_years * 12 + 1)) as m from sc))"""
_YEARS = "y as (select *, unnest(range(1, hold_years + 1)) as year from sc)"
_REV = f"""{_YEARS}, rv as (select scenario_id, year, units * rent * f as gpr, l2l, vacancy, concessions, bad_debt from (select *, product(1 + case when year <= 1 then 0 else coalesce(inflation[year], terminal) end) over (partition by scenario_id order by year) as f from y)),
rev as (select scenario_id, year::int as year, gpr, gpr * l2l as l2l, gpr * vacancy as vacancy, gpr * concessions as concessions, gpr * bad_debt as bad_debt, gpr - gpr * l2l - gpr * vacancy - gpr * concessions - gpr * bad_debt as tri from rv)"""
_DEBT = """d(scenario_id, month, n, r, pay, io, beginning, interest, principal_paid, payment, ending) as (
 select scenario_id, 0, hold_years * 12, rate / 12, principal * (rate / 12) / (1 - (1 + rate / 12) ** (-amortization)), io_months, 0.0::double, 0.0::double, 0.0::double, 0.0::double, coalesce(start_balance, principal) from sc
 union all select scenario_id, month + 1, n, r, pay, io, ending, ending * r, case when month + 1 <= io then 0 else least(greatest(0, pay - ending * r), ending) end, case when month + 1 <= io then ending * r else pay end,
 greatest(0, ending - case when month + 1 <= io then 0 else least(greatest(0, pay - ending * r), ending) end) from d where month < n)"""
_R = lambda cols, n=4: ", ".join(f"round({c} + 1e-7, {n}) as {c}" for c in cols)
_REVC = ("gpr", "l2l", "vacancy", "concessions", "bad_debt", "tri")


@query("pf01_time_grid", f"with {_S}, {_GRID} select * from g")
def pf01(spark, d):
    return pf.grid(scenarios(spark, d))


@query("pf03_revenue", f"with {_S}, {_REV} select scenario_id, year, {_R(_REVC)} from rev")
def pf03(spark, d):
    return rounded(pf.revenue(scenarios(spark, d)), *_REVC, places=4)


@query("pf04_other_income", f"with {_S}, {_YEARS} select scenario_id, year::int as year, round(600 * units * f / 12 + 1e-7, 4) as other_income from (select *, product(1 + case when year <= 1 then 0 when year = 2 then 0.05::double when year = 3 then 0.025::double else 0.02::double end) over (partition by scenario_id order by year) as f from y)")
def pf04(spark, d):
    return rounded(pf.other_income(scenarios(spark, d)), "other_income", places=4)


@query("pf05_opex", f"with {_S}, {_YEARS} select scenario_id, year::int as year, round(5000 * units * 1.03::double ** (year - 1) / 12 + 1e-7, 4) as opex from y")
def pf05(spark, d):
    return rounded(pf.opex(scenarios(spark, d)), "opex", places=4)


_LINES = """(values ('laundry', 'total', 100.0::double), ('parking', 'per_unit', 7.0::double), ('fee', 'pct_of_egr', 0.03::double), ('reserve', 'pct_of_upb', 0.01::double)) l(line, basis, base)"""


def _detail(spark, d):
    """Four lines of each scenario, one of every basis; the amounts grow with the part's size."""
    lines = "inline(array(struct('laundry' as line, 'total' as basis, 100D as base), struct('parking' as line, 'per_unit' as basis, 7D as base), struct('fee' as line, 'pct_of_egr' as basis, 0.03D as base), struct('reserve' as line, 'pct_of_upb' as basis, 0.01D as base)))"
    return src.table(spark, d, "part").selectExpr("p_partkey as scenario_id", "p_size", lines).selectExpr("scenario_id", "line", "basis", "base * p_size as amount")


@query("pf05_opex_detail", f"with {_S}, {_YEARS} select scenario_id, line, year::int as year, round(base * p_size * case basis when 'total' then 1 when 'per_unit' then units else 0 end * 1.03::double ** (year - 1) / 12 + 1e-7, 4) as opex from y join (select p_partkey, p_size from part) on p_partkey = scenario_id, {_LINES}")
def pf05_detail(spark, d):
    return rounded(pf.lines(scenarios(spark, d), _detail(spark, d), "opex"), "opex", places=4)


@query("pf04_other_income_detail", f"""with {_S}, {_YEARS} select scenario_id, line, year::int as year, round(base * p_size * case basis when 'total' then 1 else 0 end * f / 12 + 1e-7, 4) as other_income from
 (select *, product(1 + case when year <= 1 then 0 when year = 2 then 0.05::double when year = 3 then 0.025::double else 0.02::double end) over (partition by scenario_id order by year) as f from y) join (select p_partkey, p_size from part) on p_partkey = scenario_id, {_LINES} where basis = 'total'""")
def pf04_detail(spark, d):
    return rounded(pf.income_lines(scenarios(spark, d), _detail(spark, d).filter("basis = 'total'")), "other_income", places=4)


_DC = ("beginning", "interest", "principal_paid", "payment", "ending")


@query("pf09_debt", f"with recursive {_S}, {_DEBT} select scenario_id, month, {_R(_DC)} from d where month > 0")
def pf09(spark, d):
    return rounded(pf.debt(scenarios(spark, d)), *_DC, places=4)


_TIF = """tf as (select scenario_id, calendar_year, tmv, tmv * class_rate * capacity_rate as property_tax, case when calendar_year > last_increment_year then 0 else greatest(0, tmv * class_rate - base_ntc) * capacity_rate * developer_share end * (1 - admin_pct) * (1 - osa_pct) as net_tif, note_balance, note_rate from
 (select sc.* exclude (tmv), c as calendar_year, case when c <= last_increment_year then greatest(v, maa_floor) else v end as tmv from (select sc.*, unnest(range(2026, year(date '2026-04-01' + to_months(hold_years * 12 - 1)) + 1)) as c from sc) sc,
  lateral (select case c when 2026 then sc.tmv[1] when 2027 then sc.tmv[2] else sc.tmv[2] * (1 + tmv_growth) ** (c - 2027) end as v))),
n(scenario_id, calendar_year, note_ending, note_principal, tif_income) as (select scenario_id, 2025, note_balance, 0.0::double, 0.0::double from sc
 union all select n.scenario_id, n.calendar_year + 1, case when note_ending > 0 then greatest(0, note_ending * (1 + note_rate) - least(net_tif, note_ending * (1 + note_rate))) else 0 end,
 case when note_ending > 0 then least(net_tif, note_ending * (1 + note_rate)) else 0 end, case when note_ending > 0 then greatest(0, net_tif - least(net_tif, note_ending * (1 + note_rate))) else net_tif end
 from n join tf on tf.scenario_id = n.scenario_id and tf.calendar_year = n.calendar_year + 1)"""
_TC = ("tmv", "property_tax", "net_tif", "note_principal", "note_ending", "tif_income")


@query("pf06_tif", f"with recursive {_S}, {_TIF} select scenario_id, calendar_year::int as calendar_year, {_R(_TC, 3)} from tf join n using (scenario_id, calendar_year)")
def pf06(spark, d):
    return rounded(pf.tif(scenarios(spark, d)), *_TC, places=3)


_CAP = """cm as (select g.scenario_id, month, coalesce(capex[year], 0) / 12 as spent, equity_reserve, loan_cap, funding from g join sc using (scenario_id)),
ct as (select *, sum(spent) over (partition by scenario_id order by month) as t from cm where funding <> 'pari_passu'),
ca as (select *, least(t, case funding when 'loan_first' then loan_cap else equity_reserve end) as a from ct), cb as (select *, least(t - a, case funding when 'loan_first' then equity_reserve else loan_cap end) as b from ca),
cd as (select *, a - coalesce(lag(a) over w, 0) as da, b - coalesce(lag(b) over w, 0) as db from cb window w as (partition by scenario_id order by month))"""


@query("pf08_capex_funding", f"with {_S}, {_GRID}, {_CAP} select scenario_id, month, round(spent + 1e-7, 4) as spent, round(case funding when 'loan_first' then db else da end + 1e-7, 4) as equity_funded, round(case funding when 'loan_first' then da else db end + 1e-7, 4) as loan_funded from cd")
def pf08(spark, d):
    return rounded(pf.capex(scenarios(spark, d).filter("funding <> 'pari_passu'")), "spent", "equity_funded", "loan_funded", places=4)


_SHARED = """pp(scenario_id, month, e, l, spent, equity_funded, loan_funded) as (select scenario_id, 0, equity_reserve, loan_cap, 0.0::double, 0.0::double, 0.0::double from sc where funding = 'pari_passu'
 union all select scenario_id, month, e - te, greatest(0, l - tl), spent, te, tl from (select *, case when spent <= 0 or e + l <= 0 then 0 else least(spent - te, l) end as tl from
 (select pp.scenario_id, cm.month, e, l, cm.spent, case when cm.spent <= 0 or e + l <= 0 then 0 else least(cm.spent * e / (e + l), e) end as te from pp join cm on cm.scenario_id = pp.scenario_id and cm.month = pp.month + 1)))"""


@query("pf08_capex_pari_passu", f"with recursive {_S}, {_GRID}, {_CAP}, {_SHARED} select scenario_id, month, {_R(('spent', 'equity_funded', 'loan_funded'))} from pp where month > 0")
def pf08b(spark, d):
    return rounded(pf.capex(scenarios(spark, d).filter("funding = 'pari_passu'")), "spent", "equity_funded", "loan_funded", places=4)


_FLAT = """oi as (select scenario_id, year, 600 * units * f / 12 as other_income from (select *, product(1 + case when year <= 1 then 0 when year = 2 then 0.05::double when year = 3 then 0.025::double else 0.02::double end) over (partition by scenario_id order by year) as f from y)),
fx as (select scenario_id, month, spent, loan_funded from pp where month > 0 union all select scenario_id, month, spent, case funding when 'loan_first' then da else db end from cd),
cl as (select *, (bal - loan_funded) * 0.06::double / 12 as capital_interest from (select *, sum(loan_funded) over (partition by scenario_id order by month) as bal from fx)),
mo as (select g.scenario_id, g.year, g.month, g.calendar_year, g.calendar_month, gpr, rev.l2l, rev.vacancy, rev.concessions, rev.bad_debt, tri, other_income, n.tif_income / 12 as tif_income, tf.property_tax / 12 as property_tax, 5000 * units * 1.03::double ** (g.year - 1) / 12 as opex, spent,
 d.payment + capital_interest as debt_service, loan_funded as draw, d.ending + bal as balance, tri + other_income + n.tif_income / 12 as egr, amf_pct, reserves_pupy * units / 12 + professional / 12 + mip_pct * d.ending / 12 + case when calendar_month in (2, 8) then surplus_note / 2 else 0 end as rest
 from g join sc using (scenario_id) join rev on rev.scenario_id = g.scenario_id and rev.year = g.year join oi on oi.scenario_id = g.scenario_id and oi.year = g.year join tf on tf.scenario_id = g.scenario_id and tf.calendar_year = g.calendar_year
 join n on n.scenario_id = g.scenario_id and n.calendar_year = g.calendar_year join cl on cl.scenario_id = g.scenario_id and cl.month = g.month join d on d.scenario_id = g.scenario_id and d.month = g.month),
an as (select *, noi - non_operating - spent - debt_service + draw as levered_cf, noi - spent as unlevered_cf, case when debt_service > 0 then noi / debt_service else 0 end as dscr from (
 select scenario_id, year, min(calendar_year) as calendar_year, sum(gpr) as gpr, sum(l2l) as l2l, sum(vacancy) as vacancy, sum(concessions) as concessions, sum(bad_debt) as bad_debt, sum(tri) as tri, sum(other_income) as other_income, sum(tif_income) as tif_income, sum(egr) as egr,
 sum(opex) as opex, sum(property_tax) as property_tax, sum(egr - opex - property_tax) as noi, sum(amf_pct * egr + rest) as non_operating, sum(spent) as spent, sum(debt_service) as debt_service, sum(draw) as draw, arg_max(balance, month) as balance_eoy from mo group by 1, 2))"""
_ALL = f"with recursive {_S}, {_GRID}, {_REV}, {_CAP}, {_SHARED}, {_DEBT}, {_TIF}, {_FLAT}"
_AC = (*pf.SUMS, "balance_eoy", "levered_cf", "unlevered_cf", "dscr")


@query("pf11_annual_lines", f"{_ALL} select scenario_id, year, calendar_year, {_R(_AC, 3)} from an")
def pf11(spark, d):
    return rounded(pf.annual(pf.monthly(scenarios(spark, d))), *_AC, places=3)


_BISECT = """cf as (select an.scenario_id, -greatest(0, cost_basis - principal) as e0, -cost_basis as c0, list(levered_cf + case when year = sale_year then net else 0 end order by year) as lv, list(unlevered_cf + case when year = sale_year then gross else 0 end order by year) as un,
 avg(case when debt_service > 0 then dscr end) as avg_dscr, min(case when debt_service > 0 then dscr end) as min_dscr, max(case when year = 1 then noi end) as noi1 from an join sc using (scenario_id)
 join (select scenario_id, gross, gross - balance_eoy as net from (select an.scenario_id, balance_eoy, noi * (1 + coalesce(inflation[sale_year + 1], terminal)) / exit_cap * (1 - sale_cost_pct) as gross from an join sc using (scenario_id) where year = sale_year)) x using (scenario_id) group by an.scenario_id, cost_basis, principal),
fl as (select scenario_id, 'l' as k, list_prepend(e0, lv) as f from cf union all select scenario_id, 'u', list_prepend(c0, un) from cf),
bi(scenario_id, k, i, lo, hi, up, f) as (select scenario_id, k, 0, -0.9999::double, 10.0::double, low > 0, f from (select *, list_sum(list_transform(f, lambda x, j: x / 0.0001::double ** (j - 1))) as low, list_sum(list_transform(f, lambda x, j: x / 11.0::double ** (j - 1))) as high from fl) where (low > 0) <> (high > 0)
 union all select scenario_id, k, i + 1, case when same then mid else lo end, case when same then hi else mid end, up, f from (select *, (lo + hi) / 2 as mid, (list_sum(list_transform(f, lambda x, j: x / (1 + (lo + hi) / 2) ** (j - 1))) > 0) = up as same from bi where i < 60)),
ir as (select scenario_id, max(case when k = 'l' then (lo + hi) / 2 end) as levered_irr, max(case when k = 'u' then (lo + hi) / 2 end) as unlevered_irr from bi where i = 60 group by 1)"""
_RC = ("levered_irr", "unlevered_irr", "equity_multiple", "avg_dscr", "min_dscr", "yield_on_cost")


@query("pf14_returns", f"""{_ALL}, {_BISECT} select scenario_id, round(levered_irr + 1e-7, 5) as levered_irr, round(unlevered_irr + 1e-7, 5) as unlevered_irr, round(coalesce(list_sum(list_filter(lv, lambda x: x > 0)) / nullif(-e0, 0), 0) + 1e-7, 5) as equity_multiple,
 round(coalesce(avg_dscr, 0) + 1e-7, 5) as avg_dscr, round(coalesce(min_dscr, 0) + 1e-7, 5) as min_dscr, round(coalesce(noi1 / nullif(-c0, 0), 0) + 1e-7, 5) as yield_on_cost from cf left join ir using (scenario_id)""")
def pf14(spark, d):
    s = scenarios(spark, d)
    years = written(pf.annual(pf.monthly(s)))  # read twice
    return rounded(pf.returns(s, years, pf.residual(s, years)), *_RC, places=5)


@query("pf13_irr", """with recursive f as (select o_custkey, list(cf order by k) as fl from (select o_custkey, 0 as k, -1.5 * max(o_totalprice) as cf from orders group by 1 union all select o_custkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey), o_totalprice / 2 from orders) group by 1),
 b(o_custkey, i, lo, hi, fl) as (select o_custkey, 0, -0.9999::double, 10.0::double, fl from f where list_sum(list_transform(fl, lambda x, k: x / 0.0001::double ** (k - 1))) > 0 and list_sum(list_transform(fl, lambda x, k: x / 11.0::double ** (k - 1))) < 0
 union all select o_custkey, i + 1, case when list_sum(list_transform(fl, lambda x, k: x / (1 + (lo + hi) / 2) ** (k - 1))) > 0 then (lo + hi) / 2 else lo end, case when list_sum(list_transform(fl, lambda x, k: x / (1 + (lo + hi) / 2) ** (k - 1))) > 0 then hi else (lo + hi) / 2 end, fl from b where i < 60)
 select f.o_custkey, round((lo + hi) / 2, 6) as irr from f left join (select * from b where i = 60) b using (o_custkey)""")
def pf13(spark, d):
    o = src.table(spark, d, "orders")
    flows = o.groupBy("o_custkey").agg((F.max("o_totalprice") * -1.5).alias("p"), F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", (F.col("o_totalprice") / 2).alias("v")))).alias("l"))
    flows = flows.select("o_custkey", F.concat(F.array("p"), F.transform("l", lambda x: x["v"])).alias("flows"))
    return flows.select("o_custkey", F.round(pf.irr(F.col("flows")), 6).alias("irr"))


PARTNERS = wf.Partnership({"lp": (0.08, "annual"), "gp": (0.0, "annual")}, [("preferred_return", {"lp": 1.0}), ("return_of_capital", {"lp": 1.0, "gp": 1.0}), ("promote", {"lp": 0.7, "gp": 0.3})])


_TIERS = """wf(scenario_id, period, cl, rl, al, pl, cg, rg, dl, dg) as (select scenario_id, 0, 0.0::double, 0.0::double, 0.0::double, 0.0::double, 0.0::double, 0.0::double, 0.0::double, 0.0::double from sc
 union all select scenario_id, period, cl, rl + tl, al, pl + t1, cg, rg + t2 - tl, t1 + tl + 0.7::double * t3, t2 - tl + 0.3::double * t3 from (select *, case when cash - t1 - t2 > 1e-9 then cash - t1 - t2 else 0 end as t3, case when u + v > 0 then t2 * u / (u + v) else 0 end as tl from (
 select *, case when cash - t1 > 1e-9 then least(cash - t1, u + v) else 0 end as t2 from (select *, case when cash > 1e-9 then least(cash, greatest(0, al - pl)) else 0 end as t1 from (
 select *, greatest(0, cl - rl) as u, greatest(0, cg - rg) as v, oa + greatest(0, cl - rl) * 0.08::double as al from (select wf.scenario_id, an.year as period, wf.cl + case when an.year = 1 then cost_basis * 0.3::double * 0.9::double else 0 end as cl, rl, wf.al as oa, pl,
 wf.cg + case when an.year = 1 then cost_basis * 0.3::double * 0.1::double else 0 end as cg, rg, greatest(levered_cf, 0) as cash from wf join an on an.scenario_id = wf.scenario_id and an.year = wf.period + 1 join sc on sc.scenario_id = wf.scenario_id))))))"""
_WC = ("contributed", "distributed", "unpaid_pref", "unreturned_capital", "unrecouped_escrow")


@query("pf15_waterfall", f"""{_ALL}, {_TIERS} select scenario_id, period::int as period, class_id, {_R(_WC, 3)} from (
 select scenario_id, period, 'lp' as class_id, cl as contributed, dl as distributed, greatest(0, al - pl) as unpaid_pref, greatest(0, cl - rl) as unreturned_capital, 0.0::double as unrecouped_escrow from wf where period > 0
 union all select scenario_id, period, 'gp', cg, dg, 0, greatest(0, cg - rg), 0 from wf where period > 0)""")
def pf15(spark, d):
    s = scenarios(spark, d)
    cash = pf.annual(pf.monthly(s)).select("scenario_id", F.col("year").alias("period"), F.greatest("levered_cf", F.lit(0.0)).alias("distributable"))
    basis = s.select("scenario_id", (F.col("cost_basis") * 0.3).alias("b"))
    first = lambda share: F.when(F.col("period") == 1, F.col("b") * share).otherwise(0.0)
    return rounded(wf.waterfall(cash.hint("merge").join(basis, "scenario_id").withColumns({"contributed_lp": first(0.9), "contributed_gp": first(0.1)}), PARTNERS), *_WC, places=3)


@query("agg36_roster_totals", """select p_brand as scenario_id, sum(p_size)::bigint as units, sum(p_size * 800.0::double) as square_feet, round(sum(p_size * p_retailprice) + 1e-7, 2) as monthly_rent, round(sum(p_size * p_retailprice) / sum(p_size) + 1e-7, 4) as avg_rent from part group by 1""")
def agg36(spark, d):
    roster = src.table(spark, d, "part").selectExpr("p_brand as scenario_id", "p_size as unit_count", "800D as avg_sf", "p_retailprice as rent")
    out = pf.roster_totals(roster).select("scenario_id", "units", "square_feet", "monthly_rent", "avg_rent")
    return rounded(rounded(out, "monthly_rent", places=2), "avg_rent", places=4)
