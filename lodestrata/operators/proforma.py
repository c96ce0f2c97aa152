"""Forward pro forma: time grid, revenue, other income, expenses, tax increment, capital spending, debt, non-operating items, annual lines, exit and returns.

All scenarios run at once: every function is keyed by ``scenario_id``. What is a closed form is a window or a column; what is a true
recurrence (growth, loan, tax-increment note, funding, bisection) is a fold inside one row, so a scenario never spans tasks. Rows by year and month are made from a scenario's row
and its folds, not by joins. Where other rows meet scenarios, neither side is sent to all executors: Spark takes exploded rows for as few as they come from.
A scenario is a row of plain parameters: see ``PARAMETERS``; lists by year are arrays whose first entry is year 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import spread

PARAMETERS = """scenario_id long, start date, hold_years int, units double, rent double, inflation array<double>, terminal double, l2l double, vacancy double, concessions double, bad_debt double,
 other_pupy double, other_y2 double, opex_pupy double, opex_inflation double, capex array<double>, equity_reserve double, loan_cap double, capex_rate double, funding string, principal double, rate double, amortization int,
 io_months int, start_balance double, amf_pct double, reserves_pupy double, professional double, mip_pct double, surplus_note double, cost_basis double, exit_cap double, sale_cost_pct double, sale_year int,
 tmv array<double>, tmv_growth double, maa_floor double, class_rate double, capacity_rate double, base_ntc double, developer_share double, admin_pct double, osa_pct double, last_increment_year int, note_balance double, note_rate double"""
KEY = "scenario_id"
BISECTIONS = 60


def grid(scenarios: DataFrame) -> DataFrame:
    """A row a month, from the first of the starting month, with pro-forma and calendar positions."""
    first = F.trunc("start", "month")
    months = scenarios.select(KEY, first.alias("_first"), F.posexplode(F.sequence(F.lit(0), F.col("hold_years") * 12 - 1)).alias("_p", "_m"))
    date = F.add_months("_first", F.col("_m"))
    return months.select(
        KEY, (F.col("_m") + 1).alias("month"), (F.floor(F.col("_m") / 12) + 1).cast("int").alias("year"), (F.col("_m") % 12 + 1).alias("month_of_year"), F.year(date).alias("calendar_year"), F.month(date).alias("calendar_month")
    )


def inflation_rate(year: Column, rates: Column, terminal: Column) -> Column:
    """0 in year 1, then the year's own rate, or the terminal one where there is none."""
    return F.when(year <= 1, 0.0).otherwise(F.coalesce(F.get(rates, year - 1), terminal))


def _growth(rates: Column, terminal: Column) -> Column:
    """An array by pro-forma year: the running product of one plus the rates."""
    step = lambda l, y: F.concat(l, F.array(F.coalesce(F.get(l, y - 2), F.lit(1.0)) * (1 + inflation_rate(y, rates, terminal))))
    return F.when(F.col("hold_years") > 0, F.aggregate(F.sequence(F.lit(1), F.col("hold_years")), F.array().cast("array<double>"), step))


def _no_rates() -> Column:
    return F.array().cast("array<double>")


def _by_year(rows: DataFrame, growth: Column, name: str, *kept: str) -> DataFrame:
    return rows.select(KEY, *kept, F.posexplode(growth).alias("_y", name)).select(KEY, *kept, (F.col("_y") + 1).alias("year"), name)


def factors(scenarios: DataFrame, rates: Column, terminal: Column, name: str) -> DataFrame:
    """Cumulative growth by pro-forma year: the running product of one plus the rates."""
    return _by_year(scenarios, _growth(rates, terminal), name)


_LOSSES = ("l2l", "vacancy", "concessions", "bad_debt")


def _revenue_lines(factor: Column, share) -> dict[str, Column]:
    """Gross potential rent, what is lost of it (``share`` gives each loss's column), and what is left."""
    gpr = F.col("units") * F.col("rent") * factor
    lost = {c: gpr * share(c) for c in _LOSSES}
    left = gpr
    for c in _LOSSES:
        left = left - lost[c]
    return {"gpr": gpr} | lost | {"tri": left}


def revenue(scenarios: DataFrame) -> DataFrame:
    """Monthly rent by year: losses, vacancy, concessions and bad debt are all shares of gross potential rent."""
    rows = _by_year(scenarios, _growth(F.col("inflation"), F.col("terminal")), "factor", "units", "rent", *_LOSSES)
    return rows.select(KEY, "year", *[v.alias(c) for c, v in _revenue_lines(F.col("factor"), F.col).items()])


def _income_growth() -> Column:
    rates = F.transform(F.sequence(F.lit(1), F.greatest(F.size("inflation"), F.lit(2))), lambda y: F.when((y == 2) & F.col("other_y2").isNotNull(), F.col("other_y2")).otherwise(F.coalesce(F.get(F.col("inflation"), y - 1), F.col("terminal"))))
    return _growth(rates, F.col("terminal"))


def _opex_growth() -> Column:
    return _growth(_no_rates(), F.col("opex_inflation"))


def other_income(scenarios: DataFrame) -> DataFrame:
    """Plug method: an amount per unit and year that grows; year 2 may have a rate of its own."""
    return _by_year(scenarios, _income_growth(), "factor", "units", "other_pupy").select(KEY, "year", (F.col("other_pupy") * F.col("units") * F.col("factor") / 12).alias("other_income"))


def _detailed(scenarios: DataFrame, detail: DataFrame, growth: Column) -> DataFrame:
    """Detail lines by year, with ``units`` and ``factor``: lines meet scenarios before either is exploded."""
    rows = detail.hint("merge").join(scenarios.select(KEY, "units", growth.alias("_g")), KEY)
    return _by_year(rows, F.col("_g"), "factor", *[c for c in detail.columns if c != KEY], "units")


def income_lines(scenarios: DataFrame, detail: DataFrame) -> DataFrame:
    """Detail method: (scenario_id, line, amount), the first year's amounts -> a monthly amount by line and year."""
    return _detailed(scenarios, detail, _income_growth()).select(KEY, "line", "year", (F.col("amount") * F.col("factor") / 12).alias("other_income"))


def opex(scenarios: DataFrame) -> DataFrame:
    return _by_year(scenarios, _opex_growth(), "factor", "units", "opex_pupy").select(KEY, "year", (F.col("opex_pupy") * F.col("units") * F.col("factor") / 12).alias("opex"))


def lines(scenarios: DataFrame, detail: DataFrame, name: str) -> DataFrame:
    """Detail method: (scenario_id, line, basis, amount) -> a monthly amount by year; shares of income enter nothing, as in the original."""
    unit = F.when(F.col("basis") == "per_unit", F.col("units")).when(F.col("basis").isin("pct_of_egr", "pct_of_upb"), 0.0).otherwise(1.0)
    return _detailed(scenarios, detail, _opex_growth()).select(KEY, "line", "year", (F.col("amount") * unit * F.col("factor") / 12).alias(name))


def payment(principal: Column, annual_rate: Column, months: Column) -> Column:
    """Level payment of a loan: none without months, straight-line without interest."""
    r = annual_rate / 12
    return F.when(months <= 0, 0.0).when(annual_rate == 0, principal / months).otherwise(principal * r / (1 - F.pow(1 + r, -months)))


_PAID = "if({m} <= io_months, 0D, least(greatest(0D, pay - {b} * r), {b}))"


def _loan_folds(scenarios: DataFrame) -> DataFrame:
    """Scenarios with ``r``, ``pay`` and ``_left``: the acquisition loan's balances in an array, the first one before the first month. Only what recurs is folded."""
    pay = payment(F.col("principal"), F.col("rate"), F.col("amortization"))
    last = "element_at(l, -1)"
    left = f"if(hold_years > 0, aggregate(sequence(1, hold_years * 12), array(coalesce(start_balance, principal)), (l, m) -> concat(l, array(greatest(0D, {last} - {_PAID.format(m='m', b=last)})))), null)"
    return scenarios.withColumns({"r": F.col("rate") / 12, "pay": pay}).withColumn("_left", F.expr(left))


def _loan_lines() -> dict[str, Column]:
    """What the loan does in the month ``_m`` (from 0)."""
    before = F.get("_left", F.col("_m"))
    paid = F.expr(_PAID.format(m="_m + 1", b="get(_left, _m)"))
    return {"beginning": before, "interest": before * F.col("r"), "principal_paid": paid, "payment": F.when(F.col("_m") < F.col("io_months"), before * F.col("r")).otherwise(F.col("pay")), "ending": F.get("_left", F.col("_m") + 1)}


def _in_months(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_m", F.explode(F.sequence(F.lit(0), F.col("hold_years") * 12 - 1)))


def debt(scenarios: DataFrame) -> DataFrame:
    """The acquisition loan by month: interest-only months first, principal never above the balance (the last payment is not cut, as in the original)."""
    rows = _in_months(_loan_folds(spread(scenarios, KEY)).filter("hold_years > 0").select(KEY, "hold_years", "io_months", "r", "pay", "_left"))
    return rows.select(KEY, (F.col("_m") + 1).alias("month"), *[v.alias(c) for c, v in _loan_lines().items()])


def _funding_folds(scenarios: DataFrame) -> DataFrame:
    """Scenarios with ``_total``, the running sum of what is spent, and for pari passu ``_open``, what is left of both sources after each month."""
    spent = "(coalesce(get(capex, cast((m - 1) div 12 as int)), 0D) / 12)"
    total = f"if(funding = 'pari_passu' or hold_years < 1, null, aggregate(sequence(1, hold_years * 12), cast(array() as array<double>), (l, m) -> concat(l, array(coalesce(get(l, m - 2), 0D) + greatest({spent}, 0D)))))"
    s = "element_at(l, -1)"
    take_e = f"if({spent} <= 0 or {s}.e + {s}.l <= 0, 0D, least({spent} * {s}.e / ({s}.e + {s}.l), {s}.e))"
    take_l = f"if({spent} <= 0 or {s}.e + {s}.l <= 0, 0D, least({spent} - {take_e}, {s}.l))"
    shared = f"aggregate(sequence(1, hold_years * 12), array(named_struct('e', equity_reserve, 'l', loan_cap)), (l, m) -> concat(l, array(named_struct('e', {s}.e - {take_e}, 'l', greatest(0D, {s}.l - {take_l})))))"
    return scenarios.withColumns({"_total": F.expr(total), "_open": F.expr(f"if(funding = 'pari_passu' and hold_years > 0, {shared}, null)")})


def _funding_lines() -> dict[str, Column]:
    """What is spent in the month ``_m`` (from 0), from which source, and what the loan has given so far. Equity first and loan first draw on running sums cut at the limits; pari passu shares what is left of both."""
    def drawn(m: Column) -> tuple[Column, Column]:
        total, open_ = F.coalesce(F.get("_total", m), F.lit(0.0)), F.get("_open", m + 1)
        loan_first, shared = F.col("funding") == "loan_first", F.col("funding") == "pari_passu"
        first = F.least(total, F.when(loan_first, F.col("loan_cap")).otherwise(F.col("equity_reserve")))
        rest = F.least(total - first, F.when(loan_first, F.col("equity_reserve")).otherwise(F.col("loan_cap")))
        return F.when(shared, F.col("equity_reserve") - open_["e"]).when(loan_first, rest).otherwise(first), F.when(shared, F.col("loan_cap") - open_["l"]).when(loan_first, first).otherwise(rest)

    m = F.col("_m")
    now, before = drawn(m), drawn(m - 1)
    spent = F.coalesce(F.get("capex", F.floor(m / 12).cast("int")), F.lit(0.0)) / 12
    return {"spent": spent, "equity_funded": now[0] - before[0], "loan_funded": now[1] - before[1], "capital_balance": now[1]}


def capex(scenarios: DataFrame) -> DataFrame:
    """Monthly spending and its funding; scenarios without a kind of funding have no rows."""
    rows = _funding_folds(spread(scenarios.filter("hold_years > 0 and funding is not null"), KEY)).select(KEY, "hold_years", "capex", "funding", "equity_reserve", "loan_cap", "_total", "_open")
    lines = _funding_lines()
    return _in_months(rows).select(KEY, (F.col("_m") + 1).alias("month"), *[lines[c].alias(c) for c in ("spent", "equity_funded", "loan_funded")])


def capital_loan(scenarios: DataFrame, spent: DataFrame) -> DataFrame:
    """The capital loan: interest on what was drawn before the month, no repayment."""
    w = Window.partitionBy(KEY).orderBy("month")
    rows = spent.hint("merge").join(scenarios.select(KEY, "capex_rate"), KEY).withColumn("balance", F.sum("loan_funded").over(w))
    return rows.select(KEY, "month", F.col("loan_funded").alias("draw"), ((F.col("balance") - F.col("loan_funded")) * F.col("capex_rate") / 12).alias("capital_interest"), F.col("balance").alias("capital_balance"))


def _increment(scenarios: DataFrame, *kept: str) -> DataFrame:
    """Scenarios -> (scenario_id, kept, ``_tax``): the tax increment's calendar years in an array."""
    years = "sequence(year(start), year(add_months(trunc(start, 'MONTH'), hold_years * 12 - 1)))"
    value = "coalesce(get(tmv, y - year(start)), if(s.t is null, maa_floor, s.t * (1 + coalesce(tmv_growth, 0.04D))))"
    first = F.expr(f"""aggregate({years}, named_struct('t', cast(null as double), 'rows', cast(array() as array<struct<calendar_year:int,tmv:double>>)),
      (s, y) -> named_struct('t', if(y <= last_increment_year, greatest({value}, maa_floor), {value}), 'rows', concat(s.rows, array(named_struct('calendar_year', y, 'tmv', if(y <= last_increment_year, greatest({value}, maa_floor), {value}))))), s -> s.rows)""")
    rows = scenarios.withColumn("_v", first)
    # what doesn't recur is a plain list; only the note is folded
    net = "if(v.calendar_year > last_increment_year, 0D, greatest(0D, v.tmv * class_rate - base_ntc) * capacity_rate * developer_share) * (1 - admin_pct) * (1 - osa_pct)"
    rows = rows.withColumn("_n", F.expr(f"transform(_v, v -> named_struct('calendar_year', v.calendar_year, 'tmv', v.tmv, 'property_tax', v.tmv * class_rate * capacity_rate, 'net_tif', {net}))"))
    interest, paid = "s.b * note_rate", "if(s.b > 0, least(x.net_tif, s.b + s.b * note_rate), 0D)"
    fold = f"""aggregate(_n, named_struct('b', note_balance, 'rows', cast(array() as array<struct<calendar_year:int,tmv:double,property_tax:double,net_tif:double,note_principal:double,note_ending:double,tif_income:double>>)),
      (s, x) -> named_struct('b', if(s.b > 0, greatest(0D, s.b + {interest} - {paid}), 0D), 'rows', concat(s.rows, array(named_struct('calendar_year', x.calendar_year, 'tmv', x.tmv, 'property_tax', x.property_tax, 'net_tif', x.net_tif,
        'note_principal', {paid}, 'note_ending', if(s.b > 0, greatest(0D, s.b + {interest} - {paid}), 0D), 'tif_income', if(s.b > 0, greatest(0D, x.net_tif - {paid}), x.net_tif))))), s -> s.rows)"""
    return rows.select(KEY, *kept, F.expr(fold).alias("_tax"))


def tif(scenarios: DataFrame) -> DataFrame:
    """Tax increment by calendar year of the grid: value (floored while the district lasts), tax, increment, note and residual to the owner."""
    return _increment(spread(scenarios, KEY)).select(KEY, F.inline("_tax"))


def attorney_fees(active: DataFrame, baseline: DataFrame, years: list[int], share: float) -> DataFrame:
    """In years of appeal, a share of the tax saved against the baseline."""
    base = baseline.select(KEY, "calendar_year", F.col("property_tax").alias("_b"))
    fee = F.when(F.col("calendar_year").isin(years), F.greatest(F.lit(0.0), F.col("_b") - F.col("property_tax")) * share).otherwise(0.0)
    return active.join(base.hint("merge"), [KEY, "calendar_year"], "left").select(KEY, "calendar_year", F.coalesce(fee, F.lit(0.0)).alias("attorney_fee"))


def monthly(scenarios: DataFrame) -> DataFrame:
    """All monthly series side by side: a scenario's folds are arrays of its row, from which each month takes its place."""
    own = ("hold_years", "start", "units", "rent", *_LOSSES, "other_pupy", "opex_pupy", "capex", "funding", "equity_reserve", "loan_cap", "capex_rate", "io_months", "amf_pct", "reserves_pupy", "professional", "mip_pct", "surplus_note")
    arrays = {"_growth": _growth(F.col("inflation"), F.col("terminal")), "_income": _income_growth(), "_costs": _opex_growth()}
    folds = ("r", "pay", "_left", "_total", "_open")
    some = spread(scenarios.filter("hold_years > 0 and funding is not null"), KEY)
    rows = _increment(_funding_folds(_loan_folds(some)), *[c for c in some.columns if c != KEY], *folds)
    rows = rows.select(KEY, *[F.col(c).alias(f"_{c}" if c in _LOSSES else c) for c in own], "_tax", *folds, *[v.alias(c) for c, v in arrays.items()])
    c, m = F.col, F.col("_m")
    rows = _in_months(rows)
    date = F.add_months(F.trunc("start", "month"), m)
    rows = rows.withColumns({"month": m + 1, "year": (F.floor(m / 12) + 1).cast("int"), "month_of_year": m % 12 + 1, "calendar_year": F.year(date), "calendar_month": F.month(date)})
    at = lambda a: F.get(a, c("year") - 1)
    tax = F.get("_tax", c("calendar_year") - F.year("start"))
    rows = rows.withColumns(_revenue_lines(at("_growth"), lambda x: c(f"_{x}")) | _loan_lines() | _funding_lines() | {
        "other_income": c("other_pupy") * c("units") * at("_income") / 12, "opex": c("opex_pupy") * c("units") * at("_costs") / 12, "tif_income": tax["tif_income"] / 12, "property_tax": tax["property_tax"] / 12,
    }).withColumn("draw", c("loan_funded"))
    rows = rows.withColumn("capital_interest", (c("capital_balance") - c("draw")) * c("capex_rate") / 12).withColumn("egr", c("tri") + c("other_income") + c("tif_income"))
    surplus = F.when(c("calendar_month").isin(2, 8), c("surplus_note") / 2).otherwise(0.0)
    non_operating = c("amf_pct") * c("egr") + c("reserves_pupy") * c("units") / 12 + c("professional") / 12 + c("mip_pct") * c("ending") / 12 + surplus
    rows = rows.withColumns({"noi": c("egr") - c("opex") - c("property_tax"), "non_operating": non_operating, "debt_service": c("payment") + c("capital_interest"), "balance": c("ending") + c("capital_balance")})
    kept = ("units", "amf_pct", "reserves_pupy", "professional", "mip_pct", "surplus_note")
    return rows.drop("_m", "_tax", *folds, *arrays, *[f"_{c}" if c in _LOSSES else c for c in own if c not in kept])


SUMS = ("gpr", "l2l", "vacancy", "concessions", "bad_debt", "tri", "other_income", "tif_income", "egr", "opex", "property_tax", "noi", "non_operating", "spent", "debt_service", "draw")


def annual(months: DataFrame) -> DataFrame:
    """Annual lines: sums of months, the last month's balance, cash flows and coverage."""
    rows = months.groupBy(KEY, "year").agg(F.min("calendar_year").alias("calendar_year"), *[F.sum(c).alias(c) for c in SUMS], F.max_by("balance", "month").alias("balance_eoy"))
    c = F.col
    return rows.withColumns({
        "levered_cf": c("noi") - c("non_operating") - c("spent") - c("debt_service") + c("draw"), "unlevered_cf": c("noi") - c("spent"), "dscr": F.when(c("debt_service") > 0, c("noi") / c("debt_service")).otherwise(0.0),
    })


def residual(scenarios: DataFrame, years: DataFrame) -> DataFrame:
    """Exit in the sale year at next year's NOI over the exit cap rate, less costs and loans."""
    rows = scenarios.hint("merge").join(years.select(KEY, "year", "noi", "balance_eoy"), KEY).filter(F.col("year") == F.col("sale_year"))
    forward = F.col("noi") * (1 + inflation_rate(F.col("sale_year") + 1, F.col("inflation"), F.col("terminal")))
    rows = rows.withColumn("forward_noi", forward).withColumn("sale_price", F.col("forward_noi") / F.col("exit_cap")).withColumn("sale_cost", F.col("sale_price") * F.col("sale_cost_pct"))
    return rows.select(KEY, "forward_noi", "sale_price", "sale_cost", (F.col("sale_price") - F.col("sale_cost")).alias("gross_less_cost"), (F.col("sale_price") - F.col("sale_cost") - F.col("balance_eoy")).alias("net_proceeds"))


def irr(flows: Column) -> Column:
    """Rate at which an array of yearly cash flows (from year 0) is worth nothing: bisection on [-0.9999, 10]; null without a change of sign.

    The worth is summed by Horner's rule; ``BISECTIONS`` halvings exhaust the precision of a double.
    """
    worth = lambda r: F.aggregate(F.reverse(flows), F.lit(0.0), lambda a, x: a / (1 + r) + x)
    low, high = F.lit(-0.9999), F.lit(10.0)
    starts_up = worth(low) > 0
    middle = lambda s: (s["lo"] + s["hi"]) / 2
    pair = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    halve = lambda s, _: F.when((worth(middle(s)) > 0) == starts_up, pair(middle(s), s["hi"])).otherwise(pair(s["lo"], middle(s)))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(BISECTIONS)), pair(low, high), halve, middle)
    return F.when(worth(low) * worth(high) <= 0, found)


def returns(scenarios: DataFrame, years: DataFrame, exits: DataFrame) -> DataFrame:
    """IRRs, equity multiple, coverage and yield on cost."""
    rows = years.hint("merge").join(scenarios.select(KEY, "sale_year", "cost_basis", F.greatest(F.lit(0.0), F.col("cost_basis") - F.col("principal")).alias("equity")), KEY).join(exits.hint("merge"), KEY)
    at_sale = F.col("year") == F.col("sale_year")
    rows = rows.withColumns({"_l": F.col("levered_cf") + F.when(at_sale, F.col("net_proceeds")).otherwise(0.0), "_u": F.col("unlevered_cf") + F.when(at_sale, F.col("gross_less_cost")).otherwise(0.0)})
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("year", F.col(c).alias("v")))), lambda x: x["v"])
    out = rows.groupBy(KEY).agg(
        F.first("equity").alias("equity"), F.first("cost_basis").alias("cost_basis"), ordered("_l").alias("_l"), ordered("_u").alias("_u"), F.sum(F.when(F.col("_l") > 0, F.col("_l"))).alias("_out"),
        F.avg(F.when(F.col("debt_service") > 0, F.col("dscr"))).alias("avg_dscr"), F.min(F.when(F.col("debt_service") > 0, F.col("dscr"))).alias("min_dscr"), F.max(F.when(F.col("year") == 1, F.col("noi"))).alias("_noi1"),
    )
    out = out.withColumns({"levered": F.concat(F.array(-F.col("equity")), "_l"), "unlevered": F.concat(F.array(-F.col("cost_basis")), "_u")})
    ratio = lambda a, b: F.coalesce(F.expr(f"try_divide({a}, {b})"), F.lit(0.0))
    return out.select(KEY, irr(F.col("levered")).alias("levered_irr"), irr(F.col("unlevered")).alias("unlevered_irr"), ratio("coalesce(_out, 0D)", "equity").alias("equity_multiple"),
                      F.coalesce("avg_dscr", F.lit(0.0)).alias("avg_dscr"), F.coalesce("min_dscr", F.lit(0.0)).alias("min_dscr"), ratio("_noi1", "cost_basis").alias("yield_on_cost"))


def cash_on_cash(scenarios: DataFrame, years: DataFrame) -> DataFrame:
    return years.hint("merge").join(scenarios.select(KEY, F.greatest(F.lit(0.0), F.col("cost_basis") - F.col("principal")).alias("equity")), KEY).select(KEY, "year", F.coalesce(F.expr("try_divide(levered_cf, equity)"), F.lit(0.0)).alias("cash_on_cash"))


def roster_totals(roster: DataFrame) -> DataFrame:
    """Units, area and rents of a unit roster, weighted by unit counts."""
    c = F.col
    total = lambda x: F.sum(c("unit_count") * c(x))
    return roster.groupBy(KEY).agg(
        F.sum("unit_count").alias("units"), total("avg_sf").alias("square_feet"), total("rent").alias("monthly_rent"), (total("rent") * 12).alias("annual_rent"), F.expr("try_divide(sum(unit_count * rent), sum(unit_count))").alias("avg_rent"),
        F.expr("try_divide(sum(unit_count * rent), sum(unit_count * avg_sf))").alias("rent_psf"),
    )
