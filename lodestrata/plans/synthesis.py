"""Queries of financial synthesis."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import synthesis as fs
from ..sources import surrogates as src
from .registry import query
from .warehouse import rounded

YEAR = 1988  # twelve years on from here leaves the year 2001 out

_AUTH = "case document_type when 'operating_statement' then 4 else 0 end"
_D = "not is_subtotal and not is_total"
_MATCH = lambda a, b: f"case when {a} = {b} then true when {a} = 0 or {b} = 0 then false else abs({a} - {b}) / greatest(abs({a}), abs({b})) < 0.005 end"
_PERIODS = f"""it as (select * from opstat where substr(period, 1, 4)::int <= {YEAR + 12}),
prim as (select property_id, period, document_id as primary_doc from (select *, row_number() over (partition by property_id, period order by n desc, document_id) as r from
 (select property_id, period, document_id, count(*) as n from it where {_D} and category in ('income', 'expense') group by 1, 2, 3)) where r = 1),
tot as (select property_id, period, sum(case when category = 'income' then amount::decimal(18,2) end) as i, sum(case when category = 'expense' then amount::decimal(18,2) end) as e, count(case when category = 'income' then 1 end)::bigint as n_income,
 count(case when category = 'expense' then 1 end)::bigint as n_expense from it left join prim using (property_id, period) where {_D} and (primary_doc is null or document_id = primary_doc) group by 1, 2),
srcs as (select property_id, period, count(*)::bigint as source_count, max(a)::int as top_authority from (select property_id, period, document_id, max({_AUTH}) as a from it group by 1, 2, 3) group by 1, 2),
rep as (select property_id, period, amount::decimal(18,2)::double as r from it where not ({_D}) and contains(lower(line_item), 'net operating') and amount <> 0),
noi as (select property_id, period, count(*)::bigint as n_reported, min(r) as lo, max(r) as hi from rep group by 1, 2),
base as (select property_id, period, source_count, top_authority, primary_doc, coalesce(n_income, 0)::bigint as n_income, coalesce(n_expense, 0)::bigint as n_expense, coalesce(i, 0)::double as total_income, coalesce(e, 0)::double as total_expenses,
 round(coalesce(i, 0)::double - coalesce(e, 0)::double, 2) as calculated_noi, coalesce(n_reported, 0)::bigint as n_reported, lo, hi
 from srcs left join prim using (property_id, period) left join tot using (property_id, period) left join noi using (property_id, period)),
near as (select property_id, period, min((abs(r - calculated_noi), r))[2] as closest_noi from rep join base using (property_id, period) group by 1, 2),
per as (select property_id, period, source_count, top_authority, primary_doc, n_income, n_expense, total_income, total_expenses, calculated_noi, n_reported, closest_noi,
 case when total_income < 0 then 'low' when total_income > 0 and total_expenses > 0 and least(total_income, total_expenses) / greatest(total_income, total_expenses) < 0.1 then 'low' when n_income >= 3 and n_expense >= 3 then 'high'
 when (n_income >= 3 or n_expense >= 3) and total_income > 0 and total_expenses > 0 then 'high' when total_income > 0 and total_expenses > 0 and n_reported > 0 then 'medium' when (total_income > 0 or total_expenses > 0) and n_income + n_expense >= 3 then 'medium' else 'low' end as quality,
 coalesce(n_reported >= 2 and not ({_MATCH("lo", "hi")}), false) as noi_disagree, coalesce(n_reported > 0 and calculated_noi <> 0 and not ({_MATCH("closest_noi", "calculated_noi")}), false) as noi_differs
 from base left join near using (property_id, period))"""


def _periods(spark, d):
    return fs.synthesize(src.opstat(spark, d), YEAR)


@query("fs04_synthesis", f"with {_PERIODS} select * from per")
def fs04(spark, d):
    return _periods(spark, d)


@query("fs03_primary_document", f"with {_PERIODS} select property_id, period, primary_doc from prim")
def fs03(spark, d):
    return fs.primary_documents(fs.grouped(src.opstat(spark, d), YEAR)).select("property_id", "period", "primary_doc")


@query("fs10_noi_timeline", f"""with {_PERIODS} select property_id, period, calculated_noi, closest_noi, source_count, (row_number() over (partition by property_id order by substr(period, 1, 4), substr(period, 5)))::int as position
 from per where quality in ('high', 'medium')""")
def fs10(spark, d):
    return fs.noi_timeline(_periods(spark, d)).select("property_id", "period", "calculated_noi", "closest_noi", "source_count", "position")


@query("fs11_reconcile_lines", f"""with r as (select property_id, period, category, lower(trim(line_item)) as line, document_id, amount, first_value(amount) over w as a, first_value(document_id) over w as dd, row_number() over w as r from opstat where {_D}
 window w as (partition by property_id, period, category, lower(trim(line_item)) order by {_AUTH} desc, document_id, page_number, amount desc))
 select property_id, period, category, line, min(a) as amount, min(dd) as document_id, count(*)::bigint as reports, count(case when r > 1 and amount <> 0 and a <> 0 and not ({_MATCH("amount", "a")}) then 1 end)::bigint as alternates from r group by 1, 2, 3, 4""")
def fs11(spark, d):
    return fs.reconcile_lines(src.opstat(spark, d))


@query("fs13_compare_validated", f"""with {_PERIODS}, v as (select property_id, period, sum(amount::decimal(18,2))::double as validated_noi from opstat where category = 'noi' group by 1, 2)
 select property_id, period, calculated_noi, validated_noi, round(calculated_noi - validated_noi, 2) as diff, round((calculated_noi - validated_noi) / abs(validated_noi) * 100, 4) as diff_pct, {_MATCH("calculated_noi", "validated_noi")} as matches from per join v using (property_id, period)""")
def fs13(spark, d):
    validated = src.opstat(spark, d).filter("category = 'noi'").groupBy("property_id", "period").agg(F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("validated_noi"))
    return rounded(rounded(fs.compare_to_validated(_periods(spark, d), validated), "diff", places=2), "diff_pct", places=4)


@query("fs14_portfolio_comparison", f"""with {_PERIODS} select property_id, max(case when period = '1996A' then calculated_noi end) as "1996A", max(case when period = '1997A' then calculated_noi end) as "1997A", max(case when period = '1997B' then calculated_noi end) as "1997B" from per group by property_id""")
def fs14(spark, d):
    return fs.portfolio_comparison(_periods(spark, d), ["1996A", "1997A", "1997B"])


@query("fs15_cited_rollup", f"""select property_id, period, category, round(sum(amount), 2) as value, '[' || array_to_string(list_sort(list_distinct(list(document_id))), ', ') || ']' as documents from opstat where {_D} group by 1, 2, 3""")
def fs15(spark, d):
    rows = fs.cited_rollup(fs.cited(src.opstat(spark, d).filter("not is_subtotal and not is_total")))
    return rows.select("property_id", "period", "category", F.round("value", 2).alias("value"), F.concat(F.lit("["), F.array_join("documents", ", "), F.lit("]")).alias("documents"))


@query("fs17_source_reconcile", """with a as (select property_id, round(sum(amount::decimal(18,2))::double, 2) as v from opstat where category = 'income' group by 1), b as (select property_id, round(sum(amount::decimal(18,2))::double, 2) as v from opstat where category = 'expense' and is_total group by 1)
 select coalesce(a.property_id, b.property_id) as property_id, a.v as "first", b.v as "second", round(a.v - b.v, 2) as delta, round((a.v - b.v) / abs(b.v) * 100, 4) as delta_pct from a full join b using (property_id)""")
def fs17(spark, d):
    o = src.opstat(spark, d)
    total = lambda df: df.groupBy("property_id").agg(F.round(F.sum(F.col("amount").cast("decimal(18,2)")).cast("double"), 2).alias("v"))
    out = fs.reconcile_sources(total(o.filter("category = 'income'")), total(o.filter("category = 'expense' and is_total")), "property_id", "v")
    return rounded(rounded(out, "delta", places=2), "delta_pct", places=4)


@query("srt06_period_sort", """select period, substr(period, 1, 4)::int as year, case substr(period, 5) when 'A' then 0 when 'B' then 1 else 10 end as suffix_order, (case document_type when 'operating_statement' then 4 else 0 end)::int as authority, count(*)::bigint as n from opstat group by all""")
def srt06(spark, d):
    o = src.opstat(spark, d)
    c = F.col("period")
    return o.select("period", fs.period_year(c).alias("year"), fs.period_order(c).alias("suffix_order"), fs.authority(F.col("document_type")).alias("authority")).groupBy("period", "year", "suffix_order", "authority").agg(F.count("*").alias("n"))


@query("sc21_amounts_match", f"select o_orderkey, {_MATCH('o_totalprice', 'o_totalprice * (1 + (o_orderkey % 13 - 6) / 1000.0::double)')} as same from orders")
def sc21(spark, d):
    o = src.table(spark, d, "orders")
    a = F.col("o_totalprice")
    return o.select("o_orderkey", fs.amounts_match(a, a * (1 + (F.col("o_orderkey") % 13 - 6) / F.lit(1000.0))).alias("same"))
