"""Queries of smaller reads and of the operational store's states."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import portfolio as po
from ..operators import proforma, scorecard
from ..sources import surrogates as src
from ..sources.surrogates import table as t
from .registry import query

_NAMES = "case p_size % 7 when 0 then 'Studio' when 1 then 'ALCOVE - affordable' when 2 then '1 Bedroom Vintage Affordable' when 3 then '2BR new affordable' when 4 then '3-bedroom' when 5 then '2-bedroom' else 'Loft' end"


@query("sc26_unit_names", """select p_partkey, case p_size % 7 when 0 then 'Studio' when 1 then 'Alcove' when 2 then '1 Bedroom' when 3 then '2 Bedroom' when 4 then '3 Bedroom' else 'Other' end as bedrooms,
 case p_size % 7 when 1 then 'affordable_lihtc' when 2 then 'affordable_vintage' when 3 then 'new_affordable' else 'market' end as affordability from part""")
def sc26(spark, d):
    return t(spark, d, "part").selectExpr("p_partkey", f"{_NAMES} as name").select("p_partkey", tx.bedrooms(F.col("name")).alias("bedrooms"), tx.affordability(F.col("name")).alias("affordability"))


@query("sc27_column_letters", """select p_partkey, case when p_partkey % 900 + 1 <= 26 then chr((65 + p_partkey % 900)::int) when p_partkey % 900 + 1 <= 702 then chr((64 + (p_partkey % 900) // 26)::int) || chr((65 + p_partkey % 900 % 26)::int)
 else chr((64 + ((p_partkey % 900) // 26 - 1) // 26)::int) || chr((65 + ((p_partkey % 900) // 26 - 1) % 26)::int) || chr((65 + p_partkey % 900 % 26)::int) end as letters from part""")
def sc27(spark, d):
    return t(spark, d, "part").select("p_partkey", tx.column_letter(F.col("p_partkey") % 900 + 1).alias("letters"))


@query("sc32_json_salvage", """select p_partkey, case p_size % 4 when 0 then '[{"n": ' || p_size || '}]' when 1 then '{"n": {"m": ' || p_size || '}}' when 2 then '{"k": ' || p_size || '}' end as part from part""")
def sc32(spark, d):
    made = """case p_size % 4 when 0 then concat('Sure: [{"n": ', p_size, '}] and {') when 1 then concat('x {"n": {"m": ', p_size, '}} }') when 2 then concat('[not json] {"k": ', p_size, '}') else 'none [ here' end"""
    return t(spark, d, "part").selectExpr("p_partkey", f"{made} as text").select("p_partkey", tx.json_part("text").alias("part"))


@query("sc31_json", "select p_partkey, p_size as n, p_name as name from part")
def sc31(spark, d):
    held = t(spark, d, "part").select("p_partkey", F.to_json(F.struct("p_size", "p_name")).alias("j"))
    return held.select("p_partkey", F.from_json("j", "p_size int, p_name string").alias("s")).select("p_partkey", F.col("s.p_size").alias("n"), F.col("s.p_name").alias("name"))


@query("agg10_market_volume", """select market, sale_year, deals, total_volume from (select market, sale_year, count(*) as deals, sum(sale_price::decimal(18, 2))::double as total_volume, row_number() over (partition by market order by sale_year desc) as n
 from sales where sale_price is not null group by market, sale_year) where n <= 3""")
def agg10(spark, d):
    return scorecard.market_volume(src.sales(spark, d), 3)


_DOCS = "select document_id, case document_id % 4 when 0 then 'loan' when 1 then 'closing' when 2 then 'guarantee' else 'lease' end as document_type, filename, property_id, review_status from docs"


def _docs(spark, d):
    kind = "case document_id % 4 when 0 then 'loan' when 1 then 'closing' when 2 then 'guarantee' else 'lease' end as document_type"
    return src.documents(spark, d).selectExpr("document_id", kind, "filename", "property_id", "review_status")


@query("agg16_debt_summary", f"""select property_id, 'loan_terms' as bucket, document_id, 'amount' as item from ({_DOCS}) where document_type in ('loan', 'closing') union all
 select property_id, 'loan_clauses', document_id, 'remedies' from ({_DOCS}) where document_type in ('loan', 'guarantee') and document_id % 3 = 0 union all select property_id, 'guarantees', document_id, filename from ({_DOCS}) where document_type = 'guarantee'""")
def agg16(spark, d):
    docs = _docs(spark, d)
    terms = docs.select("document_id", F.lit("amount").alias("term_type"))
    return po.debt_summary(terms, docs.filter("document_id % 3 = 0").select("document_id", F.lit("remedies").alias("clause_type")), docs)


@query("agg21_search_stats", "select 'documents' as name, (select count(*) from documents) as n union all select 'units', (select count(*) from part) union all select 'usage', (select count(*) from events)")
def agg21(spark, d):
    return po.counted({"documents": t(spark, d, "documents"), "units": t(spark, d, "part"), "usage": t(spark, d, "events")})


@query("flt15_recent_activity", "select event_id, user_id from events where ts >= (select max(ts) from events) - interval 3 days")
def flt15(spark, d):
    events = t(spark, d, "events")
    held = events.join(F.broadcast(events.agg(F.max("ts").alias("now"))))  # one row
    return po.recent(held, "ts", F.col("now"), 3).select("event_id", "user_id")


@query("flt11_date_range", "select o_orderkey from orders where strftime(o_orderdate, '%Y-%m-%d') between '1996-01-01' and '1996-06-30'")
def flt11(spark, d):
    rows = t(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return rows.filter(F.col("day").between("1996-01-01", "1996-06-30")).select("o_orderkey")


@query("snk13_review_states", f"""select document_id, case when document_id % 3 = 0 then 'approved' when document_id % 3 = 1 then 'pending_review' else review_status end as review_status, case when document_id % 3 = 0 then 7 else property_id end::bigint as property_id from ({_DOCS})""")
def snk13(spark, d):
    docs = _docs(spark, d)
    rows = docs.filter("document_id % 3 < 2").selectExpr("document_id", "inline(array(named_struct('action', 'skip', 'at', 1), named_struct('action', if(document_id % 3 = 0, 'approve', 'reset'), 'at', 2)))")
    return po.reviewed(docs, rows.withColumn("property_id", F.lit(7).cast("long"))).select("document_id", "review_status", F.col("property_id").cast("long").alias("property_id"))


@query("snk14_run_log", "select o_custkey, max(o_orderkey) as run_id, case when max(o_orderkey) % 2 = 0 then 'completed' else 'failed' end as state from orders group by o_custkey")
def snk14(spark, d):
    log = t(spark, d, "orders").selectExpr("o_custkey", "o_orderkey as run_id", "inline(array(named_struct('state', 'started', 'at', 2 * o_orderkey), named_struct('state', if(o_orderkey % 2 = 0, 'completed', 'failed'), 'at', 2 * o_orderkey + 1)))")
    return po.latest_runs(log, ["o_custkey"]).select("o_custkey", "run_id", "state")


@query("rd05_rows_of_documents", f"select document_id, document_type, amount from (select document_id, document_type, document_id * 2 as amount from ({_DOCS})) where document_type = 'loan'")
def rd05(spark, d):
    docs = _docs(spark, d)
    return po.of_documents(docs.selectExpr("document_id", "document_id * 2 as amount"), docs, document_type="loan", property_id=None).select("document_id", "document_type", "amount")


@query("rd06_document_lists", f"select document_id from ({_DOCS}) where document_type = 'lease' and filename ilike '%en_1%' order by document_id desc limit 50")
def rd06(spark, d):
    return _docs(spark, d).filter((F.col("document_type") == "lease") & F.col("filename").ilike("%en_1%")).orderBy(F.desc("document_id")).limit(50).select("document_id")


@query("rd22_mode_dispatch", f"""select document_id, unnest(case document_type when 'loan' then ['terms', 'clauses'] when 'guarantee' then ['clauses'] when 'closing' then ['terms', 'clauses', 'table'] else [] end) as step from ({_DOCS})""")
def rd22(spark, d):
    return po.dispatched(_docs(spark, d), {"loan": ("dual",), "guarantee": ("legal",), "closing": ("financial", "legal", "tabular")})


@query("pf07_attorney_fees", "select p_partkey as scenario_id, 2024 + k as calendar_year, case when k = 1 then round(greatest(0, 1000 - 20 * p_size) * 0.25, 6) else 0 end::double as attorney_fee from part, (values (0), (1)) v(k)")
def pf07(spark, d):
    rows = t(spark, d, "part").selectExpr(f"p_partkey as {proforma.KEY}", "explode(array(2024, 2025)) as calendar_year", "20D * p_size as property_tax")
    found = proforma.attorney_fees(rows, rows.withColumn("property_tax", F.lit(1000.0)), [2025], 0.25)
    return found.select(F.col(proforma.KEY).alias("scenario_id"), "calendar_year", "attorney_fee")


@query("scd11_dispersion", """select p_partkey, case when p_size >= 25 then (p_size - 25) * m else (p_size - 25) / m end as tilted, (p_size - 25)::double as plain from (select *, least(2.0::double, greatest(0.5::double, 1 + 0.1::double * (p_size % 5 - 2))) as m from part)""")
def scd11(spark, d):
    rows = t(spark, d, "part").selectExpr("p_partkey", "p_size - 25D as score", "p_size % 5 - 2D as z")
    return rows.select("p_partkey", scorecard.dispersion(F.col("score"), F.col("z"), 0.1).alias("tilted"), scorecard.dispersion(F.col("score"), F.col("z")).alias("plain"))
