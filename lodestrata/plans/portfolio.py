"""Queries over the operational store, text functions, usage and access."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import labels
from ..functions import text as tx
from ..operators import matching
from ..operators import portfolio as po
from ..sources import surrogates as src
from .registry import query
from .warehouse import rounded


def t(spark, d, n):
    return src.table(spark, d, n)


@query("jn10_review_queue", """with o as (select document_id, count(case when not is_subtotal and category = 'income' then 1 end)::bigint as income_items, sum(case when not is_subtotal and category = 'income' then amount::decimal(18,2) end)::double as income_total,
 count(case when not is_subtotal and category = 'expense' then 1 end)::bigint as expense_items, sum(case when not is_subtotal and category = 'expense' then amount::decimal(18,2) end)::double as expense_total, count(*)::bigint as opstat_items from opstat group by 1),
 docs2 as (select distinct document_id, property_id from opstat union select 'none:' || s_suppkey, s_suppkey from supplier), c as (select document_id, count(*)::bigint as clauses from opstat where page_number > 45 group by 1), g as (select document_id, count(*)::bigint as gl_entries from opstat where is_total group by 1)
 select document_id, property_id, coalesce(income_items, 0)::bigint as income_items, coalesce(income_total, 0) as income_total, coalesce(expense_items, 0)::bigint as expense_items, coalesce(expense_total, 0) as expense_total, coalesce(opstat_items, 0)::bigint as opstat_items,
 coalesce(clauses, 0)::bigint as clauses, coalesce(gl_entries, 0)::bigint as gl_entries from docs2 left join o using (document_id) left join c using (document_id) left join g using (document_id)""")
def jn10(spark, d):
    o = src.opstat(spark, d)
    docs = o.select("document_id", "property_id").union(t(spark, d, "supplier").select(F.concat(F.lit("none:"), "s_suppkey"), "s_suppkey")).distinct()
    return po.review_queue(docs, o, {"clauses": o.filter("page_number > 45"), "gl_entries": o.filter("is_total")})


@query("agg17_review_stats", "select coalesce(s.status, c.status) as status, coalesce(n, 0)::bigint as n from (select unnest(['pending', 'approved', 'flagged']) as status) s full join (select coalesce(review_status, 'pending') as status, count(*) as n from docs group by 1) c on s.status = c.status")
def agg17(spark, d):
    return po.review_stats(src.documents(spark, d), "review_status")


@query("agg14_operations_summary", """select property_id, count(*)::bigint as total_units, sum((status = 'occupied')::int)::bigint as occupied, sum((status = 'vacant')::int)::bigint as vacant, sum(square_footage) as total_sqft, round(sum(current_rent), 2) as monthly_rent,
 round(avg(current_rent), 4) as avg_rent, round(sum((status = 'occupied')::int) / count(*) * 100, 1) as occupancy_rate from units group by 1""")
def agg14(spark, d):
    return rounded(rounded(po.operations_summary(src.units(spark, d)), "monthly_rent", places=2), "avg_rent", places=4)


@query("agg15_valuation_summary", """select *, round(noi / nullif(annual_debt_service, 0), 6) as dscr, round(noi / price * 100, 6) as cap_rate from (select property_id, total_revenue, total_expenses, round(total_revenue - total_expenses, 2) as noi, s_acctbal as price, case when property_id % 3 > 0 then 1000.0::double * (property_id % 3) else 0 end as annual_debt_service from
 (select property_id, coalesce(sum(case when category = 'income' and not is_subtotal and not is_total then amount::decimal(18,2) end), 0)::double as total_revenue, coalesce(sum(case when category = 'expense' and not is_subtotal and not is_total then amount::decimal(18,2) end), 0)::double as total_expenses
 from opstat group by 1) left join supplier on property_id = s_suppkey)""")
def agg15(spark, d):
    s = t(spark, d, "supplier")
    debt = s.selectExpr("s_suppkey as property_id", "case when s_suppkey % 3 > 0 then 1000D * (s_suppkey % 3) else 0D end as annual_debt_service")
    return rounded(po.valuation_summary(src.opstat(spark, d), debt, s.selectExpr("s_suppkey as property_id", "s_acctbal as price")), "dscr", "cap_rate")


@query("jn07_properties_without_documents", "select property_id, market from property where property_id not in (select property_id from docs where property_id is not null)")
def jn07(spark, d):
    return po.without(src.properties(spark, d), src.documents(spark, d), "property_id").select("property_id", "market")


@query("jn09_hierarchy_counts", """select property_id, market, coalesce(n_docs, 0)::bigint as documents, coalesce(n_sales, 0)::bigint as sales from property left join (select property_id, count(*) as n_docs from docs group by 1) using (property_id)
 left join (select property_id, count(*) as n_sales from sales group by 1) using (property_id)""")
def jn09(spark, d):
    return po.with_counts(src.properties(spark, d).select("property_id", "market"), "property_id", documents=src.documents(spark, d), sales=t(spark, d, "lineitem").select(F.col("l_partkey").alias("property_id")))


@query("jn11_expiring_leases", """select unit, n_name, lease_exp from leases join supplier on unit % 100 = s_suppkey join nation on s_nationkey = n_nationkey where lease_exp between date '1999-01-01' and date '1999-04-01'""")
def jn11(spark, d):
    rows = po.expiring(src.leases(spark, d).withColumnRenamed("lease_exp", "lease_end"), date(1999, 1, 1))
    return rows.join(t(spark, d, "supplier"), F.col("unit") % 100 == F.col("s_suppkey")).join(t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("unit", "n_name", F.col("lease_end").alias("lease_exp"))


@query("jn12_rent_roll_units", "select l.property_id, l.unit, l.lease_start, coalesce(l.effective_rent, u.current_rent) as rent, u.square_footage, u.status from leases l left join units u on l.property_id = u.property_id and l.unit = u.unit_number and u.status = 'vacant'")
def jn12(spark, d):
    u = src.units(spark, d).filter("status = 'vacant'").select("property_id", F.col("unit_number").alias("unit"), "current_rent", "square_footage", "status")
    return src.leases(spark, d).join(u, ["property_id", "unit"], "left").select("property_id", "unit", "lease_start", F.coalesce("effective_rent", "current_rent").alias("rent"), "square_footage", "status")


@query("snk11_link_by_name", "select c_custkey, coalesce(case when c_custkey % 3 = 0 then c_custkey end, p.id) as property_id from customer left join (select lower(p_name) as n, min(p_partkey) as id from part group by 1) p on (select lower(p_name) from part where p_partkey = c_custkey) = p.n")
def snk11(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    docs = t(spark, d, "customer").join(p, F.col("c_custkey") == F.col("id"), "left").select("c_custkey", F.upper("name").alias("property_name"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey")).alias("property_id"))
    return po.link_by_name(docs, p).select("c_custkey", "property_id")


@query("agg20_corrections", """select l_shipmode as term_type, total, corrected, documents, round(corrected / total * 100, 1) as rate from (select l_returnflag as l_shipmode, count(*)::bigint as total, count(case when l_quantity > 40 then 1 end)::bigint as corrected, count(distinct case when l_quantity > 40 then l_orderkey end)::bigint as documents from lineitem group by 1)""")
def agg20(spark, d):
    rows = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("term_type"), F.col("l_orderkey").alias("document_id"), F.when(F.col("l_quantity") > 40, F.col("l_quantity")).alias("user_value"))
    return po.corrections(rows)


@query("tx17_search_like", """select 'property' as category, property_id::varchar as id from (select * from property where contains(lower(property_name), 're') or contains(lower(address), 're') order by property_id::varchar limit 50)
 union all select 'document', document_id::varchar from (select * from docs where contains(lower(filename), 're') or contains(lower(text), 're') order by document_id::varchar limit 50) union all select 'owner', c_custkey::varchar from customer where contains(lower(c_mktsegment), 're') and false""")
def tx17(spark, d):
    return po.search_like({"property": (src.properties(spark, d), "property_id", ["property_name", "address"]), "document": (src.documents(spark, d), "document_id", ["filename", "text"]), "owner": (t(spark, d, "customer"), "c_custkey", ["c_name"])}, "RE")


@query("set02_union_names", "select p_name as name from part union select c_name from customer union select s_name from supplier")
def set02(spark, d):
    return t(spark, d, "part").select(F.col("p_name").alias("name")).union(t(spark, d, "customer").select("c_name")).union(t(spark, d, "supplier").select("s_name")).distinct()


@query("set03_distinct", "select distinct market, building_class from property")
def set03(spark, d):
    return src.properties(spark, d).select("market", "building_class").distinct()


@query("jn08_exists", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)")
def jn08(spark, d):
    big = t(spark, d, "orders").filter("o_totalprice > 400000")
    return t(spark, d, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("jn16_scalar_subquery", "select o_orderkey, o_orderdate::date as o_orderdate from orders where o_orderdate = (select max(o_orderdate) from orders)")
def jn16(spark, d):
    o = t(spark, d, "orders")
    return o.join(F.broadcast(o.agg(F.max("o_orderdate").alias("o_orderdate"))), "o_orderdate").select("o_orderkey", F.to_date("o_orderdate").alias("o_orderdate"))


@query("jn24_full_outer", "select coalesce(a.k, b.k) as k, a.n as exposure, b.n as total from (select o_custkey % 50 as k, count(*)::bigint as n from orders where o_orderstatus = 'P' group by 1) a full join (select c_custkey % 60 as k, count(*)::bigint as n from customer group by 1) b on a.k = b.k")
def jn24(spark, d):
    a = t(spark, d, "orders").filter("o_orderstatus = 'P'").groupBy((F.col("o_custkey") % 50).alias("k")).agg(F.count("*").alias("exposure"))
    b = t(spark, d, "customer").groupBy((F.col("c_custkey") % 60).alias("k")).agg(F.count("*").alias("total"))
    return a.join(b, "k", "full")


@query("agg23_monthly_usage", """select org_id, strftime(created_at, '%Y-%m') as period, count(*)::bigint as actions, sum(page_count)::bigint as pages, count(case when not success then 1 end)::bigint as failures, round(sum(processing_time), 4) as seconds, count(distinct user_id)::bigint as users from usage_log group by 1, 2""")
def agg23(spark, d):
    return rounded(po.monthly_usage(src.usage_log(spark, d)), "seconds", places=4)


@query("st03_rate_limit", """select event_id, in_window, in_window <= 3 as allowed from (select event_id, count(*) over (partition by org_id order by epoch(created_at)::bigint range between 3599 preceding and current row)::bigint as in_window from (select * replace (date_trunc('second', created_at) as created_at) from usage_log))""")
def st03(spark, d):
    return po.rate_limit(src.usage_log(spark, d), 3600, 3).select("event_id", "in_window", "allowed")


@query("st05_over_limit", "select org_id, strftime(created_at, '%Y-%m') as period, sum(page_count)::bigint as pages, sum(page_count) > 30000 as over from usage_log group by 1, 2")
def st05(spark, d):
    plans = spark.range(7).selectExpr("id as org_id", "30000L as page_limit")
    return po.over_limit(po.monthly_usage(src.usage_log(spark, d)), plans).select("org_id", "period", "pages", "over")


ROLES = {"admin": {"documents": "edit", "extraction": "edit"}, "analyst": {"documents": "edit", "extraction": "read"}, "viewer": {"documents": "read", "extraction": "none"}}


@query("rbac_permissions", """select s_suppkey as user_id, scope, level, case level when 'edit' then 2 when 'read' then 1 else 0 end >= 1 as allowed from (select s_suppkey, scope, case when scope = 'extraction' and s_suppkey % 5 = 0 then 'edit' when role = 'admin' then 'edit'
 when role = 'analyst' then case scope when 'documents' then 'edit' else 'read' end else case scope when 'documents' then 'read' else 'none' end end as level
 from (select s_suppkey, case s_suppkey % 4 when 0 then 'admin' when 1 then 'analyst' else 'viewer' end as role from supplier), (select unnest(['documents', 'extraction']) as scope))""")
def rbac(spark, d):
    users = t(spark, d, "supplier").selectExpr("s_suppkey as user_id", "case s_suppkey % 4 when 0 then 'admin' when 1 then 'analyst' when 2 then 'ghost' end as role_template", "if(s_suppkey % 5 = 0, map('extraction', 'edit', 'documents', 'bogus'), map('nowhere', 'edit')) as overrides")
    return po.allowed(po.permissions(users, ROLES), "read").select("user_id", "scope", "level", "allowed")


def _match_sides(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat(F.col("p_size").cast("string"), F.lit(" Main St")).alias("address"), F.col("p_brand").alias("city"), F.substring("p_type", 1, 2).alias("state"))
    return p.withColumn("name", F.concat("name", F.lit(" LLC"))), p


@query("jn19_match_properties")
def jn19(spark, d):
    return po.match_properties(*_match_sides(spark, d))


_BAG = "list_transform(string_split('abcdefghijklmnopqrstuvwxyz0123456789 ', ''), lambda c: length(s) - length(replace(s, c, '')))"
_COMMON = "list_sum(list_transform(list_zip(a.bag, b.bag), lambda x: least(x[1], x[2]))) + least(a.n - list_sum(a.bag), b.n - list_sum(b.bag))"


@query("jn19_candidates", f"""with p as (select p_partkey as id, lower(p_name) as name, p_size || ' main st' as addr, p_size as no, lower(p_brand) as city, lower(substr(p_type, 1, 2)) as state from part),
 s as (select s, length(s) as n, {_BAG} as bag from (select name as s from p union select addr from p union select city from p)),
 name as (select a.s as x, b.s as y, case when c >= least(a.n, b.n) then greatest(r, 0.85) else r end as v from (select a, b, {_COMMON} as c, 2 * ({_COMMON})::double / (a.n + b.n) as r from s a, s b where a.s in (select name from p) and b.s in (select name from p))),
 addr as (select a.s as x, b.s as y, 2 * ({_COMMON})::double / (a.n + b.n) as v from s a, s b where a.s in (select addr from p) and b.s in (select addr from p)),
 city as (select a.s as x, b.s as y, 2 * ({_COMMON})::double / (a.n + b.n) as v from s a, s b where a.s in (select city from p) and b.s in (select city from p))
 select a.id as did, b.id as pid, round(0.5 * name.v + 0.3 * case when a.no = b.no then greatest(addr.v, 0.6) else addr.v end + 0.12 * city.v + 0.08 * (a.state = b.state)::int, 6) as score
 from name join p a on a.name = name.x join p b on b.name = name.y join addr on addr.x = a.addr and addr.y = b.addr join city on city.x = a.city and city.y = b.city
 where 0.5 * name.v + 0.3 * case when a.no = b.no then greatest(addr.v, 0.6) else addr.v end + 0.12 * city.v + 0.08 * (a.state = b.state)::int + 0.0005 >= 0.95""")
def jn19_candidates(spark, d):
    return rounded(matching.candidates(*_match_sides(spark, d), 0.95), "score")


@query("jn20_containment", """with a as (select c_custkey as id, lower(trim(case when c_custkey % 3 = 0 then n_name when c_custkey % 3 = 1 then 'the ' || n_name || ' ' || c_mktsegment else c_mktsegment end)) as x from customer join nation on c_nationkey = n_nationkey),
 b as (select y, min(rid) as rid from (select n_nationkey as rid, lower(trim(n_name)) as y from nation union all select 100 + r_regionkey, lower(trim(r_name)) from region) group by y),
 exact as (select id, min(rid) as matched from a join b on x = y group by id),
 near as (select id, rid, row_number() over (partition by id order by least(length(x), length(y)) desc, rid) as n from a join b on contains(x, y) and length(y) >= 4 or contains(y, x) and length(x) >= 4 where id not in (select id from exact))
 select id, matched, 'exact' as how from exact union all select id, rid, 'contains' from near where n = 1""")
def jn20(spark, d):
    name = F.expr("case c_custkey % 3 when 0 then n_name when 1 then concat('the ', n_name, ' ', c_mktsegment) else c_mktsegment end")
    left = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), name.alias("name"))
    right = t(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).union(t(spark, d, "region").select(F.col("r_regionkey") + 100, "r_name"))
    return po.containment_match(left, right)


@query("sc16_similarity")
def sc16(spark, d):
    """Names of parts against the next part's."""
    p = t(spark, d, "part").select("p_partkey", "p_name")
    other = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next_name"))
    return p.join(other, "p_partkey").select("p_partkey", F.round(po.similarity("p_name", "next_name"), 6).alias("similarity"))


@query("tx01_filename_classifier", """select doc_id, case when f like '%rent_roll%' then 'rent_roll' when f like '%promissory note%' then 'loan' when f like '%guaranty%' then 'guarantee' when f like '%settlement-statement%' then 'closing' end as document_type,
 case when f like '%rent_roll%' then 0.92 when f like '%promissory note%' then 0.9 when f like '%guaranty%' then 0.9 when f like '%settlement-statement%' then 0.9 end::double as confidence from
 (select doc_id, case doc_id % 6 when 0 then 'q_rent_roll.pdf' when 1 then 'promissory note.pdf' when 2 then 'guaranty.doc' when 3 then 'settlement-statement.pdf' else 'other.txt' end as f from documents)""")
def tx01(spark, d):
    name = F.expr("case doc_id % 6 when 0 then 'Q_Rent_Roll.pdf' when 1 then 'Promissory Note.pdf' when 2 then 'Guaranty.doc' when 3 then 'settlement-statement.pdf' else 'other.txt' end")
    return t(spark, d, "documents").select("doc_id", labels.type_of_filename(name).alias("f")).select("doc_id", "f.document_type", "f.confidence")


@query("tx01_filenames_of_documents")
def tx01_documents(spark, d):
    return src.documents(spark, d).select("document_id", labels.type_of_filename(F.col("filename")).alias("f")).select("document_id", "f.document_type", "f.confidence")


@query("tx02_keywords_of_documents")
def tx02_documents(spark, d):
    return labels.type_of_text(src.documents(spark, d), "document_id", "text")


_SENTENCES = ("this lease agreement between landlord and tenant sets the base rent", "promissory note of the borrower to the lender with maturity date", "net operating income and total expenses", "general ledger debit credit", "")


@query("tx02_keyword_classifier", """select doc_id, case doc_id % 5 when 0 then 'lease' when 1 then 'loan' when 2 then 'operating_statement' when 3 then 'general_ledger' else 'unknown' end as document_type,
 case doc_id % 5 when 0 then least(1.0, 2 * 12.0::double / 14) when 1 then least(1.0, 2 * 12.0::double / 18) when 2 then least(1.0, 2 * 6.0::double / 22) when 3 then least(1.0, 2 * 9.0::double / 11) else 0.0 end::double as confidence from documents""")
def tx02(spark, d):
    text = F.get(F.array(*map(F.lit, _SENTENCES)), (F.col("doc_id") % 5).cast("int"))
    return labels.type_of_text(t(spark, d, "documents").select("doc_id", text.alias("text")), "doc_id", "text")


@query("sc20_line_labels", """select p_partkey, case p_size % 6 when 0 then 'gross_potential_rent' when 1 then null when 2 then null when 3 then 'payroll' when 4 then 'other' end as category, case p_size % 6 when 0 then 'explicit' when 1 then 'subtotal' when 2 then 'skip' when 3 then 'pattern' when 4 then 'unknown' else 'skip' end as method from part""")
def sc20(spark, d):
    label = F.expr("case p_size % 6 when 0 then ' Gross Potential Rent ' when 1 then 'TOTAL INCOME' when 2 then 'Accrual' when 3 then 'Regional PAYROLL cost' when 4 then 'Something else' end")
    return labels.classify_labels(t(spark, d, "part").select("p_partkey", label.alias("line")), "line").select("p_partkey", "category", "method")


@query("sc05_dates", """select p_partkey, case p_size % 4 when 0 then date '2024-03-05' when 1 then date '2024-12-31' when 2 then date '2024-01-02' end as parsed, case when p_size % 13 between 1 and 12 then make_date(case when p_size + 40 >= 80 then 1940 + p_size else 2040 + p_size end::bigint, (p_size % 13)::bigint, 1::bigint) end as month from part""")
def sc05(spark, d):
    text = F.expr("case p_size % 4 when 0 then '2024-03-05' when 1 then '12/31/2024' when 2 then '1/2/24' else 'n/a' end")
    return t(spark, d, "part").select("p_partkey", tx.parse_date(text).alias("parsed"), tx.month_year(F.concat((F.col("p_size") % 13).cast("string"), F.lit("/"), (F.col("p_size") + 40).cast("string"))).alias("month"))


@query("sc12_numbers", """select p_partkey, case p_size % 4 when 0 then p_retailprice when 1 then -p_size::double when 2 then p_size::double end as value from part""")
def sc12(spark, d):
    text = F.expr("case p_size % 4 when 0 then concat('$ ', format_number(p_retailprice, 2)) when 1 then concat('(', p_size, '.00)') when 2 then concat(p_size, '%') else 'n/a' end")
    return t(spark, d, "part").select("p_partkey", tx.number(text).alias("value"))


@query("sc15_names", """select p_partkey, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) as name, replace(p_name, ' ', '-') as slug from part""")
def sc15(spark, d):
    return t(spark, d, "part").select("p_partkey", tx.normal_name(F.concat(F.lit("The "), F.upper("p_name"), F.lit(", LLC"))).alias("name"), tx.slug(F.concat(F.lit("  "), "p_name", F.lit("!"))).alias("slug"))


@query("sc28_payment", "select p_partkey, round(p_retailprice * (0.06::double / 12) / (1 - (1 + 0.06::double / 12) ** (-p_size)) + 1e-7, 4) as payment from part")
def sc28(spark, d):
    from ..operators.proforma import payment

    return t(spark, d, "part").select("p_partkey", F.round(payment(F.col("p_retailprice"), F.lit(0.06), F.col("p_size")) + 1e-7, 4).alias("payment"))


@query("win04_best_per_key", "select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as n from orders) where n = 1")
def win04(spark, d):
    return labels.best_per_key(t(spark, d, "orders"), ["o_custkey"], F.desc("o_totalprice"), F.col("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


@query("win08_forward_fill", "select event_id, last_value(case when event_type = 'click' then value end ignore nulls) over (partition by user_id order by ts, event_id) as filled from events")
def win08(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t(spark, d, "events").select("event_id", F.last(F.when(F.col("event_type") == "click", F.col("value")), True).over(w).alias("filled"))


@query("win10_islands", """select user_id, island, count(*)::bigint as n from (select user_id, sum(fresh) over (partition by user_id order by ts, event_id)::bigint as island from (select *, case when coalesce(event_type <> lag(event_type) over (partition by user_id order by ts, event_id), true) then 1 else 0 end as fresh from events)) group by 1, 2""")
def win10(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    fresh = F.when(F.coalesce(F.col("event_type") != F.lag("event_type").over(w), F.lit(True)), 1).otherwise(0)
    return t(spark, d, "events").withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w)).groupBy("user_id", "island").agg(F.count("*").alias("n"))


@query("win09_section_end", "select doc_id, pos, coalesce(lead(pos) over (partition by doc_id order by pos) - 1, n) as ending from (select doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) as pos, unnest(string_split(text, chr(10))) as line, len(string_split(text, chr(10))) as n from documents) where length(line) < 40")
def win09(spark, d):
    rows = t(spark, d, "documents").select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n"), F.posexplode(F.split("text", "\n")).alias("p", "line")).filter(F.length("line") < 40).withColumn("pos", (F.col("p") + 1).cast("long"))
    return rows.select("doc_id", "pos", F.coalesce(F.lead("pos").over(Window.partitionBy("doc_id").orderBy("pos")) - 1, "n").alias("ending"))


@query("src17_duplicate_skip", "select doc_id, sha256(text) as hash from (select *, row_number() over (partition by sha256(text) order by doc_id) as n from documents) where n = 1")
def src17(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return labels.best_per_key(docs, ["hash"], F.col("doc_id"))


@query("agg22_opex_rollup", "select period, line_item, round(sum(amount), 2) as total from opstat where category = 'expense' group by rollup (period, line_item)")
def agg22(spark, d):
    return src.opstat(spark, d).filter("category = 'expense'").rollup("period", "line_item").agg(F.round(F.sum("amount"), 2).alias("total"))


@query("agg18_dashboard", """select (select count(*) from property)::bigint as properties, (select count(distinct market) from property)::bigint as markets, (select count(*) from docs)::bigint as documents, (select count(*) from docs where review_status = 'pending')::bigint as pending,
 (select count(*) from units where status = 'occupied')::bigint as occupied, (select count(*) from usage_log where not success)::bigint as failures""")
def agg18(spark, d):
    one = [
        src.properties(spark, d).agg(F.count("*").alias("properties"), F.count_distinct("market").alias("markets")), src.documents(spark, d).agg(F.count("*").alias("documents"), F.count(F.when(F.col("review_status") == "pending", 1)).alias("pending")),
        src.units(spark, d).agg(F.count(F.when(F.col("status") == "occupied", 1)).alias("occupied")), src.usage_log(spark, d).agg(F.count(F.when(~F.col("success"), 1)).alias("failures")),
    ]
    out = one[0]
    for other in one[1:]:
        out = out.crossJoin(F.broadcast(other))  # one row each
    return out


@query("snk06_upsert", "select coalesce(a.k, b.k) as k, coalesce(b.v, a.v) as v from (select p_partkey as k, p_size as v from part where p_partkey % 2 = 0) a full join (select p_partkey as k, case when p_size > 25 then p_size * 2 end as v from part where p_partkey % 3 = 0) b using (k)")
def snk06(spark, d):
    from ..sources.warehouse import upsert

    p = t(spark, d, "part")
    return upsert(p.filter("p_partkey % 2 = 0").selectExpr("p_partkey as k", "p_size as v"), p.filter("p_partkey % 3 = 0").selectExpr("p_partkey as k", "if(p_size > 25, p_size * 2, null) as v"), ["k"])


@query("flt05_as_of_latest", "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders where o_orderdate <= timestamp '1998-06-30') where n = 1")
def flt05(spark, d):
    from ..sources.warehouse import as_of_latest

    return as_of_latest(t(spark, d, "orders"), ["o_custkey"], "o_orderdate", "1998-06-30", "o_orderkey").select("o_custkey", "o_orderkey")


@query("sc17_snippet")
def sc17(spark, d):
    return t(spark, d, "documents").select("doc_id", tx.snippet(F.col("text"), "the").alias("snippet"))


@query("tx16_full_text_search", """with d as (select doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9à-öø-ÿß]+'), lambda w: w <> '') as ws from documents), p as (select doc_id, len(ws) as n, len(list_filter(ws, lambda w: w = 'the')) as a, len(list_filter(ws, lambda w: w = 'erer')) as b from d),
 s as (select count(*) as total, avg(n) as mean, count(case when a > 0 then 1 end) as da, count(case when b > 0 then 1 end) as db from p),
 r as (select doc_id, case when a > 0 then ln(1 + (total - da + 0.5) / (da + 0.5)) * a * 2.2::double / (a + 1.2::double * (0.25::double + 0.75::double * n / mean)) else 0 end + case when b > 0 then ln(1 + (total - db + 0.5) / (db + 0.5)) * b * 2.2::double / (b + 1.2::double * (0.25::double + 0.75::double * n / mean)) else 0 end as score from p, s where a > 0 or b > 0)
 select doc_id, round(score, 6) as score from r order by round(score, 9) desc, doc_id limit 20""")
def tx16(spark, d):
    from ..operators.search import search

    return rounded(search(t(spark, d, "documents"), "The erer", limit=20, stem=False), "score")


@query("tx16_index_search", """with d as (select doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9à-öø-ÿß]+'), lambda w: w <> '') as ws from documents),
 p as (select doc_id, len(ws) as n, len(list_filter(ws, lambda w: w = 'on')) as a, len(list_filter(range(1, len(ws)), lambda i: ws[i] = 'the' and ws[i + 1] = 'and')) as b, len(list_filter(ws, lambda w: w = 'the')) as t, len(list_filter(ws, lambda w: w = 'and')) as u,
  list_filter(ws, lambda w: starts_with(w, 'eren')) as pre, len(list_filter(ws, lambda w: w = 'is')) as x from d),
 s as (select count(*) as total, avg(n) as mean, count(case when a > 0 then 1 end) as da, count(case when t > 0 then 1 end) as dt, count(case when u > 0 then 1 end) as du from p),
 e as (select doc_id, w, count(*) as f from (select doc_id, unnest(pre) as w from p) group by all), ew as (select w, count(*) as dw from e group by w),
 es as (select doc_id, sum(ln(1 + (total - dw + 0.5) / (dw + 0.5)) * f * 2.2::double / (f + 1.2::double * (0.25::double + 0.75::double * n / mean))) as v from e join ew using (w) join p using (doc_id), s group by doc_id),
 r as (select doc_id, ln(1 + (total - da + 0.5) / (da + 0.5)) * a * 2.2::double / (a + 1.2::double * (0.25::double + 0.75::double * n / mean))
  + (ln(1 + (total - dt + 0.5) / (dt + 0.5)) + ln(1 + (total - du + 0.5) / (du + 0.5))) * b * 2.2::double / (b + 1.2::double * (0.25::double + 0.75::double * n / mean)) + coalesce(v, 0) as score
  from p left join es using (doc_id), s where a > 0 and b > 0 and x = 0)
 select doc_id, round(score, 6) as score from r order by round(score, 9) desc, doc_id limit 20""")
def tx16_index(spark, d):
    """All documents are indexed; the question reads the index."""
    from ..operators import textindex
    from .loads import folder

    path = folder(spark)
    textindex.build(t(spark, d, "documents"), path, stem=False)
    return rounded(textindex.search(spark, path, must=("on", "the and"), may=("eren*",), never=("is",), limit=20, stem=False).withColumnRenamed("doc", "doc_id"), "score")
