"""Queries of the text functions and of extraction, over documents that are written from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import templates
from ..functions import text as tx
from ..operators import extract, search
from ..sources.surrogates import table as t
from .registry import query


def _part(spark, d, **made):
    return t(spark, d, "part").select("p_partkey", *[F.expr(sql).alias(name) for name, sql in made.items()])


@query("sc07_legal_dates", """select p_partkey, case p_size % 4 when 0 then '04/01/' || (1970 + p_size) when 1 then '03/' || lpad((1 + p_size % 28)::varchar, 2, '0') || '/1996' when 2 then '03/15/2010' end as parsed from part""")
def sc07(spark, d):
    made = "case p_size % 4 when 0 then concat('this first day of April, ', 1970 + p_size) when 1 then concat('March ', 1 + p_size % 28, ', 1996') when 2 then 'on 3/15/10' else 'soon' end"
    return _part(spark, d, text=made).select("p_partkey", tx.legal_date(F.col("text")).alias("parsed"))


@query("sc08_loan_terms", """select p_partkey, concat_ws(', ', case when p_size // 12 > 0 then (p_size // 12) || case when p_size // 12 = 1 then ' year' else ' years' end end,
 case when p_size % 12 > 0 then (p_size % 12) || case when p_size % 12 = 1 then ' month' else ' months' end end) as term from part""")
def sc08(spark, d):
    return _part(spark, d, months="p_size").select("p_partkey", tx.loan_term(F.col("months")).alias("term"))


_UNITS = ", ".join(f"'{w}'" for w in tx.UNITS)


@query("sc09_written_numbers", """select p_partkey, case p_size % 3 when 0 then (p_partkey % 20) * 1000000.0::double + 200 when 1 then (p_partkey % 20) + 0.26::double end as value from part""")
def sc09(spark, d):
    word = f"upper(element_at(array({_UNITS}), cast(p_partkey % 20 + 1 as int)))"
    made = f"case p_size % 3 when 0 then concat(if(p_partkey % 20 = 0, '', concat({word}, ' MILLION ')), 'two hundred dollars') when 1 then concat({word}, ' and 26/100') else 'no number' end"
    return _part(spark, d, text=made).select("p_partkey", tx.written_number(F.col("text")).alias("value"))


@query("sc10_garbled_dollars", "select p_partkey, case p_size % 3 when 0 then p_size * 1000.0::double when 1 then p_size * 1000 + 0.5::double else p_size * 1000000.0::double end as value from part")
def sc10(spark, d):
    made = "case p_size % 3 when 0 then concat('$', p_size, ',.00000') when 1 then concat('$ ', p_size, ',000.50') else concat('$', p_size, '.000,000') end"
    return _part(spark, d, text=made).select("p_partkey", tx.garbled_dollars(F.col("text")).alias("value"))


@query("sc11_percentages", "select p_partkey, case p_size % 3 when 0 then p_size + 0.5::double when 1 then 7.25::double end as value, case p_size % 3 when 0 then p_size + 0.5::double when 1 then 7.25::double else null end as rate from part")
def sc11(spark, d):
    made = "case p_size % 3 when 0 then concat(p_size, ' 1/2%') when 1 then 'at 7.25 %' else 'none' end"
    return _part(spark, d, text=made).select("p_partkey", tx.percentage(F.col("text")).alias("value"), tx.percentage(F.col("text"), True).alias("rate"))


@query("sc14_clean_pdf", "select p_partkey, 'the Note of the ' || p_size || 'th day of the sum' as cleaned from part")
def sc14(spark, d):
    return _part(spark, d, text="concat('theNote ofthe ', p_size, ' t h day ofthe sum')").select("p_partkey", tx.clean_pdf(F.col("text")).alias("cleaned"))


@query("sc17_snippet_of_documents", """select doc_id, case when hit > 0 then case when begin > 1 then '...' else '' end || substr(text, begin, hit - begin) || '<mark>' || substr(text, hit, 3) || '</mark>' || substr(text, hit + 3, 60)
 || case when length(text) > hit + 62 then '...' else '' end else substr(text, 1, 120) end as snippet from (select doc_id, text, hit, greatest(1, hit - 60) as begin from (select doc_id, text, strpos(lower(text), 'the') as hit from documents))""")
def sc17_all(spark, d):
    return t(spark, d, "documents").select("doc_id", tx.snippet(F.col("text"), "the").alias("snippet"))


@query("sc33_chunks", """with recursive c as (select doc_id, text, 0 as chunk, 0 as start from documents where length(text) > 0 union all select doc_id, text, chunk + 1, start + 5500 from c where start + 6000 < length(text))
 select doc_id, chunk, start, length(substr(text, start + 1, 6000))::int as size from c""")
def sc33(spark, d):
    """Texts without line ends and full stops are cut at the full length."""
    docs = t(spark, d, "documents").select("doc_id", F.translate("text", "\n.", "__").alias("text"))
    return search.chunks(docs).select("doc_id", "chunk", "start", F.length("piece").alias("size"))


_NOTE = """concat('This note is made this first day of April, ', 2000 + p_size, ' between ', if(p_size % 2 = 0, 'OAK HILL APARTMENTS LLC', 'ELM COURT HOLDINGS LP'), ' and the lender\\nFIRST NATIONAL BANK. The principal sum of $', 1000 * p_size,
 '.00 with interest at the rate of ', 3 + p_size % 5, '.25% per annum, in a monthly payment of $', 100 * p_size, '.50, and the balance due and payable on 3/1/2062.', if(p_size % 3 = 0, ' There is a guaranty.', ''))"""
_TERMS = """select p_partkey, 'loan_amount' as term_type, '$' || 1000 * p_size || '.00' as value_raw, 1000.0::double * p_size as value_numeric from part
 union all select p_partkey, 'monthly_payment', '$' || 100 * p_size || '.50', 100.0::double * p_size + 0.5 from part union all select p_partkey, 'interest_rate', (3 + p_size % 5) || '.25%', 3.25::double + p_size % 5 from part
 union all select p_partkey, 'origination_date', '04/01/' || (2000 + p_size), null from part union all select p_partkey, 'maturity_date', '03/01/2062', null from part
 union all select p_partkey, 'borrower', case when p_size % 2 = 0 then 'OAK HILL APARTMENTS LLC' else 'ELM COURT HOLDINGS LP' end, null from part union all select p_partkey, 'lender', 'FIRST NATIONAL BANK', null from part"""


@query("tx04_terms", _TERMS)
def tx04(spark, d):
    return extract.terms(_part(spark, d, text=_NOTE), "p_partkey", "text").select("p_partkey", "term_type", "value_raw", "value_numeric")


@query("tx05_prose", "select p_partkey, 'guarantee' as term_type, 'guaranty' as value_raw from part where p_size % 3 = 0 union all select p_partkey, 'balance', 'balance due' from part")
def tx05(spark, d):
    return extract.prose(_part(spark, d, text=_NOTE), "p_partkey", "text", {"guarantee": ["(?i)guaranty", "(?i)surety"], "balance": ["balance\\s+due"], "none": ["zzz"]}).select("p_partkey", "term_type", "value_raw")


@query("tx06_inferred", """select p_partkey, 'rate_type' as term_type, 'Fixed' as value_raw from part union all select p_partkey, 'recourse', 'Recourse (guaranty referenced)' from part where p_size % 3 = 0
 union all select p_partkey, 'loan_term', (61 - p_size) || case when p_size = 60 then ' year, ' else ' years, ' end || '11 months' from part""")
def tx06(spark, d):
    docs = _part(spark, d, text=_NOTE)
    return extract.inferred(docs, extract.terms(docs, "p_partkey", "text"), "p_partkey", "text").select("p_partkey", "term_type", "value_raw")


_CLAUSES = "concat('Intro\\n1. Events of Default. a ', p_size, '\\n2. ', if(p_size % 2 = 0, 'Insurance', 'Other Things'), '. d\\n3. Reporting. e\\nSection 4 Remedies\\n')"


@query("tx07_clauses", """select p_partkey, 'events_of_default' as clause_type, 'Section 1' as section_ref, '1. Events of Default. a ' || p_size as full_text from part union all select p_partkey, 'insurance_requirements', 'Section 2', '2. Insurance. d' from part where p_size % 2 = 0
 union all select p_partkey, 'reporting_requirements', 'Section 3', '3. Reporting. e' || chr(10) || 'Section 4 Remedies' from part""")
def tx07(spark, d):
    return extract.clauses(_part(spark, d, text=_CLAUSES), "p_partkey", "text").select("p_partkey", "clause_type", "section_ref", "full_text")


def _rent_table(spark, d):
    return _part(spark, d, headers="array('Unit No', 'Monthly Rent', 'Market Rent', 'Occupant')", rows="array(array('1', cast(p_size as string), '120', p_name), array('2', '90', '95', ''))")


_MAPPED = "select p_partkey, 0 as at, '1' as unit_number, p_size::varchar as monthly_rent, p_name as tenant_name from part union all select p_partkey, 1, '2', '90', '' from part"


@query("tx08_mapped_columns", _MAPPED)
def tx08(spark, d):
    return extract.mapped_columns(_rent_table(spark, d), ["p_partkey"], templates.columns("rent_roll")).select("p_partkey", "at", "unit_number", "monthly_rent", "tenant_name")


@query("tx09_cascade", "select p_partkey, case when p_size % 2 = 0 then 'table' else 'text' end as origin from part")
def tx09(spark, d):
    first = _part(spark, d, origin="'table'", p_size="p_size").filter("p_size % 2 = 0").drop("p_size")
    return extract.cascade(first, _part(spark, d, origin="'text'"), "p_partkey")


_STATEMENT = """concat('2023 2024\\nActual Budget\\nREVENUE\\n-RentalIncome 100.00 1.00 ', p_size, '.00 1.10\\nParking 5.00 0.00\\nTOTALREVENUE 105.00 1.00 ', p_size + 5, '.00 1.20\\nEXPENSES\\nLandscape (12.50) 0.10\\nLandscape (12.50) 0.10\\nNet Operating Income ', p_size, '.50 0.90\\n')"""


@query("tx10_statement_lines", """select p_partkey, 'Rental Income' as line_item, 'revenue' as category, p_size::double as amount, '2024 Budget' as period, false as is_total, false as is_subtotal from part
 union all select p_partkey, 'Parking', 'revenue', 5.0, '2024 Budget', false, false from part union all select p_partkey, 'TOTALREVENUE', 'revenue', p_size + 5.0::double, '2024 Budget', false, true from part
 union all select p_partkey, 'Landscape', 'expense', -12.5, '2024 Budget', false, false from part union all select p_partkey, 'Net Operating Income', 'noi', p_size + 0.5::double, '2024 Budget', true, false from part""")
def tx10(spark, d):
    return extract.statement_lines(_part(spark, d, text=_STATEMENT), "p_partkey", "text").select("p_partkey", "line_item", "category", "amount", "period", "is_total", "is_subtotal")


_ROLLS = """case p_size % 3 when 0 then concat('Rent Roll\\n101 One BR - 724\\nAnn Lee\\n500\\n1,2', lpad(p_size, 2, '0'), '\\n102 Studio - 480\\nVacant unit\\n0\\n0\\n103 Two BR\\nBo Ray\\n0\\n1,800.50\\n')
 when 1 then '01-101\\n1BR Flat\\n724\\nAnn Lee\\n1,300.00\\n1,200.00\\n500.00\\n1/1/2024\\n12/31/2024\\nTotal\\n1,250.00\\n01-102\\n2BR\\n900\\nVACANT\\n1,700.00\\nTotal\\n0.00\\n01-103\\n1BR\\n724\\nBo Ray\\n1,300.00\\n1,100.00\\nTotal\\n1,100.00\\n'
 else '101\\nA1B\\n724\\nAnn Lee\\n1,300.00\\n1,200.00\\n1/1/2024\\n102\\nA2B\\n900\\nVACANT\\n1,700.00\\n0.00\\n1/1/2024\\n103\\nA1B\\n724\\nBo Ray\\n1,300.00\\n1,100.00\\n2/1/2024\\n' end"""


def _roll(layout: str, k: int, rows: list[tuple]) -> str:
    return " union all ".join(f"select p_partkey, '{layout}' as layout, '{u}' as unit_number, {a}::double as square_feet, {r}::double as rent, '{s}' as status from part where p_size % 3 = {k}" for u, a, r, s in rows)


@query("tx11_rent_rolls", " union all ".join([
    _roll("a", 0, [("101", 724, "(1200 + p_size)", "occupied"), ("102", 480, 0, "vacant"), ("103", "null", 1800.5, "occupied")]),
    _roll("b", 1, [("01-101", 724, 1250, "occupied"), ("01-102", 900, "null", "vacant"), ("01-103", 724, 1100, "occupied")]),
    _roll("c", 2, [("101", 724, 1200, "occupied"), ("102", 900, "null", "vacant"), ("103", 724, 1100, "occupied")]),
]))
def tx11(spark, d):
    return extract.rent_roll(_part(spark, d, text=_ROLLS), "p_partkey", "text").select("p_partkey", "layout", "unit_number", "square_feet", "rent", "status")


def _years(spark, d):
    rows = "array(array('Revenue', '', '', ''), array('Rent', cast(p_size as string), '1,100', '10%'), array('Operating Expenses', '', '', ''), array('Taxes', '(50)', '60', ''), array('Net Operating Income', '950', '1,040', ''), array('Roof', '5', '', ''))"
    made = _part(spark, d, headers="array('', '2023 Actual', '2024B', 'Var %')", rows=rows).withColumn("sheet", F.lit("s"))
    return extract.year_table(made, ["p_partkey", "sheet"])


_YEARS = """select p_partkey, 'Rent' as label, '2023A' as period, p_size::double as amount, 'income' as category, false as below_the_line from part union all select p_partkey, 'Rent', '2024B', 1100.0, 'income', false from part
 union all select p_partkey, 'Taxes', '2023A', -50.0, 'expense', false from part union all select p_partkey, 'Taxes', '2024B', 60.0, 'expense', false from part
 union all select p_partkey, 'Net Operating Income', '2023A', 950.0, 'expense', false from part union all select p_partkey, 'Net Operating Income', '2024B', 1040.0, 'expense', false from part union all select p_partkey, 'Roof', '2023A', 5.0, 'expense', true from part"""


@query("tx12_year_tables", _YEARS)
def tx12(spark, d):
    return _years(spark, d).select("p_partkey", "label", "period", "amount", "category", "below_the_line")


@query("tx13_best_sheets", f"select p_partkey, label, period, case when p_partkey % 2 = 0 then 'z' else 's' end as sheet, case when p_partkey % 2 = 0 then 2 * amount else amount end as amount from ({_YEARS})")
def tx13(spark, d):
    one = _years(spark, d)
    other = one.withColumns({"sheet": F.lit("z"), "amount": F.when(F.col("p_partkey") % 2 == 0, F.col("amount") * 2).otherwise(F.col("amount") / 2)})
    return extract.best_sheets(one.unionByName(other), "p_partkey", "sheet").select("p_partkey", "label", "period", "sheet", "amount")


_LEASE = "concat('The landlord is ELM COURT HOLDINGS LLC. The minimum rent is $', 100 * p_size, '.00 and the security deposit is $500.00. The expiration date is 3/1/2062.')"


@query("tx18_lease_template", """select p_partkey, 'base_rent' as term_type, 100.0::double * p_size as value_numeric from part union all select p_partkey, 'security_deposit', 500.0 from part""")
def tx18(spark, d):
    wanted = {k: v for k, v in templates.fields("lease").items() if k in ("base_rent", "security_deposit")}
    return extract.terms(_part(spark, d, text=_LEASE), "p_partkey", "text", wanted).select("p_partkey", "term_type", "value_numeric")


@query("tx14_analysis", f"""select p_partkey, term_type, value_raw from ({_TERMS}) union all select p_partkey, 'rate_type', 'Fixed' from part union all select p_partkey, 'recourse', 'Recourse (guaranty referenced)' from part where p_size % 3 = 0
 union all select p_partkey, 'loan_term', (61 - p_size) || case when p_size = 60 then ' year, ' else ' years, ' end || '11 months' from part""")
def tx14(spark, d):
    """Rules first, then what follows from them."""
    docs = _part(spark, d, text=_NOTE)
    found = extract.terms(docs, "p_partkey", "text")
    return found.select("p_partkey", "term_type", "value_raw").unionByName(extract.inferred(docs, found, "p_partkey", "text").select("p_partkey", "term_type", "value_raw"))
