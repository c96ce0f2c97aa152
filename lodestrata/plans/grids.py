"""Queries of the loaders of cell grids and printed statements; the grids are laid out from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import grids
from ..sources.surrogates import table as t
from .registry import query
from .warehouse import rounded

_LABELS = ("Gross Potential Rent", "TOTAL INCOME", "Regional PAYROLL cost", "TOTAL OPERATING EXPENSES", "Accrual", "NET OPERATING INCOME", "Something else")
_LABEL = "element_at(array(" + ", ".join(f"'{x}'" for x in _LABELS) + "), l_linenumber)"


def _cell(row: str, col: str, text: str = "null", number: str = "null", day: str = "null") -> str:
    return f"named_struct('row', cast({row} as int), 'col', cast({col} as int), 'text', cast({text} as string), 'number', cast({number} as double), 'day', cast({day} as date))"


def _laid(rows: DataFrame, file: str, sheet: str, *cells: str) -> DataFrame:
    return rows.select(F.expr(f"cast({file} as string)").alias("file"), F.expr(f"cast({sheet} as string)").alias("sheet"), F.expr(f"inline(array({', '.join(cells)}))"))


def _monthly(spark, d, *by: str) -> DataFrame:
    return t(spark, d, "lineitem").groupBy("l_suppkey", "l_linenumber", *by, F.month("l_shipdate").alias("m")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("amount"))


def _statement_cells(spark, d, sheet: str) -> DataFrame:
    """A statement for each supplier (and year): the header in row 5 to 12, the total in column 14 to 16."""
    by = ("y",) if sheet == "y" else ()
    lines = t(spark, d, "lineitem").withColumn("y", F.year("l_shipdate"))
    months = lines.groupBy("l_suppkey", "l_linenumber", *by, F.month("l_shipdate").alias("m")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("amount"))
    totals = lines.groupBy("l_suppkey", "l_linenumber", *by).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("amount"))
    heads = lines.select("l_suppkey", *by).distinct().withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(12))))
    header, total = "5 + l_suppkey % 8", "14 + l_suppkey % 3"
    file = "concat('statement ', l_suppkey)"
    return (
        _laid(heads, file, sheet, _cell(header, "m + 1", day="make_date(2020, m, 1)"), _cell(header, total, text="'Total Forecast'"), _cell("4", "2", text="'Period'"))
        .unionByName(_laid(months, file, sheet, _cell(f"{header} + l_linenumber", "m + 1", number="amount")).filter("col <= 13"))
        .unionByName(_laid(totals, file, sheet, _cell(f"{header} + l_linenumber", "1", text=f"concat(' ', {_LABEL}, ' ')"), _cell(f"{header} + l_linenumber", total, number="amount")))
        # a total that isn't the rightmost, blanks and notes below
        .unionByName(_laid(heads.filter("m = 1"), file, sheet, _cell(header, "14", text="'Total'"), _cell("40", "1", text="'Notes'"), _cell("41", "2", text="'  '")))
    )


_KINDS = """(values (1, 'Gross Potential Rent', null, 'gross_potential_rent', 'explicit'), (2, 'TOTAL INCOME', 'total_revenue', null, 'subtotal'), (3, 'Regional PAYROLL cost', null, 'payroll', 'pattern'),
 (4, 'TOTAL OPERATING EXPENSES', 'total_opex', null, 'subtotal'), (6, 'NET OPERATING INCOME', 'noi', null, 'subtotal'), (7, 'Something else', null, 'other', 'unknown')) k(l_linenumber, label, field, category, method)"""


@query("src20_income_statement", f"""select 'statement ' || l_suppkey as file, (5 + l_suppkey % 8 + l_linenumber)::int as row, label, field, category, method, sum(l_extendedprice::decimal(18,2))::double as amount, chr((78 + l_suppkey % 3)::int) || (5 + l_suppkey % 8 + l_linenumber) as cell
 from lineitem join {_KINDS} using (l_linenumber) group by l_suppkey, l_linenumber, label, field, category, method""")
def src20(spark, d):
    return rounded(grids.income_statements(_statement_cells(spark, d, "'all'")).drop("sheet"), "amount", places=2)


@query("src21_statements_of_all_years", f"""select 'statement ' || l_suppkey as file, year(l_shipdate)::varchar as sheet, label, field, category, sum(l_extendedprice::decimal(18,2))::double as amount from lineitem join {_KINDS} using (l_linenumber)
 group by l_suppkey, year(l_shipdate), label, field, category""")
def src21(spark, d):
    return rounded(grids.income_statements(_statement_cells(spark, d, "y")).select("file", "sheet", "label", "field", "category", "amount"), "amount", places=2)


@query("src22_trailing_statement", """select 'ttm ' || l_suppkey as file, (5 + l_linenumber)::int as row, label, field, category, sum(l_extendedprice::decimal(18,2))::double as amount, 'O' || (5 + l_linenumber) as cell from lineitem
 join (values (1, 'Gross Potential Rent', null, 'gross_potential_rent'), (2, 'Total Income', 'total_revenue', null), (3, 'Regional PAYROLL cost', null, 'payroll'), (5, 'Total Expense', 'total_opex', null), (6, 'Net Operating Income', 'noi', null), (7, 'Something else', null, 'other')) k(l_linenumber, label, field, category) using (l_linenumber)
 group by l_suppkey, l_linenumber, label, field, category""")
def src22(spark, d):
    names = "element_at(array('Gross Potential Rent', 'Total Income', 'Regional PAYROLL cost', 'Gross Potential', 'Total Expense', 'Net Operating Income', 'Something else'), l_linenumber)"
    months = _monthly(spark, d)
    totals = months.groupBy("l_suppkey", "l_linenumber").agg(F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("amount"))
    row, file = "5 + l_linenumber", "concat('ttm ', l_suppkey)"
    code = "if(l_linenumber in (1, 3, 7), concat('50', l_linenumber), ' ')"
    cells = _laid(months, file, "'TTM'", _cell(row, "m + 2", number="amount")).unionByName(_laid(totals, file, "'TTM'", _cell(row, "1", text=code), _cell(row, "2", text=names), _cell(row, "15", number="amount")))
    return rounded(grids.trailing_statements(cells).drop("sheet", "method"), "amount", places=2)


@query("src22_printed_totals", """select l_suppkey, case l_linenumber when 2 then 'total_revenue' when 4 then 'total_opex' when 6 then 'noi' end as field, sum(case when l_returnflag = 'R' then -1 else 1 end * l_extendedprice::decimal(18,2))::double as amount, (1 + l_suppkey % 3)::int as page
 from lineitem where l_linenumber in (2, 4, 6) group by l_suppkey, l_linenumber""")
def src22_printed(spark, d):
    """Pages with a line a row: label, twelve months and the total, with thousands separators; a longer label before the one asked for, and a later line of the same label."""
    money = F.when(F.col("l_returnflag") == "R", -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")).cast("decimal(18,2)")
    lines = t(spark, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.sum(money).alias("total"), *[F.coalesce(F.sum(F.when(F.month("l_shipdate") == m, money)), F.lit(0)).alias(f"m{m}") for m in range(1, 13)])
    text = F.concat_ws(" ", F.expr(_LABEL), *[F.format_number(c, 2) for c in (*(f"m{m}" for m in range(1, 13)), "total")])
    body = lines.select("l_suppkey", F.struct("l_linenumber", text.alias("line")).alias("x")).groupBy("l_suppkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("body"))
    decoy = F.concat(F.lit("TOTAL INCOME ADJUSTMENTS" + " 1.00" * 13 + "\nTOTAL INCOME 1.00\n"), F.col("body"), F.lit("\nTOTAL INCOME" + " 2.00" * 13))
    pages = body.select("l_suppkey", (F.col("l_suppkey") % 3 + 1).cast("int").alias("page_number"), decoy.alias("text")).unionByName(body.select("l_suppkey", F.lit(9).alias("page_number"), F.lit("NET OPERATING INCOME" + " 3.00" * 13).alias("text")))
    return rounded(grids.statement_totals(pages, "l_suppkey"), "amount", places=2)


def _ledger_cells(spark, d) -> DataFrame:
    """A ledger for each year of orders (a file) and status (a sheet); headers in row 3 to 5, in columns that differ by sheet."""
    o = t(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    file, sheet, c = "concat('ledger ', y)", "o_orderstatus", "if(o_orderstatus = 'F', 1, 0)"
    row, head = "20 + o_orderkey", "3 + y % 3"
    heads = o.select("y", "o_orderstatus").distinct()
    names = ("Period", "Entry Date", "Ref", "Description", "Debit", "Credit")
    kind = "case when o_orderkey % 11 = 0 then 'Balance Forward' when o_orderkey % 13 = 0 then '2018 Beginning Balance' else concat('Entry ', o_orderkey) end"
    debit, credit = "if(o_orderkey % 3 = 0, o_totalprice, 0)", "if(o_orderkey % 3 = 1, o_totalprice, 0)"
    return _laid(heads, file, sheet, *[_cell(head, f"{i + 1} + {c}", text=f"' {n} '") for i, n in enumerate(names)], _cell("2", "1", text="'Period'")).unionByName(_laid(
        o, file, sheet, _cell(row, f"1 + {c}", text="date_format(o_orderdate, 'MM/yy')"), _cell(row, f"2 + {c}", text="if(o_orderkey % 5 = 0, null, date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss'))"), _cell(row, f"3 + {c}", text="o_orderkey"), _cell(row, f"4 + {c}", text=kind),
        _cell(row, f"5 + {c}", number=debit), _cell(row, f"6 + {c}", number=credit),
    ))


_MOVES = """select o_orderkey, case o_orderstatus when 'F' then 'A' when 'O' then 'B' end as class_id, case when o_orderkey % 13 = 0 or o_orderkey % 5 = 0 then date_trunc('month', o_orderdate)::date else o_orderdate::date end as date,
 case when o_orderkey % 13 = 0 or o_orderkey % 3 = 1 then 'contribution' else 'distribution' end as transaction_type, case when o_orderkey % 3 = 0 then 1 else -1 end * o_totalprice::decimal(18,2) as amount from orders where o_orderstatus in ('F', 'O') and o_orderkey % 3 <> 2 and o_orderkey % 11 <> 0"""


@query("src23_equity_ledger", f"select o_orderkey + 20 as row, class_id, date, transaction_type, amount::double as amount, o_orderkey::varchar as ref, o_orderkey % 13 = 0 as is_inception from ({_MOVES})")
def src23(spark, d):
    rows = grids.equity_transactions(_ledger_cells(spark, d), {"F": "A", "O": "B"})
    return rounded(rows.select(F.col("row").cast("long").alias("row"), "class_id", "date", "transaction_type", "amount", "ref", "is_inception"), "amount", places=2)


@query("agg33_annual_equity", f"""select class_id, year, contributions::double as contributions, distributions::double as distributions, (contributions - distributions)::double as net, (sum(contributions - distributions) over (partition by class_id order by year))::double as balance from (
 select class_id, year(date)::int as year, coalesce(sum(case when amount < 0 then -amount end), 0) as contributions, coalesce(sum(case when amount >= 0 then amount end), 0) as distributions from ({_MOVES}) group by 1, 2)""")
def agg33(spark, d):
    return grids.annual_equity(grids.equity_transactions(_ledger_cells(spark, d), {"F": "A", "O": "B"}))


def _overview_cells(spark, d) -> DataFrame:
    """An overview for every ten parts: facts of the first, a unit type each, totals below; yearly sums of a supplier's lines."""
    p = t(spark, d, "part").withColumn("f", F.expr("p_partkey div 10"))
    file, row = "concat('overview ', f)", "8 + p_partkey % 10"
    types = _laid(p, file, "'Revenues'", _cell(row, "2", text="if(p_partkey % 10 = 9, 'TOTALS', concat(p_name, ' ', element_at(array('Studio', '2 Bedroom', '1BR New Affordable'), cast(p_size % 3 + 1 as int))))"), _cell(row, "3", number="if(p_size % 10 = 0, 0, p_size)"), _cell(row, "4", number="400 + p_size"), _cell(row, "6", number="p_retailprice"), _cell(row, "10", number="if(p_size % 2 = 0, p_retailprice + 10, null)"))
    roll = _laid(p, file, "'Rent Roll'", _cell("7 + p_partkey % 10", "10", number="if(p_size % 4 = 0, p_retailprice + 5, null)"), _cell("7 + p_partkey % 10", "11", number="if(p_size % 3 = 0, -p_size, null)"))
    first = p.filter("p_partkey % 10 = 0")
    facts = _laid(first, file, "'Property Summary'", _cell("5", "3", text="p_name"), _cell("7", "3", text="p_brand"), _cell("9", "3", number="p_partkey"), _cell("12", "3", number="1950 + p_partkey % 70"), _cell("16", "3", text="'beyond'"))
    years = t(spark, d, "lineitem").filter(F.year("l_shipdate").between(1992, 1999)).groupBy(F.col("l_suppkey").alias("f"), F.year("l_shipdate").alias("y"), "l_linenumber").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("amount"))
    sums = _laid(years.filter("l_linenumber <= 4"), file, "'Annual Cash Flow Reforecast'", _cell("element_at(array(17, 33, 37, 26), l_linenumber)", "y - 1992 + 4", number="amount"))
    return types.unionByName(roll).unionByName(facts).unionByName(sums)


@query("src24_property_facts", """select 'overview ' || (p_partkey // 10) as file, unnest(['name', 'city', 'zip_code', 'year_built']) as field, unnest([p_name, p_brand, p_partkey::varchar, (1950 + p_partkey % 70)::varchar]) as value, unnest(['C5', 'C7', 'C9', 'C12']) as cell from part where p_partkey % 10 = 0""")
def src24_facts(spark, d):
    return grids.property_facts(_overview_cells(spark, d))


@query("src24_unit_roster", """select 'overview ' || (p_partkey // 10) as file, (8 + p_partkey % 10)::int as row, case p_size % 3 when 0 then 'Studio' when 1 then '2 Bedroom' else '1 Bedroom' end as bedrooms, case when p_size % 3 = 2 then 'new_affordable' else 'market' end as affordability, p_size::int as unit_count, (400 + p_size)::int as unit_sf, round(p_retailprice, 2) as face_rent,
 round(p_retailprice + case when p_size % 4 = 0 then 5 else 0 end - case when p_size % 3 = 0 then p_size else 0 end, 2) as net_rent, round(p_retailprice + case when p_size % 2 = 0 then 10 else 0 end, 2) as year1_rent from part where p_partkey % 10 < 9 and p_size % 10 <> 0""")
def src24_roster(spark, d):
    return rounded(grids.unit_roster(_overview_cells(spark, d)).drop("name"), "face_rent", "net_rent", "year1_rent", places=2)


@query("src24_overview_rollups", """select 'overview ' || l_suppkey as file, (year(l_shipdate) + 28)::int as year, (year(l_shipdate) + 28) || case when year(l_shipdate) < 1997 then 'A' when year(l_shipdate) = 1997 then ' Reforecast' else ' Proforma' end as label, case l_linenumber when 1 then 'total_revenue' when 2 then 'total_opex' else 'noi' end as field,
 sum(l_extendedprice::decimal(18,2))::double as amount, chr((68 + year(l_shipdate) - 1992)::int) || case l_linenumber when 1 then 17 when 2 then 33 else 37 end as cell from lineitem where year(l_shipdate) between 1992 and 1999 and l_linenumber <= 3 group by l_suppkey, year(l_shipdate), l_linenumber""")
def src24_rollups(spark, d):
    return rounded(grids.overview_rollups(_overview_cells(spark, d)), "amount", places=2)
