"""Extraction on small texts with known contents."""

from pyspark.sql import functions as F

from lodestrata.operators import extract


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def test_terms(spark):
    text = """This note is made this first day of April, 2027 between OAK HILL APARTMENTS LLC and the lender
FIRST NATIONAL BANK. The principal sum of THREE MILLION and 00/100 Dollars ($3000,.00000) with interest at the rate of seven and 26/100 percent per annum,
in a monthly payment of $19,911.50, and the balance due and payable on 3/1/2062. Default interest is 11.5%. There is a guaranty."""
    d = docs(spark, text, None)
    found = extract.terms(d, "id", "text")
    got = {r.term_type: (r.value_raw, r.value_numeric, r.confidence) for r in found.collect()}
    assert got["loan_amount"][1:] == (3_000_000.0, 0.90) and got["monthly_payment"][1] == 19911.5
    assert got["interest_rate"][1:] == (7.26, 0.90) and got["default_rate"][1] == 11.5
    assert got["origination_date"][0] == "04/01/2027" and got["maturity_date"][0] == "03/01/2062"
    assert got["borrower"][0] == "OAK HILL APARTMENTS LLC" and got["lender"][0] == "FIRST NATIONAL BANK"
    more = {(r.id, r.term_type): r.value_raw for r in extract.inferred(d, found, "id", "text").collect()}
    assert more == {(0, "rate_type"): "Fixed", (0, "loan_term"): "34 years, 11 months", (0, "recourse"): "Recourse (guaranty referenced)", (1, "rate_type"): "Fixed"}
    prose = extract.prose(d, "id", "text", {"guarantee": ["(?i)guaranty", "x"], "none": ["zzz"]}).collect()
    assert [(r.id, r.term_type, r.value_raw) for r in prose] == [(0, "guarantee", "guaranty")]


def test_clauses(spark):
    text = "Intro\n1. Events of Default. a b c\n2. Insurance. d\n3. Other Things. e\nSection 4 Remedies\n"
    got = extract.clauses(docs(spark, text, ""), "id", "text").collect()
    assert [(r.clause_type, r.section_ref, r.full_text) for r in got] == [("events_of_default", "Section 1", "1. Events of Default. a b c"), ("insurance_requirements", "Section 2", "2. Insurance. d")]


def test_statement_lines(spark):
    text = "2023 2024\nActual Budget\nREVENUE\n-RentalIncome 100.00 1.00 110.00 1.10\nParking 5.00 0.00\nTOTALREVENUE 105.00 1.00 116.00 1.20\nEXPENSES\nLandscape (12.50) 0.10\nLandscape (12.50) 0.10\nNet Operating Income 92.50 0.90\n"
    rows = extract.statement_lines(docs(spark, text), "id", "text").collect()
    assert [(r.line_item, r.category, r.amount, r.period, r.is_total, r.is_subtotal) for r in rows] == [
        ("Rental Income", "revenue", 110.0, "2024 Budget", False, False), ("Parking", "revenue", 5.0, "2024 Budget", False, False), ("TOTALREVENUE", "revenue", 116.0, "2024 Budget", False, True),
        ("Landscape", "expense", -12.5, "2024 Budget", False, False), ("Net Operating Income", "noi", 92.5, "2024 Budget", True, False),
    ]


def test_rent_rolls(spark):
    a = "Rent Roll\n101 One BR - 724\nAnn Lee\n500\n1,200\n102 Studio - 480\nVacant unit\n0\n0\n103 Two BR\nBo Ray\n0\n1,800.50\n"
    b = "01-101\n1BR Flat\n724\nAnn Lee\n1,300.00\n1,200.00\n500.00\n1/1/2024\n12/31/2024\nTotal\n1,250.00\n01-102\n2BR\n900\nVACANT\n1,700.00\nTotal\n0.00\n01-103\n1BR\n724\nBo Ray\n1,300.00\n1,100.00\nTotal\n1,100.00\n"
    c = "101\nA1B\n724\nAnn Lee\n1,300.00\n1,200.00\n1/1/2024\n102\nA2B\n900\nVACANT\n1,700.00\n0.00\n1/1/2024\n103\nA1B\n724\nBo Ray\n1,300.00\n1,100.00\n2/1/2024\n"
    got = {}
    for r in extract.rent_roll(docs(spark, a, b, c, "nothing", None), "id", "text").collect():
        got.setdefault((r.id, r.layout), []).append((r.unit_number, r.square_feet, r.rent, r.status))
    assert got[0, "a"] == [("101", 724.0, 1200.0, "occupied"), ("102", 480.0, 0.0, "vacant"), ("103", None, 1800.5, "occupied")]
    assert got[1, "b"] == [("01-101", 724.0, 1250.0, "occupied"), ("01-102", 900.0, None, "vacant"), ("01-103", 724.0, 1100.0, "occupied")]
    assert got[2, "c"] == [("101", 724.0, 1200.0, "occupied"), ("102", 900.0, None, "vacant"), ("103", 724.0, 1100.0, "occupied")]
    assert len(got) == 3


def test_year_tables(spark):
    rows = [["Revenue", "", "", "", ""], ["Rent", "1,000", "1,100", "10%", "1,150"], ["Total Revenue", "1,000", "1,100", "", ""], ["Operating Expenses", "", "", "", ""], ["Taxes", "(50)", "60", "", ""], ["Net Operating Income", "950", "1,040", "", ""], ["Roof", "5", "", "", ""]]
    t = spark.createDataFrame([(1, "s", ["", "2023 Actual", "2024B", "Var %", "2024 Budget"], rows)], "id int, sheet string, headers array<string>, rows array<array<string>>")
    got = extract.year_table(t, ["id", "sheet"]).orderBy("at", "period")
    assert [(r.label, r.period, r.amount, r.category, r.below_the_line, r.is_subtotal) for r in got.collect()] == [
        ("Rent", "2023A", 1000.0, "income", False, False), ("Rent", "2024B", 1100.0, "income", False, False), ("Total Revenue", "2023A", 1000.0, "income", False, True), ("Total Revenue", "2024B", 1100.0, "income", False, True),
        ("Taxes", "2023A", -50.0, "expense", False, False), ("Taxes", "2024B", 60.0, "expense", False, False), ("Net Operating Income", "2023A", 950.0, "expense", False, False), ("Net Operating Income", "2024B", 1040.0, "expense", False, False),
        ("Roof", "2023A", 5.0, "expense", True, False),
    ]
    twice = got.union(got.withColumn("sheet", F.lit("z")).withColumn("amount", F.col("amount") / 2))
    assert {r.sheet for r in extract.best_sheets(twice, "id", "sheet").collect()} == {"s"}


def test_mapped_columns(spark):
    t = spark.createDataFrame([(1, ["Unit No", "Monthly Rent", "Market Rent"], [["1", "100", "120"], ["2", "90", "95"]])], "id int, headers array<string>, rows array<array<string>>")
    got = extract.mapped_columns(t, ["id"], {"unit_number": ["unit"], "monthly_rent": ["rent"], "tenant": ["name"]}).orderBy("at").collect()
    assert [(r.unit_number, r.monthly_rent, r.tenant) for r in got] == [("1", "100", None), ("2", "90", None)]
    other = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    assert {r.id for r in extract.cascade(other.filter("id = 1"), other, "id").collect()} == {1, 2}


def test_templates(spark):
    from lodestrata.functions import templates

    assert [len(templates.fields(t)) for t in ("lease", "loan", "closing", "guarantee")] == [22, 24, 13, 8]
    assert [len(templates.CLAUSE_TYPES[t]) for t in ("lease", "loan", "closing", "guarantee")] == [23, 13, 10, 9]
    assert [len(templates.columns(t)) for t in ("rent_roll", "operating_statement", "general_ledger")] == [9, 5, 9]
    d = docs(spark, "the tenant ACME HOLDINGS LLC pays a monthly rent of $1,500.00 and a deposit of two thousand dollars")
    got = {r.term_type: (r.value_raw, r.value_numeric) for r in extract.terms(d, "id", "text", templates.fields("lease")).collect()}
    assert got["base_rent"][1] == 1500.0 and got["security_deposit"][1] == 2000.0 and got["tenant_name"][0] == "ACME HOLDINGS LLC"
    assert {r.clause_type for r in extract.clauses(docs(spark, "1. Governing Law. x\n2. Remedies. y\n"), "id", "text", templates.clause_types("guarantee", extract.CLAUSES)).collect()} == {"governing_law", "remedies"}
