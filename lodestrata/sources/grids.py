"""Statements, ledgers and overviews as grids of cells.

Workbooks come as one long table of cells, ``file, sheet, row, col`` (from 1) and one of ``text, number, day``; whatever decodes them is outside. Layouts differ from file to file, so each loader first finds where
things are (the row of months, the column of totals, the columns of a ledger) by aggregates over the cells of a sheet, and then joins the cells it wants by their places. All files and sheets are loaded at once;
a sheet is never one task's business, since everything is an aggregate by sheet, a join or a window by row.

Every figure keeps the cell that it was read from. Defined results: a sheet in which the layout isn't found has no rows; blank and missing cells are the same; of two cells of one place the greater one counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.labels import classify_labels

CELLS = "file string, sheet string, row int, col int, text string, number double, day date"
SHEET = ["file", "sheet"]
#: Labels whose amounts are a period's rollups (fixed values).
ROLLUPS = {"TOTAL INCOME": "total_revenue", "TOTAL OPERATING EXPENSES": "total_opex", "NET OPERATING INCOME": "noi"}
TRAILING_ROLLUPS = {"TOTAL INCOME": "total_revenue", "TOTAL OPERATING EXPENSE": "total_opex", "TOTAL EXPENSE": "total_opex", "NET OPERATING INCOME": "noi"}
#: Words of a column of totals (fixed values).
TOTAL_WORDS = ("Total", "Forecast")
#: A ledger's columns, words of rows that carry a balance on, and of the first contribution (fixed values).
LEDGER_COLUMNS = ("period", "entry date", "ref", "description", "debit", "credit")
CARRIED = ("BALANCE FORWARD", "OPENING BALANCE FOR YEAR", "FISCAL YEAR", "ACCOUNT TOTALS")
INCEPTION = ("BEGINNING BALAN", "IMPORTED BEGINN")
#: Where an overview's facts are: column C from row 5 on (fixed values).
FACTS = ("name", "address", "city", "state", "zip_code", "market", "submarket", "year_built", "total_units", "total_buildings", "stories")


def _one_of(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in parts))


def _looked_up(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def clean(cells: DataFrame) -> DataFrame:
    """One cell a place, none of them blank."""
    rows = cells.withColumn("text", F.when(F.trim("text") != "", F.col("text"))).filter("text is not null or number is not null or day is not null")
    return rows.groupBy(*SHEET, "row", "col").agg(F.max("text").alias("text"), F.max("number").alias("number"), F.max("day").alias("day"))


def month_headers(cells: DataFrame, first: int = 5, last: int = 14) -> DataFrame:
    """(file, sheet, header, months, total): the first row with a date in the second column, how many of its twelve months are dates, and the rightmost column of totals (the fourteenth without one)."""
    near = cells.filter(F.col("row").between(first, last))
    found = near.filter("col = 2 and day is not null").groupBy(*SHEET).agg(F.min("row").alias("header"))
    inside = near.join(found, SHEET).filter("row = header")
    total = F.max(F.when((F.col("col") >= 14) & _one_of(F.col("text"), TOTAL_WORDS), F.col("col")))
    return inside.groupBy(*SHEET, "header").agg(F.count_if(F.col("col").between(2, 13) & F.col("day").isNotNull()).alias("months"), F.coalesce(total, F.lit(14)).alias("total"))


def _beside(cells: DataFrame, headers: DataFrame, label: int, amount: Column, code: int | None = None) -> DataFrame:
    """(file, sheet, row, line, code, amount, cell) of the rows below the header that have a label and a number in the amount's column."""
    rows = cells.join(headers, SHEET).filter("row > header")
    text = lambda c: F.max(F.when(F.col("col") == c, F.trim(F.coalesce(F.col("text"), F.col("number").cast("string"), F.col("day").cast("string")))))
    value = F.max(F.when(F.col("col") == amount, F.col("number")))
    out = rows.groupBy(*SHEET, "row").agg(text(label).alias("line"), (text(code) if code else F.lit(None).cast("string")).alias("code"), value.alias("amount"), F.first(amount).alias("_c"))
    return out.filter("line is not null and amount is not null").withColumn("cell", F.concat(tx.column_letter(F.col("_c")), F.col("row").cast("string"))).drop("_c")


def _last_rollup(rows: DataFrame) -> DataFrame:
    """Of several rows of one rollup the last counts."""
    w = Window.partitionBy(*SHEET, "field").orderBy(F.desc("row"))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


_STATEMENT = (*SHEET, "row", "label", "field", "category", "method", "amount", "cell")


def income_statements(cells: DataFrame) -> DataFrame:
    """Twelve-month statements -> items (``category``) and rollups (``field``), each with its cell. Other subtotals and skipped labels are left out; unknown labels are items of the method "unknown"."""
    cells = clean(cells)
    rows = classify_labels(_beside(cells, month_headers(cells), 1, F.col("total")), "line").withColumnRenamed("line", "label").withColumn("field", F.when(F.col("method") == "subtotal", _looked_up(F.col("label"), ROLLUPS)))
    items = rows.filter(~F.col("method").isin("subtotal", "skip") & F.col("category").isNotNull())
    rollups = _last_rollup(rows.filter("field is not null")).withColumn("category", F.lit(None).cast("string"))
    return items.select(*_STATEMENT).unionByName(rollups.select(*_STATEMENT))


def trailing_statements(cells: DataFrame, header: int = 5, total: int = 15) -> DataFrame:
    """Trailing-twelve statements, with an account number before the label: a row without one is a subtotal, of which only the rollups are kept."""
    cells = clean(cells)
    place = cells.select(*SHEET).distinct().select(*SHEET, F.lit(header).alias("header"), F.lit(total).alias("total"))
    rows = classify_labels(_beside(cells, place, 2, F.col("total"), code=1), "line").withColumnRenamed("line", "label")
    rows = rows.withColumn("field", F.when(F.col("code").isNull(), _looked_up(F.upper("label"), TRAILING_ROLLUPS)))
    items = rows.filter("code is not null and category is not null")
    rollups = _last_rollup(rows.filter("field is not null")).withColumns({"category": F.lit(None).cast("string"), "method": F.lit("subtotal")})
    return items.select(*_STATEMENT).unionByName(rollups.select(*_STATEMENT))


def tailed_lines(pages: DataFrame, key: list[str], text: str = "text", columns: int = 13) -> DataFrame:
    """Text lines aligned from the right: (key, line, label, amounts) of the lines that end in at least so many amounts; the label is what stands before the first amount."""
    lines = pages.select(*key, F.posexplode(F.split(text, "\n")).alias("line", "body"))
    amounts = F.transform(F.regexp_extract_all("body", F.lit(r"-?[0-9,]+\.[0-9]{2}"), F.lit(0)), lambda a: F.replace(a, F.lit(","), F.lit("")).try_cast("double"))
    label = F.trim(F.regexp_extract("body", r"^(.*?)(?:-?[0-9,]+\.[0-9]{2}|$)", 1))
    return lines.select(*key, "line", "body", label.alias("label"), F.filter(amounts, lambda a: a.isNotNull()).alias("amounts")).filter(F.size("amounts") >= columns)


def statement_totals(pages: DataFrame, document: str, page: str = "page_number", text: str = "text", columns: int = 13) -> DataFrame:
    """(document, field, amount, page) of the rollups of a printed statement: the first line that begins with the label, then goes on with a digit or a minus, and has all the columns; the last is the total."""
    rows = tailed_lines(pages, [document, page], text, columns)
    head = F.upper(F.trim("body"))
    parts = []
    for label, field in ROLLUPS.items():
        after = F.ltrim(F.substring(head, len(label) + 1, 1 << 20))
        parts.append(F.when(head.startswith(label) & ((after == "") | after.rlike(r"^[0-9-]")), field))
    found = rows.withColumn("field", F.coalesce(*parts)).filter("field is not null")
    first = found.groupBy(document, "field").agg(F.min_by(F.struct(F.element_at("amounts", -1).alias("amount"), F.col(page).alias("page")), F.struct(page, "line")).alias("f"))
    return first.select(document, "field", "f.*")


def ledger_columns(cells: DataFrame, last: int = 11) -> DataFrame:
    """(file, sheet, header, columns): the first row among the first eleven that names a period and a debit or a credit, and where its columns are (name -> column, the rightmost of equal names)."""
    names = cells.filter(F.col("row") <= last).select(*SHEET, "row", "col", F.lower(F.trim("text")).alias("name")).filter(F.col("name").isin(*LEDGER_COLUMNS))
    by_row = names.groupBy(*SHEET, "row", "name").agg(F.max("col").alias("col")).groupBy(*SHEET, "row").agg(F.map_from_entries(F.collect_list(F.struct("name", "col"))).alias("columns"))
    whole = by_row.filter(F.map_contains_key("columns", "period") & (F.map_contains_key("columns", "debit") | F.map_contains_key("columns", "credit")))
    return whole.groupBy(*SHEET).agg(F.min_by("columns", "row").alias("columns"), F.min("row").alias("header"))


def _entry_date(cell: Column) -> Column:
    text = F.trim(cell["text"])
    return F.coalesce(cell["day"], F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"), tx.parse_date(F.regexp_extract(text, r"^(\d{1,2}/\d{1,2}/\d{4})$", 1)))


def equity_transactions(cells: DataFrame, classes: dict[str, str]) -> DataFrame:
    """Capital-account ledgers -> cash movements: contributions are negative (debit minus credit).

    Rows without an amount and rows that carry a balance on are no movements; the first contribution of an account stands as a beginning balance and is dated by its period, not by its entry.
    ``classes``: sheet -> class of investor; other sheets are left out.
    """
    cells = clean(cells).withColumn("class_id", _looked_up(F.col("sheet"), classes)).filter("class_id is not null")
    rows = cells.join(ledger_columns(cells), SHEET).filter("row > header")
    at = lambda name: F.max(F.when(F.col("col") == F.try_element_at("columns", F.lit(name)), F.struct("text", "number", "day"))).alias(name.replace(" ", "_"))
    lines = rows.groupBy(*SHEET, "class_id", "row").agg(*map(at, LEDGER_COLUMNS))
    amount = lambda c: F.coalesce(F.col(f"{c}.number"), F.lit(0.0))
    text = lambda c: F.coalesce(F.trim(F.coalesce(F.col(f"{c}.text"), F.col(f"{c}.number").cast("string"), F.col(f"{c}.day").cast("string"))), F.lit(""))
    moved = lines.withColumns({"_d": amount("debit"), "_c": amount("credit"), "description_text": text("description"), "period_label": text("period")}).filter("_d <> 0 or _c <> 0")
    upper = F.upper("description_text")
    moved = moved.filter(~_one_of(upper, CARRIED)).withColumn("is_inception", _one_of(upper, INCEPTION))
    period = tx.month_year(F.col("period_label"))
    dated = moved.withColumn("date", F.when(F.col("is_inception") & period.isNotNull(), period).otherwise(F.coalesce(_entry_date(F.col("entry_date")), period))).filter("date is not null")
    kind = F.when(F.col("is_inception") | (F.col("_c") > 0), "contribution").otherwise("distribution")
    return dated.select(*SHEET, "row", "class_id", "date", kind.alias("transaction_type"), (F.col("_d") - F.col("_c")).alias("amount"), F.nullif("description_text", F.lit("")).alias("description"), "period_label", F.nullif(text("ref"), F.lit("")).alias("ref"), "is_inception")


def annual_equity(transactions: DataFrame) -> DataFrame:
    """(class_id, year, contributions, distributions, net, balance): what came in and went out each year, and the capital in the account at its end."""
    money = F.col("amount").cast("decimal(18,2)")
    of = lambda x: F.coalesce(F.sum(x), F.lit(0))
    years = transactions.groupBy("class_id", F.year("date").alias("year")).agg(of(F.when(money < 0, -money)).alias("contributions"), of(F.when(money >= 0, money)).alias("distributions"))
    years = years.withColumn("net", F.col("contributions") - F.col("distributions"))
    upto = Window.partitionBy("class_id").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    return years.withColumn("balance", F.sum("net").over(upto)).select("class_id", "year", *[F.col(c).cast("double").alias(c) for c in ("contributions", "distributions", "net", "balance")])


def property_facts(cells: DataFrame, sheet: str = "Property Summary") -> DataFrame:
    """(file, field, value, cell) of an overview's first page."""
    rows = clean(cells).filter((F.col("sheet") == sheet) & (F.col("col") == 3) & F.col("row").between(5, 4 + len(FACTS)))
    whole = F.when(F.col("number") == F.floor("number"), F.col("number").cast("long").cast("string")).otherwise(F.col("number").cast("string"))
    return rows.select("file", F.element_at(F.array(*map(F.lit, FACTS)), F.col("row") - 4).alias("field"), F.coalesce(F.trim("text"), whole, F.col("day").cast("string")).alias("value"), F.concat(F.lit("C"), "row").alias("cell"))


def unit_roster(cells: DataFrame, revenues: str = "Revenues", roll: str = "Rent Roll", first: int = 8, last: int = 17) -> DataFrame:
    """Unit types of an overview: counts, areas and rents, with the rents net of concessions from the row above on the rent roll. The list ends before its totals or a row without a name."""
    rows = clean(cells).filter(F.col("sheet").isin(revenues, roll))
    at = lambda c, what: F.max(F.when(F.col("col") == c, F.col(what)))
    types = rows.filter((F.col("sheet") == revenues) & F.col("row").between(first, last)).groupBy("file", "row").agg(
        F.trim(at(2, "text")).alias("name"), at(3, "number").alias("unit_count"), at(4, "number").alias("unit_sf"), at(6, "number").alias("face_rent"), at(10, "number").alias("_year1"),
    )
    ends = F.upper(F.coalesce("name", F.lit("TOTALS"))).rlike("TOTALS|AVERAGE") | (F.col("row") != F.lit(first) + F.row_number().over(Window.partitionBy("file").orderBy("row")) - 1)
    upto = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    open_ = types.withColumn("_ends", ends).withColumn("_over", F.max("_ends").over(upto)).filter("not _over and unit_count <> 0")
    net = rows.filter(F.col("sheet") == roll).groupBy("file", (F.col("row") + 1).alias("row")).agg(at(10, "number").alias("_face"), at(11, "number").alias("_concession"))
    filled = lambda c, other: F.coalesce(F.nullif(c, F.lit(0.0)), other)
    return open_.join(net, ["file", "row"], "left").select(
        "file", "row", "name", tx.bedrooms(F.col("name")).alias("bedrooms"), tx.affordability(F.col("name")).alias("affordability"), F.col("unit_count").cast("int").alias("unit_count"), F.col("unit_sf").cast("int").alias("unit_sf"), "face_rent",
        (filled("_face", F.col("face_rent")) + F.coalesce("_concession", F.lit(0.0))).alias("net_rent"), filled("_year1", F.col("face_rent")).alias("year1_rent"),
    )


def overview_rollups(cells: DataFrame, sheet: str = "Annual Cash Flow Reforecast", first_year: int = 2020, last_year: int = 2027, reforecast: int = 2025) -> DataFrame:
    """(file, year, label, field, amount, cell): an overview's yearly revenues (row 17), expenses (33) and net operating income (37), a column a year from the fourth on."""
    fields = {17: "total_revenue", 33: "total_opex", 37: "noi"}
    rows = clean(cells).filter((F.col("sheet") == sheet) & F.col("row").isin(*fields) & F.col("col").between(4, 4 + last_year - first_year) & F.col("number").isNotNull())
    year = F.col("col") - 4 + first_year
    label = F.concat(year.cast("string"), F.when(year < reforecast, "A").when(year == reforecast, " Reforecast").otherwise(" Proforma"))
    field = F.element_at(F.create_map(*[F.lit(x) for kv in fields.items() for x in kv]), F.col("row"))
    return rows.select("file", year.alias("year"), label.alias("label"), field.alias("field"), F.col("number").alias("amount"), F.concat(tx.column_letter(F.col("col")), F.col("row").cast("string")).alias("cell"))
