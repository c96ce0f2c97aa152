"""Extraction from document text: financial terms, clauses, statement lines, rent rolls and year tables.

Documents are independent, and a parser needs a document's lines in order, so each runs as a generator over whole documents in Arrow
batches: no shuffle, one document in memory at a time. What works on the found values (choice of a field's best value, removal of repeats) is relational.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.labels import best_per_key

#: Fields of a loan with kind and keywords (fixed values); other templates are passed in the same form.
LOAN = {
    "loan_amount": ("money", ("loan amount", "principal sum", "principal amount", "original principal", "sum of")),
    "monthly_payment": ("money", ("monthly payment", "monthly installment", "installments of")),
    "interest_rate": ("percent", ("interest rate", "rate of interest", "interest at the rate", "per annum")),
    "default_rate": ("percent", ("default interest", "default rate")),
    "origination_date": ("date", ("origination date", "made this", "executed", "effective", "dated as of", "closing")),
    "maturity_date": ("date", ("maturity date", "payable on", "due and payable", "final installment")),
    "borrower": ("entity", ("borrower", "mortgagor", "between")),
    "lender": ("entity", ("lender", "mortgagee", "payable to")),
}
#: Phrases of section titles by clause type (fixed values).
CLAUSES = {
    "events_of_default": ("events of default", "event of default", "default event", "shall constitute a default", "default under this"), "remedies": ("remedies", "acceleration", "foreclosure", "rights and remedies", "appointment of receiver"),
    "representations_warranties": ("representations", "warranties", "represents and warrants"), "covenants": ("covenants", "covenant", "miscellaneous covenants"), "insurance_requirements": ("insurance", "coverage"),
    "environmental": ("environmental", "hazardous substance", "hazardous material"), "transfer_restrictions": ("transfer", "assignment of", "conveyance", "sale or transfer"),
    "due_on_sale": ("due on sale", "due-on-sale", "transfer of property", "prohibition on transfer"), "subordination": ("subordination", "subordinate"), "cross_default": ("cross default", "cross-default"),
    "reporting_requirements": ("reporting", "financial statements", "books and records"), "cash_management": ("cash management", "cash sweep"), "lockbox": ("lockbox", "lock box", "cash collateral"),
}
_NUMBER = "|".join([*tx.UNITS[1:], *tx.TENS, *tx.SCALES])
_MONTH = "|".join(tx.MONTHS)
#: What a value looks like, by kind and source; a written one is more reliable than digits (fixed order).
VALUES = (
    ("money", "written", 0.90, rf"(?i)\b(?:(?:{_NUMBER})[\s-]+)+(?:and\s+\d+/100\s+)?dollars?"),
    ("money", "numeric", 0.65, r"\$\s*\d[\d,.]{0,18}\d"),
    ("percent", "written", 0.90, rf"(?i)\b(?:(?:{_NUMBER})[\s-]+)*(?:{_NUMBER})(?:\s+and\s+\d+/100)?\s*(?:percent|per\s*cent)"),
    ("percent", "numeric", 0.65, r"(?i)\d+(?:\.\d+)?(?:\s+\d+/\d+)?\s*(?:percent|%|per\s*(?:cent|annum))"),
    ("date", "text", 0.85, rf"(?i)(?:\d{{1,2}}(?:st|nd|rd|th)?|first|second|third)\s+day\s+of\s+\w+,?\s*\d{{4}}|\b(?:{_MONTH})\s+\d{{1,2}},?\s*\d{{4}}|\b\d{{1,2}}/\d{{1,2}}/\d{{2,4}}"),
    ("entity", "text", 0.80, r"[A-Z][A-Z\s,.&'-]{4,80}?(?:COMPANY|CORPORATION|PARTNERSHIP|LLC|LP|INC|TRUST|BANK|L\.P\.)\b"),
)
CONTEXT = 150


def _parsed(df: DataFrame, key: str, text: str, schema: str, parse: Callable[[str], Iterator[tuple]]) -> DataFrame:
    """``parse`` over every document's text; its tuples, behind the key."""
    rows = df.select(key, text)
    names = [key, *(c.strip().split()[0] for c in schema.split(","))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(k, *r) for k, body in zip(batch[key], batch[text], strict=True) for r in parse(body or "")], columns=names)

    return rows.mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, {schema}")


def values(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Every amount, percentage, date and name in a text with what stands before it (since the value of the same kind before)."""
    patterns = [(kind, source, confidence, re.compile(p)) for kind, source, confidence, p in VALUES]

    def parse(body: str) -> Iterator[tuple]:
        flat, last = body.replace("\n", " "), {}
        found = [(m.start(), m, k) for k, v in enumerate(patterns) for m in v[3].finditer(flat)]
        for at, m, rank in sorted(found, key=lambda x: (x[0], x[2])):
            kind, source, confidence, _ = patterns[rank]
            yield kind, source, rank, at, " ".join(m[0].split()), flat[max(last.get(kind, 0), at - CONTEXT) : at].lower(), confidence
            last[kind] = max(last.get(kind, 0), m.end())

    return _parsed(docs, key, text, "kind string, source string, rank int, position long, raw string, context string, confidence double", parse)


def numeric(kind: Column, source: Column, raw: Column, context: Column) -> Column:
    """The number of a value; dates and names have none."""
    rate = context.rlike("interest|rate|coupon|spread|margin|floor|cap|default")
    percent = F.regexp_replace(F.lower(raw), r"\s*(percent|per\s*cent|per\s*annum)", "%")
    digits = F.when(rate, tx.percentage(percent, True)).otherwise(tx.percentage(percent))
    words = tx.written_number(F.regexp_replace(F.lower(raw), r"\s*(percent|per\s*cent)$", ""))
    return F.when(kind == "money", F.when(source == "written", words).otherwise(tx.garbled_dollars(raw))).when(kind == "percent", F.when(source == "written", words).otherwise(digits))


def terms(docs: DataFrame, key: str, text: str, template: dict = LOAN) -> DataFrame:
    """The best value of each field: the first, written before numeric, whose context has one of the field's keywords."""
    spark = docs.sparkSession
    fields = spark.createDataFrame([(n, k, list(ws)) for n, (k, ws) in template.items()], "term_type string, kind string, keywords array<string>")
    found = values(docs, key, text).join(F.broadcast(fields), "kind")  # a template's fields
    hits = found.filter(F.exists("keywords", lambda w: F.contains(F.col("context"), w)))
    best = best_per_key(hits, [key, "term_type"], F.col("rank"), F.col("position"))
    value = F.when(F.col("kind") == "date", F.coalesce(tx.legal_date(F.col("raw")), F.col("raw"))).otherwise(F.col("raw"))
    return best.select(key, "term_type", value.alias("value_raw"), numeric(F.col("kind"), F.col("source"), F.col("raw"), F.col("context")).alias("value_numeric"), F.when(F.col("kind") == "percent", "%").alias("value_unit"), "confidence")


def inferred(docs: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    """Fields that follow from others or from what a text doesn't say: fixed rate, loan term, recourse."""
    low = docs.select(key, F.lower(F.coalesce(text, F.lit(""))).alias("t"))
    named = lambda name: F.max(F.when(F.col("term_type") == name, F.to_date("value_raw", "MM/dd/yyyy")))
    dates = found.filter(F.col("term_type").isin("origination_date", "maturity_date") & F.col("value_raw").rlike(r"^\d{2}/\d{2}/\d{4}$")).groupBy(key).agg(named("origination_date").alias("a"), named("maturity_date").alias("b"))
    rows = low.join(dates, key, "left")
    floating = F.col("t").rlike("sofr|libor|prime rate|adjustable|variable rate|floating rate|index rate")
    months = F.round(F.months_between("b", "a")).cast("int")
    guesses = F.array(
        F.when(~floating, F.struct(F.lit("rate_type").alias("term_type"), F.lit("Fixed").alias("value_raw"), F.lit(0.75).alias("confidence"))),
        F.when(months > 0, F.struct(F.lit("loan_term").alias("term_type"), tx.loan_term(months).alias("value_raw"), F.lit(0.85).alias("confidence"))),
        F.when(F.col("t").rlike("non[- ]?recourse"), F.struct(F.lit("recourse").alias("term_type"), F.lit("Non-recourse").alias("value_raw"), F.lit(0.80).alias("confidence"))).when(
            F.col("t").rlike(r"guaranty|guarantor|personal\s*(?:liability|guarantee)"), F.struct(F.lit("recourse").alias("term_type"), F.lit("Recourse (guaranty referenced)").alias("value_raw"), F.lit(0.70).alias("confidence"))
        ),
    )
    return rows.select(key, F.explode(F.filter(guesses, lambda g: g.isNotNull())).alias("g")).select(key, "g.*").join(found.select(key, "term_type"), [key, "term_type"], "left_anti")


def prose(docs: DataFrame, key: str, text: str, patterns: dict[str, list[str]]) -> DataFrame:
    """The first match of each field's patterns in running text."""
    flat = docs.select(key, F.regexp_replace(F.coalesce(text, F.lit("")), "\n", " ").alias("t"))
    first = lambda ps: F.coalesce(*[F.nullif(F.regexp_extract("t", f"({p})", 1), F.lit("")) for p in ps])
    found = flat.select(key, *[first(ps).alias(n) for n, ps in patterns.items()]).unpivot([key], list(patterns), "term_type", "value_raw")
    return found.filter("value_raw is not null").withColumn("confidence", F.lit(0.80))


_HEADERS = (re.compile(r"(?m)^[^\S\n]*((?:ARTICLE|SECTION|Article|Section)\s+[\dIVXivx]+)[.\s]*[-–—]?\s*([A-Z][^\n]+)"), re.compile(r"(?m)^\s*(\d{1,2})\.\s+([A-Z][A-Za-z ,;:&'-]+?)(?:\.|$)"))


def clauses(docs: DataFrame, key: str, text: str, types: dict[str, tuple[str, ...]] = CLAUSES) -> DataFrame:
    """Sections of known types: the header style that occurs more often, a body up to the next header (3000 characters for the last, 2000 stored)."""
    known = dict(types)

    def parse(body: str) -> Iterator[tuple]:
        found = max((list(p.finditer(body)) for p in _HEADERS), key=len)
        for n, m in enumerate(found):
            end = found[n + 1].start() if n + 1 < len(found) else min(m.start() + 3000, len(body))
            title = m[2].strip().rstrip(".")
            kind = next((k for k, phrases in known.items() if any(p in title.lower() for p in phrases)), None)
            if kind:
                yield kind, m[1] if m[1][0].isalpha() else f"Section {m[1]}", title, body[m.start() : end].strip()[:2000], 0.70

    return _parsed(docs, key, text, "clause_type string, section_ref string, clause_title string, full_text string, confidence double", parse)


_AMOUNT = re.compile(r"\(?\d[\d,]*\.\d{2}\)?")
#: Which words of a squeezed label decide its category, in order (fixed values).
LINE_KINDS = (
    ("netoperatingincome", "noi"), ("fundsfromoperations", "noi"), ("netincome", "other"), ("netcashflow", "other"), ("debtservice", "debt_service"), ("mortgage", "debt_service"), ("interest", "debt_service"),
    ("depreciation", "other"), ("amortization", "other"), ("capital", "capital"), ("improvement", "capital"), ("revenue", "revenue"), ("income", "revenue"), ("expense", "expense"), ("operating", "expense"),
)


def _money(text: str) -> float:
    value = float(re.sub(r"[(),$\s]", "", text))
    return -value if text.startswith("(") else value


def statement_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Income-statement lines: a label, then amounts in pairs (amount, per area); the last period counts, repeated lines count once."""

    def parse(body: str) -> Iterator[tuple]:
        lines = [x.strip() for x in body.split("\n")]
        period, section, seen = None, "other", set()
        for n, line in enumerate(lines):
            if re.fullmatch(r"\d{4}(?:\s+\d{4})+", line):
                kinds = re.findall(r"(?i)actual|budget|reforecast|forecast|projected", lines[n + 1]) if n + 1 < len(lines) else []
                years = line.split()
                period = period or (f"{years[-1]} {kinds[-1]}" if len(kinds) == len(years) else None)
                continue
            if not line or line in seen or re.match(r"(?i)database:|entity:|accrual|actual|budget|reforecast|page:", line):
                continue
            seen.add(line)
            amounts = _AMOUNT.findall(line)
            label = line[: line.index(amounts[0])].strip().lstrip("-").strip() if amounts else line
            squeezed = re.sub(r"\s+", "", label).lower()
            if not amounts:
                section = {"revenue": "revenue", "expense": "expense", "expenses": "expense"}.get(squeezed, "other" if "adjustmentstocash" in squeezed else section)
                continue
            if not label:
                continue
            total = squeezed.startswith("net")
            subtotal = "total" in squeezed and not total
            kind = "noi" if squeezed in ("noi", "ffo") else next((c for w, c in LINE_KINDS if w in squeezed), section)
            if subtotal and "revenue" in squeezed:
                section = "revenue"
            elif squeezed in ("expense", "expenses") or subtotal and "expense" in squeezed:
                section = "expense"
            name = " ".join(re.sub(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", label).replace("&", " & ").split())
            amount = _money(amounts[-2] if len(amounts) > 1 else amounts[0])
            per_area = _money(amounts[-1]) if len(amounts) > 1 else None
            yield name, kind, amount, per_area or None, period, total, subtotal

    return _parsed(docs, key, text, "line_item string, category string, amount double, amount_psf double, period string, is_total boolean, is_subtotal boolean", parse)


_DATE, _PLAIN = re.compile(r"\d{1,2}/\d{1,2}/\d{2,4}"), re.compile(r"-?\$?[\d,]+(?:\.\d+)?")


def _record_a(record: list[str]) -> tuple | None:
    """Unit and type (with the area at its end), tenant, deposit, rent."""
    m = re.fullmatch(r"(\d+)\s+(.+)", record[0])
    if not m or len(record) < 2 or _PLAIN.fullmatch(record[1]):
        return None
    area = re.search(r"[-\s]\s*(\d{3,5})$", m[2])
    numbers = [float(x.replace(",", "").replace("$", "")) if _PLAIN.fullmatch(x) else None for x in record[2:]]
    rent = numbers[1] if len(numbers) > 1 else None
    kind = (m[2][: area.start()] if area else m[2]).rstrip(" -")
    return m[1], kind, record[1], float(area[1]) if area else None, rent, None, numbers[0] or None if numbers else None, None, None, "occupied" if rent and rent > 0 else "vacant"


def _record_b(record: list[str]) -> tuple | None:
    """Unit, type, area and tenant or VACANT, then amounts by place: market, rent, deposit; a Total line's amount is the rent that counts."""
    unit, kind, rest = record[0], record[1] if len(record) > 1 else "", record[2:]
    vacant = any("VACANT" in x.upper() for x in rest)
    dates = [x for x in rest if _DATE.fullmatch(x)]
    total, numbers, area, tenant = None, [], None, None
    for n, x in enumerate(rest):
        if x.lower() == "total":
            total = next((_money(y.replace("-", "")) for y in rest[n + 1 :] if _PLAIN.fullmatch(y)), None)
            break
        if _PLAIN.fullmatch(x) and not _DATE.fullmatch(x):
            if area is None and re.fullmatch(r"\d{3,4}", x):
                area = float(x)
            else:
                numbers.append(_money(x))
        elif not _DATE.fullmatch(x) and tenant is None and "VACANT" not in x.upper():
            tenant = x
    rent = total if total is not None else numbers[1] if len(numbers) > 1 else None
    if vacant:
        tenant, rent = None, None
    return unit, kind, tenant, area, rent, numbers[0] if numbers else None, numbers[2] if len(numbers) > 2 else None, dates[0] if dates else None, dates[1] if len(dates) > 1 else None, "vacant" if vacant else "occupied"


def _record_c(record: list[str]) -> tuple | None:
    """Unit number, type code, area, tenant, then amounts and dates."""
    numbers = [_money(x) for x in record[3:] if _PLAIN.fullmatch(x) and not _DATE.fullmatch(x)]
    dates = [x for x in record[3:] if _DATE.fullmatch(x)]
    tenant = next((x for x in record[3:] if not _PLAIN.fullmatch(x) and not _DATE.fullmatch(x)), None)
    vacant = tenant is None or "VACANT" in tenant.upper()
    rent = numbers[1] if len(numbers) > 1 else None
    return record[0], record[1], None if vacant else tenant, _money(record[2]), None if vacant else rent, numbers[0] if numbers else None, numbers[2] if len(numbers) > 2 else None, dates[0] if dates else None, dates[1] if len(dates) > 1 else None, "vacant" if vacant else "occupied"


def _starts(lines: list[str]) -> dict[str, list[int]]:
    code = re.compile(r"[A-Z0-9]*\d[A-Z0-9]*x\d|[A-Z]+\d+[A-Z0-9]*|\d+[A-Za-z]+\d*")
    return {
        "a": [k for k, x in enumerate(lines) if re.fullmatch(r"\d+\s+\S.*", x)],
        "b": [k for k in range(len(lines) - 1) if re.fullmatch(r"\d+-\d+[A-Z]?|[A-Z]-?\d+", lines[k]) and re.search(r"[A-Za-z]", lines[k + 1])],
        "c": [k for k in range(len(lines) - 2) if lines[k].isdigit() and code.fullmatch(lines[k + 1]) and re.fullmatch(r"\d{3,4}", lines[k + 2])],
    }


def rent_roll(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rent-roll records in one of three layouts: B with Total lines, C by unit, code and area, A by fixed record length (that of the first record)."""

    def parse(body: str) -> Iterator[tuple]:
        lines = [x.strip() for x in body.split("\n") if x.strip() and not re.match(r"(?i)rent roll|page\b|unit\s+type|as of", x.strip())]
        starts, totals = _starts(lines), sum(x.lower() == "total" for x in lines)
        layout = "b" if totals and len(starts["b"]) > 2 else "c" if len(starts["c"]) > 2 else "a" if len(starts["a"]) > 2 else "b" if totals else ""
        at = starts.get(layout, [])
        length = at[1] - at[0] if len(at) > 1 else 0
        if layout == "a" and not 2 <= length <= 10 or layout == "c" and not 4 <= length <= 15:
            return
        for n, k in enumerate(at):
            end = at[n + 1] if n + 1 < len(at) else len(lines)
            row = {"a": _record_a, "b": _record_b, "c": _record_c}[layout](lines[k : k + length] if layout == "a" else lines[k:end])
            if row:
                yield layout, *row

    return _parsed(docs, key, text, "layout string, unit_number string, unit_type string, tenant string, square_feet double, rent double, market_rent double, deposit double, move_in string, lease_end string, status string", parse)


#: Words that set a table's section (fixed values).
SECTIONS = (("income", ("revenue", "income")), ("expense", ("expense", "opex")))
BELOW_LINE = ("debt service", "capital", "reserve", "distribution", "cash flow")


def year_table(tables: DataFrame, key: list[str], headers: str = "headers", rows: str = "rows") -> DataFrame:
    """Tables with a column a year: one row per label and year, with section and whether it lies below the line.

    Columns of variances are skipped; of a year that occurs twice the first counts; a section lasts until the next (the last one seen above), and
    everything after a net operating income is below the line. (1,234) is negative.
    """
    year = r"(?:^|\D)((?:19|20)\d{2})\s*([A-Za-z]*)"
    wide = tables.select(*key, headers, F.posexplode(rows).alias("at", "cells")).withColumn("label", F.trim(F.get("cells", F.lit(0))))
    low = F.lower("label")
    w = Window.partitionBy(*key).orderBy("at")
    section = F.lit(None).cast("string")
    for name, words in reversed(SECTIONS):
        section = F.when(~low.contains("net") & ~low.contains("total") & low.rlike("|".join(words)) & (F.size(F.filter("cells", lambda c: tx.number(c).isNotNull())) == 0), name).otherwise(section)
    marked = wide.withColumn("section", F.last(section, True).over(w)).withColumn("below", F.coalesce(F.max(low.rlike("net operating income|^noi")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)) | low.rlike("|".join(BELOW_LINE)))
    cells = marked.select(*key, "at", "label", "section", "below", F.posexplode(F.arrays_zip(F.col(headers).alias("h"), F.col("cells").alias("c"))).alias("column", "x")).filter(F.col("column") > 0)
    header = F.coalesce(F.col("x.h"), F.lit(""))
    suffix = F.upper(F.substring(F.regexp_extract(header, year, 2), 1, 1))
    kept = cells.withColumn("year", F.regexp_extract(header, year, 1).try_cast("int")).filter(F.col("year").isNotNull() & ~F.lower(header).rlike("var|%|change|diff"))
    kept = kept.withColumn("period", F.concat(F.col("year").cast("string"), F.when(suffix.isin("A", "B", "F", "P"), suffix).when(suffix == "R", "F").otherwise("A"))).withColumn("amount", tx.number(F.col("x.c"))).filter("amount is not null")
    subtotal = F.lower("label").contains("total")
    return best_per_key(kept, [*key, "at", "period"], F.col("column")).select(*key, "at", "label", "period", "amount", F.coalesce("section", F.lit("other")).alias("category"), F.col("below").alias("below_the_line"), subtotal.alias("is_subtotal"))


def best_sheets(lines: DataFrame, document: str, sheet: str) -> DataFrame:
    """Of several sheets that give one period, the one with the largest amounts, then the most lines; then each (category, line, period) once."""
    score = lines.groupBy(document, sheet, "period").agg(F.sum(F.abs("amount")).alias("s"), F.count("*").alias("n"))
    best = best_per_key(score, [document, "period"], F.desc("s"), F.desc("n"), F.col(sheet)).select(document, sheet, "period")
    return best_per_key(lines.join(best, [document, sheet, "period"], "left_semi"), [document, "period", "category", "label"], F.desc(F.abs("amount")), F.col("at"))


def mapped_columns(tables: DataFrame, key: list[str], aliases: dict[str, list[str]], headers: str = "headers", rows: str = "rows") -> DataFrame:
    """Table cells by template column: a header that equals or contains an alias; of several the first column, of one header the first template column."""
    spark = tables.sparkSession
    names = spark.createDataFrame([(k, name, a.lower()) for k, (name, xs) in enumerate(aliases.items()) for a in (name.replace("_", " "), *xs)], "ord int, field string, alias string")
    heads = tables.select(*key, F.posexplode(headers).alias("column", "h")).withColumn("h", F.lower(F.trim("h")))
    hit = heads.crossJoin(F.broadcast(names)).filter((F.col("h") == F.col("alias")) | F.col("h").contains(F.col("alias")))  # a template's aliases
    exact = (F.col("h") == F.col("alias")).cast("int")
    one = best_per_key(best_per_key(hit, [*key, "column"], F.desc(exact), F.col("ord")), [*key, "field"], F.col("column")).select(*key, "column", "field")
    cells = tables.select(*key, F.posexplode(rows).alias("at", "cells")).select(*key, "at", F.posexplode("cells").alias("column", "value"))
    # Spark takes exploded cells and headers for as few as the tables, so neither is to be sent to all executors
    return cells.hint("merge").join(one, [*key, "column"]).groupBy(*key, "at").pivot("field", list(aliases)).agg(F.first("value"))


def cascade(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of the first source; of documents that it has none for, those of the second."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)
