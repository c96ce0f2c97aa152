"""Financial synthesis: multi-source, multi-period reconciliation of operating statements, for all properties at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How far a document type is trusted for financial data (fixed values).
AUTHORITY = {
    "general_ledger": 5, "operating_statement": 4, "rent_roll": 4, "closing": 3, "due_diligence": 2, "proforma": 2, "equity_waterfall": 2, "loan": 2, "guarantee": 1,
    "lease": 1, "hud_form": 3, "cost_certification": 3, "partnership_agreement": 1, "organizational": 0, "reference": 0,
}
#: Order of period suffixes within a year (fixed values).
SUFFIX = {"A": 0, "ACTUAL": 0, "ACTUALS": 0, "B": 1, "BUDGET": 1, "F": 2, "FORECAST": 2, "REFORECAST": 2, "P": 3, "PROFORMA": 3}
TOLERANCE = 0.005
PERIOD = r"^(\d{4})\s*([A-Za-z]*)"
KEY = ["property_id", "period"]


def lookup(c: Column, table: dict, default) -> Column:
    """A small fixed table as an expression."""
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def authority(document_type: Column) -> Column:
    return lookup(document_type, AUTHORITY, 0)


def period_year(period: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.coalesce(period, F.lit("")), PERIOD, 1).try_cast("int"), F.lit(9999))


def period_order(period: Column) -> Column:
    """Position of the suffix within the year: actual, budget, forecast, pro forma; 10 for others, 99 if there is no year."""
    text = F.coalesce(period, F.lit(""))
    return F.when(F.regexp_extract(text, PERIOD, 1) == "", 99).otherwise(lookup(F.upper(F.regexp_extract(text, PERIOD, 2)), SUFFIX, 10))


def amounts_match(a: Column, b: Column) -> Column:
    """Equal, or both non-zero and within half a percent of the larger."""
    return F.when(a == b, True).when((a == 0) | (b == 0), False).otherwise(F.abs(a - b) / F.greatest(F.abs(a), F.abs(b)) < TOLERANCE)


def grouped(items: DataFrame, as_of_year: int) -> DataFrame:
    """Items with a period (null: "Unknown"), without those over twelve years ahead."""
    named = items.withColumn("period", F.coalesce("period", F.lit("Unknown")))
    year = period_year(F.col("period"))
    return named.filter((year == 9999) | (year <= as_of_year + 12))


def _detail() -> Column:
    return ~F.coalesce("is_subtotal", F.lit(False)) & ~F.coalesce("is_total", F.lit(False))


def primary_documents(items: DataFrame) -> DataFrame:
    """The document with most detail items of a property and period; ties to the least id."""
    counts = items.filter(_detail() & F.col("category").isin("income", "revenue", "expense")).groupBy(*KEY, "document_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*KEY).orderBy(F.desc("n"), "document_id")
    return counts.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(*KEY, F.col("document_id").alias("primary_doc"), F.col("n").alias("primary_items"))


def _subtotal_score(side: str) -> Column:
    line = F.lower(F.coalesce("line_item", F.lit("")))
    has = lambda x: line.contains(x)
    if side == "expense":
        return F.when(has("total") & (has("opex") | has("operating") | has("expense")), 10).when(has("opex") & ~has("total"), 5).otherwise(0)
    return F.when(has("total") & (has("revenue") | has("income")), 10).when(has("total"), 5).otherwise(0)


def _best_subtotal(items: DataFrame, side: str) -> DataFrame:
    """The most total-like positive subtotal of the side; then authority, then the largest amount."""
    rows = items.filter(~_detail() & (F.col("category") == side) & (F.col("amount") > 0)).withColumn("_s", _subtotal_score(side)).filter("_s > 0")
    return rows.groupBy(*KEY).agg(F.max(F.struct("_s", authority(F.col("document_type")).alias("a"), "amount"))["amount"].alias(f"best_{side}"))


def reported_noi(items: DataFrame) -> DataFrame:
    line = F.lower(F.coalesce("line_item", F.lit("")))
    return items.filter(~_detail() & (line.contains("noi") | line.contains("net operating")) & (F.col("amount") != 0))


def synthesize(items: DataFrame, as_of_year: int) -> DataFrame:
    """One row per property and period: totals of the primary document, reported NOI, sources, discrepancies and quality."""
    rows = grouped(items, as_of_year)
    primary = primary_documents(rows)
    money = F.col("amount").cast("decimal(18,2)")
    mine = rows.join(primary, KEY, "left").filter(_detail() & (F.col("primary_doc").isNull() | (F.col("document_id") == F.col("primary_doc"))))
    side = lambda *names: F.col("category").isin(*names)
    totals = mine.groupBy(*KEY).agg(
        F.sum(F.when(side("income", "revenue"), money)).alias("_in"), F.sum(F.when(side("expense"), money)).alias("_out"),
        F.count(F.when(side("income", "revenue"), 1)).alias("n_income"), F.count(F.when(side("expense"), 1)).alias("n_expense"),
    )
    sources = rows.groupBy(*KEY, "document_id").agg(F.max(authority(F.col("document_type"))).alias("a")).groupBy(*KEY).agg(F.count("*").alias("source_count"), F.max("a").alias("top_authority"))
    noi = reported_noi(rows).groupBy(*KEY).agg(F.count("*").alias("n_reported"), F.min(money).alias("min_noi"), F.max(money).alias("max_noi"))
    out = sources.join(primary, KEY, "left").join(totals, KEY, "left").join(_best_subtotal(rows, "income"), KEY, "left").join(_best_subtotal(rows, "expense"), KEY, "left").join(noi, KEY, "left")
    zero = F.lit(0)
    out = out.withColumns({c: F.coalesce(c, zero) for c in ("n_income", "n_expense", "n_reported")})
    pick = lambda total, n, best: F.coalesce(F.when(F.col(n) == 0, F.coalesce(best, zero)).otherwise(F.col(total)), zero).cast("double")
    out = out.withColumn("total_income", pick("_in", "n_income", "best_income")).withColumn("total_expenses", pick("_out", "n_expense", "best_expense"))
    out = out.withColumn("calculated_noi", F.round(F.col("total_income") - F.col("total_expenses"), 2))
    closest = (
        reported_noi(rows).select(*KEY, money.cast("double").alias("r")).join(out.select(*KEY, "calculated_noi"), KEY)
        .groupBy(*KEY).agg(F.min(F.struct(F.abs(F.col("r") - F.col("calculated_noi")).alias("d"), "r"))["r"].alias("closest_noi"))
    )
    i, e, n = F.col("total_income"), F.col("total_expenses"), F.col("n_income") + F.col("n_expense")
    both = (i > 0) & (e > 0)
    quality = (
        F.when(i < 0, "low").when(both & (F.least(i, e) / F.greatest(i, e) < 0.10), "low").when((F.col("n_income") >= 3) & (F.col("n_expense") >= 3), "high")
        .when(((F.col("n_income") >= 3) | (F.col("n_expense") >= 3)) & both, "high").when(both & (F.col("n_reported") > 0), "medium").when(((i > 0) | (e > 0)) & (n >= 3), "medium").otherwise("low")
    )
    disagree = (F.col("n_reported") >= 2) & ~amounts_match(F.col("min_noi").cast("double"), F.col("max_noi").cast("double"))
    differs = (F.col("n_reported") > 0) & (F.col("calculated_noi") != 0) & ~amounts_match(F.col("closest_noi"), F.col("calculated_noi"))
    return out.join(closest, KEY, "left").select(
        *KEY, "source_count", "top_authority", "primary_doc", F.col("n_income").cast("long").alias("n_income"), F.col("n_expense").cast("long").alias("n_expense"), "total_income", "total_expenses",
        "calculated_noi", F.col("n_reported").cast("long").alias("n_reported"), "closest_noi", quality.alias("quality"), F.coalesce(disagree, F.lit(False)).alias("noi_disagree"), F.coalesce(differs, F.lit(False)).alias("noi_differs"),
    )


def noi_timeline(periods: DataFrame) -> DataFrame:
    """Periods of high or medium quality in their order, with the position."""
    w = Window.partitionBy("property_id").orderBy(period_year(F.col("period")), period_order(F.col("period")), "period")
    return periods.filter(F.col("quality").isin("high", "medium")).withColumn("position", F.row_number().over(w))


def reconcile_lines(items: DataFrame) -> DataFrame:
    """A line item that several documents report: the most authoritative value, and how many others differ from it."""
    by = [*KEY, "category", "line"]
    named = items.filter(_detail()).withColumn("line", F.lower(F.trim("line_item")))
    w = Window.partitionBy(*by).orderBy(F.desc(authority(F.col("document_type"))), "document_id", "page_number", F.desc("amount"))
    first = lambda c: F.first(c).over(w)
    marked = named.withColumns({"_amount": first("amount"), "_doc": first("document_id"), "_r": F.row_number().over(w)})
    other = (F.col("_r") > 1) & (F.col("amount") != 0) & (F.col("_amount") != 0) & ~amounts_match(F.col("amount"), F.col("_amount"))
    return marked.groupBy(*by).agg(F.min("_amount").alias("amount"), F.min("_doc").alias("document_id"), F.count("*").alias("reports"), F.count(F.when(other, 1)).alias("alternates"))


def compare_to_validated(periods: DataFrame, validated: DataFrame) -> DataFrame:
    """Calculated against validated NOI: difference, percentage, and whether they match."""
    diff = F.col("calculated_noi") - F.col("validated_noi")
    return periods.join(validated, KEY).select(*KEY, "calculated_noi", "validated_noi", diff.alias("diff"), F.expr("try_divide(calculated_noi - validated_noi, abs(validated_noi)) * 100").alias("diff_pct"), amounts_match(F.col("calculated_noi"), F.col("validated_noi")).alias("matches"))


def portfolio_comparison(periods: DataFrame, wanted: list[str]) -> DataFrame:
    """Properties by period: NOI side by side."""
    return periods.groupBy("property_id").pivot("period", wanted).agg(F.first("calculated_noi"))


def cited(items: DataFrame) -> DataFrame:
    """Line items as cited values: value and a list of citations with locator, verbatim text, confidence and method."""
    citation = F.struct(
        F.col("document_id"), F.struct(F.col("page_number")).alias("locator"), F.format_number("amount", 2).alias("verbatim"),
        F.when(_detail(), 0.9).otherwise(0.7).alias("confidence"), F.lit("table_extraction").alias("method"),
    )
    return items.select(*KEY, "category", "line_item", F.struct(F.col("amount").alias("value"), F.array(citation).alias("citations"), F.lit(None).cast("string").alias("note")).alias("cited"))


def cited_rollup(rows: DataFrame) -> DataFrame:
    """Sums by period and category that keep the ids of the documents they rest on."""
    return rows.groupBy(*KEY, "category").agg(F.sum("cited.value").alias("value"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("cited.citations.document_id")))).alias("documents"), F.min("cited.citations")[0]["confidence"].alias("confidence"))


def reconcile_sources(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Two sources by key (a full join): both values, the difference and its share."""
    joined = a.select(key, F.col(value).alias("first")).join(b.select(key, F.col(value).alias("second")), key, "full")
    return joined.withColumn("delta", F.col("first") - F.col("second")).withColumn("delta_pct", F.expr("try_divide(first - second, abs(second)) * 100"))


#: Tiers of citations by document type, and what a statement's document counts as (fixed values).
TIERS = {
    "general_ledger": "PRIMARY", "operating_statement": "PRIMARY", "rent_roll": "PRIMARY", "closing": "SECONDARY", "hud_form": "SECONDARY", "cost_cert": "SECONDARY", "proforma": "SECONDARY", "equity_waterfall": "SECONDARY", "loan": "SECONDARY",
    "due_diligence": "TERTIARY", "partnership_agreement": "TERTIARY", "organizational": "TERTIARY", "reference": "TERTIARY", "budget": "SECONDARY",
}
SOURCE_TYPES = {
    "operating_statement": "MRI_INCOME_STATEMENT", "rent_roll": "RENT_ROLL", "general_ledger": "GL_EXPORT", "proforma": "VALUATION_PROFORMA", "closing": "CLOSING_STATEMENT", "hud_form": "CLOSING_STATEMENT", "loan": "LOAN_AGREEMENT",
    "partnership_agreement": "LLC_AGREEMENT", "organizational": "LLC_AGREEMENT", "equity_waterfall": "WATERFALL_CALC", "due_diligence": "ACCOUNTANT_WORKPAPER", "reference": "OTHER", "cost_cert": "CLOSING_STATEMENT", "budget": "BUDGET_FILE",
}


def tier(document_type: Column) -> Column:
    """How a citation of the document counts; unlisted types are tertiary."""
    return lookup(document_type, TIERS, "TERTIARY")


def source_type(document_type: Column) -> Column:
    return lookup(document_type, SOURCE_TYPES, "OTHER")


def registered(documents: DataFrame) -> DataFrame:
    """Documents -> the registry of sources: (source_id, title, source_type, tier)."""
    return documents.select(F.col("document_id").cast("string").alias("source_id"), F.col("filename").alias("title"), source_type(F.col("document_type")).alias("source_type"), tier(F.col("document_type")).alias("tier"))


def by_tier(cited_items: DataFrame, registry: DataFrame) -> DataFrame:
    """Cited line items -> amounts by period, category and tier of their source, with the share of the period's category that rests on it."""
    rows = cited_items.select(*KEY, "category", F.col("cited.value").alias("value"), F.explode("cited.citations.document_id").alias("source_id")).join(registry.select("source_id", "tier"), "source_id", "left")
    money = F.sum(F.col("value").cast("decimal(18,2)"))
    sums = rows.groupBy(*KEY, "category", F.coalesce("tier", F.lit("TERTIARY")).alias("tier")).agg(money.alias("amount"), F.count("*").alias("items"))
    whole = sums.groupBy(*KEY, "category").agg(F.sum("amount").alias("_all"))
    return sums.join(whole, [*KEY, "category"]).select(*KEY, "category", "tier", F.col("amount").cast("double").alias("amount"), "items", F.expr("try_divide(cast(amount as double), cast(_all as double))").alias("share"))


def notes(periods: DataFrame, items: DataFrame) -> DataFrame:
    """A property's notes: the span of its periods, the number of its documents, periods with discrepancies, and those that are projections.

    A projection is a period whose name holds a B or an F, as budgets' and forecasts' do.
    """
    order = F.struct(period_year(F.col("period")), period_order(F.col("period")), "period")
    is_plan = F.upper("period").rlike("B|F")
    sums = periods.groupBy("property_id").agg(
        F.count("*").alias("n_periods"), F.min_by("period", order).alias("first_period"), F.max_by("period", order).alias("last_period"), F.count_if(F.col("noi_disagree") | F.col("noi_differs")).alias("n_discrepancies"),
        F.array_sort(F.collect_list(F.when(is_plan, F.struct(period_year(F.col("period")).alias("y"), period_order(F.col("period")).alias("o"), "period")))).alias("_plans"),
    )
    docs = items.groupBy("property_id").agg(F.count_distinct("document_id").alias("n_documents"))
    rows = docs.join(sums, "property_id", "left").withColumn("plans", F.coalesce(F.transform("_plans", lambda x: x["period"]), F.array().cast("array<string>")))
    spelled = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    n = lambda c: F.col(c).cast("string")
    lines = F.array(
        spelled("Financial data spans ", n("n_periods"), " periods: ", F.col("first_period"), " through ", F.col("last_period"), "."), spelled("Data sourced from ", n("n_documents"), " document(s)."),
        F.when(F.col("n_discrepancies") > 0, spelled(n("n_discrepancies"), " of ", n("n_periods"), " periods have discrepancies between source documents. See period-level notes for details.")),
        F.when(F.size("plans") > 0, spelled("Budget/forecast periods detected: ", F.array_join("plans", ", "), ". These contain projected figures, not actuals.")),
    )
    said = F.when(F.col("n_periods").isNull(), F.array(F.lit("No financial periods found."))).otherwise(F.array_compact(lines))
    return rows.select("property_id", F.coalesce("n_periods", F.lit(0)).alias("n_periods"), "n_documents", F.coalesce("n_discrepancies", F.lit(0)).alias("n_discrepancies"), "plans", said.alias("notes"))
