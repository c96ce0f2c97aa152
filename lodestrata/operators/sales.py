"""Sales comps: search, comparables, trends, owners and market summaries over transactions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import beside, quantiles

#: What a search may be sorted by (fixed values).
SORTS = {"sale_date": "sale_date", "sale_price": "sale_price", "cap_rate": "cap_rate_actual", "ppu": "price_per_unit", "units": "num_units", "market": "market"}
MOST_ROWS = 500


def whole_sum(column: str) -> Column:
    """A sum of money as a whole number, summed in cents: the same whatever the order of the rows."""
    return F.round(F.sum(F.col(column).cast("decimal(18,2)"))).cast("long")


def contains(column: str, part: str) -> Column:
    """Case-insensitive substring; % and _ are literal."""
    return F.lower(column).contains(part.lower())


def matching(filters: dict) -> Column:
    """A conjunction of the filters that are set: {column: value}, {column__min / __max: bound}, {column__has: part} (a tuple of columns: any)."""

    def one(key, value) -> Column:
        name, _, how = key.partition("__")
        if how == "min":
            return F.col(name) >= value
        if how == "max":
            return F.col(name) <= value
        if how == "has":
            return reduce(lambda a, b: a | b, (contains(c, value) for c in name.split("|")))
        if how == "in":
            return F.col(name).isin(list(value))
        return F.col(name) == value

    return reduce(lambda a, b: a & b, (one(k, v) for k, v in filters.items() if v), F.lit(True))


def search(sales: DataFrame, filters: dict, sort_by: str = "sale_date", ascending: bool = False, limit: int = 100, key: str = "transaction_id") -> DataFrame:
    """Transactions that match, nulls last either way; unknown sort names mean the date. Ties are broken by ``key``."""
    c = F.col(SORTS.get(sort_by, "sale_date"))
    return sales.filter(matching(filters)).orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last(), key).limit(min(limit, MOST_ROWS))


def comps(sales: DataFrame, market: str, num_units: int | None = None, year_built: int | None = None, building_class: str | None = None, radius_years: int = 3, radius_units: float = 0.5, limit: int = 25) -> DataFrame:
    """Comparable sales: unit count within a share (bounds truncated), year built within five times the radius."""
    wanted = (F.col("market") == market) & F.col("sale_price").isNotNull()
    if num_units and radius_units:
        wanted &= F.col("num_units").between(int(num_units * (1 - radius_units)), int(num_units * (1 + radius_units)))
    if year_built and radius_years:
        wanted &= F.col("year_built").between(year_built - radius_years * 5, year_built + radius_years * 5)
    if building_class:
        wanted &= F.col("building_class") == building_class
    return sales.filter(wanted).orderBy(F.desc("sale_date"), "transaction_id").limit(limit)


def _in_sets(rows: DataFrame, columns: list[str], sets: dict[int, list[str]]) -> DataFrame:
    """Every row once a grouping set, whose number is ``g``; columns outside the set are null."""
    out = rows.withColumn("g", F.explode(F.array(*map(F.lit, sets))))
    return out.withColumns({c: F.when(F.col("g").isin(*[g for g, within in sets.items() if c in within]), F.col(c)) for c in columns})


def cap_rate_cube(sales: DataFrame) -> DataFrame:
    """Cap-rate aggregates at three granularities, from one pass over the sales with grouping sets."""
    rates = sales.filter("cap_rate_actual is not null").select("market", "asset_class", F.col("sale_year").cast("string").alias("year"), F.col("sale_quarter").alias("quarter"), "cap_rate_actual")
    cols = ["market", "asset_class", "year", "quarter"]
    rows = _in_sets(rates, cols, {0: ["market", "asset_class", "year"], 1: ["asset_class", "year"], 2: ["quarter"]})
    grouped = rows.groupBy("g", *cols).agg(F.count("cap_rate_actual").alias("n_deals"), F.avg("cap_rate_actual").alias("cap_rate_mean"), F.stddev_samp("cap_rate_actual").alias("cap_rate_std"))
    shares = {f"cap_rate_{n}": ("cap_rate_actual", p) for n, p in (("median", 0.5), ("p25", 0.25), ("p75", 0.75))}
    grouped = beside(grouped, quantiles(rows, ["g", *cols], shares), ["g", *cols], "left")
    kind = lambda a, b, c: F.when(F.col("g") == 0, a).when(F.col("g") == 1, b).otherwise(c)
    return grouped.select("market", "asset_class", F.coalesce("year", "quarter").alias("period"), kind("year", "year", "quarter").alias("period_type"), kind("market", "national_by_class", "national").alias("granularity"),
                          "n_deals", "cap_rate_median", "cap_rate_mean", "cap_rate_std", "cap_rate_p25", "cap_rate_p75")


def pricing_cube(sales: DataFrame) -> DataFrame:
    """Pricing aggregates by year: national, by market, by market and class."""
    cols = ["market", "building_class", "sale_year"]
    rows = _in_sets(sales.select(*cols, "sale_price", "price_per_unit"), cols, {0: cols, 1: ["market", "sale_year"], 2: ["sale_year"]})
    grouped = rows.groupBy("g", *cols).agg(F.count("*").alias("n_deals"), F.sum("sale_price").alias("total_volume"), F.avg("price_per_unit").alias("mean_ppu"))
    shares = {"median_price": ("sale_price", 0.5), "median_ppu": ("price_per_unit", 0.5), "p25_ppu": ("price_per_unit", 0.25), "p75_ppu": ("price_per_unit", 0.75)}
    grouped = beside(grouped, quantiles(rows, ["g", *cols], shares), ["g", *cols], "left")
    kind = F.when(F.col("g") == 0, "market_by_class").when(F.col("g") == 1, "market").otherwise("national")
    return grouped.withColumn("granularity", kind).drop("g")


def national_pricing(sales: DataFrame) -> DataFrame:
    """The cube's national rows, with deals and the median price per unit."""
    rows = sales.select("sale_year", "price_per_unit")
    medians = quantiles(rows, ["sale_year"], {"median_ppu": ("price_per_unit", 0.5)})
    out = beside(rows.groupBy("sale_year").agg(F.count("*").alias("n_deals")), medians, ["sale_year"], "left")
    none = F.lit(None).cast("string")
    return out.select(none.alias("market"), none.alias("building_class"), "sale_year", "n_deals", "median_ppu", F.lit("national").alias("granularity"))


def market_medians(sales: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the cubes say of markets by year: (market, asset_class, period, cap_rate_median) and (market, sale_year, median_ppu), with the cubes' kinds. Both come from one pass over the sales; groups without a value have no row."""
    one = lambda kind, by, value: F.struct(F.lit(kind).alias("kind"), by.alias("asset_class"), F.col(value).alias("value"))
    both = F.explode(F.array(one("cap", F.col("asset_class"), "cap_rate_actual"), one("ppu", F.lit(None).cast("string"), "price_per_unit"))).alias("_s")
    found = quantiles(sales.select("market", "sale_year", both).select("market", "sale_year", "_s.*"), ["kind", "market", "asset_class", "sale_year"], {"median": ("value", 0.5)})
    found = found.withColumns({"period_type": F.lit("year"), "granularity": F.lit("market")})
    caps = found.filter("kind = 'cap'").select("market", "asset_class", F.col("sale_year").cast("string").alias("period"), "period_type", "granularity", F.col("median").alias("cap_rate_median"))
    return caps, found.filter("kind = 'ppu'").select("market", "sale_year", "granularity", F.col("median").alias("median_ppu"))


def cap_rate_trend(cube: DataFrame, market: str | None = None, period_type: str = "year", asset_class: str | None = None) -> DataFrame:
    """One series: a market's, or the national one (by class for years, overall for quarters)."""
    wanted = F.col("period_type") == period_type
    wanted &= (F.col("market") == market) & (F.col("granularity") == "market") if market else F.col("granularity") == ("national_by_class" if period_type == "year" else "national")
    if asset_class:
        wanted &= F.col("asset_class") == asset_class
    return cube.filter(wanted).orderBy(F.asc_nulls_last("asset_class"), "period")


def cap_rate_snapshot(cube: DataFrame, period: str | None = None) -> DataFrame:
    """All markets at one year; by default the latest, found by a scalar join."""
    yearly = cube.filter("period_type = 'year'")
    if period:
        wanted = yearly.filter(F.col("period") == period)
    else:
        wanted = yearly.join(F.broadcast(yearly.agg(F.max("period").alias("period"))), "period")  # one row
    return wanted.filter("granularity = 'market'")


def pricing_trend(cube: DataFrame, market: str | None = None, building_class: str | None = None) -> DataFrame:
    if market:
        wanted = (F.col("market") == market) & (F.col("granularity") == ("market_by_class" if building_class else "market"))
    else:
        wanted = F.col("granularity").like("%class%") if building_class else F.col("granularity") == "national"
    return cube.filter(wanted & (F.col("building_class") == building_class) if building_class else wanted).orderBy("sale_year", F.asc_nulls_last("market"))


def market_summary(sales: DataFrame, by: list[str]) -> DataFrame:
    """Deals, volumes, medians and years of each group of priced sales."""
    priced = sales.filter("sale_price is not null")
    aggs = [
        F.count("*").alias("deals"), F.count("cap_rate_actual").alias("has_cap_rate"), whole_sum("sale_price").alias("total_volume"),
        F.min("sale_year").alias("min_year"), F.max("sale_year").alias("max_year"),
    ]
    medians = quantiles(priced, by, {"median_price": ("sale_price", 0.5), "median_cap_rate": ("cap_rate_actual", 0.5), "median_ppu": ("price_per_unit", 0.5)})
    out = beside(priced.groupBy(*by).agg(*aggs), medians, by, "left").withColumn("median_price", F.bround("median_price").cast("long"))
    return out.select(*by, "deals", "has_cap_rate", "median_price", "total_volume", "median_cap_rate", "median_ppu", "min_year", "max_year")


def top_players(sales: DataFrame, side: str, most: int = 10) -> DataFrame:
    """Each market's buyers or sellers by deals; ties by name."""
    deals = sales.filter(F.col(side).isNotNull()).groupBy("market", F.col(side).alias("name")).agg(F.count("*").alias("deals"), whole_sum("sale_price").alias("volume"))
    w = Window.partitionBy("market").orderBy(F.desc("deals"), "name")
    return deals.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def owner_search(ownership: DataFrame, part: str, limit: int = 50) -> DataFrame:
    return (
        ownership.filter(contains("owner_canonical", part))
        .groupBy("owner_canonical")
        .agg(
            F.count_distinct("property_id").alias("properties"), F.count(F.when(F.col("is_current"), 1)).alias("current_holdings"), whole_sum("acquisition_price").alias("total_acquired"),
            F.min("acquisition_date").alias("earliest"), F.max("acquisition_date").alias("latest"), F.avg("hold_months").alias("avg_hold"),
        )
        .orderBy(F.desc("properties"), "owner_canonical")
        .limit(limit)
    )


def owner_portfolio(ownership: DataFrame, sales: DataFrame, owner: str) -> DataFrame:
    """An owner's holdings with what the transactions say of the property: one row per (property, acquisition), the first by transaction id."""
    own = ownership.filter(F.lower("owner_canonical") == owner.lower())
    facts = sales.select("property_id", F.struct("transaction_id", "property_name", "market", "num_units").alias("t")).groupBy("property_id").agg(F.min("t").alias("t"))
    w = Window.partitionBy("property_id", "acquisition_date").orderBy("ownership_id")
    first = own.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return first.join(facts, "property_id", "left").select(first["*"], "t.property_name", "t.market", "t.num_units")


def ownership_history(ownership: DataFrame, property_id) -> DataFrame:
    return ownership.filter(F.col("property_id") == property_id).orderBy(F.asc_nulls_last("acquisition_date"), "ownership_id")
