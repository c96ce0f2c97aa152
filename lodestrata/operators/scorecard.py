"""Market scorecard: signals from the warehouse, the tilt arithmetic, duration weights and tier-weighted ranks, for all markets in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: (cap, weight of impact, floor) of the category, volatility and period multipliers (fixed values).
CATEGORY, VOLATILITY, PERIOD = (3.0, 0.25, 0.25), (3.0, 0.35, 0.25), (3.0, 0.20, 0.25)
#: Weights of periods and their signals by area: demand and supply, occupancy, rent (fixed values).
PERIODS = {"Q1": 0.00, "Annual": 0.10, "2Yr": 0.15, "3Yr": 0.00, "5Yr": 0.25, "10Yr": 0.50}
DS_SIGNAL = {"Q1": 1.1311, "Annual": 0.9838, "2Yr": 0.9178, "3Yr": 0.9080, "5Yr": 0.8984, "10Yr": 0.8695, "12Yr": 0.8550}
OCC_SIGNAL = {"Q1": 0.9000, "Annual": 0.8200, "2Yr": 0.7800, "3Yr": 0.7400, "5Yr": 0.7000, "10Yr": 0.6500, "12Yr": 0.6200}
RENT_SIGNAL = {"Q1": 0.6673, "Annual": 0.6349, "2Yr": 0.6123, "3Yr": 0.5266, "5Yr": 0.4409, "10Yr": 0.3554, "12Yr": 0.3200}
#: Metric weights by area (fixed values).
DS = {"absorption": 1.0, "deliveries": 1.0, "abs_del": 1.0, "sf_permits_yoy": 0.50, "renter_weighted_pop_yoy": 0.50, "pop_20_34_share": 0.25}
OCC = {"blended_occ": 1.0, "under_construction": 1.0, "yrs_to_stab": 1.0}
RENT = {"eff_rent_overall": 1.0, "eff_rent_1br": 1.0, "eff_rent_studio": 1.0, "eff_rent_2br": 1.0, "eff_rent_3br": 1.0}
AREAS = {"ds": (DS, DS_SIGNAL, 0.35), "occ": (OCC, OCC_SIGNAL, 0.25), "rent": (RENT, RENT_SIGNAL, 0.40)}
TIERS = {"All": 0.40, "4 & 5 Star": 0.25, "3 Star": 0.25, "1 & 2 Star": 0.10}
MOMENTUM_KNOB, Z_CAP, LEAST_YEARS = 0.35, 3.0, 3
ACTUAL_OCC, EFFECTIVE_OCC = 0.35, 0.65
#: Period weights by years of analysis (fixed values).
DURATIONS = {
    1: {"Q1": 0.75, "Annual": 0.25}, 2: {"Q1": 0.50, "Annual": 0.30, "2Yr": 0.20}, 3: {"Q1": 0.25, "Annual": 0.25, "2Yr": 0.25, "3Yr": 0.25}, 4: {"Q1": 0.25, "Annual": 0.40, "2Yr": 0.35},
    5: {"Q1": 0.25, "Annual": 0.50, "5Yr": 0.25}, 6: {"Q1": 0.10, "Annual": 0.30, "2Yr": 0.30, "3Yr": 0.30}, 9: {"Annual": 0.30, "3Yr": 0.70}, 10: {"Annual": 0.10, "2Yr": 0.15, "5Yr": 0.25, "10Yr": 0.50},
    12: {"Annual": 0.25, "2Yr": 0.40, "3Yr": 0.35}, 15: {"Annual": 0.10, "3Yr": 0.30, "5Yr": 0.60}, 20: {"2Yr": 0.20, "5Yr": 0.30, "10Yr": 0.50},
}


def duration_weights(years: int) -> dict[str, float]:
    """The table's row, or a linear mix of the rows around it; beyond its ends the end rows."""
    known = sorted(DURATIONS)
    low = max((k for k in known if k <= years), default=known[0])
    high = min((k for k in known if k >= years), default=known[-1])
    at = 0.0 if low == high else (years - low) / (high - low)
    return {p: DURATIONS[low].get(p, 0.0) * (1 - at) + DURATIONS[high].get(p, 0.0) * at for p in PERIODS}


def asymmetric(z: Column, factor: Column) -> Column:
    """A factor raises good scores and softens bad ones; 0 or NaN changes nothing."""
    return F.when((factor == 0) | F.isnan(factor) | F.isnan(z), z).when(z >= 0, z * factor).otherwise(z / factor)


def bounded(z: Column, indicator: tuple[float, float, float]) -> Column:
    cap, weight, floor = indicator
    return F.when(F.isnan(z), 1.0).otherwise(F.least(F.lit(cap), F.greatest(F.lit(floor), 1 + weight * z)))


def clamp(z: Column, most: float = Z_CAP) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(-most), z))


def total_z(signal: Column, volatility: Column, category: Column) -> Column:
    return clamp(asymmetric(signal * bounded(category, CATEGORY), bounded(volatility, VOLATILITY)))


def momentum_decay(step: Column, half_life: float) -> Column:
    return F.pow(F.lit(2.0), -step / half_life)


def momentum_weight(step: Column, half_life: float, most: float) -> Column:
    return 1 + most * momentum_decay(step, half_life)


def momentum_effective(tilt: Column, knob: float = MOMENTUM_KNOB) -> Column:
    return F.when(F.isnan(tilt) | (tilt <= 0) | F.lit(knob == 0), 1.0).otherwise(F.pow(tilt, F.lit(knob)))


def dispersion(score: Column, z: Column, weight: float = 0.0, cap: float = 2.0, floor: float = 0.5) -> Column:
    return score if weight == 0 else asymmetric(score, F.least(F.lit(cap), F.greatest(F.lit(floor), 1 + weight * z)))


def category_z(value: Column, values: Column) -> Column:
    """Against a list of values: at least two, with a sample deviation above zero; else 0."""
    clean = F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x))
    n = F.size(clean)
    mean = F.aggregate(clean, F.lit(0.0), lambda a, x: a + x) / n
    var = F.aggregate(clean, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / (n - 1)
    return F.when(value.isNull() | F.isnan(value) | (n < 2), 0.0).otherwise(F.when(var > 1e-30, (value - mean) / F.sqrt(var)).otherwise(0.0))


def cross_market_z(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """A signal's z across markets; 0 below three markets or without spread."""
    w = Window.partitionBy(*by)
    std = F.stddev_samp(value).over(w)
    return rows.withColumn("signal_z", F.when((F.count(value).over(w) >= 3) & (std > 0), (F.col(value) - F.avg(value).over(w)) / std).otherwise(0.0))


def latest(rows: DataFrame, by: str, year: str, most: int = 12) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(year))
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most)


def scoreable(cube: DataFrame, sales: DataFrame) -> DataFrame:
    """Markets that have both cap rates and sales."""
    return cube.filter("granularity = 'market' and market is not null").select("market").intersect(sales.filter("market is not null").select("market"))


def signals(cube: DataFrame, pricing: DataFrame, sales: DataFrame, properties: DataFrame, z: DataFrame) -> DataFrame:
    """One row per market with the raw signals: all markets at once instead of four queries each. Markets with under three yearly cap rates drop out."""
    caps = cube.filter("period_type = 'year' and granularity = 'market' and cap_rate_median is not null").groupBy("market", "period").agg(F.avg("cap_rate_median").alias("m"))
    ranked = latest(caps, "market", "period")
    by_cap = ranked.groupBy("market").agg(
        F.count("*").alias("years"), F.avg(F.when(F.col("_r") <= 3, F.col("m"))).alias("cap3"), F.stddev_pop(F.when(F.col("_r") <= 5, F.col("m"))).alias("vol5"), F.array_sort(F.collect_list("m")).alias("caps")
    )
    ppu = latest(pricing.filter("granularity = 'market' and median_ppu is not null"), "market", "sale_year")
    by_ppu = ppu.groupBy("market").agg(F.max_by("median_ppu", "sale_year").alias("new"), F.min_by("median_ppu", "sale_year").alias("old"), F.count("*").alias("n_ppu"))
    mean_z = z.join(properties.select("property_id", "market"), "property_id").groupBy("market").agg(F.avg("z_score").alias("avg_z"))
    out = scoreable(cube, sales).join(by_cap.filter(F.col("years") >= LEAST_YEARS), "market").join(by_ppu, "market", "left").join(mean_z, "market", "left")
    rent = F.when(F.col("n_ppu") >= 2, F.expr("coalesce(try_divide(new - old, old), 0)")).otherwise(0.0)
    volatility = F.when(F.col("years") >= 5, F.col("vol5")).otherwise(0.0)
    return out.select("market", (-F.col("cap3")).alias("absorption"), volatility.alias("volatility"), rent.alias("rent"), (F.coalesce("avg_z", F.lit(0.0)) * 0.5).alias("occ"))


def period_scores(markets: DataFrame, weights: dict[str, float] = PERIODS, tilt: float = 1.0) -> DataFrame:
    """Long (market, period) scores: total z by metric, area means, period adjustment, fundamental blend."""
    spark = markets.sparkSession
    plan = spark.createDataFrame([(p, w, DS_SIGNAL.get(p, 0.9), OCC_SIGNAL.get(p, 0.7), RENT_SIGNAL.get(p, 0.5)) for p, w in weights.items() if w], "period string, weight double, ds_z double, occ_z double, rent_z double")
    c, zero = F.col, F.lit(0.0)
    # the values against which a metric's category is measured: every signal of the market
    every = F.array(c("absorption"), zero, c("absorption"), zero, zero, *[c("rent")] * len(RENT), c("occ"), c("occ"), c("occ"))
    # each step is a projection of its own, so that no expression is written out twice; none of it depends on the period
    rows = markets.withColumns({"_za": category_z(c("absorption"), every), "_z0": category_z(zero, every), "_zr": category_z(c("rent"), every)})
    rows = rows.withColumns({"_ba": bounded(c("_za"), CATEGORY) * c("absorption"), "_br": bounded(c("_zr"), CATEGORY) * c("rent"), "_bv": bounded(c("volatility"), VOLATILITY)})
    rows = rows.withColumns({"_ta": clamp(asymmetric(c("_ba"), c("_bv"))), "_tb": clamp(c("_ba")), "_tr": clamp(c("_br"))})
    rows = rows.select(
        "market", ((c("_ta") + c("_tb")) / sum(DS.values())).alias("_ds"),  # metrics that are missing count as 0
        (clamp((ACTUAL_OCC + EFFECTIVE_OCC) * clamp(c("occ"))) / sum(OCC.values())).alias("_occ"), c("_tr").alias("_rent"),
    )
    rows = rows.crossJoin(F.broadcast(plan))  # at most seven periods
    rows = rows.withColumns({f"_f{a}": bounded(c(f"{a}_z"), PERIOD) for a in ("ds", "occ", "rent")})
    out = rows.withColumns({"ds": asymmetric(c("_ds"), c("_fds")), "occ_score": asymmetric(c("_occ"), c("_focc")), "rent_score": asymmetric(c("_rent"), c("_frent"))})
    effective = momentum_effective(F.lit(tilt))
    blend = sum((asymmetric(c(x), effective) * w for x, w in (("ds", 0.35), ("occ_score", 0.25), ("rent_score", 0.40))), F.lit(0.0))
    return out.select("market", "period", "weight", "ds", "occ_score", "rent_score", blend.alias("mf"))


def market_scores(periods: DataFrame) -> DataFrame:
    """Duration-weighted scores: means over the periods present, by weight."""
    mean = lambda c: (F.sum(F.col(c) * F.col("weight")) / F.sum("weight")).alias(c)
    return periods.groupBy("market").agg(*[mean(c) for c in ("ds", "occ_score", "rent_score", "mf")])


def rankings(tier_scores: DataFrame, weights: dict[str, float] = TIERS) -> DataFrame:
    """(tier, market, mf) -> final score over the tiers present and its rank (ties share the better rank)."""
    weight = F.lit(None).cast("double")
    for name, w in weights.items():
        weight = F.when(F.col("tier") == name, w).otherwise(weight)
    final = tier_scores.withColumn("_w", weight).filter("_w is not null").groupBy("market").agg((F.sum(F.col("_w") * F.col("mf")) / F.sum("_w")).alias("final_score"))
    # the table has a row per market, which is what one task ranks
    return final.withColumn("rank", F.rank().over(Window.orderBy(F.desc(F.round("final_score", 9)))))


def momentum_mean(rows: DataFrame, by: list[str], step: str, value: str, half_life: float, most: float) -> DataFrame:
    """Mean of the latest values with weights that halve every ``half_life`` steps above a constant."""
    w = momentum_weight(F.col(step), half_life, most) if half_life else F.lit(1.0)
    return rows.filter(F.col(value).isNotNull()).groupBy(*by).agg((F.sum(w * F.col(value)) / F.sum(w)).alias("value"))


def market_volume(sales: DataFrame, years: int = 12) -> DataFrame:
    """Deals and volume by market and year, of each market's latest years."""
    by_year = sales.filter("sale_price is not null").groupBy("market", "sale_year").agg(F.count("*").alias("deals"), F.sum(F.col("sale_price").cast("decimal(18,2)")).cast("double").alias("total_volume"))
    return by_year.withColumn("_n", F.row_number().over(Window.partitionBy("market").orderBy(F.desc("sale_year")))).filter(F.col("_n") <= years).drop("_n")
