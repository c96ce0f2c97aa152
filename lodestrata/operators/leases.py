"""Lease pricing: downtime, break-even floors, availability, exposure, velocity, concessions, seasonality and the recommended rent.

All properties are priced at once: every function works by ``KEYS`` (property and unit type). ``as_of`` is always a parameter.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["property_id", "unit_type"]
AVAILABLE = ("vacant", "notice", "available", "model")
DAYS_A_MONTH = 30.4
#: Make-ready cost by general type, and for any other (fixed values).
MAKE_READY = {"Micro": 800.0, "Studio": 900.0, "Alcove": 1000.0, "1BR": 1400.0, "2BR": 1800.0, "3BR": 2200.0, "PH": 2800.0}
MAKE_READY_ELSE = 1500.0
#: Commission and marketing of a new lease (fixed values).
COMMISSION, MARKETING = 150.0, 300.0
#: (name, upper bound, multiplier) (fixed values).
VELOCITY = (("stalled", 0.05, 0.85), ("slow", 0.10, 0.92), ("normal", 0.20, 1.00), ("strong", 0.30, 1.05), ("very_strong", 1.00, 1.08))
GAP_LEVEL = (("tight", 0.01, 1.03), ("light", 0.03, 1.01), ("moderate", 0.06, 1.00), ("elevated", 0.10, 0.98), ("deep", 1.00, 0.95))
GAP_TREND = (("tightening", -0.01, None), ("stable", 0.01, None), ("widening", 1.00, None))
#: Seasonal multipliers by month where data are thin (fixed values).
SEASON = (0.98, 0.98, 1.00, 1.01, 1.02, 1.02, 1.02, 1.02, 1.00, 0.99, 0.98, 0.98)
#: Weights of exposure now and at 30, 60, 90 and 180 days (fixed values).
EXPOSURE = (("current_exposed", 0.40), ("exp_30", 0.25), ("exp_60", 0.20), ("exp_90", 0.10), ("exp_180", 0.05))
#: Weights of scarcity, velocity, gap and season; cap and posture thresholds (fixed values).
PREMIUM = (0.40, 0.25, 0.20, 0.15)
PREMIUM_CAP, PUSH, CONCEDE = 0.06, 0.02, -0.02


def tier(x: Column, tiers) -> Column:
    """The first tier whose bound is not below ``x``; the last beyond all; null stays null."""
    out = F.when(x.isNull(), None)
    for name, bound, _ in tiers[:-1]:
        out = out.when(x <= bound, name)
    return out.otherwise(tiers[-1][0])


def multiplier(name: Column, tiers) -> Column:
    out = F.lit(1.0)
    for known, _, m in tiers:
        out = F.when(name == known, m).otherwise(out)
    return out


def unit_type(bedrooms: Column, square_feet: Column) -> Column:
    """Inferred unit type: bedrooms if known, else by size."""
    return (
        F.when(bedrooms == 0, "Studio").when(bedrooms.isNotNull(), F.concat(bedrooms.cast("int").cast("string"), F.lit("BR")))
        .when(square_feet < 450, "Studio").when(square_feet < 700, "1BR").when(square_feet < 1000, "2BR").when(square_feet.isNotNull(), "3BR").otherwise("Unknown")
    )


def lease_term(start: Column, end: Column) -> Column:
    """Months to one decimal between 30 and 900 days; else 12."""
    days = F.datediff(end, start)
    return F.when(days.between(30, 900), F.round(days / DAYS_A_MONTH, 1)).otherwise(12.0)


def gaps(leases: DataFrame, order: tuple[str, ...] = ("lease_start", "lease_id", "line")) -> DataFrame:
    """Days between a lease and the one before in the same unit; renewals and gaps outside [-30, 540] are left out."""
    w = Window.partitionBy("property_id", "unit").orderBy(*order)
    return (
        leases.filter("unit is not null and lease_start is not null")
        .withColumn("_end", F.lag("lease_exp").over(w))
        .filter(~F.col("is_renewal") & F.col("_end").isNotNull())
        .withColumn("gap", F.datediff("lease_start", "_end").cast("double"))
        .filter(F.col("gap").between(-30, 540))
    )


def downtime(gap_rows: DataFrame, by: list[str]) -> DataFrame:
    """Median, mean, quartiles and the mean without a tenth at either end (from four gaps on).

    Gaps are whole days within [-30, 540], so a group has at most 571 counted rows, however many leases it has.
    """
    counted = gap_rows.groupBy(*by, "gap").agg(F.count("*").alias("_c"))
    place, whole = Window.partitionBy(*by).orderBy("gap").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)
    ranked = counted.withColumns({"_to": F.sum("_c").over(place), "_n": F.sum("_c").over(whole)})
    cut = F.when(F.col("_n") >= 4, F.greatest(F.lit(1), F.floor(F.col("_n") * 0.1))).otherwise(0)
    inside = F.greatest(F.lit(0), F.least("_to", F.col("_n") - cut) - F.greatest(F.col("_to") - F.col("_c"), cut))
    share = lambda p, name: F.percentile("gap", F.lit(p), F.col("_c")).alias(name)
    return ranked.groupBy(*by).agg(
        share(0.5, "median_days"), (F.sum(F.col("gap") * F.col("_c")) / F.sum("_c")).alias("mean_days"), share(0.75, "p75_days"), share(0.9, "p90_days"),
        F.sum("_c").alias("n_turns"), F.try_divide(F.sum(F.col("gap") * inside), F.sum(inside)).alias("trimmed_mean"),
    )


def floors(leases: DataFrame) -> DataFrame:
    """Break-even rent by unit type: in-place rent plus the turnover cost spread over the term.

    The downtime is the unit type's median, else the property's, else 30 days; terms outside 6..24 months don't count, 12 stands in for none.
    """
    base = leases.groupBy(*KEYS).agg(
        F.avg("effective_rent").alias("inplace_rent"), F.percentile(F.when(F.col("term_months").between(6, 24), F.col("term_months")), F.lit(0.5)).alias("term"), F.min("general_type").alias("general_type")
    )
    found = gaps(leases)
    own = downtime(found, KEYS).select(*KEYS, F.col("median_days").alias("_own"))
    whole = downtime(found, ["property_id"]).select("property_id", F.col("median_days").alias("_all"))
    rows = base.join(own, KEYS, "left").join(whole, "property_id", "left")
    ready = F.lit(MAKE_READY_ELSE)
    for name, cost in MAKE_READY.items():
        ready = F.when(F.col("general_type") == name, cost).otherwise(ready)
    days, term = F.coalesce("_own", "_all", F.lit(30.0)), F.coalesce("term", F.lit(12.0))
    total = F.col("inplace_rent") / DAYS_A_MONTH * days + ready + MARKETING + COMMISSION
    feasible = F.coalesce(F.col("inplace_rent") > 0, F.lit(False))
    return rows.select(*KEYS, "inplace_rent", term.alias("term_months"), days.alias("downtime_days"), ready.alias("make_ready"), total.alias("total_cost"), feasible.alias("feasible"), F.when(feasible, F.col("inplace_rent") + total / term).alias("floor"))


def availability(units: DataFrame) -> DataFrame:
    """Available and total units by unit type, by its floorplan (each type's least) and by property."""
    rows = units.select("property_id", F.coalesce("unit_type", F.lit("unknown")).alias("unit_type"), "floorplan", F.lower("status").isin(*AVAILABLE).cast("int").alias("free"))
    by_type = rows.groupBy(*KEYS).agg(F.sum("free").alias("ut_avail"), F.count("*").alias("ut_total"), F.min("floorplan").alias("floorplan"))
    over = lambda *by: Window.partitionBy(*by)
    return by_type.withColumns({f"{p}_{n}": F.sum(f"ut_{n}").over(w) for p, w in (("fp", over("property_id", "floorplan")), ("property", over("property_id"))) for n in ("avail", "total")})


def exposure(available: DataFrame, leases: DataFrame, as_of: date) -> DataFrame:
    """Units exposed now and by leases that end within 30, 60, 90 and 180 days, at most all units; and the weighted share."""
    days = F.datediff("lease_exp", F.lit(as_of))
    ends = leases.groupBy(*KEYS).agg(*[F.count(F.when((days > 0) & (days <= h), 1)).alias(f"_{h}") for h in (30, 60, 90, 180)])
    out = available.join(ends, KEYS, "left").withColumn("current_exposed", F.col("ut_avail"))
    out = out.withColumns({f"exp_{h}": F.least(F.col("ut_avail") + F.coalesce(f"_{h}", F.lit(0)), F.col("ut_total")) for h in (30, 60, 90, 180)})
    share = sum((F.col(c) / F.greatest("ut_total", F.lit(1)) * w for c, w in EXPOSURE), F.lit(0.0))
    return out.select(*KEYS, "ut_total", "current_exposed", "exp_30", "exp_60", "exp_90", "exp_180", (share / sum(w for _, w in EXPOSURE)).alias("exposure_pct"))


def velocity(available: DataFrame, leases: DataFrame, as_of: date, window_days: int = 90) -> DataFrame:
    """New leases within the window, a month and as a share of all units, with the tier."""
    recent = F.col("lease_start").between(F.date_sub(F.lit(as_of), window_days), F.lit(as_of))
    signed = leases.filter(~F.col("is_renewal") & recent).groupBy(*KEYS).agg(F.count("*").alias("_s"))
    out = available.join(signed, KEYS, "left").withColumn("leases_signed", F.coalesce("_s", F.lit(0).cast("long")))
    out = out.withColumn("monthly_absorption", F.col("leases_signed") / (window_days / DAYS_A_MONTH) / F.greatest("ut_total", F.lit(1)))
    return out.select(*KEYS, "leases_signed", "monthly_absorption", tier(F.col("monthly_absorption"), VELOCITY).alias("velocity_tier"))


def gap(leases: DataFrame, as_of: date, by: list[str], window_days: int = 90) -> DataFrame:
    """Mean share of the face rent that is conceded, now and in the window before, with level and trend."""
    end, cut, prior = F.lit(as_of), F.date_sub(F.lit(as_of), window_days), F.date_sub(F.lit(as_of), 2 * window_days)
    new = leases.filter(~F.col("is_renewal") & (F.col("face_rent") > 0) & F.coalesce(F.col("effective_rent") != 0, F.lit(False)))
    share = F.greatest(F.lit(0.0), (F.col("face_rent") - F.col("effective_rent")) / F.col("face_rent"))
    start = F.col("lease_start")
    out = new.groupBy(*by).agg(
        F.avg(F.when(start.between(cut, end), share)).alias("_now"), F.avg(F.when((start >= prior) & (start < cut), share)).alias("_then"), F.count(F.when(start.between(cut, end), 1)).alias("n")
    )
    out = out.withColumn("gap_pct", F.coalesce("_now", F.lit(0.0))).withColumn("trend", F.col("gap_pct") - F.coalesce("_then", "gap_pct"))
    return out.select(*by, "n", "gap_pct", "trend", tier(F.round("gap_pct", 9), GAP_LEVEL).alias("gap_level"), tier(F.round("trend", 9), GAP_TREND).alias("gap_trend"))


def seasonality(leases: DataFrame, as_of: date, window_months: int = 24, least: int = 10, smoothing: float = 0.3) -> DataFrame:
    """Twelve multipliers a property: its own share of leases smoothed toward one, or the default where leases are few."""
    spark = leases.sparkSession
    months = spark.createDataFrame([(m + 1, x) for m, x in enumerate(SEASON)], "month int, usual double")
    new = leases.filter(~F.col("is_renewal") & F.col("lease_start").between(F.date_sub(F.lit(as_of), window_months * 30), F.lit(as_of)))
    counts = new.groupBy("property_id", F.month("lease_start").alias("month")).agg(F.count("*").alias("_n"))
    grid = leases.select("property_id").distinct().crossJoin(F.broadcast(months))  # twelve rows
    rows = grid.join(counts, ["property_id", "month"], "left").withColumn("n", F.coalesce("_n", F.lit(0).cast("long")))
    mean = F.sum("n").over(Window.partitionBy("property_id")) / 12
    index = F.when(F.col("n") >= least, F.col("n") / mean * (1 - smoothing) + smoothing).otherwise(F.col("usual"))
    return rows.select("property_id", "month", "n", index.alias("multiplier"))


def price(leases: DataFrame, units: DataFrame, as_of: date, month: int, scenario: str = "new") -> DataFrame:
    """Floor, premium, recommended rent and posture of every unit type."""
    free = availability(units)
    season = seasonality(leases, as_of).filter(F.col("month") == month).select("property_id", "multiplier")
    whole = gap(leases, as_of, ["property_id"]).select("property_id", F.col("gap_level").alias("_level"))
    rows = (
        floors(leases).join(exposure(free, leases, as_of).drop("ut_total"), KEYS, "left").join(velocity(free, leases, as_of), KEYS, "left")
        .join(gap(leases, as_of, KEYS).select(*KEYS, "gap_level"), KEYS, "left").join(whole, "property_id", "left").join(season, "property_id", "left")
    )
    level = F.coalesce("gap_level", "_level")
    seasonal = F.lit(1.0) if scenario == "renewal" else F.coalesce("multiplier", F.lit(SEASON[month - 1]))
    a, b, c, d = PREMIUM
    signal = F.lit(0.10) - F.coalesce("exposure_pct", F.lit(0.0))
    premium = signal * a + (multiplier(F.col("velocity_tier"), VELOCITY) - 1) * b + (multiplier(level, GAP_LEVEL) - 1) * c + (seasonal - 1) * d
    rows = rows.filter("feasible").withColumn("premium", F.greatest(F.lit(-PREMIUM_CAP), F.least(F.lit(PREMIUM_CAP), premium)))
    posture = F.when(F.col("premium") >= PUSH, "push").when(F.col("premium") <= CONCEDE, "concede").otherwise("hold")
    return rows.select(*KEYS, "floor", "exposure_pct", "velocity_tier", level.alias("gap_level"), seasonal.alias("seasonal"), "premium", (F.col("floor") * (1 + F.col("premium"))).alias("recommended"), posture.alias("posture"))


def rent_summary(units: DataFrame) -> DataFrame:
    """Rents and occupancy by property."""
    free = F.lower("status").isin(*AVAILABLE)
    return units.groupBy("property_id").agg(
        F.count("*").alias("units"), F.avg("current_rent").alias("avg_rent"), F.min("current_rent").alias("min_rent"), F.max("current_rent").alias("max_rent"), F.avg("market_rent").alias("avg_market_rent"),
        (F.count(F.when(~free, 1)) / F.count("*") * 100).alias("occupancy_pct"),
    )
