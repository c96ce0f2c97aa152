"""Property inventory: peer z-scores, profiles, outliers, peers, coverage, tiers and the identity bridge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sales import matching

LEAST_PEERS = 3


def universe(secondary_type: Column, segment: Column) -> Column:
    return F.when(secondary_type == "Manufactured Housing/Mobile Home Park", "Manufactured Housing").when(segment == "Senior", "Senior").otherwise("Market Rate Apartments")


def affordability_pool(rent_type: Column) -> Column:
    return F.when(rent_type.isin("Market", "Market/Affordable", "Affordable"), rent_type).otherwise("Market")


def size_tier(units: Column) -> Column:
    """Left-closed bins; a missing size is null (the text "nan" of the original is not kept)."""
    return F.when(units < 50, "1: 25-49").when(units < 75, "2: 50-74").when(units < 150, "3: 75-149").when(units < 300, "4: 150-299").when(units >= 300, "5: 300+")


def quality_tier(stars: Column) -> Column:
    return F.when(stars <= 2, "1&2 Star").when(stars == 3, "3 Star").when(stars >= 4, "4&5 Star")


def peer_zscores(pool: DataFrame, score: DataFrame, cut: list[str], cut_name: str, metrics: list[str], universe_name: str = "Market Rate Apartments", view: str = "all", key: str = "property_id") -> DataFrame:
    """Every metric of every scored property against its peers in ``pool`` (same values of ``cut``), long.

    Mean, sample deviation and count per group are aggregated with partial sums and joined back; z needs a positive deviation and three peers.
    """
    whole = lambda df, *more: df.dropna(subset=cut).select(*more, *cut, *[F.col(m).cast("double").alias(m) for m in metrics])
    melt = lambda df, ids: df.unpivot(ids, metrics, "metric", "value")
    stats = melt(whole(pool), cut).groupBy(*cut, "metric").agg(F.avg("value").alias("peer_mean"), F.stddev_samp("value").alias("peer_std"), F.count("value").alias("peer_n"))
    scored = melt(whole(score, key), [key, *cut]).join(stats, [*cut, "metric"], "left")
    valid = (F.col("peer_std") > 0) & (F.col("peer_n") >= LEAST_PEERS)
    return scored.select(
        key, F.lit(universe_name).alias("universe"), F.lit(cut_name).alias("peer_cut"), F.lit(view).alias("view"), F.concat_ws(" | ", *[F.col(c).cast("string") for c in cut]).alias("peer_group_key"),
        "metric", "value", "peer_mean", "peer_std", "peer_n", F.when(valid, (F.col("value") - F.col("peer_mean")) / F.col("peer_std")).alias("z_score"),
    )


ORDERS = {
    "abs_z": lambda: F.abs("z_score").desc_nulls_last(), "z_asc": lambda: F.asc_nulls_last("z_score"), "z_desc": lambda: F.desc_nulls_last("z_score"), "metric": lambda: F.asc("metric"),
}


def zscores_of(z: DataFrame, property_id, peer_cut: str | None = None, sort_by: str = "abs_z", limit: int = 50) -> DataFrame:
    found = z.filter(F.col("property_id") == property_id)
    if peer_cut:
        found = found.filter(F.col("peer_cut") == peer_cut)
    return found.orderBy(ORDERS.get(sort_by, ORDERS["abs_z"])(), "peer_cut", "metric").limit(limit)


def outliers(z: DataFrame, threshold: float = 2.0) -> DataFrame:
    return z.filter(F.abs("z_score") > threshold).withColumn("side", F.when(F.col("z_score") > 0, "strength").otherwise("weakness"))


def z_summary(z: DataFrame) -> DataFrame:
    return z.groupBy("property_id", "peer_cut").agg(F.count_distinct("metric").alias("metrics"), F.avg("z_score").alias("avg_z"), F.min("z_score").alias("min_z"), F.max("z_score").alias("max_z"))


def peers_of(z: DataFrame, properties: DataFrame, property_id, peer_cut: str, limit: int = 100) -> DataFrame:
    """The properties that share the given one's peer group, with their mean z."""
    group = z.filter((F.col("property_id") == property_id) & (F.col("peer_cut") == peer_cut)).select("peer_group_key", "peer_cut").distinct()
    current = properties.filter("valid_to = '9999-12-31'").select("property_id", "property_name", "address", "num_units", "year_built", "building_class")
    mean = z.join(group, ["peer_group_key", "peer_cut"], "left_semi").groupBy("property_id").agg(F.avg("z_score").alias("avg_z"))
    return mean.join(current, "property_id").orderBy(F.desc_nulls_last(F.round("avg_z", 9)), "property_id").limit(limit)


def market_stats(properties: DataFrame, z: DataFrame) -> DataFrame:
    """Inventory by market with how much of it has scores."""
    current = properties.filter("valid_to = '9999-12-31'")
    stats = current.groupBy("market").agg(
        F.count("*").alias("total_properties"), F.count_distinct("submarket").alias("submarkets"), F.avg("num_units").alias("avg_units"), F.percentile("num_units", F.lit(0.5)).alias("median_units"),
        F.avg("year_built").alias("avg_year_built"), F.sum("num_units").cast("double").alias("total_units"),
    )
    scored = z.select("property_id").distinct().join(properties.select("property_id", "market"), "property_id").groupBy("market").agg(F.count_distinct("property_id").alias("scored_properties"))
    return stats.join(scored, "market", "left").withColumn("scored_properties", F.coalesce("scored_properties", F.lit(0).cast("long"))).withColumn("coverage_pct", F.round(F.col("scored_properties") / F.col("total_properties") * 100, 1))


def scored_markets(properties: DataFrame, z: DataFrame) -> DataFrame:
    """Markets with scores; the scores are reduced to a row per property and cut before the outer join, so nothing fans out."""
    per = z.groupBy("property_id").agg(F.collect_set("peer_cut").alias("cuts"), F.collect_set("metric").alias("metrics"))
    joined = properties.filter("valid_to = '9999-12-31' and market is not null").join(per, "property_id", "left")
    return (
        joined.groupBy("market")
        .agg(
            F.count_distinct(F.when(F.col("cuts").isNotNull(), F.col("property_id"))).alias("scored_properties"), F.count_distinct("property_id").alias("total_properties"),
            F.size(F.array_distinct(F.flatten(F.collect_set("cuts")))).cast("long").alias("peer_cuts"), F.size(F.array_distinct(F.flatten(F.collect_set("metrics")))).cast("long").alias("metrics"),
        )
        .filter("scored_properties > 0")
    )


def search(properties: DataFrame, z: DataFrame, filters: dict, scored_only: bool = False, limit: int = 50) -> DataFrame:
    """Properties that match, with whether they have scores; largest first."""
    found = properties.filter("valid_to = '9999-12-31'").filter(matching(filters))
    ids = z.select("property_id").distinct()
    if scored_only:
        found = found.join(ids, "property_id", "left_semi").withColumn("has_scores", F.lit(1))
    else:
        found = found.join(ids.withColumn("has_scores", F.lit(1)), "property_id", "left").withColumn("has_scores", F.coalesce("has_scores", F.lit(0)))
    return found.orderBy(F.desc_nulls_last("num_units"), "property_id").limit(limit)


def address_hash(address: Column, city: Column, state: Column) -> Column:
    """MD5 of the trimmed, lower-cased parts; null if all are missing (both fixed against the original)."""
    part = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    joined = F.concat(part(address), part(city), part(state))
    return F.when(joined != "", F.md5(joined))


def bridge(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left`` (with address, city, state) with the least ``property_id`` of ``right`` of the same address."""
    known = right.withColumn("_h", address_hash(F.col("address"), F.col("city"), F.col("state"))).filter("_h is not null").groupBy("_h").agg(F.min("property_id").alias("matched_id"))
    return left.withColumn("_h", address_hash(F.col("address"), F.col("city"), F.col("state"))).join(known, "_h", "left").drop("_h")
