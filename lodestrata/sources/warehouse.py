"""Warehouse loads: readers with strict text schemas, the ingestion log, upserts, as-of reads and exports."""

from __future__ import annotations

import re
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.inventory import address_hash

LOG = "ingestion_id long, source string, source_vintage string, knowledge_date date, ingested_at timestamp, file_path string, record_count long, notes string"
OPEN_END = "9999-12-31"
#: Columns of the sources and what they become (fixed values).
INVENTORY = {
    "PropertyID": "property_id string", "Property Address": "address string", "City": "city string", "State": "state string", "Zip": "zip string", "Market Name": "market string", "Submarket Name": "submarket string",
    "Property Name": "property_name string", "Year Built": "year_built int", "Number Of Units": "num_units int", "Building Class": "building_class string", "Style": "style string", "Latitude": "latitude double", "Longitude": "longitude double",
}
ZSCORES = {
    "PropertyID": "property_id string", "Universe": "universe string", "peer_cut": "peer_cut string", "view": "view string", "peer_group_key": "peer_group_key string", "metric": "metric string", "value": "value double",
    "peer_mean": "peer_mean double", "peer_std": "peer_std double", "peer_n": "peer_n int", "z_score": "z_score double",
}
PEER_STATS = {k: v for k, v in ZSCORES.items() if k not in ("PropertyID", "value", "z_score")}
SALES = {
    "transaction_id": "transaction_id string", "property_id": "property_id string", "asset_class": "asset_class string", "sale_date": "sale_date date", "sale_year": "sale_year int", "sale_quarter": "sale_quarter string", "sale_price": "sale_price double",
    "actual_cap_rate": "cap_rate_actual double", "pro_forma_cap_rate": "cap_rate_proforma double", "price_per_unit": "price_per_unit double", "price_per_sf": "price_per_sf double", "number_of_units": "num_units int", "year_built": "year_built int",
    "building_class": "building_class string", "property_name": "property_name string", "property_address": "property_address string", "property_city": "city string", "property_state": "state string", "market": "market string", "submarket": "submarket string",
    "buyer_company": "buyer_name string", "seller_company": "seller_name string", "source_file": "source_file string", "source_sheet": "source_sheet string", "source_row": "source_row int",
}
OWNERSHIP = {
    "property_id": "property_id string", "owner_company_canonical": "owner_canonical string", "acquired_date": "acquisition_date date", "disposed_date": "disposition_date date", "acquisition_price": "acquisition_price double",
    "disposition_price": "disposition_price double", "hold_months": "hold_months int",
}


def projected(raw: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Renamed and cast columns; what can't be cast is null, and so is a column that the file lacks."""
    def one(name: str, target: str) -> Column:
        new, kind = target.split()
        c = F.col(f"`{name}`") if name in raw.columns else F.lit(None)
        return (c.cast("string").try_cast("double").cast("int") if kind == "int" else c.cast("string").try_cast(kind)).alias(new)

    return raw.select(*[one(n, t) for n, t in columns.items()])


def lineage(df: DataFrame, ingestion_id: int, knowledge_date: date) -> DataFrame:
    return df.withColumns({"knowledge_date": F.lit(knowledge_date), "ingestion_id": F.lit(ingestion_id).cast("long")})


def csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text: no second pass to guess types."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def inventory(spark: SparkSession, path: str, ingestion_id: int, knowledge_date: date) -> DataFrame:
    """dim_property from a Parquet inventory: rows with an id, address hash (trimmed), open validity."""
    rows = projected(spark.read.parquet(path), INVENTORY).filter("property_id is not null")
    rows = rows.withColumns({"address_hash": address_hash(F.col("address"), F.col("city"), F.col("state")), "valid_from": F.lit(knowledge_date), "valid_to": F.lit(OPEN_END).cast("date")})
    return lineage(rows.withColumn("property_key", F.xxhash64("property_id", "valid_from")), ingestion_id, knowledge_date)


def zscores(spark: SparkSession, path: str, ingestion_id: int, knowledge_date: date) -> DataFrame:
    return lineage(projected(spark.read.parquet(path), ZSCORES), ingestion_id, knowledge_date)


def peer_stats(spark: SparkSession, path: str, ingestion_id: int, knowledge_date: date) -> DataFrame:
    return lineage(projected(spark.read.parquet(path), PEER_STATS), ingestion_id, knowledge_date)


def sales(spark: SparkSession, path: str, ingestion_id: int, knowledge_date: date) -> DataFrame:
    return lineage(projected(csv(spark, path), SALES), ingestion_id, knowledge_date)


def cap_rates(spark: SparkSession, path: str, granularity: str, period_type: str, is_clean: bool, ingestion_id: int, knowledge_date: date) -> DataFrame:
    """Cap-rate aggregates: no market at national level, a class only where the granularity has one."""
    raw = csv(spark, path)
    columns = {"market": "market string", "asset_class": "asset_class string", "sale_quarter" if period_type == "quarter" else "sale_year": "period string", "building_class": "building_class string", "n_deals": "n_deals int"}
    columns |= {f"cap_rate_{k}": f"cap_rate_{k} double" for k in ("median", "mean", "std", "p25", "p75")}
    rows = projected(raw, columns)
    if "national" in granularity:
        rows = rows.withColumn("market", F.lit(None).cast("string"))
    if "class" not in granularity:
        rows = rows.withColumn("building_class", F.lit(None).cast("string"))
    return lineage(rows.withColumns({"granularity": F.lit(granularity), "period_type": F.lit(period_type), "is_clean": F.lit(is_clean)}), ingestion_id, knowledge_date)


def pricing(spark: SparkSession, path: str, granularity: str, ingestion_id: int, knowledge_date: date) -> DataFrame:
    """Pricing aggregates; columns that a file lacks are null, and the price per area may go by either of two names."""
    raw = csv(spark, path)
    if "median_ppsf" not in raw.columns and "median_psf" in raw.columns:
        raw = raw.withColumnRenamed("median_psf", "median_ppsf")
    columns = {c: f"{c} string" for c in ("market", "building_class", "vintage_bucket")} | {"sale_year": "sale_year int", "n_deals": "n_deals int", "total_volume_usd": "total_volume double"}
    columns |= {c: f"{c} double" for c in ("median_price", "median_ppu", "p25_ppu", "p75_ppu", "mean_ppu", "median_ppsf")}
    return lineage(projected(raw, columns).withColumn("granularity", F.lit(granularity)), ingestion_id, knowledge_date)


def ownership(spark: SparkSession, path: str, ingestion_id: int, knowledge_date: date) -> DataFrame:
    raw = csv(spark, path)
    rows = projected(raw, OWNERSHIP | {"is_current_owner": "is_current string"})
    return lineage(rows.withColumn("is_current", F.coalesce(F.col("is_current") == "True", F.lit(False))), ingestion_id, knowledge_date)


def register(spark: SparkSession, log: DataFrame | None, source: str, vintage: str, knowledge_date: date, path: str, records: int, at: datetime, notes: str | None = None) -> DataFrame:
    """The log with one more load; the count is of the rows that were written."""
    last = (log.agg(F.max("ingestion_id")).first()[0] or 0) if log is not None else 0
    row = spark.createDataFrame([(last + 1, source, vintage, knowledge_date, at, path, records, notes)], LOG)
    return row if log is None else log.unionByName(row)


def reload(manifest: list[dict], target: str) -> dict[str, int]:
    """Overwrite every table of the manifest ({"table", "rows": function giving a DataFrame}); several entries of a table are put together."""
    counts, tables = {}, {}
    for entry in manifest:
        tables.setdefault(entry["table"], []).append(entry["rows"]())
    for name, parts in tables.items():
        rows = parts[0]
        for other in parts[1:]:
            rows = rows.unionByName(other, allowMissingColumns=True)
        rows.write.mode("overwrite").parquet(f"{target}/{name}")
        counts[name] = rows.sparkSession.read.parquet(f"{target}/{name}").count()
    return counts


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New non-null values win; rows of either side stay."""
    a, b = old.alias("a"), new.alias("b")
    joined = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key], "full")
    return joined.select(*[F.coalesce(f"b.{c}", f"a.{c}").alias(c) if c in new.columns else F.col(f"a.{c}") for c in old.columns])


def versioned(old: DataFrame, new: DataFrame, key: str, on: date) -> DataFrame:
    """True history: a changed current row is closed on the date and the new one opened; unchanged rows stay."""
    facts = [c for c in new.columns if c != key]
    current, past = old.filter(F.col("valid_to") == OPEN_END), old.filter(F.col("valid_to") != OPEN_END)
    mark = lambda df: df.withColumn("_d", F.xxhash64(*facts))
    fresh = mark(new).alias("n").join(mark(current).select(key, "_d").alias("o"), key, "left").filter(F.col("o._d").isNull() | (F.col("o._d") != F.col("n._d"))).select(*[F.col(f"n.{c}") if c != key else F.col(key) for c in new.columns])
    fresh = fresh.withColumns({"valid_from": F.lit(on), "valid_to": F.lit(OPEN_END).cast("date")})
    changed = current.join(fresh.select(key), key, "left_semi").withColumn("valid_to", F.lit(on))
    return past.unionByName(changed).unionByName(current.join(fresh.select(key), key, "left_anti")).unionByName(fresh)


def as_of(rows: DataFrame, known: date | str, column: str = "knowledge_date") -> DataFrame:
    """What was known by a date."""
    return rows.filter(F.col(column) <= F.lit(known).cast(rows.schema[column].dataType))


def as_of_latest(rows: DataFrame, key: list[str], column: str, known: date | str, tie: str) -> DataFrame:
    """The latest of each key that was known by a date."""
    w = Window.partitionBy(*key).orderBy(F.desc(column), F.desc(tie))
    return as_of(rows, known, column).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def export_columns(rows: DataFrame, spec: list[tuple[str, str, str]]) -> DataFrame:
    """(header, column, format): currency is rounded to cents, shares up to one become percentages, dates are ISO text."""
    def one(header: str, name: str, kind: str) -> Column:
        c = F.col(name) if name in rows.columns else F.lit(None)
        made = {"currency": F.round(c.cast("double"), 2), "percent": F.round(F.when(F.abs(c.cast("double")) <= 1, c.cast("double") * 100).otherwise(c.cast("double")), 2), "date": F.date_format(c.cast("date"), "yyyy-MM-dd")}
        return made.get(kind, c.cast("string")).alias(header)

    return rows.select(*[one(*s) for s in spec])


def export_csv(rows: DataFrame, path: str, filters: dict | None = None) -> None:
    """A folder of CSV files with headers; the parts are written where their rows are."""
    for name, value in (filters or {}).items():
        if re.fullmatch(r"\w+", name) and name in rows.columns:
            rows = rows.filter(F.col(name) == value)
    rows.write.mode("overwrite").csv(path, header=True)
