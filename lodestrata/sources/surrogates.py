"""Domain tables built from the driver tables.

The operators see only the domain schema; another deployment replaces this module by its own readers.
Every function takes (spark, directory) and returns a lazy DataFrame; column pruning reaches the Parquet scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dim_property from part."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey as property_id", "p_name as property_name", "concat(p_name, ' ', p_size) as address", "p_brand as city", "substr(p_type, 1, 2) as state",
        "p_brand as market", "concat(p_brand, '/', p_size % 5) as submarket", "cast(1950 + p_partkey % 70 as int) as year_built", "p_size as num_units",
        "p_type as building_class", "p_retailprice as ask", "date'9999-12-31' as valid_to",
    )


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fact_sales_transaction from lineitem and its dimensions, which are joined among themselves first, so that the many rows are dealt anew as few times as may be."""
    t = lambda n: table(spark, sf_dir, n)
    return (
        t("lineitem")
        .join(t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
        .selectExpr(
            "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as transaction_id", "l_partkey as property_id", "l_returnflag as asset_class", "p_name as property_name",
            "concat(p_name, ' ', p_size) as property_address", "n_name as market", "cast(l_shipdate as date) as sale_date", "year(l_shipdate) as sale_year",
            "concat(year(l_shipdate), ' Q', quarter(l_shipdate)) as sale_quarter", "l_extendedprice as sale_price", "nullif(l_discount, 0D) as cap_rate_actual",
            "l_extendedprice / l_quantity as price_per_unit", "cast(l_quantity as int) as num_units", "cast(1950 + l_partkey % 70 as int) as year_built", "p_type as building_class",
            "c_name as buyer_name", "s_name as seller_name",
        )
    )


def ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fact_ownership from orders: a customer's orders are its acquisitions, in turn disposed of at the next."""
    spell = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .withColumn("next_date", F.lead("o_orderdate").over(spell))
        .withColumn("next_price", F.lead("o_totalprice").over(spell))
        .selectExpr(
            "o_orderkey as ownership_id", "o_custkey % 997 as property_id", "c_name as owner_canonical", "cast(o_orderdate as date) as acquisition_date", "cast(next_date as date) as disposition_date",
            "o_totalprice as acquisition_price", "next_price as disposition_price", "cast(datediff(next_date, o_orderdate) div 30 as int) as hold_months", "o_orderstatus = 'O' as is_current",
        )
    )


def leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lease records from lineitem: the part is the unit, its type the unit type."""
    t = lambda n: table(spark, sf_dir, n)
    return (
        t("lineitem")
        .join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
        .selectExpr(
            "p_brand as property_id", "l_partkey as unit", "p_type as unit_type", "case when p_size <= 10 then 'Studio' when p_size <= 25 then '1BR' when p_size <= 40 then '2BR' else 'other' end as general_type",
            "cast(l_shipdate as date) as lease_start", "date_add(cast(l_shipdate as date), 180 + cast(l_quantity as int) * 7) as lease_exp", "l_extendedprice / l_quantity as face_rent",
            "l_extendedprice / l_quantity * (1 - l_discount) as effective_rent", "6 + cast(l_quantity as int) % 19 as term_months", "l_returnflag = 'R' as is_renewal",
            "l_orderkey as lease_id", "l_linenumber as line",
        )
    )


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit roster from part."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_brand as property_id", "p_partkey as unit_number", "p_type as unit_type", "concat(p_type, '-', p_size % 3) as floorplan", "p_size % 4 as bedrooms",
        "element_at(array('occupied', 'occupied', 'occupied', 'occupied', 'vacant', 'notice', 'available', 'model'), cast(p_partkey % 8 as int) + 1) as status",
        "p_retailprice as current_rent", "p_retailprice * (1 + (p_partkey % 11 - 5) / 100.0D) as market_rent", "cast(400 + p_size * 15 as double) as square_footage",
    )


def opstat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operating-statement items from lineitem and orders: the supplier is the property, its priorities the documents."""
    t = lambda n: table(spark, sf_dir, n)
    return (
        t("lineitem")
        .join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .selectExpr(
            "l_suppkey as property_id", "concat(l_suppkey, ':', substr(o_orderpriority, 1, 1)) as document_id",
            "element_at(array('audited_financial', 'operating_statement', 'budget', 'appraisal', 'other'), cast(substr(o_orderpriority, 1, 1) as int)) as document_type",
            "concat(year(l_shipdate), case l_linestatus when 'F' then 'A' else 'B' end) as period",
            "case l_returnflag when 'A' then 'income' when 'N' then 'expense' else 'noi' end as category",
            "case when l_linenumber = 7 then 'Net Operating Income' else concat('line ', l_linenumber) end as line_item",
            "l_extendedprice as amount", "l_linenumber = 6 as is_subtotal", "l_linenumber = 5 as is_total", "cast(l_quantity as int) as page_number",
        )
    )


def usage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage events."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "user_id % 7 as org_id", "user_id", "event_type as action", "cast(value as int) % 50 as page_count", "value as processing_time", "event_id % 10 <> 0 as success", "ts as created_at"
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the property they belong to."""
    return table(spark, sf_dir, "documents").selectExpr("doc_id as document_id", "concat(source, '_', lang, '_', doc_id, '.txt') as filename", "source", "lang", "doc_id % 500 as property_id", "text", "n_chars",
        "case when doc_id % 5 = 0 then 'lease' when doc_id % 5 = 1 then 'rent_roll' when doc_id % 5 = 2 then 'operating_statement' when doc_id % 5 = 3 then 'loan' else 'other' end as document_type",
        "case when doc_id % 4 = 0 then 'approved' when doc_id % 4 = 1 then 'pending' when doc_id % 4 = 2 then 'skipped' end as review_status")
