"""Queries of the sources and sinks: the driver tables are written in the layout of a source and loaded from there."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import inventory as inv
from ..operators import portfolio
from ..session import shared_path
from ..sources import documents, warehouse
from ..sources.surrogates import table as t
from .registry import query

KNOWN = date(2024, 6, 30)


def folder(spark: SparkSession) -> str:
    return shared_path(spark, "loads")


def _as_csv(df: DataFrame) -> str:
    path = folder(df.sparkSession)
    warehouse.export_csv(df, path)
    return path


def _as_parquet(df: DataFrame) -> str:
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return path


_INVENTORY = """p_partkey as PropertyID, concat(' ', p_name, ' ', p_size) as `Property Address`, p_brand as City, substr(p_type, 1, 2) as State, p_brand as `Market Name`, 1950 + p_partkey % 70 as `Year Built`,
 if(p_size % 7 = 0, 'n/a', cast(p_size as string)) as `Number Of Units`, p_type as `Building Class`"""


@query("src01_inventory_scan", """select p_partkey::varchar as property_id, ' ' || p_name || ' ' || p_size as address, p_brand as market, (1950 + p_partkey % 70)::int as year_built, case when p_size % 7 <> 0 then p_size end as num_units, null::varchar as zip,
 md5(lower(p_name || ' ' || p_size) || lower(p_brand) || lower(substr(p_type, 1, 2))) as address_hash, '2024-06-30' as known, 1::bigint as ingestion_id from part""")
def src01(spark, d):
    rows = warehouse.inventory(spark, _as_parquet(t(spark, d, "part").selectExpr(*_columns(_INVENTORY))), 1, KNOWN)
    return rows.select("property_id", "address", "market", "year_built", "num_units", "zip", "address_hash", F.col("knowledge_date").cast("string").alias("known"), "ingestion_id")


def _columns(sql: str) -> list[str]:
    """The expressions of a select list, parted at commas outside brackets and quotes."""
    out, depth, quoted = [""], 0, False
    for c in sql:
        quoted ^= c == "'"
        depth += (c == "(") - (c == ")") if not quoted else 0
        if c == "," and not depth and not quoted:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


_Z = "p_partkey as PropertyID, 'all' as Universe, p_brand as peer_cut, 'unit' as view, p_type as peer_group_key, 'price' as metric, p_retailprice as value, 900.0D as peer_mean, 10.0D as peer_std, cast(p_size as bigint) as peer_n, (p_retailprice - 900) / 10 as z_score"


@query("src02_zscore_scan", "select p_partkey::varchar as property_id, p_brand as peer_cut, p_type as peer_group_key, p_retailprice as value, p_size as peer_n, (p_retailprice - 900) / 10 as z_score from part")
def src02(spark, d):
    return warehouse.zscores(spark, _as_parquet(t(spark, d, "part").selectExpr(*_columns(_Z))), 2, KNOWN).select("property_id", "peer_cut", "peer_group_key", "value", "peer_n", "z_score")


@query("src03_peer_stats_scan", "select p_brand as peer_cut, p_type as peer_group_key, 'price' as metric, 900.0::double as peer_mean, p_size as peer_n, 3::bigint as ingestion_id from part")
def src03(spark, d):
    return warehouse.peer_stats(spark, _as_parquet(t(spark, d, "part").selectExpr(*_columns(_Z))), 3, KNOWN).select("peer_cut", "peer_group_key", "metric", "peer_mean", "peer_n", "ingestion_id")


@query("src04_sales_scan", """select o_orderkey::varchar as transaction_id, o_orderdate::date as sale_date, year(o_orderdate)::int as sale_year, case when o_orderkey % 5 <> 0 then o_totalprice end as sale_price, 'Elm "A", ' || o_orderkey as property_name, null::varchar as market from orders""")
def src04(spark, d):
    made = "o_orderkey as transaction_id, date_format(o_orderdate, 'yyyy-MM-dd') as sale_date, concat(year(o_orderdate), '.0') as sale_year, if(o_orderkey % 5 = 0, 'n/a', cast(o_totalprice as string)) as sale_price, concat('Elm \"A\", ', o_orderkey) as property_name"
    path = folder(spark)
    t(spark, d, "orders").selectExpr(*_columns(made)).write.csv(path, header=True, escape='"')
    return warehouse.sales(spark, path, 4, KNOWN).select("transaction_id", "sale_date", "sale_year", "sale_price", "property_name", "market")


_CAPS = "p_brand as market, p_type as asset_class, 2000 + p_size as sale_year, 'A' as building_class, p_size as n_deals, p_size / 100D as cap_rate_median"


@query("src05_cap_rate_scan", "select null::varchar as market, p_type as asset_class, (2000 + p_size)::varchar as period, null::varchar as building_class, p_size as n_deals, p_size / 100.0::double as cap_rate_median, null::double as cap_rate_std, 'national_year' as granularity from part")
def src05(spark, d):
    rows = warehouse.cap_rates(spark, _as_csv(t(spark, d, "part").selectExpr(*_columns(_CAPS))), "national_year", "year", True, 5, KNOWN)
    return rows.select("market", "asset_class", "period", "building_class", "n_deals", "cap_rate_median", "cap_rate_std", "granularity")


@query("src06_pricing_scan", "select p_brand as market, (2000 + p_size)::int as sale_year, p_retailprice as median_ppsf, null::double as mean_ppu, p_size as n_deals from part")
def src06(spark, d):
    """The price per area goes by its other name; a column is missing."""
    made = "p_brand as market, 2000 + p_size as sale_year, p_retailprice as median_psf, p_size as n_deals"
    return warehouse.pricing(spark, _as_csv(t(spark, d, "part").selectExpr(*_columns(made))), "market_year", 6, KNOWN).select("market", "sale_year", "median_ppsf", "mean_ppu", "n_deals")


@query("src07_ownership_scan", "select p_partkey::varchar as property_id, p_brand as owner_canonical, date '2020-01-31' as acquisition_date, case when p_size % 2 = 0 then p_retailprice end as acquisition_price, p_size as hold_months, p_size % 3 = 0 as is_current from part")
def src07(spark, d):
    made = "p_partkey as property_id, p_brand as owner_company_canonical, '2020-01-31' as acquired_date, if(p_size % 2 = 0, cast(p_retailprice as string), '-') as acquisition_price, p_size as hold_months, case p_size % 3 when 0 then 'True' when 1 then 'False' end as is_current_owner"
    return warehouse.ownership(spark, _as_csv(t(spark, d, "part").selectExpr(*_columns(made))), 7, KNOWN).select("property_id", "owner_canonical", "acquisition_date", "acquisition_price", "hold_months", "is_current")


@query("src08_reload", "select 'cap_rates' as name, (select count(*) from part) + (select count(*) from supplier) as records union all select 'pricing', count(*) from customer")
def src08(spark, d):
    manifest = [
        {"table": "cap_rates", "rows": lambda: t(spark, d, "part").select(F.col("p_partkey").alias("k"))}, {"table": "cap_rates", "rows": lambda: t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), "s_name")},
        {"table": "pricing", "rows": lambda: t(spark, d, "customer").select("c_custkey")},
    ]
    return spark.createDataFrame(list(warehouse.reload(manifest, folder(spark)).items()), "name string, records long")


@query("src09_register", "select * from (values (1::bigint, 'sales', '2024Q1', 10::bigint), (2, 'pricing', '2024Q2', 20), (3, 'sales', '2024Q2', 30)) v(ingestion_id, source, source_vintage, record_count)")
def src09(spark, d):
    log = None
    for source, vintage, n in (("sales", "2024Q1", 10), ("pricing", "2024Q2", 20), ("sales", "2024Q2", 30)):
        log = warehouse.register(spark, log, source, vintage, KNOWN, "p", n, datetime(2024, 7, 1))
    return log.select("ingestion_id", "source", "source_vintage", "record_count")


@query("src09_loads_of_tables", """select row_number() over (order by k)::bigint as ingestion_id, source, vintage as source_vintage, n::bigint as record_count, (date '2024-06-30' + k::int)::varchar as known from (select 0 as k, 'inventory' as source, '2024Q1' as vintage, (select count(*) from part) as n union all select 1, 'sales', '2024Q2', (select count(*) from lineitem)
 union all select 2, 'ownership', '2024Q2', (select count(*) from orders) union all select 3, 'inventory', '2024Q3', (select count(*) from part where p_size > 10))""")
def src09_tables(spark, d):
    """Each table is written as its source's file, loaded from there, and registered with the rows that the load gave; the log's own order gives the ids."""
    from datetime import timedelta

    log, parts = None, t(spark, d, "part")
    for k, (source, vintage, rows) in enumerate((("inventory", "2024Q1", parts), ("sales", "2024Q2", t(spark, d, "lineitem")), ("ownership", "2024Q2", t(spark, d, "orders")), ("inventory", "2024Q3", parts.filter("p_size > 10")))):
        path = _as_parquet(rows)
        log = warehouse.register(spark, log, source, vintage, KNOWN + timedelta(days=k), path, spark.read.parquet(path).count(), datetime(2024, 7, 1))
    return log.select("ingestion_id", "source", "source_vintage", "record_count", F.col("knowledge_date").cast("string").alias("known"))


_PATHS = "concat('/in/', p_partkey, '/File ', p_size, '.', case p_size % 5 when 0 then 'PDF' when 1 then 'xlsx' when 2 then 'Txt' when 3 then 'jpeg' else 'zip' end)"


def _files(spark, d):
    content = "encode(if(p_size % 2 = 0, concat('caf', chr(233), ' ', p_name), p_name), if(p_size % 4 = 0, 'ISO-8859-1', 'UTF-8'))"
    return documents.routed(t(spark, d, "part").selectExpr("p_partkey", f"{_PATHS} as path", f"{content} as content", f"cast(length({content}) as long) as length"))


@query("src10_file_router", """select p_partkey, 'File ' || p_size || '.' || case p_size % 5 when 0 then 'PDF' when 1 then 'xlsx' when 2 then 'Txt' when 3 then 'jpeg' else 'zip' end as filename, case p_size % 5 when 0 then 'pdf' when 1 then 'xlsx' when 2 then 'txt' when 3 then 'jpeg' else 'zip' end as extension,
 case p_size % 5 when 0 then 'pdf' when 1 then 'xlsx' when 2 then 'text' when 3 then 'image' end as route from part""")
def src10(spark, d):
    return _files(spark, d).select("p_partkey", "filename", "extension", "route")


@query("src13_text_reader", "select 'File ' || p_size || '.Txt' as filename, 1 as page_number, case when p_size % 2 = 0 then 'café ' || p_name else p_name end as text from part where p_size % 5 = 2")
def src13(spark, d):
    """UTF-8 and Latin-1 files beside each other."""
    return documents.text_pages(_files(spark, d)).select("filename", "page_number", "text")


@query("src16_tables_in_text", "select p_partkey, 1 as first_line, 2 as n_rows, 3 as n_cells, p_size::varchar as corner from part where p_size % 2 = 0")
def src16(spark, d):
    made = "if(p_size % 2 = 0, concat('Heading\\nUnit  Rent  ', p_size, '\\n101\\t1,200\\tAnn Lee\\nno table here'), 'a  b  1\\nonly one row')"
    found = documents.tables_in_text(t(spark, d, "part").selectExpr("p_partkey", f"{made} as text"), ["p_partkey"])
    return found.select("p_partkey", "first_line", F.size("rows").alias("n_rows"), F.size(F.col("rows")[0]).alias("n_cells"), F.col("rows")[0][2].alias("corner"))


@query("src18_folder_batch", "select n_nationkey::bigint as k, n_name || chr(10) as text, 'txt' as extension from nation")
def src18(spark, d):
    path = folder(spark)
    t(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("value")).repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    found = documents.files(spark, path, "*.txt")
    return found.select(F.regexp_extract("path", r"n_nationkey=(\d+)", 1).cast("long").alias("k"), documents.decoded("content").alias("text"), "extension")


@query("snk01_export_columns", "select p_name as \"Name\", round(p_retailprice, 2) as \"Price\", round(p_size, 2)::double as \"Share\", null::varchar as \"Missing\" from part")
def snk01(spark, d):
    rows = t(spark, d, "part").select("p_name", "p_retailprice", (F.col("p_size") / 100).alias("share"))
    return warehouse.export_columns(rows, [("Name", "p_name", "text"), ("Price", "p_retailprice", "currency"), ("Share", "share", "percent"), ("Missing", "x", "text")])


@query("snk04_table_dump", "select p_partkey::varchar as p_partkey, p_name, p_size::varchar as p_size from part where p_size = 10")
def snk04(spark, d):
    """Equality filters on known columns only."""
    path = folder(spark)
    warehouse.export_csv(t(spark, d, "part").select("p_partkey", "p_name", "p_size"), path, {"p_size": 10, "p_size; drop": 1, "other": 2})
    return warehouse.csv(spark, path)


@query("snk12_corrections_kept", "select p_partkey, coalesce(case when p_size % 2 = 0 then 'mine' end, p_name) as value, p_name as extracted from part")
def snk12(spark, d):
    rows = t(spark, d, "part").selectExpr("p_partkey", "p_name as extracted", "if(p_size % 2 = 0, 'mine', null) as user_value")
    return rows.select("p_partkey", portfolio.effective("user_value", "extracted").alias("value"), "extracted")


@query("sc02_try_cast", "select p_partkey, case when p_size % 3 = 0 then p_size end as n, case when p_size % 3 <> 1 then p_size::double end as x from part")
def sc02(spark, d):
    raw = t(spark, d, "part").selectExpr("p_partkey", "case p_size % 3 when 0 then cast(p_size as string) when 1 then 'n/a' end as n", "case p_size % 3 when 1 then '-' else cast(p_size as string) end as x")
    return raw.select("p_partkey", F.col("n").try_cast("int").alias("n"), F.col("x").try_cast("double").alias("x"))


@query("jn05_search_scored_by_word", """select property_id, property_name, market, num_units, 1 as has_scores from property where property_name like '%widget%' and num_units >= 5 and property_id in (select property_id from zscore) order by num_units desc nulls last, property_id limit 50""")
def jn05_rows(spark, d):
    from ..sources import surrogates as src
    from .warehouse import zscores

    return inv.search(src.properties(spark, d), zscores(spark, d), {"property_name__has": "widget", "num_units__min": 5}, True).select("property_id", "property_name", "market", "num_units", "has_scores")
