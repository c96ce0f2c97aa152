"""DuckDB twins of ``lodestrata.sources.surrogates``: an oracle names a domain table and gets its definition in front."""

from __future__ import annotations

import re

TABLES = {
    "property": """select p_partkey as property_id, p_name as property_name, p_name || ' ' || p_size as address, p_brand as city, substr(p_type, 1, 2) as state,
      p_brand as market, p_brand || '/' || (p_size % 5) as submarket, (1950 + p_partkey % 70)::int as year_built, p_size as num_units,
      p_type as building_class, p_retailprice as ask, date '9999-12-31' as valid_to from part""",
    "sales": """select l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as transaction_id, l_partkey as property_id, l_returnflag as asset_class, p_name as property_name,
      p_name || ' ' || p_size as property_address, n_name as market, l_shipdate::date as sale_date, year(l_shipdate)::int as sale_year,
      year(l_shipdate) || ' Q' || quarter(l_shipdate) as sale_quarter, l_extendedprice as sale_price, nullif(l_discount, 0) as cap_rate_actual,
      l_extendedprice / l_quantity as price_per_unit, l_quantity::int as num_units, (1950 + l_partkey % 70)::int as year_built, p_type as building_class,
      c_name as buyer_name, s_name as seller_name
      from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
      join nation on s_nationkey = n_nationkey join part on l_partkey = p_partkey""",
    "ownership": """select o_orderkey as ownership_id, o_custkey % 997 as property_id, c_name as owner_canonical, o_orderdate::date as acquisition_date, nd::date as disposition_date,
      o_totalprice as acquisition_price, np as disposition_price, (date_diff('day', o_orderdate::date, nd::date) // 30)::int as hold_months, o_orderstatus = 'O' as is_current
      from (select *, lead(o_orderdate) over w as nd, lead(o_totalprice) over w as np from orders join customer on o_custkey = c_custkey
      window w as (partition by o_custkey order by o_orderdate, o_orderkey))""",
    "leases": """select p_brand as property_id, l_partkey as unit, p_type as unit_type, case when p_size <= 10 then 'Studio' when p_size <= 25 then '1BR' when p_size <= 40 then '2BR' else 'other' end as general_type,
      l_shipdate::date as lease_start, l_shipdate::date + (180 + l_quantity::int * 7) as lease_exp, l_extendedprice / l_quantity as face_rent,
      l_extendedprice / l_quantity * (1 - l_discount) as effective_rent, 6 + l_quantity::int % 19 as term_months, l_returnflag = 'R' as is_renewal,
      l_orderkey as lease_id, l_linenumber as line from lineitem join part on l_partkey = p_partkey""",
    "units": """select p_brand as property_id, p_partkey as unit_number, p_type as unit_type, p_type || '-' || (p_size % 3) as floorplan, p_size % 4 as bedrooms,
      (['occupied', 'occupied', 'occupied', 'occupied', 'vacant', 'notice', 'available', 'model'])[p_partkey % 8 + 1] as status,
      p_retailprice as current_rent, p_retailprice * (1 + (p_partkey % 11 - 5) / 100.0::double) as market_rent, (400 + p_size * 15)::double as square_footage from part""",
    "opstat": """select l_suppkey as property_id, l_suppkey || ':' || substr(o_orderpriority, 1, 1) as document_id,
      (['audited_financial', 'operating_statement', 'budget', 'appraisal', 'other'])[substr(o_orderpriority, 1, 1)::int] as document_type,
      year(l_shipdate) || case l_linestatus when 'F' then 'A' else 'B' end as period,
      case l_returnflag when 'A' then 'income' when 'N' then 'expense' else 'noi' end as category,
      case when l_linenumber = 7 then 'Net Operating Income' else 'line ' || l_linenumber end as line_item,
      l_extendedprice as amount, l_linenumber = 6 as is_subtotal, l_linenumber = 5 as is_total, l_quantity::int as page_number
      from lineitem join orders on l_orderkey = o_orderkey""",
    "usage_log": """select event_id, user_id % 7 as org_id, user_id, event_type as action, trunc(value)::int % 50 as page_count, value as processing_time, event_id % 10 <> 0 as success, ts as created_at from events""",
    "docs": """select doc_id as document_id, source || '_' || lang || '_' || doc_id || '.txt' as filename, source, lang, doc_id % 500 as property_id, text, n_chars,
      case when doc_id % 5 = 0 then 'lease' when doc_id % 5 = 1 then 'rent_roll' when doc_id % 5 = 2 then 'operating_statement' when doc_id % 5 = 3 then 'loan' else 'other' end as document_type,
      case when doc_id % 4 = 0 then 'approved' when doc_id % 4 = 1 then 'pending' when doc_id % 4 = 2 then 'skipped' end as review_status from documents""",
    "zscore": """select property_id, 'Market Rate Apartments' as universe, 'market_class' as peer_cut, 'all' as "view", market || ' | ' || building_class as peer_group_key, metric, value,
      avg(value) over g as peer_mean, stddev_samp(value) over g as peer_std, count(value) over g as peer_n,
      case when stddev_samp(value) over g > 0 and count(value) over g >= 3 then (value - avg(value) over g) / stddev_samp(value) over g end as z_score
      from (select property_id, market, building_class, unnest(['num_units', 'ask', 'year_built']) as metric, unnest([num_units::double, ask, year_built::double]) as value from property)
      window g as (partition by market, building_class, metric)""",
    "caprate": """select market, asset_class, sale_year::varchar as period, 'year' as period_type, 'market' as granularity, count(cap_rate_actual)::bigint as n_deals, median(cap_rate_actual) as cap_rate_median,
      avg(cap_rate_actual) as cap_rate_mean, stddev_samp(cap_rate_actual) as cap_rate_std, quantile_cont(cap_rate_actual, 0.25) as cap_rate_p25, quantile_cont(cap_rate_actual, 0.75) as cap_rate_p75
      from sales where cap_rate_actual is not null group by market, asset_class, sale_year
      union all select null, asset_class, sale_year::varchar, 'year', 'national_by_class', count(cap_rate_actual)::bigint, median(cap_rate_actual), avg(cap_rate_actual), stddev_samp(cap_rate_actual),
      quantile_cont(cap_rate_actual, 0.25), quantile_cont(cap_rate_actual, 0.75) from sales where cap_rate_actual is not null group by asset_class, sale_year
      union all select null, null, sale_quarter, 'quarter', 'national', count(cap_rate_actual)::bigint, median(cap_rate_actual), avg(cap_rate_actual), stddev_samp(cap_rate_actual),
      quantile_cont(cap_rate_actual, 0.25), quantile_cont(cap_rate_actual, 0.75) from sales where cap_rate_actual is not null group by sale_quarter""",
    "pricing": """select market, case when by_class then building_class end as building_class, sale_year, case when market is null then 'national' when by_class then 'market_by_class' else 'market' end as granularity,
      count(*)::bigint as n_deals, sum(sale_price) as total_volume, median(sale_price) as median_price, median(price_per_unit) as median_ppu, quantile_cont(price_per_unit, 0.25) as p25_ppu,
      quantile_cont(price_per_unit, 0.75) as p75_ppu, avg(price_per_unit) as mean_ppu
      from (select case when g < 2 then market end as market, case when g = 1 then building_class end as building_class, g = 1 as by_class, sale_year, sale_price, price_per_unit from sales, (values (0), (1), (2)) v(g))
      group by market, building_class, by_class, sale_year""",
}


def _needs(sql: str, seen: dict[str, str]) -> None:
    for name, body in TABLES.items():
        if name not in seen and re.search(rf"\b(?:from|join)\s+{name}\b|,\s*{name}\b", sql):
            _needs(body, seen)
            seen.setdefault(name, body)


def with_tables(sql: str) -> str:
    """``sql`` (without a leading WITH of its own, or starting with "with ") behind the tables that it names."""
    seen: dict[str, str] = {}
    _needs(sql, seen)
    if not seen:
        return sql
    head = ", ".join(f"{n} as ({b})" for n, b in seen.items())
    body = sql.strip()
    recursive = "recursive " if body[:15].lower().startswith("with recursive") else ""
    if body[:5].lower() == "with ":
        return f"with {recursive}{head}, {body[5 + len(recursive) :]}"
    return f"with {head} {body}"
