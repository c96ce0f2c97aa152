"""Queries of score runs, scenario overlays, provenance, the mutable store, notes and tiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hierarchy as hi
from ..operators import overlays as ov
from ..operators import proforma as pf
from ..operators import provenance as pv
from ..operators import scorecard as sc
from ..operators import scorestore as ss
from ..operators import synthesis as fs
from ..sources import surrogates as src
from ..sources.surrogates import table as t
from .loads import folder
from .registry import query
from .synthesis import _PERIODS, _periods
from .warehouse import rounded

# Score runs: a market is a nation, a run a year of shipments; a nation is scored in a run if its key and the year's last digit allow it.

_RUN_YEARS = range(1992, 1999)
_SCORES = """v as (select n_name as market, year(l_shipdate)::int as y, sum(l_extendedprice::decimal(18,2))::double as s, avg(l_discount) as a, avg(l_tax) as b, avg(l_quantity) as c, min(n_nationkey) as k from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
 where year(l_shipdate) between 1992 and 1998 group by 1, 2), f as (select *, rank() over (partition by y order by s desc)::int as rank from v where (k + y) % 3 <> 0)"""


def _store(spark, d):
    """Runs are appended one after the other, as they would be over time."""
    lines = t(spark, d, "lineitem").join(t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    v = lines.filter(F.year("l_shipdate").between(1992, 1998)).groupBy(F.col("n_name").alias("market"), F.year("l_shipdate").alias("y")).agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("mf"), F.avg("l_discount").alias("ds"), F.avg("l_tax").alias("occ_score"), F.avg("l_quantity").alias("rent_score"), F.min("n_nationkey").alias("k"),
    ).withColumn("tier", F.lit("All"))
    from pyspark.sql import Window

    path, v = folder(spark), v.persist()
    for year in _RUN_YEARS:
        one = v.filter(f"y = {year} and (k + y) % 3 <> 0")
        finals = one.withColumnRenamed("mf", "final_score").withColumn("rank", F.rank().over(Window.orderBy(F.desc("final_score"))))
        periods = one.withColumn("period", F.explode(F.array(F.lit("Annual"), F.lit("2Yr"))))
        ss.append(ss.run_rows(f"run {year}", F.lit(f"{year}-06-01 00:00:00"), F.lit(f"{year}-05-31"), one, periods, finals, '{"years": 10}'), path)
    v.unpersist()
    return ss.read(spark, path)


@query("snk05_stored_runs", f"""with {_SCORES} select 'run ' || y as run_id, score_type, count(*)::bigint as n, round(sum(s), 2) as total from f, (values ('tier', 1), ('final', 1), ('period', 1), ('period', 2)) k(score_type, i) group by 1, 2""")
def snk05(spark, d):
    return _store(spark, d).groupBy("run_id", "score_type").agg(F.count("*").alias("n"), F.round(F.sum("score_value"), 2).alias("total"))


@query("scd17_latest_rankings", f"with {_SCORES} select market, round(s, 2) as final_score, rank, 'run ' || y as run_id from f where y = (select max(y) from f)")
def scd17_rankings(spark, d):
    return ss.rankings(_store(spark, d)).select("market", F.round("score_value", 2).alias("final_score"), "rank", "run_id")


@query("scd17_history", f"with {_SCORES} select market, place, round(s, 2) as final_score, rank, y::varchar as year from (select *, row_number() over (partition by market order by y desc)::int as place from f) where place <= 3")
def scd17_history(spark, d):
    return ss.history(_store(spark, d), 3).select("market", "place", F.round("score_value", 2).alias("final_score"), "rank", F.year("scored_at").cast("string").alias("year"))


@query("scd17_explained", f"""with {_SCORES}, l as (select * from (select *, row_number() over (partition by market order by y desc) as p from f) where p = 1)
 select market, round(s, 2) as final_score, rank, round(a * 0.35, 6) as ds_share, round(b * 0.25, 6) as occ_score_share, round(c * 0.40, 6) as rent_score_share, '2Yr, Annual' as periods, 'All' as tiers from l""")
def scd17_explained(spark, d):
    names = lambda c, name: F.array_join(F.transform(c, lambda x: x[name]), ", ").alias(c)
    out = ss.explained(_store(spark, d)).select("market", F.round("final_score", 2).alias("final_score"), "rank", "ds_share", "occ_score_share", "rent_score_share", names("periods", "period"), names("tiers", "tier"))
    return rounded(out, "ds_share", "occ_score_share", "rent_score_share")


def _mode(case: str) -> str:
    return f"""select market, round(sum(w * ds) / sum(w), 6) as ds, round(sum(w * occ) / sum(w), 6) as occ_score, round(sum(w * rent) / sum(w), 6) as rent_score, round(sum(w * mf) / sum(w), 6) as mf from (select *, {case} as w from p) where w is not null group by market"""


_BY_PERIOD = """with p as (select n_name as market, year(l_shipdate) as y, (['Q1', 'Annual', '2Yr', '3Yr', '5Yr', '10Yr', '12Yr'])[(year(l_shipdate) - 1991)::int] as period, avg(l_discount) as ds, avg(l_tax) as occ, avg(l_quantity) as rent, avg(l_extendedprice) as mf
 from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey where year(l_shipdate) between 1992 and 1998 group by 1, 2)"""


@query("scd13_duration_modes", f"""{_BY_PERIOD} select 'standalone' as mode, * from ({_mode("case when y - 1991 <= 5 then 10.0::double end")}) union all
 select 'auto', * from ({_mode("case period when 'Q1' then 0.1::double * 2 / 3 when 'Annual' then 0.3::double when '2Yr' then 0.2::double when '3Yr' then 0.3::double + 0.4::double / 3 end")}) union all
 select 'fixed', * from ({_mode("case period when 'Annual' then 0.10::double when '2Yr' then 0.15::double when '5Yr' then 0.25::double when '10Yr' then 0.5::double end")})""")
def scd13_modes(spark, d):
    """Seven years of analysis in the automatic mode, five in the standalone one."""
    from functools import reduce

    lines = t(spark, d, "lineitem").join(t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    one = lines.filter(F.year("l_shipdate").between(1992, 1998)).groupBy(F.col("n_name").alias("market"), F.year("l_shipdate").alias("y")).agg(F.avg("l_discount").alias("ds"), F.avg("l_tax").alias("occ_score"), F.avg("l_quantity").alias("rent_score"), F.avg("l_extendedprice").alias("mf"))
    named = one.withColumn("period", F.expr("try_element_at(array('Q1', 'Annual', '2Yr', '3Yr', '5Yr', '10Yr', '12Yr'), y - 1991)"))
    single = one.withColumn("period", F.expr("concat('Yr', y - 1991)"))
    parts = [sc.market_scores(ss.weighted_by(rows, mode, years)).withColumn("mode", F.lit(mode)) for mode, years, rows in (("standalone", 5, single), ("auto", 7, named), ("fixed", 0, named))]
    return rounded(reduce(lambda a, b: a.unionByName(b), parts), "ds", "occ_score", "rent_score", "mf")


# Overlays: a scenario for every part; the base has nested, cited parameters, overlays change some of them.

_BASE = """to_json(named_struct('meta', named_struct('name', p_name, 'tags', array('a', p_brand)), 'debt', named_struct('rate', named_struct('value', p_size / 100.0D, 'source', concat('s', p_partkey % 7), 'note', 'base', 'locator', named_struct('page', p_size, 'sheet', 'S')), 'term', 30),
 'residual', named_struct('cap', named_struct('value', 0.05D, 'source', 'appraisal')), 'flat', 1))"""
_OVER = """case p_partkey % 4 when 0 then to_json(named_struct('debt', named_struct('rate', named_struct('value', 0.07D, 'confidence', 0.5D)))) when 1 then to_json(named_struct('debt', 5, 'flat', named_struct('a', 1, 'b', 2))) when 2 then '{"residual": {"cap": {"source": "guess"}}, "meta": {"tags": ["z"], "gone": null}}' else 'not json' end"""
_TOP = """if(p_partkey % 3 = 0, '{"debt": {"term": 40}, "flat": {"b": 3}}', '{}')"""


def _layers(spark, d):
    from functools import reduce

    p = t(spark, d, "part")
    return reduce(lambda a, b: a.union(b), [p.select(F.col("p_partkey").alias("scenario"), F.lit(k).alias("layer"), F.expr(x).alias("body")) for k, x in enumerate((_BASE, _OVER, _TOP))])


_MERGED = """with m as (select p_partkey, p_partkey % 4 as o, p_partkey % 3 = 0 as t, p_size, p_name, p_brand from part), leaf as (
 select p_partkey as scenario, 'meta/name' as path, '"' || p_name || '"' as value, 0 as layer from m union all select p_partkey, 'meta/tags', case when o = 2 then '["z"]' else '["a", "' || p_brand || '"]' end, case when o = 2 then 1 else 0 end from m
 union all select p_partkey, 'meta/gone', 'null', 1 from m where o = 2
 union all select p_partkey, 'debt/rate/value', case when o = 0 then '0.07' else (p_size / 100.0::double)::varchar end, case when o = 0 then 1 else 0 end from m where o <> 1 union all select p_partkey, 'debt/rate/confidence', '0.5', 1 from m where o = 0
 union all select p_partkey, 'debt/rate/source', '"s' || p_partkey % 7 || '"', 0 from m where o <> 1 union all select p_partkey, 'debt/rate/note', '"base"', 0 from m where o <> 1 union all select p_partkey, 'debt/rate/locator/page', p_size::varchar, 0 from m where o <> 1
 union all select p_partkey, 'debt/rate/locator/sheet', '"S"', 0 from m where o <> 1 union all select p_partkey, 'debt', '5', 1 from m where o = 1 and not t
 union all select p_partkey, 'debt/term', case when t then '40' else '30' end, case when t then 2 else 0 end from m where o <> 1 or t
 union all select p_partkey, 'residual/cap/value', '0.05', 0 from m union all select p_partkey, 'residual/cap/source', case when o = 2 then '"guess"' else '"appraisal"' end, case when o = 2 then 1 else 0 end from m
 union all select p_partkey, 'flat', '1', 0 from m where o <> 1 and not t union all select p_partkey, 'flat/a', '1', 1 from m where o = 1 union all select p_partkey, 'flat/b', case when t then '3' else '2' end, case when t then 2 else 1 end from m where o = 1 or t)"""


@query("src27_merged_scenarios", f"{_MERGED} select scenario, path, value, layer from leaf")
def src27(spark, d):
    return ov.merged(ov.flattened(_layers(spark, d))).select("scenario", "path", "value", "layer")


@query("src27_citations", f"""{_MERGED} select a.scenario, substr(a.path, 1, length(a.path) - 6) as path, trim(a.value, '"') as value, trim(s.value, '"') as source, coalesce(c.value::double, 1.0) as confidence, case when a.path like 'debt%' then p.value end as page
 from leaf a join leaf s on a.scenario = s.scenario and s.path = substr(a.path, 1, length(a.path) - 5) || 'source' left join leaf c on c.scenario = a.scenario and c.path = substr(a.path, 1, length(a.path) - 5) || 'confidence'
 left join leaf p on p.scenario = a.scenario and p.path = substr(a.path, 1, length(a.path) - 5) || 'locator/page' where a.path like '%/value'""")
def src27_citations(spark, d):
    return ov.citations(ov.merged(ov.flattened(_layers(spark, d)))).select("scenario", "path", "value", "source", "confidence", F.try_element_at("locator", F.lit("page")).alias("page"))


@query("src25_unregistered_sources", f"""{_MERGED} select scenario, substr(path, 1, length(path) - 7) as path, trim(value, '"') as source from leaf where path like '%/source' and trim(value, '"') not in ('appraisal', 's0', 's1', 's2', 's3', 's4')""")
def src25(spark, d):
    registry = t(spark, d, "nation").filter("n_nationkey < 5").select(F.concat(F.lit("s"), "n_nationkey").alias("source_id")).union(spark.sql("select 'appraisal'"))
    return ov.unregistered(ov.citations(ov.merged(ov.flattened(_layers(spark, d)))), registry).select("scenario", "path", "source")


@query("pf19_scenarios_from_overlays", """select p_partkey as scenario, case when p_partkey % 4 = 0 then 0.07 when p_partkey % 4 <> 1 then p_size / 100.0::double end as rate, case when p_partkey % 3 = 0 then 40 when p_partkey % 4 <> 1 then 30 end::int as term,
 case when p_partkey % 3 = 0 or p_partkey % 4 <> 1 then round(case when p_partkey % 4 = 1 then null else 1000 * (case when p_partkey % 4 = 0 then 0.07 else p_size / 100.0::double end / 12) / (1 - (1 + case when p_partkey % 4 = 0 then 0.07 else p_size / 100.0::double end / 12) ** (-12 * case when p_partkey % 3 = 0 then 40 else 30 end)) end + 1e-7, 4) end as payment from part""")
def pf19(spark, d):
    """All merged scenarios go through the loan at once."""
    rows = ov.merged(ov.flattened(_layers(spark, d)))
    one = lambda path, kind: F.max(F.when(F.col("path") == path, F.col("value").try_cast(kind)))
    wide = rows.groupBy("scenario").agg(one("debt/rate/value", "double").alias("rate"), one("debt/term", "int").alias("term"))
    return wide.withColumn("payment", F.round(pf.payment(F.lit(1000.0), F.col("rate"), F.col("term") * 12) + 1e-7, 4))


@query("src26_validated_overlay", """with v as (select s_suppkey as asset, unnest([2023, 2024]) as year, unnest([round(s_acctbal, 1), case when s_suppkey % 2 = 0 then 2.5 end]) * 1000.0 as noi, unnest([s_suppkey / 10.0, null]) * 1000.0::double as amf from supplier)
 select a.asset, a.year, a.label, round(noi, 2) as property_noi, round(amf, 2) as amf_amount, case when noi is not null or amf is not null then 0.95::double end as confidence from
 (select s_suppkey as asset, unnest([2022, 2023, 2024, 2024]) as year, unnest(['2022A', '2023A', '2024 Reforecast', 'TTM Sep 2024']) as label from supplier) a left join v on a.asset = v.asset and a.year = v.year and a.label in ('2023A', '2024 Reforecast')""")
def src26(spark, d):
    s = t(spark, d, "supplier").withColumnRenamed("s_suppkey", "asset")
    actuals = s.select("asset", F.expr("inline(array(struct(2022 as year, '2022A' as label, 'YEAR' as period_type), struct(2023 as year, '2023A' as label, 'YEAR' as period_type), struct(2024 as year, 'TTM Sep 2024' as label, 'TTM' as period_type), struct(2024 as year, '2024 Reforecast' as label, 'REFORECAST' as period_type)))"))
    noi = s.select("asset", F.lit("Property NOI").alias("section"), F.expr("""if(asset % 2 = 0, concat('{"2023A": ', cast(round(s_acctbal, 1) as string), ', "2024F": 2.5}'), concat('{"2023A": ', cast(round(s_acctbal, 1) as string), ', "2024F": null}'))""").alias("body"))
    amf = s.select("asset", F.lit("AMF (in OpEx)").alias("section"), F.expr("""concat('{"2023A": ', cast(asset / 10.0D as string), ', "bad": 1}')""").alias("body"))
    return rounded(ov.overlaid(actuals, ov.validated(noi.union(amf).union(amf.withColumn("section", F.lit("other"))))).select("asset", "year", "label", "property_noi", "amf_amount", "confidence"), "property_noi", "amf_amount", places=2)


# Provenance: a part's rent and growth by its own sales, its brand's, its type's and the model.

_FIELDS = ["rent", "growth"]


@query("lp09_assumptions", """with own as (select l_partkey as k, avg(l_extendedprice / l_quantity) as v, count(*) as n from lineitem where l_returnflag = 'R' group by 1), derived as (select l_partkey as k, avg(l_tax) as v, count(*) as n from lineitem group by 1 having count(*) > 30),
 market as (select p_brand, avg(p_retailprice) as r, avg(p_size / 100.0::double) as g, count(*) as n from part group by 1)
 select p_partkey, 'rent' as field, round(coalesce(own.v, market.r), 6) as value, case when own.v is not null then 'PROPERTY_ACTUAL' else 'MARKET_BENCHMARK' end as source, case when own.v is not null then 'high' else 'medium' end as confidence, case when own.v is not null then own.n else market.n end::bigint as sample_size,
  (1 + (own.v is not null)::int)::bigint as candidates, case when own.v is not null then 'MARKET_BENCHMARK' else '' end as passed_over from part join market using (p_brand) left join own on p_partkey = own.k
 union all select p_partkey, 'growth', round(coalesce(derived.v, market.g), 6), case when derived.v is not null then 'PROPERTY_DERIVED' else 'MARKET_BENCHMARK' end, case when derived.v is not null then 'high' else 'medium' end, case when derived.v is not null then derived.n else market.n end::bigint,
  (2 + (derived.v is not null)::int)::bigint, case when derived.v is not null then 'MARKET_BENCHMARK, MODEL_DEFAULT' else 'MODEL_DEFAULT' end from part join market using (p_brand) left join derived on p_partkey = derived.k""")
def lp09(spark, d):
    li, p = t(spark, d, "lineitem"), t(spark, d, "part")
    own = li.filter("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("rent"), F.count("*").alias("n"))
    derived = li.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.avg("l_tax").alias("growth"), F.count("*").alias("n")).filter("n > 30")
    market = p.join(p.groupBy("p_brand").agg(F.avg("p_retailprice").alias("rent"), F.avg(F.col("p_size") / F.lit(100.0)).alias("growth"), F.count("*").alias("n")), "p_brand")
    n, key = F.col("n"), ["p_partkey"]
    parts = [pv.assumptions(own, key, ["rent"], "PROPERTY_ACTUAL", "own sales", n), pv.assumptions(derived, key, ["growth"], "PROPERTY_DERIVED", "all sales", n), pv.assumptions(market, key, _FIELDS, "MARKET_BENCHMARK", "brand", n), pv.assumptions(p.withColumn("growth", F.lit(0.02)), key, ["growth"], "MODEL_DEFAULT", "two per cent")]
    out = pv.merged(parts, key).select("p_partkey", "field", "value", "source", "confidence", "sample_size", "candidates", F.array_join("passed_over", ", ").alias("passed_over"))
    return rounded(out, "value")


# The mutable store: regions hold nations, these suppliers and customers, customers orders, orders lines.

_TREE = [hi.Relation("lineitem", "line", "l_orderkey", "orders"), hi.Relation("orders", "o_orderkey", "o_custkey", "customer"), hi.Relation("customer", "c_custkey", "c_nationkey", "nation"), hi.Relation("supplier", "s_suppkey", "s_nationkey", "nation"), hi.Relation("nation", "n_nationkey", "n_regionkey", "region")]


def _tree(spark, d):
    tables = {n: t(spark, d, n) for n in ("region", "nation", "supplier", "customer", "orders")}
    return tables | {"lineitem": t(spark, d, "lineitem").withColumn("line", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))}


_DEAD = """dn as (select n_nationkey from nation where n_regionkey = 1), dc as (select c_custkey from customer where c_nationkey in (select * from dn) or c_custkey % 100 = 7), ds as (select s_suppkey from supplier where s_nationkey in (select * from dn)),
 d_o as (select o_orderkey from orders where o_custkey in (select * from dc) or o_orderkey % 1000 = 3), dl as (select distinct l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as id from lineitem where l_orderkey in (select * from d_o))"""


def _asked(spark, d):
    return spark.sql("select 'region' as table, '1' as id").union(t(spark, d, "customer").filter("c_custkey % 100 = 7").select(F.lit("customer"), F.col("c_custkey").cast("string"))).union(t(spark, d, "orders").filter("o_orderkey % 1000 = 3").select(F.lit("orders"), F.col("o_orderkey").cast("string")))


@query("snk10_cascading_delete", f"""with {_DEAD} select 'region' as "table", '1' as id union all select 'nation', n_nationkey::varchar from dn union all select 'customer', c_custkey::varchar from dc union all select 'supplier', s_suppkey::varchar from ds union all select 'orders', o_orderkey::varchar from d_o union all select 'lineitem', id from dl""")
def snk10(spark, d):
    return hi.cascade(_asked(spark, d), _tree(spark, d), _TREE)


@query("snk10_reads_and_compaction", f"""with {_DEAD} select 'orders' as name, count(*)::bigint as alive, round(sum(o_totalprice::decimal(18,2))::double, 2) as total, 0::bigint as left_over from orders where o_orderkey not in (select * from d_o)
 union all select 'customer', count(*), round(sum(c_acctbal::decimal(18,2))::double, 2), (select count(*) from dn) + (select count(*) from ds) + 1 + (select count(*) from d_o) + (select count(*) from dl) from customer where c_custkey not in (select * from dc)""")
def snk10_reads(spark, d):
    """Tombstones are written twice, which adds nothing; orders are read through them, customers compacted."""
    path, tables = folder(spark), _tree(spark, d)
    for _ in range(2):
        hi.bury(hi.cascade(_asked(spark, d), tables, _TREE), path)
    dead = hi.buried(spark, path)
    customers, rest = hi.compacted(tables["customer"], "customer", "c_custkey", dead, folder(spark))
    total = lambda name, c: [F.lit(name).alias("name"), F.count("*").alias("alive"), F.round(F.sum(F.col(c).cast("decimal(18,2)")).cast("double"), 2).alias("total")]
    orders = hi.alive(tables["orders"], "orders", "o_orderkey", dead).agg(*total("orders", "o_totalprice")).withColumn("left_over", F.lit(0).cast("long"))
    return orders.unionByName(customers.agg(*total("customer", "c_acctbal")).join(F.broadcast(rest.agg(F.count("*").alias("left_over")))))  # one row each


@query("snk09_allowed_updates", """select c_custkey, case when c_custkey % 5 = 0 then 'seg ' || c_custkey else c_mktsegment end as c_mktsegment, case when c_custkey % 7 = 0 then null when c_custkey % 5 = 0 then c_custkey + 0.5 else c_acctbal end as c_acctbal, c_nationkey from customer""")
def snk09(spark, d):
    """A later change wins, a null clears, a column that isn't allowed and a value that isn't a number change nothing."""
    c = t(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey")
    change = lambda where, field, value, at: c.filter(where).select(F.col("c_custkey").alias("id"), F.lit(field).alias("field"), F.expr(value).alias("value"), F.lit(at).alias("at"))
    changes = change("c_custkey % 5 = 0", "c_mktsegment", "'old'", 1).union(change("c_custkey % 5 = 0", "c_mktsegment", "concat('seg ', c_custkey)", 2)).union(change("c_custkey % 5 = 0", "c_acctbal", "cast(c_custkey + 0.5 as string)", 1))
    changes = changes.union(change("c_custkey % 7 = 0", "c_acctbal", "cast(null as string)", 3)).union(change("c_custkey % 11 = 0", "c_nationkey", "'99'", 1)).union(change("c_custkey % 2 = 1 and c_custkey % 5 > 0 and c_custkey % 7 > 0", "c_acctbal", "'a lot'", 9))
    return hi.updated(c, "c_custkey", changes, ("c_mktsegment", "c_acctbal"))


# Notes and tiers


@query("fs12_notes", f"""with {_PERIODS}, p as (select property_id, count(*)::bigint as n, arg_min(period, period) as a, arg_max(period, period) as z, count(case when noi_disagree or noi_differs then 1 end)::bigint as bad, coalesce(string_agg(case when contains(period, 'B') or contains(period, 'F') then period end, ', ' order by period), '') as plans from per group by 1),
 o as (select property_id, count(distinct document_id)::bigint as n_documents from opstat group by 1)
 select property_id, coalesce(n, 0)::bigint as n_periods, n_documents, coalesce(bad, 0)::bigint as n_discrepancies, case when n is null then 'No financial periods found.' else 'Financial data spans ' || n || ' periods: ' || a || ' through ' || z || '. Data sourced from ' || n_documents || ' document(s).'
 || case when bad > 0 then ' ' || bad || ' of ' || n || ' periods have discrepancies between source documents. See period-level notes for details.' else '' end || case when plans <> '' then ' Budget/forecast periods detected: ' || plans || '. These contain projected figures, not actuals.' else '' end end as notes
 from o left join p using (property_id)""")
def fs12(spark, d):
    return fs.notes(_periods(spark, d), src.opstat(spark, d)).select("property_id", "n_periods", "n_documents", "n_discrepancies", F.array_join("notes", " ").alias("notes"))


@query("fs16_amounts_by_tier", """with r as (select property_id, period, category, case document_type when 'operating_statement' then 'PRIMARY' when 'budget' then 'SECONDARY' else 'TERTIARY' end as tier, sum(amount::decimal(18,2)) as a, count(*)::bigint as items from opstat group by all)
 select property_id, period, category, tier, a::double as amount, items, round(a::double / (sum(a) over (partition by property_id, period, category))::double, 6) as share from r""")
def fs16(spark, d):
    o = src.opstat(spark, d)
    registry = fs.registered(o.select("document_id", F.col("document_id").alias("filename"), "document_type").distinct())
    return rounded(fs.by_tier(fs.cited(o), registry), "share")


@query("fs16_registry", """select document_id as source_id, max(case document_type when 'operating_statement' then 'MRI_INCOME_STATEMENT' when 'budget' then 'BUDGET_FILE' else 'OTHER' end) as source_type, max(case document_type when 'operating_statement' then 'PRIMARY' when 'budget' then 'SECONDARY' else 'TERTIARY' end) as tier from opstat group by 1""")
def fs16_registry(spark, d):
    o = src.opstat(spark, d)
    return fs.registered(o.select("document_id", F.col("document_id").alias("filename"), "document_type").distinct()).drop("title")
