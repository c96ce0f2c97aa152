"""What must not grow: copies that are compared, tables sent to all executors, rows of one task."""

import pytest
from pyspark.sql import functions as F
from test_indexes import PLACES, places

from lodestrata.operators import matching
from lodestrata.plans import catalog


@pytest.fixture
def met(monkeypatch):
    """Documents and properties that were compared, by call."""
    seen, whole = [], matching._met

    def run(asks, members, exact=True):
        seen.append((asks.select("id").distinct().count(), members.select("id").distinct().count()))
        return whole(asks, members, exact)

    monkeypatch.setattr(matching, "_met", run)
    return seen


def _thrice(rows):
    return rows.withColumn("c", F.explode(F.array(*map(F.lit, (0, 1000, 2000))))).withColumn("id", F.col("id") + F.col("c")).drop("c")


def test_copies_are_compared_once_by_candidates(spark, met):
    rows = spark.createDataFrame([r for r in places(30, 7) if r[1]], PLACES)
    pairs = lambda df: sorted((r.did, r.pid, round(r.score, 9)) for r in matching.candidates(df, df, 0.6).collect())
    one = pairs(rows)
    assert pairs(_thrice(rows)) == sorted((d + i, p + j, s) for d, p, s in one for i in (0, 1000, 2000) for j in (0, 1000, 2000))
    assert met[0] == met[1]


def test_copies_are_compared_once_by_the_best_five(spark, met):
    """Five of least id at most among equal properties; equal documents get the same."""
    docs, props = (spark.createDataFrame([r for r in places(n, seed) if r[1]], PLACES) for n, seed in ((20, 1), (30, 2)))
    best = lambda d, p: {(r.document_id, r["rank"]): (r.property_id, r.score) for r in matching.match_properties(d, p, most=5).collect()}
    every = {}
    for r in matching.match_properties(docs, props, most=100).collect():
        every.setdefault(r.document_id, []).append((r.property_id, r.score))
    want = {}
    for d, found in every.items():
        copies = sorted((-s, p + j) for p, s in found for j in (0, 1000, 2000))[:5]
        want |= {(d + i, n + 1): (p, -s) for i in (0, 1000, 2000) for n, (s, p) in enumerate(copies)}
    assert best(_thrice(docs), _thrice(props)) == want
    assert met[0] == met[1]


#: Queries whose joined sides are exploded or come from Python, so that Spark takes them for smaller than they are.
NOT_BROADCAST = ["pf05_opex_detail", "pf08_capex_funding", "pf11_annual_lines", "pf14_returns", "pf15_waterfall", "pf19_scenarios_from_overlays", "src27_citations", "src27_merged_scenarios"]


def _join_of_cells(spark, data):
    return catalog.QUERIES["tx08_mapped_columns"](spark, data)._jdf.queryExecution().executedPlan().toString()


def test_cells_are_not_sent_to_all_executors(spark, data):
    assert "BroadcastHashJoin" not in _join_of_cells(spark, data)


@pytest.mark.parametrize("name", NOT_BROADCAST)
def test_no_exploded_rows_are_sent_to_all_executors(spark, data, name):
    plan = catalog.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan


def test_little_data_with_folds_is_dealt_to_many_tasks(spark, data):
    assert catalog.QUERIES["pf08_capex_funding"](spark, data).rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.fixture
def counted(monkeypatch):
    """Rows that go into percentiles, by call."""
    from lodestrata.operators import sales

    seen, whole = [], sales.quantiles

    def run(rows, *args):
        seen.append(rows.count())
        return whole(rows, *args)

    monkeypatch.setattr(sales, "quantiles", run)
    return seen


def _sales(spark, data):
    from lodestrata.sources import surrogates

    return surrogates.sales(spark, data)


@pytest.mark.parametrize("name, times", [("flt08_pricing_trend", 1), ("scd14_rankings", 2), ("scd18_scenario_compare", 2), ("scd13_market_scores", 2), ("scd12_period_scores", 2), ("scd15_signals", 2)])
def test_percentiles_are_taken_of_what_is_asked_for(spark, data, counted, name, times):
    catalog.QUERIES[name](spark, data)
    assert counted == [times * _sales(spark, data).count()]
