"""Every registered query against its oracle at the smallest scale; queries without one must give rows of a stable schema."""

import re

import duckdb
import pytest
from conftest import DATA, compare
from pyspark.sql import functions as F

from lodestrata.functions import labels
from lodestrata.plans import catalog, portfolio

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, data, duck, name):
    df = catalog.QUERIES[name](spark, data)
    found = duck.sql(catalog.ORACLES[name])
    compare((df.columns, [tuple(r) for r in df.collect()]), (found.columns, found.fetchall()))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, data, name):
    df = catalog.QUERIES[name](spark, data)
    assert df.count() > 0 and df.schema == catalog.QUERIES[name](spark, data).schema


def test_matching_asks_for_every_row(spark, data):
    parts = spark.read.parquet(f"{data}/part.parquet").count()
    more = spark.read.parquet(f"{data}/part.parquet").withColumn("p_partkey", F.col("p_partkey") + 300)
    found = catalog.QUERIES["jn19_match_properties"](spark, data)
    assert found.select("document_id").distinct().count() == parts
    with pytest.MonkeyPatch.context() as m:  # ids above 300 too
        m.setattr(portfolio, "t", lambda *_: more)
        assert catalog.QUERIES["jn19_match_properties"](spark, data).select("document_id").distinct().count() == parts


def test_search_has_the_whole_owner_table(spark, data, monkeypatch):
    seen = {}
    monkeypatch.setattr(portfolio.po, "search_like", lambda sources, *_: seen.update(sources) or spark.range(1))
    catalog.QUERIES["tx17_search_like"](spark, data)
    assert seen["owner"][0].count() == spark.read.parquet(f"{data}/customer.parquet").count()


def test_types_of_the_documents_own_names_and_texts(spark, data):
    """Against brute force; the words of the keyword table are in some texts by chance only, so that some documents get them in front."""
    docs = {r.document_id: (r.filename, r.text) for r in portfolio.src.documents(spark, data).collect()}
    pool = [w for good, bad in labels.KEYWORDS.values() for w in good + bad]
    texts = {k: (" ".join(pool[(k * 7 + i * i) % len(pool)] for i in range(k % 9)) + " " * (k % 3 * 490) + (t or "")) for k, (_, t) in docs.items()}

    def of_text(text):
        body = text[:5000].lower()
        best = (0.0, None)
        for kind, (good, bad) in labels.KEYWORDS.items():
            points = sum(3 if w in body[:500] else w in body for w in good)
            points -= sum(4 if w in body[:500] else w in body[:1000] for w in bad)
            best = max(best, (max(0, points) / len(good), kind), key=lambda x: x[0])
        return (best[1] if best[0] > 0 else "unknown", round(min(1.0, 2 * best[0]), 9))

    def of_name(name):
        return next(((kind, confidence) for pattern, kind, confidence in labels.FILENAMES if re.search(pattern, name.lower())), (None, None))

    got = catalog.QUERIES["tx02_keywords_of_documents"](spark, data).collect()
    assert {r.document_id: (r.document_type, round(r.confidence, 9)) for r in got} == {k: of_text(t or "") for k, (_, t) in docs.items()}
    rows = spark.createDataFrame(list(texts.items()), "document_id long, text string")
    got = {r.document_id: (r.document_type, round(r.confidence, 9)) for r in labels.type_of_text(rows, "document_id", "text").collect()}
    assert got == {k: of_text(t) for k, t in texts.items()} and len({kind for kind, _ in got.values()}) > 3
    got = catalog.QUERIES["tx01_filenames_of_documents"](spark, data).collect()
    assert {r.document_id: (r.document_type, r.confidence) for r in got} == {k: of_name(n) for k, (n, _) in docs.items()}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
