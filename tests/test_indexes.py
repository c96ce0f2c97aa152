"""The top-k join, the text index, percentiles and the loaders of grids against brute force and by hand."""

import math
import random
import re
from collections import Counter
from datetime import date
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lodestrata.functions.quantiles import quantiles
from lodestrata.operators import matching, search, textindex
from lodestrata.sources import grids


PLACES = "id long, name string, address string, city string, state string"


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def whole_score(d, p):
    n, a, g = (ratio(d[k], p[k]) for k in range(3))
    if d[0] and p[0] and (d[0] in p[0] or p[0] in d[0]):
        n = max(n, 0.85)
    if d[4] and d[4] == p[4]:
        a = max(a, 0.6)
    return math.floor((n * 50 + a * 30 + g * 12 + (8 if d[3] and d[3] == p[3] else 0)) * 10 + 0.5) / 1000


def places(n, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("oak elm pine court place gardens tower lofts village the green river hill park view señorío".split())
    rows = [(k, " ".join(word() for _ in range(rng.randrange(1, 4))), f"{rng.randrange(1, 60)} {word()} st", rng.choice(["austin", "boston", "dallas", "el paso", ""]), rng.choice(["tx", "ma", None])) for k in range(n)]
    return rows + [(n, None, None, None, None), (n + 1, "", "", "", ""), (n + 2, "x" * 300, "7", "austin", "tx"), (n + 3, "Oak", None, "austin", "tx")]


@pytest.mark.parametrize("cell, part, seeds", [(512, 50_000, 8), (4, 7, 1)])
def test_top_five_equal_comparing_every_pair(spark, monkeypatch, cell, part, seeds):
    for name, value in (("CELL", cell), ("PART", part), ("SEEDS", seeds), ("BLOCK", 20)):
        monkeypatch.setattr(matching, name, value)
    docs, props = (spark.createDataFrame(places(n, seed), PLACES) for n, seed in ((60, 1), (150, 2)))
    strings = lambda df: {r.id: (r.name, r.addr, r.city, r.state, r.no) for r in matching.prepared(df).collect()}
    d, p = strings(docs), strings(props)
    want = {}
    for k, x in d.items():
        best = sorted((-s, j) for j, y in p.items() if (s := whole_score(x, y)) >= 0.4)[:5]
        want |= {(k, n + 1): (j, -s) for n, (s, j) in enumerate(best)}
    got = {(r.document_id, r["rank"]): (r.property_id, r.score) for r in matching.match_properties(docs, props).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)


def test_bounds_never_fall_below_scores(spark):
    d, p = (matching.prepared(spark.createDataFrame(places(40, seed), PLACES)).toPandas() for seed in (3, 4))
    docs, props = matching._Side(d), matching._Side(p)
    cells = matching._Cells(matching.summaries(matching.in_cells(spark.createDataFrame(p))).toPandas())
    k = {r.id: r.k for r in matching.in_cells(spark.createDataFrame(p)).collect()}
    facts = lambda rows: list(rows[["name", "addr", "city", "state", "no"]].itertuples(index=False, name=None))
    for x, own, by_cell in zip(facts(d), matching._bounds(docs, props), matching._bounds(docs, cells), strict=True):
        of_cell = dict(zip(cells.ids, by_cell, strict=True))
        for j, y in enumerate(facts(p)):
            assert whole_score(x, y) <= own[j] + matching.SLACK and own[j] <= of_cell[k[p["id"][j]]] + 1e-9


def test_few_pairs_are_compared(spark, data):
    """The pairs that are met grow far slower than the number of all pairs."""
    met = []
    for n in (100, 200, 400):
        rows = spark.createDataFrame(places(n, 5), PLACES)
        members = matching.in_cells(matching.prepared(rows))
        floors = matching.floors(matching.prepared(rows), matching.prepared(rows), 0.4, 5).select("id", "name", "addr", "city", "state", "no", "floor")
        met.append(matching._met(matching.asked(floors, matching.summaries(members)), members, exact=False).count())
    assert met[2] < 0.2 * 400**2 and met[2] / met[1] < 3.2


# the text index


def tokens(text, stem):
    found = re.findall(textindex.TOKEN, (text or "").lower())
    return [search.stem(w) for w in found] if stem else found


def ranked(docs, must, may, never, limit, stem):
    words = {k: tokens(t, stem) for k, t in docs.items()}
    mean = sum(map(len, words.values())) / len(words) or 1.0
    df = Counter(w for ws in words.values() for w in set(ws))
    idf = lambda w: math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5))
    tf = lambda f, n: f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean))

    def score(item, ws):
        terms = re.findall(textindex.TOKEN, item.lower())
        if item.endswith("*") and len(terms) == 1:
            return sum(idf(w) * tf(f, len(ws)) for w, f in Counter(ws).items() if w.startswith(terms[0]))
        terms = [search.stem(w) for w in terms] if stem else terms
        if not terms:
            return 0.0
        times = sum(ws[i : i + len(terms)] == terms for i in range(len(ws)))
        return sum(map(idf, terms)) * tf(times, len(ws)) if times else 0.0

    out = {}
    for k, ws in words.items():
        scores = [score(x, ws) for x in (*must, *may)]
        if all(scores[: len(must)]) and any(scores) and not any(score(x, ws) for x in never):
            out[k] = sum(scores)
    return sorted(((round(s, 6), k) for k, s in out.items()), key=lambda x: (-x[0], x[1]))[:limit]


QUESTIONS = [
    (("rent",), (), ()), (("base rent",), (), ()), ((), ("rent", "lease"), ()), (("rent",), ("base rent", "lea*"), ("void",)), (("the the",), (), ()), (("a b a",), (), ()), (("rent*",), (), ("base rent",)), (("nothinglikeit",), (), ()), (("...",), (), ()), ((), ("zz*",), ()), (("the", "of"), ("rent lease",), ()), ((), (), ("rent",)),
]


@pytest.mark.parametrize("stem", [False, True])
def test_index_answers_as_a_scan_does(spark, tmp_path, monkeypatch, stem):
    rng = random.Random(7)
    vocabulary = "the the the of of a a b rent rents rental base lease leases leasing void zzz caf\xe9 2024".split()
    docs = {k: " ".join(rng.choice(vocabulary) + rng.choice(["", "", ",", ". "]) for _ in range(rng.choice([1, 3, 8, 40, 200]))) for k in range(300)} | {900: None, 901: "", 902: "the " * 2000}
    monkeypatch.setattr(textindex, "BLOCK", 16)
    path = str(tmp_path / "index")
    textindex.build(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3), path, stem=stem)
    for must, may, never in QUESTIONS[::3] if stem else QUESTIONS:
        for wave in (1,) if stem else (1, 64):
            got = [(round(r.score, 6), r.doc) for r in textindex.search(spark, path, must, may, never, limit=12, stem=stem, wave=wave).collect()]
            want = ranked(docs, must, may, never, 12, stem)
            assert [k for _, k in got] == [k for _, k in want] and [s for s, _ in got] == pytest.approx([s for s, _ in want], abs=2e-6), (must, may, never)


def test_a_question_reads_its_own_terms_only(spark, tmp_path):
    path = str(tmp_path / "index")
    textindex.build(spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta beta")], "doc_id long, text string"), path, stem=False)
    rows = textindex.asked_postings(spark, path, [textindex._Item("beta", False), textindex._Item("gam*", False)])
    plan = rows.select("term", "n")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "PushedFilters" in plan and "head" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "StringStartsWith(term,gam)" in plan and "docs" not in plan.split("ReadSchema")[1]
    assert {r.term for r in rows.collect()} == {"beta", "gamma"}


def test_index_of_an_empty_table(spark, tmp_path):
    textindex.build(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "index"))
    assert textindex.search(spark, str(tmp_path / "index"), ("rent",)).collect() == []


# percentiles


def test_percentiles_with_an_outlier(spark):
    values = [float(k) for k in range(5000)] + [1e12, -1e15]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 2.0)], "k string, v double").repartition(5)
    got = {r.k: (r.low, r.mid, r.top) for r in quantiles(df, ["k"], {"low": ("v", 0.25), "mid": ("v", 0.5), "top": ("v", 1.0)}).collect()}
    want = {r.k: tuple(r)[1:] for r in df.groupBy("k").agg(*[F.percentile("v", F.lit(p)) for p in (0.25, 0.5, 1.0)]).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


# grids


def cells(spark, *rows):
    """(file, sheet, row, col, value) with values of any kind."""
    kinds = lambda v: (v if isinstance(v, str) else None, float(v) if isinstance(v, (int, float)) else None, v if isinstance(v, date) else None)
    return spark.createDataFrame([(f, s, r, c, *kinds(v)) for f, s, r, c, v in rows], grids.CELLS)


def test_statements_without_a_header_or_with_late_totals(spark):
    months = [("a", "S", 6, c, date(2023, c - 1, 1)) for c in range(2, 14)]
    got = grids.income_statements(cells(
        spark, *months, ("a", "S", 5, 2, "Month"), ("a", "S", 6, 14, "Total"), ("a", "S", 6, 20, "Total Forecast"), ("a", "S", 7, 1, "Gross Potential Rent"), ("a", "S", 7, 14, 5), ("a", "S", 7, 20, 7), ("a", "S", 8, 1, "TOTAL INCOME"), ("a", "S", 8, 20, 9),
        ("a", "S", 9, 1, "TOTAL INCOME"), ("a", "S", 9, 20, 11), ("a", "S", 10, 1, "  "), ("a", "S", 10, 20, 1), ("a", "S", 11, 1, "Nothing"), ("b", "S", 2, 2, date(2023, 1, 1)), ("b", "S", 3, 1, "Gross Potential Rent"), ("b", "S", 3, 14, 3), ("a", "S", 4, 1, "Gross Potential Rent"), ("a", "S", 4, 20, 8),
    )).collect()
    assert {(r.file, r.row, r.field, r.amount, r.cell) for r in got} == {("a", 7, None, 7.0, "T7"), ("a", 9, "total_revenue", 11.0, "T9")}
    assert grids.income_statements(spark.createDataFrame([], grids.CELLS)).collect() == []


def test_ledger_edges(spark):
    head = [("f", "KA", 3, c, n) for c, n in enumerate(["Period", "Entry Date", "Ref", "Description", "Debit", "Credit"], 1)]
    rows = [
        (4, "12/17", date(2019, 8, 1), "r", "2018 Beginning Balance", None, 100), (5, "01/18", "2018-01-15 10:00:00", 7, "Draw", None, 50), (6, "02/18", None, None, "Paid out", 30, 0), (7, "03/18", None, None, "Account Totals", 180, 0),
        (8, None, None, None, "no date", 5, 0), (9, "04/18", None, None, "no amount", 0, 0), (10, "05/79", "05/06/2018", None, None, 10, 4),
    ]
    grid = cells(spark, *head, *[("f", "KA", r[0], c, v) for r in rows for c, v in enumerate(r[1:], 1) if v is not None], *[("f", "other", *x[2:]) for x in head], ("f", "other", 4, 5, 3.0), ("f", "KA", 12, 1, "Period"))
    got = grids.equity_transactions(grid, {"KA": "K"})
    assert {(r.row, r.date, r.transaction_type, r.amount) for r in got.collect()} == {(4, date(2017, 12, 1), "contribution", -100.0), (5, date(2018, 1, 15), "contribution", -50.0), (6, date(2018, 2, 1), "distribution", 30.0), (10, date(2018, 5, 6), "contribution", 6.0)}
    assert {(r.year, r.contributions, r.distributions, r.net, r.balance) for r in grids.annual_equity(got).collect()} == {(2017, 100.0, 0.0, 100.0, 100.0), (2018, 50.0, 36.0, 14.0, 114.0)}


def test_tailed_lines(spark):
    pages = spark.createDataFrame([(1, 1, "NET OPERATING INCOME " + " ".join(f"{k},000.50" for k in range(13)) + "\nTOTAL INCOME -1.00 2.00\nTotal Income 5" + " 1.00" * 12 + " -2,500.25"), (2, 1, None)], "doc int, page_number int, text string")
    assert {(r.doc, r.field, r.amount) for r in grids.statement_totals(pages, "doc").collect()} == {(1, "noi", 12000.5), (1, "total_revenue", -2500.25)}


def test_roster_ends_at_its_totals(spark):
    grid = [("f", "Revenues", r, c, v) for r, name in ((8, "Studio A"), (9, "1BR"), (10, "TOTALS"), (11, "2BR")) for c, v in ((2, name), (3, 5), (4, 500), (6, 900.0))]
    got = grids.unit_roster(cells(spark, *grid, ("f", "Rent Roll", 7, 10, 950.0), ("f", "Rent Roll", 7, 11, -20.0))).collect()
    assert sorted((r.row, r.bedrooms, r.net_rent, r.year1_rent) for r in got) == [(8, "Studio", 930.0, 900.0), (9, "1 Bedroom", 900.0, 900.0)]
