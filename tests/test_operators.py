"""Hand-computed fixtures for what SQL can't express, edges and quirks."""

from datetime import date, datetime
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import labels
from lodestrata.functions import text as tx
from lodestrata.functions.quantiles import quantiles
from lodestrata.operators import inventory, leases, portfolio, proforma, scorecard, search, waterfall
from lodestrata.operators import synthesis as fs
from lodestrata.sources import documents, warehouse
from lodestrata.streaming import usage


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_tiers_at_their_edges(spark):
    got = [one(spark, leases.tier(F.lit(x), leases.VELOCITY)) for x in (0.05, 0.0500001, 0.10, 0.20, 0.30, 0.31, 5.0)]
    assert got == ["stalled", "slow", "slow", "normal", "strong", "very_strong", "very_strong"]
    assert [one(spark, inventory.size_tier(F.lit(x))) for x in (49, 50, 74, 75, 150, 299, 300)] == ["1: 25-49", "2: 50-74", "2: 50-74", "3: 75-149", "4: 150-299", "4: 150-299", "5: 300+"]
    assert one(spark, inventory.size_tier(F.lit(None).cast("int"))) is None
    assert [one(spark, leases.unit_type(F.lit(None).cast("int"), F.lit(x))) for x in (449, 450, 699, 700, 999, 1000)] == ["Studio", "1BR", "1BR", "2BR", "2BR", "3BR"]


def test_downtime_trims_and_limits(spark):
    start = date(2024, 1, 1)
    rows = spark.createDataFrame([(1, float(g)) for g in (10, 20, 30, 400)], "property_id int, gap double")
    got = leases.downtime(rows, ["property_id"]).first()
    assert (got.median_days, got.trimmed_mean, got.n_turns) == (25.0, 25.0, 4)
    assert got.p75_days == pytest.approx(122.5)
    days = lambda n: date.fromordinal(start.toordinal() + n)
    ls = [(1, u, "A", days(0), days(100), False, 1, u) for u in range(4)] + [(1, u, "A", days(100 + g), days(900), u == 9, 2, u) for u, g in enumerate((-31, -30, 540, 541))]
    df = spark.createDataFrame(ls, "property_id int, unit int, unit_type string, lease_start date, lease_exp date, is_renewal boolean, lease_id int, line int")
    assert sorted(r.gap for r in leases.gaps(df).collect()) == [-30.0, 540.0]


def test_peer_zscore_needs_three_peers(spark):
    p = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (3, "a", 3.0), (4, "b", 1.0), (5, "b", 2.0), (6, None, 9.0)], "property_id int, market string, v double")
    z = {r.property_id: r.z_score for r in inventory.peer_zscores(p, p, ["market"], "m", ["v"]).collect()}
    assert z == {1: -1.0, 2: 0.0, 3: 1.0, 4: None, 5: None}


def test_scorecard_arithmetic(spark):
    f = lambda z, a: one(spark, scorecard.asymmetric(F.lit(z), F.lit(a)))
    assert (f(2.0, 1.5), f(-3.0, 1.5), f(-3.0, 0.0)) == (3.0, -2.0, -3.0)
    assert one(spark, scorecard.bounded(F.lit(-9.0), scorecard.CATEGORY)) == 0.25
    assert scorecard.duration_weights(10) == scorecard.PERIODS
    assert scorecard.duration_weights(7)["Annual"] == pytest.approx(0.30)
    assert scorecard.duration_weights(50) == scorecard.duration_weights(20)
    assert one(spark, scorecard.category_z(F.lit(3.0), F.array(*map(F.lit, (1.0, 2.0, 3.0))))) == pytest.approx(1.0)
    rows = spark.createDataFrame([("All", "x", 1.0), ("3 Star", "x", 0.0), ("All", "y", 1.0)], "tier string, market string, mf double")
    got = {r.market: (round(r.final_score, 6), r["rank"]) for r in scorecard.rankings(rows).collect()}
    assert got == {"y": (1.0, 1), "x": (round(0.4 / 0.65, 6), 2)}


def _scenario(**changes):
    base = dict(
        scenario_id=1, start=date(2026, 4, 15), hold_years=2, units=10.0, rent=100.0, inflation=[0.0, 0.03], terminal=0.02, l2l=0.01, vacancy=0.05, concessions=0.0, bad_debt=0.01, other_pupy=120.0, other_y2=None, opex_pupy=600.0,
        opex_inflation=0.03, capex=[1200.0, 2400.0], equity_reserve=1500.0, loan_cap=1000.0, capex_rate=0.06, funding="equity_first", principal=100000.0, rate=0.06, amortization=360, io_months=2, start_balance=None, amf_pct=0.02,
        reserves_pupy=12.0, professional=120.0, mip_pct=0.0, surplus_note=100.0, cost_basis=150000.0, exit_cap=0.05, sale_cost_pct=0.02, sale_year=2, tmv=[100000.0], tmv_growth=0.1, maa_floor=90000.0, class_rate=0.0125, capacity_rate=1.0,
        base_ntc=500.0, developer_share=0.9, admin_pct=0.1, osa_pct=0.0, last_increment_year=2027, note_balance=500.0, note_rate=0.1,
    )
    return base | changes


def _scenarios(spark, *changes):
    rows = [_scenario(scenario_id=i, **c) for i, c in enumerate(changes)]
    order = [p.split()[0] for p in proforma.PARAMETERS.replace("\n", " ").split(",")]
    return spark.createDataFrame([tuple(r[c] for c in order) for r in rows], proforma.PARAMETERS)


def test_debt_matches_a_loop(spark):
    s = _scenarios(spark, {}, {"rate": 0.0, "amortization": 12, "io_months": 0}, {"start_balance": 500.0, "io_months": 0})
    got = {(r.scenario_id, r.month): r for r in proforma.debt(s).collect()}
    for k, (rate, n, io, balance) in enumerate(((0.06, 360, 2, 100000.0), (0.0, 12, 0, 100000.0), (0.06, 360, 0, 500.0))):
        pay = 100000.0 / n if rate == 0 else 100000.0 * rate / 12 / (1 - (1 + rate / 12) ** -n)
        for m in range(1, 25):
            interest = balance * rate / 12
            principal = 0.0 if m <= io else min(max(0.0, pay - interest), balance)
            r = got[k, m]
            assert r.beginning == pytest.approx(balance) and r.principal_paid == pytest.approx(principal) and r.payment == pytest.approx(interest if m <= io else pay)
            balance = max(0.0, balance - principal)
            assert r.ending == pytest.approx(balance)


@pytest.mark.parametrize("funding", ["equity_first", "loan_first", "pari_passu"])
def test_capex_funding_matches_a_loop(spark, funding):
    rows = sorted(proforma.capex(_scenarios(spark, {"funding": funding})).collect(), key=lambda r: r.month)
    equity, loan = 1500.0, 1000.0
    for r in rows:
        spent = 100.0 if r.month <= 12 else 200.0
        if funding == "equity_first":
            e = min(spent, equity)
            n = min(spent - e, loan)
        elif funding == "loan_first":
            n = min(spent, loan)
            e = min(spent - n, equity)
        else:
            e = min(spent * equity / (equity + loan), equity) if equity + loan > 0 else 0.0
            n = min(spent - e, loan) if equity + loan > 0 else 0.0
        equity, loan = equity - e, loan - n
        assert (r.spent, r.equity_funded, r.loan_funded) == pytest.approx((spent, e, n))


def test_tif_matches_a_loop(spark):
    rows = sorted(proforma.tif(_scenarios(spark, {"hold_years": 4})).collect(), key=lambda r: r.calendar_year)
    note, value = 500.0, None
    for r in rows:
        value = 100000.0 if r.calendar_year == 2026 else value * 1.1
        if r.calendar_year <= 2027:
            value = max(value, 90000.0)
        net = max(0.0, value * 0.0125 - 500.0) * 0.9 * 0.9 if r.calendar_year <= 2027 else 0.0
        paid = min(net, note * 1.1) if note > 0 else 0.0
        income = max(0.0, net - paid) if note > 0 else net
        note = max(0.0, note * 1.1 - paid) if note > 0 else 0.0
        assert (r.tmv, r.net_tif, r.note_principal, r.note_ending, r.tif_income) == pytest.approx((value, net, paid, note, income))


def test_annual_lines_and_returns(spark):
    s = _scenarios(spark, {})
    years = proforma.annual(proforma.monthly(s))
    first = years.filter("year = 1").first()
    assert first.gpr == pytest.approx(12000.0) and first.tri == pytest.approx(12000 * 0.93) and first.other_income == pytest.approx(1200.0)
    assert first.noi == pytest.approx(first.egr - first.opex - first.property_tax)
    assert first.levered_cf == pytest.approx(first.noi - first.non_operating - first.spent - first.debt_service + first.draw)
    exits = proforma.residual(s, years)
    out = proforma.returns(s, years, exits).first()
    flows = [-50000.0] + [r.levered_cf + (exits.first().net_proceeds if r.year == 2 else 0) for r in sorted(years.collect(), key=lambda r: r.year)]
    if out.levered_irr is not None:
        assert sum(c / (1 + out.levered_irr) ** i for i, c in enumerate(flows)) == pytest.approx(0, abs=1e-3)


def test_irr(spark):
    f = lambda xs: one(spark, proforma.irr(F.array(*[F.lit(float(x)) for x in xs])))
    assert f([-100, 110]) == pytest.approx(0.10) and f([-100, 0, 121]) == pytest.approx(0.10)
    assert f([100, 110]) is None


def test_waterfall_never_overpays(spark):
    p = waterfall.Partnership({"lp": (0.10, "annual"), "gp": (0.0, "annual")}, [("escrow_recapture", {"lp": 1.0, "gp": 1.0}), ("preferred_return", {"lp": 1.0}), ("return_of_capital", {"lp": 1.0, "gp": 1.0}), ("promote", {"lp": 0.8, "gp": 0.2})])
    periods = pd.DataFrame({"scenario_id": 1, "period": [1, 2, 3], "distributable": [5.0, 120.0, 0.0], "contributed_lp": [90.0, 0, 0], "contributed_gp": [10.0, 0, 0], "escrow_lp": [3.0, 0, 0], "escrow_gp": [4.0, 0, 0]})
    rows = waterfall.waterfall(spark.createDataFrame(periods), p).orderBy("period", F.desc("class_id")).collect()
    assert rows[0].distributed == 3.0 and rows[1].distributed == 2.0  # escrow first, no more than the cash
    assert rows[2].distributed + rows[3].distributed == pytest.approx(120.0)
    # two of escrow are left, then 9 + 9 of pref, then 100 of capital, and nothing over
    assert rows[3].distributed == pytest.approx(2.0 + 10.0 * (120 - 2 - 18) / 100)
    assert waterfall.effective_rate(0.12, "monthly") == pytest.approx(1.01**12 - 1)


def test_waterfall_conserves_cash(spark):
    """Random partnerships: what is paid and left adds up, and balances follow from payments."""
    rng = np.random.default_rng(3)
    p = waterfall.Partnership({"a": (0.08, "monthly"), "b": (0.12, "quarterly"), "c": (0.0, "annual")}, [("preferred_return", {}), ("escrow_recapture", {"b": 1.0}), ("return_of_capital", {"a": 1.0, "b": 1.0, "c": 1.0}), ("catch_up", {"c": 0.5}), ("promote", {"a": 0.5, "c": 0.4})])
    rows = [(s, t, *map(float, rng.integers(0, 300, 7))) for s in range(20) for t in range(1, 7)]
    df = spark.createDataFrame(rows, "scenario_id int, period int, distributable double, contributed_a double, contributed_b double, contributed_c double, escrow_a double, escrow_b double, escrow_c double")
    got = {(r.scenario_id, r.period, r.class_id): r for r in waterfall.waterfall(df, p).collect()}
    for s in range(20):
        owed, due, held, put_in = ({c: 0.0 for c in "abc"} for _ in range(4))
        for _, t, cash, *x in (r for r in rows if r[0] == s):
            paid = dict.fromkeys("abc", 0.0)
            for c, given, kept in zip("abc", x[:3], x[3:], strict=True):
                owed[c] += given
                put_in[c] += given
                held[c] += kept
                due[c] += owed[c] * waterfall.effective_rate(*p.classes[c])

            def pro_rata(book, cash):
                total = sum(book.values())
                return {c: min(cash, total) * v / total if total else 0.0 for c, v in book.items()}

            for step in range(5):
                if cash <= 1e-9:
                    break
                book = (due, held, owed, None, None)[step]
                out = pro_rata(due, cash) if step == 0 else {"b": min(cash, held["b"])} if step == 1 else pro_rata(owed, cash) if step == 2 else {"c": cash * 0.5} if step == 3 else {"a": cash * 0.5, "c": cash * 0.4}
                for c, v in out.items():
                    paid[c] += v
                    if book is not None:
                        book[c] -= v
                cash -= sum(out.values())
            for c in "abc":
                r = got[s, t, c]
                assert (r.contributed, r.distributed, r.unpaid_pref, r.unreturned_capital, r.unrecouped_escrow) == pytest.approx((put_in[c], paid[c], due[c], owed[c], held[c]), abs=1e-6)


def test_periods_and_amounts(spark):
    df = spark.createDataFrame([("2023A",), ("2023 Budget",), ("2024F",), ("TTM",), (None,)], "p string").select(fs.period_year(F.col("p")).alias("y"), fs.period_order(F.col("p")).alias("o"))
    assert [tuple(r) for r in df.collect()] == [(2023, 0), (2023, 1), (2024, 2), (9999, 99), (9999, 99)]
    m = lambda a, b: one(spark, fs.amounts_match(F.lit(a), F.lit(b)))
    assert (m(0.0, 0.0), m(0.0, 1.0), m(1000.0, 1004.9), m(1000.0, 1006.0)) == (True, False, True, False)


def test_synthesis_falls_back_to_subtotals(spark):
    cols = "property_id int, document_id string, document_type string, period string, category string, line_item string, amount double, is_subtotal boolean, is_total boolean, page_number int"
    rows = [
        (1, "a", "operating_statement", "2023A", "income", "Rent", 100.0, False, False, 1), (1, "a", "operating_statement", "2023A", "income", "Parking", 20.0, False, False, 1), (1, "b", "loan", "2023A", "income", "Rent", 90.0, False, False, 1),
        (1, "a", "operating_statement", "2023A", "expense", "Total OPEX", 50.0, True, False, 1), (1, "a", "operating_statement", "2023A", "noi", "NOI", 70.2, True, False, 1), (1, "a", "operating_statement", "2099A", "income", "x", 1.0, False, False, 1),
    ]
    got = fs.synthesize(spark.createDataFrame(rows, cols), 2024).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.total_income, r.total_expenses, r.calculated_noi, r.closest_noi, r.source_count, r.quality, r.noi_differs) == (120.0, 50.0, 70.0, 70.2, 2, "medium", False)


def test_text_functions(spark):
    t = lambda f, x, *a: one(spark, f(F.lit(x), *a))
    assert t(tx.written_number, "THREE MILLION") == 3_000_000 and t(tx.written_number, "seven and 26/100") == 7.26
    assert t(tx.written_number, "one hundred twenty-five thousand") == 125_000 and t(tx.written_number, "hello") is None
    assert t(tx.legal_date, "the first day of April, 2027") == "04/01/2027" and t(tx.legal_date, "April 15, 1996") == "04/15/1996" and t(tx.legal_date, "3/15/10") == "03/15/2010" and t(tx.legal_date, "soon") is None
    assert t(tx.garbled_dollars, "$3000,.00000") == 3_000_000 and t(tx.garbled_dollars, "$1,234.56") == 1234.56
    assert t(tx.percentage, "72.6%") == 72.6 and t(tx.percentage, "5 1/2%") == 5.5 and t(tx.percentage, "525%", True) == 5.25
    assert t(tx.number, "(1,234.00)") == -1234.0 and t(tx.number, "n/a") is None
    assert t(tx.clean_pdf, "iA dayof theLoan ofthe 2n d part") == "1st day of the Loan of the 2nd part"
    assert one(spark, tx.loan_term(F.lit(25))) == "2 years, 1 month"
    assert t(tx.normal_name, "The Oaks at Main, LLC") == "oaks main"
    assert t(tx.snippet, "aaa Needle bbb", "needle") == "aaa <mark>Needle</mark> bbb"


def test_stemmer_and_search(spark):
    assert [search.stem(w) for w in "caresses ponies cats agreed plastered motoring hopping falling hissing happy relational conditional digitizer electrical hopeful adjustment adoption controlling".split()] == (
        "caress poni cat agre plaster motor hop fall hiss happi relat condit digit electr hope adjust adopt control".split()
    )
    docs = spark.createDataFrame([(1, "Leases and leasing of units"), (2, "a lease"), (3, "nothing"), (4, None)], "doc_id int, text string")
    assert [r.doc_id for r in search.search(docs, "leased").collect()] == [2, 1]
    pieces = search.chunks(spark.createDataFrame([(1, "x" * 5 + ". " + "y" * 9), (2, "")], "doc_id int, text string"), size=10, overlap=2).collect()
    assert [p.piece for p in pieces] == ["xxxxx. ", ". yyyyyyyy", "yyy"]


def test_matching(spark):
    p = spark.createDataFrame([(1, "Oak Court", "12 Main St", "Austin", "TX"), (2, "Pine Hill", "9 Elm", "Dallas", "TX")], "id int, name string, address string, city string, state string")
    d = spark.createDataFrame([(7, "Oak Court LLC", "12 Main Street", "Austin", "TX")], p.schema)
    got = portfolio.match_properties(d, p).collect()
    assert [(r.property_id, r.confidence) for r in got] == [(1, "high")]
    pair = spark.createDataFrame([("oak court", "oak cort")], "a string, b string").select(portfolio.similarity("a", "b")).first()[0]
    assert pair == pytest.approx(SequenceMatcher(None, "oak court", "oak cort").ratio())
    a, b = spark.createDataFrame([(1, "Oak Court Apartments"), (2, "Pine")], "id int, name string"), spark.createDataFrame([(5, "oak court"), (6, "pine")], "id int, name string")
    assert {(r.id, r.matched, r.how) for r in portfolio.containment_match(a, b).collect()} == {(1, 5, "contains"), (2, 6, "exact")}


def test_containment_inside_words_and_of_hot_names(spark):
    """A name inside a word counts, the longest wins, ties go to the least id, and a word that all names share links none by itself."""
    a = [(1, "Oakwood"), (2, "wood"), (3, "Elm Apartments West"), (4, None), (5, "elm")] + [(k, f"Apartments {k}") for k in range(100, 400)]
    b = [(10, "wood"), (11, "Wood"), (12, "oak"), (13, "apartments west"), (14, "Apartments"), (15, None), (16, "Big Elm")]
    left, right = spark.createDataFrame(a, "id int, name string"), spark.createDataFrame(b, "id int, name string")

    def brute(x):
        exact = [r for r, y in b if x and y and x.lower() == y.lower()]
        if exact:
            return min(exact), "exact"
        inside = [(-min(len(x), len(y)), r) for r, y in b if x and y and min(len(x), len(y)) >= 4 and (x.lower() in y.lower() or y.lower() in x.lower())]
        return (min(inside)[1], "contains") if inside else None

    want = {k: brute(x) for k, x in a if brute(x)}
    assert {r.id: (r.matched, r.how) for r in portfolio.containment_match(left, right).collect()} == want


def test_quantiles_match_the_percentile_of_all_values(spark):
    rows = [("a", float(k % 97) ** 3) for k in range(3000)] + [(None, 1.0), (None, 4.0), ("b", 7.0), ("b", 7.0), ("c", None), ("d", -5.0), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: tuple(r)[1:] for r in quantiles(df, ["k"], {"low": ("v", 0.25), "mid": ("v", 0.5), "high": ("v", 0.9)}).collect()}
    want = {r.k: tuple(r)[1:] for r in df.groupBy("k").agg(*[F.percentile("v", F.lit(p)) for p in (0.25, 0.5, 0.9)]).collect()}
    assert "c" not in got and got == {k: pytest.approx(v) for k, v in want.items() if k != "c"}


def test_rate_limit_over_spans(spark):
    times = [0, 1, 59, 60, 60, 61, 119, 120, 500]
    log = spark.createDataFrame([(1, k, s) for k, s in enumerate(times)] + [(None, 90, 30)], "org_id long, event_id long, s long").withColumn("created_at", F.timestamp_seconds("s"))
    got = {r.event_id: r.in_window for r in portfolio.rate_limit(log, 60, 3).collect()}
    assert got == {k: sum(t - 60 < x <= t for x in times) for k, t in enumerate(times)} | {90: 1}


def test_matching_of_hot_keys(spark):
    """A city, number or word of over a thousand properties still links them."""
    p = spark.createDataFrame([(k, f"Name{k:05d}", "12 Main St", "Austin", "TX") for k in range(2500)], "id int, name string, address string, city string, state string")
    d = spark.createDataFrame([(7, "Zzz", "12 Main St", "Austin", "TX")], p.schema)
    assert [(r.property_id, r["rank"], r.score) for r in portfolio.match_properties(d, p).orderBy("rank").collect()] == [(k, k + 1, 0.5) for k in range(5)]


def test_permissions(spark):
    roles = {"admin": {"a": "edit"}, "viewer": {"a": "read"}}
    users = spark.createDataFrame([("u", "admin", {"a": "none"}), ("v", "ghost", {"a": "bogus", "zzz": "edit"}), ("w", None, None)], "user_id string, role_template string, overrides map<string,string>")
    assert {r.user_id: (r.scope, r.level) for r in portfolio.permissions(users, roles).collect()} == {"u": ("a", "none"), "v": ("a", "read"), "w": ("a", "read")}


def test_labels(spark):
    rows = spark.createDataFrame([("Gross Potential Rent",), ("TOTAL INCOME",), ("Accrual",), ("PAYROLL extra",), ("Zebra",), ("  ",), (None,)], "x string")
    assert [(r.category, r.method) for r in labels.classify_labels(rows, "x").collect()] == [("gross_potential_rent", "explicit"), (None, "subtotal"), (None, "skip"), ("payroll", "pattern"), ("other", "unknown"), (None, "skip"), (None, "skip")]
    docs = spark.createDataFrame([(1, "Rent_Roll.xlsx", "x"), (2, "a.pdf", "General Ledger debit credit"), (3, "b.pdf", None)], "id int, f string, t string")
    assert {r.id: r.document_type for r in labels.classify_documents(docs, "id", "f", "t").collect()} == {1: "rent_roll", 2: "general_ledger", 3: "unknown"}


def test_warehouse_loads(spark, tmp_path):
    (tmp_path / "s.csv").write_text("transaction_id,sale_price,number_of_units,sale_date\nt1,1000.5,12.0,2024-01-31\nt2,oops,,bad\n")
    got = warehouse.sales(spark, str(tmp_path / "s.csv"), 3, date(2024, 5, 1)).orderBy("transaction_id").collect()
    assert (got[0].sale_price, got[0].num_units, got[0].sale_date, got[0].ingestion_id) == (1000.5, 12, date(2024, 1, 31), 3)
    assert (got[1].sale_price, got[1].num_units, got[1].sale_date, got[1].market) == (None, None, None, None)
    (tmp_path / "p.csv").write_text("sale_year,n_deals,median_psf\n2020,5,1.5\n")
    assert warehouse.pricing(spark, str(tmp_path / "p.csv"), "national", 1, date(2024, 1, 1)).first().median_ppsf == 1.5
    (tmp_path / "o.csv").write_text("property_id,is_current_owner\n1,True\n2,False\n3,\n")
    assert [r.is_current for r in warehouse.ownership(spark, str(tmp_path / "o.csv"), 1, date(2024, 1, 1)).orderBy("property_id").collect()] == [True, False, False]
    spark.createDataFrame([("9", " 1 Main ", "Austin", "TX"), (None, "x", "y", "z"), ("8", None, None, None)], "PropertyID string, `Property Address` string, City string, State string").write.parquet(str(tmp_path / "inv"))
    inv = {r.property_id: r.address_hash for r in warehouse.inventory(spark, str(tmp_path / "inv"), 1, date(2024, 1, 1)).collect()}
    assert set(inv) == {"9", "8"} and inv["8"] is None
    log = warehouse.register(spark, None, "a", "v", date(2024, 1, 1), "/p", 5, datetime(2024, 1, 1))
    assert [r.ingestion_id for r in warehouse.register(spark, log, "b", "v", date(2024, 1, 1), "/p", 6, datetime(2024, 1, 2)).orderBy("ingestion_id").collect()] == [1, 2]
    counts = warehouse.reload([{"table": "t", "rows": lambda: spark.range(3)}, {"table": "t", "rows": lambda: spark.range(2)}], str(tmp_path / "wh"))
    assert counts == {"t": 5}


def test_history(spark):
    old = spark.createDataFrame([(1, "a", date(2020, 1, 1), date(9999, 12, 31)), (2, "b", date(2020, 1, 1), date(9999, 12, 31))], "id int, v string, valid_from date, valid_to date")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (3, "d")], "id int, v string")
    got = {tuple(r) for r in warehouse.versioned(old, new, "id", date(2024, 1, 1)).collect()}
    end = date(9999, 12, 31)
    assert got == {(1, "a", date(2020, 1, 1), end), (2, "b", date(2020, 1, 1), date(2024, 1, 1)), (2, "c", date(2024, 1, 1), end), (3, "d", date(2024, 1, 1), end)}


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(1.005, 0.255, date(2024, 1, 2), 5)], "a double, b double, c date, d int")
    assert warehouse.export_columns(df, [("A", "a", "currency"), ("B", "b", "percent"), ("C", "c", "date"), ("D", "d", "text"), ("E", "zz", "text")]).first()[1:] == (25.5, "2024-01-02", "5", None)
    warehouse.export_csv(df, str(tmp_path / "out"), {"d": 5, "zz": 1})
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 1


def test_documents_and_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_bytes("h\xe9llo".encode("latin-1"))
    (folder / "b.md").write_text("same")
    (folder / "c.txt").write_text("same")
    (folder / "d.exe").write_bytes(b"x")
    files = documents.files(spark, str(folder))
    assert {r.filename: r.route for r in files.collect()} == {"a.txt": "text", "b.md": "text", "c.txt": "text", "d.exe": None}
    fresh = documents.without_known(files, files.filter("filename = 'd.exe'"))
    assert {r.filename for r in fresh.collect()} == {"a.txt", "b.md"}
    assert {r.text for r in documents.text_pages(fresh).collect()} == {"h\xe9llo", "same"}
    store = str(tmp_path / "store")
    for _ in range(2):
        usage.watch(spark, str(folder), store, str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(store).count() == 2
    (folder / "e.txt").write_text("same")
    (folder / "f.txt").write_text("new")
    usage.watch(spark, str(folder), store, str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(store).count() == 3
    pages = spark.createDataFrame([(1, "Title\nA  1  2\nB  3  4\nnote\nC  5  6")], "id int, text string")
    assert [r.rows for r in documents.tables_in_text(pages, ["id"]).collect()] == [[["A", "1", "2"], ["B", "3", "4"]]]


def test_stateful_limit(spark, tmp_path):
    rows = [(1, i, datetime(2024, 1, 1, 0, 0, i)) for i in range(5)] + [(1, 9, datetime(2024, 1, 1, 0, 1, 1))]
    spark.createDataFrame(rows, "org_id long, event_id long, created_at timestamp").coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("org_id long, event_id long, created_at timestamp").parquet(str(tmp_path / "e"))
    q = usage.limited(stream, 60, 3).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.event_id: r.allowed for r in spark.table("limited").collect()} == {0: True, 1: True, 2: True, 3: False, 4: False, 9: True}
