"""Operational store: review queue, summaries, dashboards, matching, search, usage and permissions."""

from __future__ import annotations

from datetime import date
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .matching import match_properties  # noqa: F401

#: Levels of access and what each role grants by scope group (fixed values).
LEVELS = {"none": 0, "read": 1, "edit": 2}
PLANS = {"free": 100, "standard": 1_000, "pro": 10_000}


def per_key(rows: DataFrame, key: str, **aggregates: Column) -> DataFrame:
    return rows.groupBy(key).agg(*[c.alias(n) for n, c in aggregates.items()])


def review_queue(documents: DataFrame, opstat: DataFrame, others: dict[str, DataFrame]) -> DataFrame:
    """Documents with what was extracted from each; every source is aggregated before its join, so nothing fans out."""
    plain = ~F.col("is_subtotal")
    income, expense = plain & F.col("category").isin("income", "revenue"), plain & (F.col("category") == "expense")
    money = F.col("amount").cast("decimal(18,2)")
    own = per_key(opstat, "document_id", income_items=F.count(F.when(income, 1)), income_total=F.sum(F.when(income, money)), expense_items=F.count(F.when(expense, 1)), expense_total=F.sum(F.when(expense, money)), opstat_items=F.count("*"))
    out, counts = documents.join(own, "document_id", "left"), ["income_items", "expense_items", "opstat_items"]
    for name, rows in others.items():
        out = out.join(per_key(rows, "document_id", **{name: F.count("*")}), "document_id", "left")
        counts.append(name)
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in counts}
    return out.withColumns(zero).withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("income_total", "expense_total")})


def review_stats(documents: DataFrame, status: str, known: tuple[str, ...] = ("pending", "approved", "flagged")) -> DataFrame:
    """Counts by status; known ones with none count 0, null is pending."""
    spark = documents.sparkSession
    counts = documents.groupBy(F.coalesce(status, F.lit("pending")).alias("status")).agg(F.count("*").alias("n"))
    dim = spark.createDataFrame([(k,) for k in known], "status string")
    return dim.join(counts, "status", "full").select("status", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def operations_summary(units: DataFrame) -> DataFrame:
    """Units, occupancy, area and rents by property."""
    status = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0))
    return units.groupBy("property_id").agg(
        F.count("*").alias("total_units"), status("occupied").alias("occupied"), status("vacant").alias("vacant"), F.sum("square_footage").alias("total_sqft"), F.sum("current_rent").alias("monthly_rent"), F.avg("current_rent").alias("avg_rent"),
    ).withColumn("occupancy_rate", F.round(F.expr("try_divide(occupied, total_units)") * 100, 1))


def valuation_summary(opstat: DataFrame, debt_service: DataFrame, prices: DataFrame) -> DataFrame:
    """NOI from detail items, coverage of the annual debt service, and the cap rate on the price."""
    detail, money = ~F.col("is_subtotal") & ~F.col("is_total"), F.col("amount").cast("decimal(18,2)")
    rows = opstat.groupBy("property_id").agg(
        F.coalesce(F.sum(F.when(detail & F.col("category").isin("revenue", "income"), money)), F.lit(0)).cast("double").alias("total_revenue"),
        F.coalesce(F.sum(F.when(detail & (F.col("category") == "expense"), money)), F.lit(0)).cast("double").alias("total_expenses"),
    )
    rows = rows.withColumn("noi", F.round(F.col("total_revenue") - F.col("total_expenses"), 2)).join(debt_service, "property_id", "left").join(prices, "property_id", "left")
    dscr = F.when(F.col("annual_debt_service") > 0, F.col("noi") / F.col("annual_debt_service"))
    return rows.withColumn("dscr", dscr).withColumn("cap_rate", F.when((F.col("price") != 0) & (F.col("noi") != 0), F.col("noi") / F.col("price") * 100))


def without(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Parents that have no child."""
    return parents.join(children.select(key).distinct(), key, "left_anti")


def with_counts(parents: DataFrame, key: str, **children: DataFrame) -> DataFrame:
    """Parents with the number of each kind of child."""
    out = parents
    for name, rows in children.items():
        out = out.join(rows.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return out


def link_by_name(documents: DataFrame, properties: DataFrame) -> DataFrame:
    """Documents without a property get the least id among properties of the same name, case aside."""
    first = properties.groupBy(F.lower("name").alias("_n")).agg(F.min("id").alias("_id"))
    joined = documents.join(first, F.lower("property_name") == F.col("_n"), "left")
    return joined.withColumn("property_id", F.coalesce("property_id", "_id")).drop("_n", "_id")


def expiring(units: DataFrame, as_of: date, days: int = 90) -> DataFrame:
    return units.filter(F.col("lease_end").between(F.lit(as_of), F.date_add(F.lit(as_of), days)))


def corrections(terms: DataFrame) -> DataFrame:
    """How often users corrected a value, by type."""
    changed = F.col("user_value").isNotNull()
    return terms.groupBy("term_type").agg(F.count("*").alias("total"), F.count(F.when(changed, 1)).alias("corrected"), F.count_distinct(F.when(changed, F.col("document_id"))).alias("documents")).withColumn("rate", F.round(F.col("corrected") / F.col("total") * 100, 1))


def effective(user: str, extracted: str) -> Column:
    return F.coalesce(F.col(user), F.col(extracted))


def search_like(sources: dict[str, tuple[DataFrame, str, list[str]]], part: str, limit: int = 50) -> DataFrame:
    """One result list over several tables: {category: (rows, id, columns)}; any column may contain the text, case aside."""
    found = [
        rows.filter(reduce(lambda a, b: a | b, (F.lower(F.col(c).cast("string")).contains(part.lower()) for c in columns))).select(F.lit(name).alias("category"), F.col(key).cast("string").alias("id"))
        for name, (rows, key, columns) in sources.items()
    ]
    w = Window.partitionBy("category").orderBy("id")
    return reduce(DataFrame.union, found).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).drop("_n")


def of_documents(rows: DataFrame, docs: DataFrame, **equal) -> DataFrame:
    """Rows of a table below the documents with type and name; ``equal``: values of columns, None for any."""
    out = rows.join(docs.select("document_id", "document_type", "filename", "property_id"), "document_id")
    for name, value in equal.items():
        out = out if value is None else out.filter(F.col(name) == value)
    return out


def debt_summary(terms: DataFrame, clauses: DataFrame, docs: DataFrame) -> DataFrame:
    """Every property's debt documents in one list: terms of loans and closings, clauses of loans and guarantees, and guarantees."""
    part = lambda rows, types, bucket, item: of_documents(rows, docs).filter(F.col("document_type").isin(*types)).select("property_id", F.lit(bucket).alias("bucket"), "document_id", F.col(item).alias("item"))
    guarantees = docs.filter("document_type = 'guarantee'").select("property_id", F.lit("guarantees").alias("bucket"), "document_id", F.col("filename").alias("item"))
    return part(terms, ("loan", "closing"), "loan_terms", "term_type").unionByName(part(clauses, ("loan", "guarantee"), "loan_clauses", "clause_type")).unionByName(guarantees)


def counted(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table."""
    return reduce(DataFrame.union, (rows.agg(F.lit(name).alias("name"), F.count("*").alias("n")).select("name", "n") for name, rows in tables.items()))


def recent(rows: DataFrame, at: str, now: Column, days: int = 30) -> DataFrame:
    """The last days up to a moment that the caller names."""
    return rows.filter((F.col(at) >= now - F.expr(f"interval {days} days")) & (F.col(at) <= now))


def reviewed(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Review states after decisions (``document_id action property_id at``), of which the last counts: approve links to its property, skip and reset change the state."""
    w = Window.partitionBy("document_id").orderBy(F.desc("at"))
    last = decisions.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("document_id", "action", F.col("property_id").alias("_p"))
    state = F.when(F.col("action") == "approve", "approved").when(F.col("action") == "skip", "skipped").when(F.col("action") == "reset", "pending_review").otherwise(F.col("review_status"))
    joined = docs.join(last, "document_id", "left").withColumn("review_status", state)
    return joined.withColumn("property_id", F.when(F.col("action") == "approve", F.coalesce("_p", "property_id")).otherwise(F.col("property_id"))).drop("action", "_p")


def latest_runs(log: DataFrame, key: list[str]) -> DataFrame:
    """The newest run of each key from an append-only log (``run_id state at``): a run's state is its last one."""
    state = log.groupBy(*key, "run_id").agg(F.min("at").alias("started_at"), F.max_by("state", "at").alias("state"))
    return state.groupBy(*key).agg(F.max_by(F.struct("run_id", "state", "started_at"), F.struct("started_at", "run_id")).alias("r")).select(*key, "r.*")


#: What is run on a document, by the mode of its type (fixed values).
MODES = {"dual": ("terms", "clauses"), "legal": ("clauses",), "financial": ("terms",), "tabular": ("table",)}


def dispatched(docs: DataFrame, modes: dict[str, tuple[str, ...]]) -> DataFrame:
    """(document_id, step) of the steps that a document's type asks for by its modes; types without any have none."""
    steps = [(kind, step) for kind, names in modes.items() for step in dict.fromkeys(s for m in names for s in MODES[m])]
    plan = docs.sparkSession.createDataFrame(steps, "document_type string, step string")
    return docs.join(F.broadcast(plan), "document_type").select("document_id", "step")  # a fixed table


# Matching

@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks (0 to 1); 0 where a side is empty."""
    known: dict = {}
    for x, y in zip(a, b, strict=True):
        if (x, y) not in known:
            known[x, y] = SequenceMatcher(None, x, y).ratio() if x and y else 0.0
    return pd.Series([known[x, y] for x, y in zip(a, b, strict=True)], dtype="float64")


def containment_match(left: DataFrame, right: DataFrame, least: int = 4) -> DataFrame:
    """Exact name, else one name inside the other with an overlap of at least four characters, longest first; ties go to the least id.

    Names are compared once each. All pieces of ``least`` characters of a name occur in whatever contains it, so a name is looked up by
    the one of its pieces that the fewest names of the other side have; one with a piece that none has is inside none.
    """
    a = left.select("id", F.lower(F.trim("name")).alias("x"))
    b = right.select(F.col("id").alias("rid"), F.lower(F.trim("name")).alias("y")).groupBy("y").agg(F.min("rid").alias("rid"))
    exact = a.join(b, a["x"] == b["y"]).groupBy("id").agg(F.min("rid").alias("matched")).withColumn("how", F.lit("exact"))
    rest = a.join(exact, "id", "left_anti")

    def pieces(names: DataFrame, c: str) -> DataFrame:
        every = F.transform(F.sequence(F.lit(1), F.length(c) - least + 1), lambda i: F.substr(c, i, F.lit(least)))
        return names.select(c).filter(F.length(c) >= least).distinct().select(c, F.explode(F.array_distinct(every)).alias("g"))

    def inside(short: DataFrame, s: str, long: DataFrame, n: str) -> DataFrame:
        held = pieces(long, n)
        asked = pieces(short, s).join(held.groupBy("g").agg(F.count("*").alias("n")), "g", "left")
        rarest = asked.groupBy(s).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("r")).filter("r.n > 0").select(s, F.col("r.g").alias("g"))
        return rarest.join(held, "g").filter(F.contains(n, s)).select("x", "y")

    near = inside(b, "y", rest, "x").union(inside(rest, "x", b, "y")).distinct()
    near = near.join(b, "y").withColumn("o", F.least(F.length("x"), F.length("y")))
    found = near.groupBy("x").agg(F.max(F.struct("o", (-F.col("rid")).alias("r")))["r"].alias("_r"))
    best = rest.join(found, "x").groupBy("id").agg(F.max("_r").alias("_r")).select("id", (-F.col("_r")).alias("matched"), F.lit("contains").alias("how"))
    return exact.unionByName(best)


# Usage and permissions


def monthly_usage(log: DataFrame) -> DataFrame:
    return log.groupBy("org_id", F.date_format("created_at", "yyyy-MM").alias("period")).agg(
        F.count("*").alias("actions"), F.sum("page_count").alias("pages"), F.count(F.when(~F.col("success"), 1)).alias("failures"), F.sum("processing_time").alias("seconds"), F.count_distinct("user_id").alias("users")
    )


def rate_limit(log: DataFrame, seconds: int = 60, most: int = 30) -> DataFrame:
    """Requests an organisation made in the minute that ends with each event, and whether that is within the limit.

    Time is cut into spans of one window; events count in their own span and, as counts by second, in the next, so a busy organisation is many tasks.
    """
    timed = log.withColumn("_t", F.col("created_at").cast("timestamp").cast("long"))
    counts = timed.groupBy("org_id", "_t").agg(F.count("*").alias("_c"))
    span = F.floor(F.col("_t") / seconds)
    both = counts.select("org_id", "_t", "_c", F.explode(F.array(span, span + 1)).alias("_s"))
    w = Window.partitionBy("org_id", "_s").orderBy("_t").rangeBetween(-(seconds - 1), 0)
    within = both.withColumn("in_window", F.sum("_c").over(w)).filter(F.col("_s") == span).select(F.col("org_id").alias("_o"), F.col("_t").alias("_at"), "in_window")
    same = F.col("org_id").eqNullSafe(F.col("_o")) & F.col("_t").eqNullSafe(F.col("_at"))
    return timed.join(within, same).select(*[timed[c] for c in log.columns], "in_window").withColumn("allowed", F.col("in_window") <= most)


def over_limit(monthly: DataFrame, plans: DataFrame) -> DataFrame:
    """Months in which an organisation used more pages than its plan has."""
    return monthly.join(plans, "org_id").withColumn("over", F.col("pages") > F.col("page_limit"))


def permissions(users: DataFrame, templates: dict[str, dict[str, str]], default: str = "viewer") -> DataFrame:
    """A row per user and scope: the role's template under the user's overrides; unknown roles are viewers, unknown scopes and levels in overrides count for nothing."""
    spark = users.sparkSession
    grants = spark.createDataFrame([(r, s, v) for r, scopes in templates.items() for s, v in scopes.items()], "role string, scope string, level string")
    role = F.when(F.col("role_template").isin(*templates), F.col("role_template")).otherwise(default)
    rows = users.withColumn("role", role).join(F.broadcast(grants), "role")  # a fixed table
    own = F.try_element_at(F.col("overrides"), F.col("scope"))
    return rows.select("user_id", "role", "scope", F.when(own.isin(*LEVELS), own).otherwise(F.col("level")).alias("level"))


def allowed(rows: DataFrame, wanted: str) -> DataFrame:
    rank = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])
    return rows.withColumn("allowed", rank[F.col("level")] >= LEVELS[wanted])
