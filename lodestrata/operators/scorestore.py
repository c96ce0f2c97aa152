"""The store of score runs: every run's tier, period and final rows are appended; readers resolve the latest run.

Rows are partitioned by ``score_type``, so a reader of rankings scans no period rows. A market's breakdown takes each kind of row from the latest run that has any of the market, as runs may cover
different markets. "Latest" is an aggregation by market, not a window over the history; only ``history`` ranks rows, by market.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scorecard import AREAS, DURATIONS, PERIODS, duration_weights

SCHEMA = "run_id string, scored_at timestamp, knowledge_date date, market string, tier string, period string, score_type string, score_value double, rank int, ds double, occ_score double, rent_score double, config string"
HISTORY = 20
#: Weights of single years in the standalone mode (fixed values).
STANDALONE = {f"Yr{n}": 10.0 for n in range(1, 11)}
_AREAS = ("ds", "occ_score", "rent_score")


def period_weights(mode: str = "fixed", years: int = 10, fixed: dict[str, float] | None = None) -> dict[str, float]:
    """Weights of periods: ``standalone`` (single years up to ``years``), ``auto`` (by the length of the analysis) or ``fixed``. They needn't add up: means are taken over the periods present."""
    if mode == "standalone":
        return {p: w for p, w in STANDALONE.items() if int(p[2:]) <= years}
    if mode == "auto":
        return duration_weights(years)
    if mode == "fixed":
        return dict(PERIODS if fixed is None else fixed)
    raise ValueError(mode)


def weighted_by(periods: DataFrame, mode: str = "fixed", years: int = 10, fixed: dict[str, float] | None = None) -> DataFrame:
    """Period scores with the ``weight`` of a mode, for ``scorecard.market_scores``; periods without a weight drop out."""
    weights = {p: w for p, w in period_weights(mode, years, fixed).items() if w}
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("period")) if weights else F.lit(None).cast("double")
    return periods.withColumn("weight", weight).filter("weight is not null")


def run_rows(run_id: str, scored_at: Column, knowledge_date: Column, tiers: DataFrame, periods: DataFrame, finals: DataFrame, config: str) -> DataFrame:
    """One run's rows: tiers (``market tier mf`` and areas), periods (with ``period``) and finals (``market final_score rank`` and areas)."""
    areas = [F.col(c).cast("double").alias(c) for c in _AREAS]
    none = lambda kind: F.lit(None).cast(kind)

    def rows(df: DataFrame, kind: str, value: str, tier: Column, period: Column, rank: Column, config: Column) -> DataFrame:
        return df.select(F.lit(run_id).alias("run_id"), scored_at.cast("timestamp").alias("scored_at"), knowledge_date.cast("date").alias("knowledge_date"), "market", tier.alias("tier"), period.alias("period"), F.lit(kind).alias("score_type"), F.col(value).cast("double").alias("score_value"), rank.cast("int").alias("rank"), *areas, config.alias("config"))

    text = F.lit(config)
    return (
        rows(tiers, "tier", "mf", F.col("tier"), none("string"), none("int"), text)
        .unionByName(rows(periods, "period", "mf", F.col("tier"), F.col("period"), none("int"), none("string")))
        .unionByName(rows(finals, "final", "final_score", F.lit("weighted"), none("string"), F.col("rank"), text))
    )


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("score_type").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def _of(store: DataFrame, kind: str) -> DataFrame:
    return store.filter(F.col("score_type") == kind)


def rankings(store: DataFrame, tier: str | None = None) -> DataFrame:
    """Finals of the latest run that has any, in the order of ranks."""
    finals = _of(store, "final")
    newest = finals.agg(F.max("scored_at").alias("scored_at"))  # one row
    rows = finals.join(F.broadcast(newest), "scored_at")
    return (rows if tier is None else rows.filter(F.col("tier") == tier)).orderBy(F.asc_nulls_last("rank"), "market")


def latest_of_market(store: DataFrame, kind: str) -> DataFrame:
    """A market's rows of the latest run that has rows of this kind for it."""
    rows = _of(store, kind)
    newest = rows.groupBy("market").agg(F.max("scored_at").alias("scored_at"))
    return rows.join(newest, ["market", "scored_at"])


def history(store: DataFrame, most: int = HISTORY) -> DataFrame:
    """A market's finals from the newest run on, the last ``most`` of them."""
    w = Window.partitionBy("market").orderBy(F.desc("scored_at"), F.desc("run_id"))
    return _of(store, "final").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def explained(store: DataFrame) -> DataFrame:
    """A row a market: the final score, each area's share in it (score times weight), and the periods and tiers below."""
    final = latest_of_market(store, "final").groupBy("market").agg(F.max_by(F.struct("score_value", "rank", *_AREAS, "run_id"), "run_id").alias("f")).select("market", "f.*")
    weights = dict(zip(_AREAS, (w for _, _, w in AREAS.values()), strict=True))
    below = lambda kind, name: latest_of_market(store, kind).groupBy("market").agg(F.array_sort(F.collect_list(F.struct(name, "score_value"))).alias(f"{kind}s"))
    out = final.join(below("period", "period"), "market", "left").join(below("tier", "tier"), "market", "left")
    return out.select("market", F.col("score_value").alias("final_score"), "rank", *[F.col(c) for c in _AREAS], *[(F.coalesce(c, F.lit(0.0)) * w).alias(f"{c}_share") for c, w in weights.items()], "periods", "tiers")


def configuration(spark: SparkSession) -> DataFrame:
    """The weights in use: (kind, name, weight) of areas, periods, tiers and durations."""
    from .scorecard import TIERS

    rows = [("area", a, float(x[2])) for a, x in AREAS.items()] + [("period", p, float(w)) for p, w in PERIODS.items()] + [("tier", t, float(w)) for t, w in TIERS.items()] + [(f"{y} years", p, float(w)) for y in DURATIONS for p, w in duration_weights(y).items()]
    return spark.createDataFrame(rows, "kind string, name string, weight double")
