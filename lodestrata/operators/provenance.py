"""Assumptions with provenance: records of several sources are merged field by field, and the winner's source, confidence and sample are kept.

A field's value comes from the best source that has one: what the property itself shows, what is derived from it, the market's benchmark, the model's default, a placeholder. Within a source the surer value wins,
then the larger sample, then the smaller value, so that reruns agree. Merging is one aggregation with partial results before its shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sources from the best on, and the confidence that a value of each has unless it says otherwise; confidences from the surest on (fixed values).
SOURCES = ("PROPERTY_ACTUAL", "PROPERTY_DERIVED", "MARKET_BENCHMARK", "MODEL_DEFAULT", "PLACEHOLDER")
CONFIDENCE = {"PROPERTY_ACTUAL": "high", "PROPERTY_DERIVED": "high", "MARKET_BENCHMARK": "medium", "MODEL_DEFAULT": "low", "PLACEHOLDER": "low"}
LEVELS = ("high", "medium", "low")


def _place(c: Column, names: tuple[str, ...]) -> Column:
    """From 1 on; what isn't listed comes after all."""
    at = F.array_position(F.array(*map(F.lit, names)), c)
    return F.when(at > 0, at).otherwise(len(names) + 1)


def assumptions(rows: DataFrame, key: list[str], fields: list[str], source: str, detail: str = "", sample: Column | None = None, confidence: str | None = None) -> DataFrame:
    """Wide rows -> a row for each field that has a value: (key, field, value, source, confidence, sample_size, detail)."""
    if source not in SOURCES:
        raise ValueError(source)
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields])).alias("p")
    long = rows.select(*key, (sample if sample is not None else F.lit(None)).cast("long").alias("sample_size"), pairs).select(*key, "p.field", "p.value", "sample_size")
    return long.filter("value is not null and not isnan(value)").select(*key, "field", "value", F.lit(source).alias("source"), F.lit(confidence or CONFIDENCE[source]).alias("confidence"), "sample_size", F.lit(detail).alias("detail"))


def merged(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """The best value of each field, with its provenance, ``candidates`` (how many there were) and ``passed_over`` (the sources that lost)."""
    rows = reduce(DataFrame.unionByName, parts)
    order = F.struct(_place(F.col("source"), SOURCES), _place(F.col("confidence"), LEVELS), -F.coalesce("sample_size", F.lit(0)), "value", "detail")
    best = F.min_by(F.struct("value", "source", "confidence", "sample_size", "detail"), order)
    out = rows.groupBy(*key, "field").agg(best.alias("b"), F.count("*").alias("candidates"), F.array_sort(F.collect_set("source")).alias("_all"))
    return out.select(*key, "field", "b.*", "candidates", F.array_except("_all", F.array("b.source")).alias("passed_over"))


def wide(best: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """A row for each key: the values, and how many of them rest on the property itself."""
    value = lambda f: F.max(F.when(F.col("field") == f, F.col("value"))).alias(f)
    return best.groupBy(*key).agg(*map(value, fields), F.count_if(F.col("source").isin(*SOURCES[:2])).alias("own"), F.count("*").alias("known"))
