"""All queries of the reference's operators and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import grids, leases, loads, portfolio, proforma, reads, records, scorecard, synthesis, texts, warehouse  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peer z-scores of every property metric."""
    return QUERIES["agg11_peer_zscore"](spark, sf_dir)
