"""All queries of the library, by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.plans import asks as _asks  # noqa: F401  registers its queries
from docloom.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused lexical and salience ranking over the chunks of all documents."""
    return QUERIES["rank_fusion"](spark, sf_dir)
