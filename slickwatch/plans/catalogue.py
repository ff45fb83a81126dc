"""All registered queries; importing the plan modules registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slickwatch.plans import assessment, ensemble, imagery, metocean, scalars, scene, vessel
from slickwatch.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Vessels of each case in order of investigative priority, with reasons."""
    return QUERIES["ranked_vessels"](spark, folder)
