"""Pandas UDFs that are made on first use, and a package that Python workers can import."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def on_workers() -> SparkSession:
    spark = SparkSession.getActiveSession()
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (env.get("PYTHONPATH", ""), ROOT) if x)
    return spark


def series_udf(function, returns: str):
    """A pandas UDF of `function` (Series to Series); workers import it by name."""
    on_workers()
    return F.pandas_udf(function, returns)
