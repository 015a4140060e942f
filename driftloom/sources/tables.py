"""Scans of the project's tables.

Each function reads one Parquet table; Catalyst pushes filters and column
selections into the scan, so nothing is pruned by hand here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: First instant of day 0 of the study.
DAY0 = "2008-09-19"

#: Columns of the proximity log; three of them need quoting because of their dots.
USER = "`user.id`"
PEER = "`remote.user.id.if.known`"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` in ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dated(proximity: DataFrame, day0: str = DAY0) -> DataFrame:
    """Readings of the proximity log with a time at or after day 0."""
    return proximity.filter(F.col("time") >= F.lit(day0).cast("timestamp_ntz"))
