"""Hourly government rows: sites, and corrections by later files (J5, P6, P8, A16, T-6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_state(rows: DataFrame, prefix: str = "490") -> DataFrame:
    """Rows of sites whose id begins with the state's code."""
    return rows.where(F.col("site_id").startswith(prefix))


def of_sites(rows: DataFrame, sites: DataFrame, prefix: str = "490") -> DataFrame:
    """Rows of known sites; if none are known, of the state."""
    return in_state(rows, prefix) if sites.isEmpty() else rows.join(sites.select("site_id").distinct(), "site_id", "left_semi")


def first_of_site(sites: DataFrame, value: str, order: str) -> DataFrame:
    """What the first row of each site says."""
    return sites.groupBy("site_id").agg(F.min_by(value, order).alias(value))


def corrected_hours(rows: DataFrame) -> DataFrame:
    """site_id, parameter, hour, value, files: of an hour's rows that of the last file holds (A16, T-6)."""
    return rows.where("value IS NOT NULL").groupBy("site_id", "parameter", "hour").agg(F.max_by("value", F.struct("file_ts", "reading_id")).alias("value"), F.count("*").alias("files"))
