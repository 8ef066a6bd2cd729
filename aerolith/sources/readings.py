"""Readings from a generic events table: one row per observation.

sensor and source come from the user, the pollutant from the event's type; mobile sensors drift with the event's number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.aqi import pollutant_key

POLLUTANTS = {"click": "PM25", "view": "PM10", "purchase": "OZNE", "signup": "NO2", "error": "CO"}
SOURCES = ["mobile", "fixed", "purpleair", "airnow"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reading_id, sensor_id, source, ts (UTC, without zone), lat, lon, pollutant (feed's name), key, value, meta."""
    e = table(spark, sf_dir, "events")
    name = F.element_at(F.create_map(*(F.lit(x) for kv in POLLUTANTS.items() for x in kv)), F.col("event_type"))
    source = F.element_at(F.array(*map(F.lit, SOURCES)), (F.pmod("user_id", F.lit(4)) + 1).cast("int"))
    drift = F.when(F.pmod("user_id", F.lit(4)) == 0, F.pmod("event_id", F.lit(100)) / 1e5).otherwise(0.0)
    return e.select(
        F.col("event_id").alias("reading_id"), F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("sensor_id"), source.alias("source"),
        F.col("ts").cast("timestamp_ntz").alias("ts"), (F.lit(40.4) + F.pmod(F.col("user_id") * 37, F.lit(500)) / 1e3 + drift).alias("lat"),
        (F.lit(-112.2) + F.pmod(F.col("user_id") * 91, F.lit(500)) / 1e3 - drift).alias("lon"), name.alias("pollutant"), pollutant_key(name).alias("key"), "value", F.col("props").alias("meta"),
    )


_NAME = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in POLLUTANTS.items()) + " END"
_KEY = "CASE event_type WHEN 'click' THEN 'pm2.5' WHEN 'view' THEN 'pm10' WHEN 'purchase' THEN 'ozone' WHEN 'signup' THEN 'no2' WHEN 'error' THEN 'co' END"
_DRIFT = "CASE WHEN user_id % 4 = 0 THEN (event_id % 100)::DOUBLE / 1e5::DOUBLE ELSE 0.0::DOUBLE END"
#: The same rows in SQL, as the first of a query's common tables.
READINGS_SQL = f"""WITH readings AS (SELECT event_id AS reading_id, 'S' || user_id AS sensor_id, ['mobile', 'fixed', 'purpleair', 'airnow'][user_id % 4 + 1] AS source, ts::TIMESTAMP AS ts,
 40.4::DOUBLE + (user_id * 37 % 500)::DOUBLE / 1e3::DOUBLE + {_DRIFT} AS lat, -112.2::DOUBLE + (user_id * 91 % 500)::DOUBLE / 1e3::DOUBLE - {_DRIFT} AS lon,
 {_NAME} AS pollutant, {_KEY} AS key, value, props AS meta FROM events)"""
