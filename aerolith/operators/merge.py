"""Merges of feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_names(sensors: DataFrame, names: DataFrame, pinned: DataFrame) -> DataFrame:
    """Custom names where not empty, and whether the sensor is pinned (J2, J3). names: sensor_id, custom."""
    out = sensors.join(names, "sensor_id", "left").join(pinned.select("sensor_id").distinct().withColumn("_p", F.lit(True)), "sensor_id", "left")
    name = F.coalesce(F.when(F.trim("custom") != "", F.trim("custom")), F.col("name"))
    return out.withColumns({"name": name, "pinned": F.coalesce("_p", F.lit(False))}).drop("custom", "_p")


def merge_by_place(fixed: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming readings into fixed sensors at the same place, to three decimals (J4), both of sensor_id, lat, lon, key, value.

    Of fixed sensors at one place the last by id takes them; its own readings win; incoming sensors without a place
    among the fixed ones are added. origin says where a reading is from."""
    at = F.struct(F.round("lat", 3).alias("lat"), F.round("lon", 3).alias("lon"))
    own = fixed.withColumn("place", at).groupBy("place").agg(F.max("sensor_id").alias("target"))
    placed = incoming.withColumn("place", at).join(own, "place", "left").select(F.col("sensor_id").alias("incoming"), F.coalesce("target", "sensor_id").alias("sensor_id"), "key", "value", F.when(F.col("target").isNull(), "added").otherwise("merged").alias("origin"))
    # several incoming sensors at one place: the first by id
    placed = placed.groupBy("sensor_id", "key", "origin").agg(F.min_by("value", "incoming").alias("value"))
    new = placed.join(fixed.select("sensor_id", "key"), ["sensor_id", "key"], "left_anti")
    return fixed.select("sensor_id", "key", "value", F.lit("own").alias("origin")).unionByName(new)


def upserted(cached: DataFrame, fetched: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Fetched rows replace cached ones of their key, others stay."""
    f = fetched.select(key, *(F.col(v).alias(f"_{v}") for v in values), F.lit(True).alias("_f"))
    out = cached.select(key, *values, F.lit(True).alias("_c")).join(f, key, "full")
    state = F.when(F.col("_c").isNull(), "new").when(F.col("_f").isNull(), "kept").otherwise("updated")
    return out.select(key, *(F.when(F.col("_f"), F.col(f"_{v}")).otherwise(F.col(v)).alias(v) for v in values), state.alias("state"))


def offline(history: DataFrame, live: DataFrame) -> DataFrame:
    """Sensors of the history that aren't live."""
    return history.select("sensor_id").distinct().join(live.select("sensor_id").distinct(), "sensor_id", "left_anti")


def map_changes(before: DataFrame, after: DataFrame, *by: str) -> DataFrame:
    """Keys whose value differs between two (by, key, value) tables, added and removed ones too."""
    a = before.select(*by, "key", F.col("value").alias("old"))
    b = after.select(*by, "key", F.col("value").alias("new"))
    return a.join(b, [*by, "key"], "full").where(~F.col("old").eqNullSafe(F.col("new")))


def accepted_history(rows: DataFrame) -> DataFrame:
    """Readings that a history takes in (W19, the part by equality): government ones once for each time, the first in;
    others unless value and time repeat the one before. Community sensors' rule needs the last accepted reading; see
    ``accept_community``."""
    w = Window.partitionBy("sensor_id", "key").orderBy("recorded_at", "reading_id")
    first = F.row_number().over(Window.partitionBy("sensor_id", "key", "ts").orderBy("recorded_at", "reading_id")) == 1
    same = F.col("value").eqNullSafe(F.lag("value").over(w)) & F.col("ts").eqNullSafe(F.lag("ts").over(w)) & (F.row_number().over(w) > 1)
    return rows.withColumn("_ok", F.when(F.col("source") == "airnow", first).otherwise(~same)).where("_ok").drop("_ok")


def cliff_flags(df: DataFrame, value: str = "value") -> DataFrame:
    """flag: on the high side of an impossible jump.

    Two values in sequence are a cliff if the higher is 500 or more and 8 times the lower (0.1 at least). After a jump
    up, values are flagged until a jump down or a value below 500. So a value's flag is that of the last decisive event
    up to it, which is a window function."""
    w = Window.partitionBy("sensor_id", "key").orderBy("ts", "reading_id")
    v, p = F.col(value), F.lag(value).over(w)
    hi, lo = F.greatest(v, p), F.greatest(F.least(v, p), F.lit(0.1))
    cliff = p.isNotNull() & (hi / lo >= 8.0) & (hi >= 500.0)
    event = F.when(cliff, (v > p).cast("int")).when(v < 500.0, 0)
    out = df.where(v.isNotNull() & ~F.isnan(v)).withColumn("_event", event)
    return out.withColumn("flag", F.coalesce(F.last("_event", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) == 1).drop("_event")
