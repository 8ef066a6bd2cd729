"""Feeds as they arrive: nested JSON, pipe-separated files, columnar responses, NDJSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.aqi import clamp_feed, color_index, number, pollutant_key
from ..functions.time import parse_utc

#: Keys beside the sensors in a pollutant's section, and weather that isn't a pollutant.
METADATA = ["LastUpdateUTC", "LastUpdateLocal", "VarName", "VarUnit", "APITimeStart", "APITimeEnd"]
WEATHER = ["BARPR", "DEWPOINT", "TEMP", "WD", "WS", "RHUM", "SOLAR", "PRECIP", "CEIL", "VSBY", "BC_LC", "BC_DC"]
LISTS = T.StructType([T.StructField(c, T.ArrayType(T.StringType())) for c in ("Latitude", "Longitude", "TimeUTC", "Value")])
SINGLE = T.StructType([T.StructField(c, T.StringType()) for c in ("Latitude", "Longitude", "TimeUTC", "Value")])
SITE_FIELDS = ["aqsid", "parameter", "site_code", "site_name", "status", "agency_id", "agency_name", "epa_region", "latitude", "longitude", "elevation", "gmt_offset", "country_code", "msa_code", "msa_name", "state_code", "state_name", "county_code", "county_name"]


def without_nan(json: Column) -> Column:
    """NaN and Infinity, which JSON hasn't, become null."""
    return F.regexp_replace(json, r"(?<=[:\[,])\s*-?(?:NaN|Infinity)\s*(?=[,\]}])", " null")


def sections(raw: DataFrame, column: str = "raw") -> DataFrame:
    """pollutant, pollutant_no (its place in the feed), sensor_id, payload (JSON) of each sensor in each section."""
    outer = F.from_json(without_nan(F.col(column)), T.MapType(T.StringType(), T.StringType()))
    a = raw.select(F.posexplode(F.map_entries(outer)).alias("pollutant_no", "s")).select("pollutant_no", F.col("s.key").alias("pollutant"), F.from_json("s.value", T.MapType(T.StringType(), T.StringType())).alias("m"))
    b = a.where("m IS NOT NULL").select("pollutant_no", "pollutant", F.explode(F.map_entries("m")).alias("e"))
    return b.select("pollutant_no", "pollutant", F.col("e.key").alias("sensor_id"), F.col("e.value").alias("payload")).where(~F.col("sensor_id").isin(METADATA))


def right_aligned(values: Column, n: Column) -> Column:
    """The last n of a list; a shorter one is filled with nulls in front."""
    have = F.coalesce(F.size(values), F.lit(0))
    have = F.when(values.isNull(), 0).otherwise(have)
    cut = F.when(have >= n, F.slice(values, have - n + 1, n)).otherwise(F.coalesce(values, F.expr("cast(array() as array<string>)")))
    return F.concat(F.array_repeat(F.lit(None).cast("string"), (n - F.least(have, n)).cast("int")), cut)


def mobile_points(raw: DataFrame, column: str = "raw") -> DataFrame:
    """One row for each point and pollutant of the mobile feed (S4, P10): sensor_id, seq, t, ts, lat, lon, pollutant,
    key, value (null where it can't be), ci."""
    s = sections(raw, column).withColumn("p", F.from_json("payload", LISTS)).where(F.size("p.Latitude").cast("int") > 0)
    n = F.least(F.size("p.Latitude"), F.size("p.Longitude"))
    s = s.where(n > 0).withColumn("z", F.arrays_zip(*(right_aligned(F.col(f"p.{c}"), n).alias(c) for c in ("Latitude", "Longitude", "TimeUTC", "Value"))))
    s = s.select("pollutant_no", "pollutant", "sensor_id", F.posexplode("z").alias("seq", "v"))
    key = pollutant_key(F.col("pollutant"))
    value = clamp_feed(key, number(F.col("v.Value")))
    out = s.select("sensor_id", "pollutant_no", "pollutant", key.alias("key"), "seq", F.col("v.TimeUTC").alias("t"), parse_utc(F.col("v.TimeUTC")).alias("ts"), number(F.col("v.Latitude")).alias("lat"), number(F.col("v.Longitude")).alias("lon"), value.alias("value"))
    return out.where("lat IS NOT NULL AND lon IS NOT NULL").withColumn("ci", color_index(F.col("key"), F.col("value")))


def tracks(points: DataFrame, most: int = 200) -> DataFrame:
    """Points of all pollutants merged by sensor and time (J1, W1-W5): the last pollutant's place, values carried
    forward and then backward, repeats of place and time left out, the latest ``most`` kept."""
    from ..operators.windows import filled, last_n, without_repeats

    at = F.coalesce(F.col("t"), F.concat(F.lit("idx:"), F.col("seq").cast("string")))
    p = points.withColumn("at", at)
    keys = ["PM25", "PM10", "OZNE", "NO2", "CO"]
    values = [F.max_by(F.when(F.col("pollutant") == k, F.col("value")), F.when((F.col("pollutant") == k) & F.col("value").isNotNull(), F.col("seq"))).alias(k.lower()) for k in keys]
    m = p.groupBy("sensor_id", "at").agg(F.min("ts").alias("ts"), F.max_by("lat", "pollutant_no").alias("lat"), F.max_by("lon", "pollutant_no").alias("lon"), F.min("seq").alias("reading_id"), *values)
    m = m.withColumn("ts", F.col("ts"))
    m = without_repeats(m, "sensor_id", same=("lat", "lon", "at"))
    m = m.withColumns({k.lower(): filled(k.lower(), "sensor_id") for k in keys})
    return last_n(m, most, "sensor_id").drop("reading_id")


def fixed_readings(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Readings of the fixed feed, without weather, with a place."""
    s = sections(raw, column).where(~F.upper("pollutant").isin(WEATHER)).withColumn("p", F.from_json("payload", SINGLE))
    key = pollutant_key(F.col("pollutant"))
    out = s.select("sensor_id", "pollutant", key.alias("key"), parse_utc(F.col("p.TimeUTC")).alias("ts"), number(F.col("p.Latitude")).alias("lat"), number(F.col("p.Longitude")).alias("lon"), number(F.col("p.Value")).alias("value"))
    return out.where("lat IS NOT NULL AND lon IS NOT NULL")


def sites(lines: DataFrame) -> DataFrame:
    """Monitoring sites from pipe-separated lines; lines of fewer fields are dropped."""
    f = F.split("value", r"\|", -1)
    cols = [number(F.get(f, F.lit(i))).alias(c) if c in ("latitude", "longitude", "elevation", "gmt_offset") else F.trim(F.get(f, F.lit(i))).alias(c) for i, c in enumerate(SITE_FIELDS)]
    return lines.where(F.size(f) >= len(SITE_FIELDS)).select(*cols)


def hourly(lines: DataFrame) -> DataFrame:
    """Hourly government records; a bad date drops the line, a bad value is null."""
    f = F.split("value", r"\|", -1)
    g = lambda i: F.trim(F.get(f, F.lit(i)))
    ts = F.try_to_timestamp(F.concat_ws(" ", g(0), g(1)), F.lit("MM/dd/yy HH:mm")).cast("timestamp_ntz")
    return lines.where(F.size(f) >= 9).select(ts.alias("ts"), g(2).alias("site_id"), g(3).alias("site_name"), number(g(4)).alias("gmt_offset"), g(5).alias("parameter"), g(6).alias("unit"), number(g(7)).alias("value"), g(8).alias("agency")).where("ts IS NOT NULL")


def hour_paths(first: str, last: str, pattern: str) -> Column:
    """Paths of the hourly files from one hour to another, both included."""
    hours = F.sequence(F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz"), F.expr("INTERVAL 1 HOUR"))
    return F.transform(hours, lambda h: F.date_format(h, pattern))


def community(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Rows of a columnar response {fields, data} (S14, J6): sensor_id, name, lat, lon, value, last_seen."""
    r = raw.select(F.from_json(without_nan(F.col(column)), "fields array<string>, data array<array<string>>").alias("r"))
    r = r.select("r.fields", F.explode("r.data").alias("d"))
    g = lambda name: F.try_element_at("d", F.array_position("fields", name).cast("int"))
    safe = lambda name: F.when(F.array_position("fields", name) > 0, g(name))
    return r.select(F.concat(F.lit("PA_"), safe("sensor_index")).alias("sensor_id"), safe("name").alias("name"), number(safe("latitude")).alias("lat"), number(safe("longitude")).alias("lon"), number(safe("pm2.5")).alias("value"), safe("last_seen").try_cast("long").alias("last_seen")).where("value IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")


def ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a log of JSON lines; blank and broken lines are left out."""
    rows = spark.read.text(path).where("trim(value) <> ''")
    return rows.select(F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE"}).alias("r")).where("r._corrupt_record IS NULL").select("r.*").drop("_corrupt_record")


def road_graph(raw: DataFrame, column: str = "raw") -> tuple[DataFrame, DataFrame]:
    """Nodes (node, lat, lon, elev) and directed edges (src, dst, dist_m) of a stored graph."""
    g = raw.select(F.from_json(column, "nodes array<array<double>>, adj array<array<array<double>>>").alias("g"))
    nodes = g.select(F.posexplode("g.nodes").alias("node", "p")).select(F.col("node").cast("long").alias("node"), F.get("p", F.lit(0)).alias("lat"), F.get("p", F.lit(1)).alias("lon"), F.get("p", F.lit(2)).alias("elev"))
    edges = g.select(F.posexplode("g.adj").alias("src", "out")).select(F.col("src").cast("long").alias("src"), F.explode("out").alias("e")).select("src", F.get("e", F.lit(0)).cast("long").alias("dst"), F.get("e", F.lit(1)).alias("dist_m"))
    return nodes, edges
