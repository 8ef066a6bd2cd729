"""Queries of colours, bars, labels, and of places on maps."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import aqi as A
from ..functions import display as D
from ..functions import geo as E
from ..functions import time as T
from ..operators import windows as W
from ..schema import AQI_RAMP, AQI_TOPS, FIELD_TOPS, PM25_RAMP
from ..sources.readings import READINGS_SQL, readings, table
from .registry import query
from .sensor_queries import _LATEST, latest


@query(f"""{READINGS_SQL}, f AS (SELECT reading_id, value, {D.field_aqi_sql('value')} AS field_aqi FROM readings WHERE key = 'pm2.5')
SELECT reading_id, round(field_aqi, 6) AS field_aqi, {D.category_sql('value', FIELD_TOPS)} AS by_value, {D.category_sql('field_aqi', AQI_TOPS)} AS by_aqi, {D.sentinel_sql('value')} AS sentinel,
 {D.ramp_sql('value', PM25_RAMP)} AS value_rgb, {D.ramp_sql('field_aqi', AQI_RAMP)} AS aqi_rgb, CASE WHEN field_aqi <= 50 THEN '🟢' WHEN field_aqi <= 100 THEN '🟡' WHEN field_aqi <= 150 THEN '🟠' WHEN field_aqi <= 200 THEN '🔴' WHEN field_aqi <= 300 THEN '🟣' ELSE '🟤' END AS mark FROM f""")
def field_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index for fields, categories, sentinel bands, continuous colours and marks of particle readings (F2d, F9-F11, F14)."""
    v, q = F.col("value"), F.col("field_aqi")
    f = readings(spark, sf_dir).where("key = 'pm2.5'").select("reading_id", "value", D.field_aqi(v).alias("field_aqi"))
    return f.select("reading_id", F.round("field_aqi", 6).alias("field_aqi"), D.category(v, FIELD_TOPS).alias("by_value"), D.category(q, AQI_TOPS).alias("by_aqi"), D.sentinel_color(v).alias("sentinel"), D.ramp(v, PM25_RAMP).alias("value_rgb"), D.ramp(q, AQI_RAMP).alias("aqi_rgb"), D.indicator(q).alias("mark"))


_RGB = "r.p_partkey, ((p_partkey * 7919) // 65536) % 256 AS r, ((p_partkey * 7919) // 256) % 256 AS g, (p_partkey * 7919) % 256 AS b"


@query(f"""WITH c AS (SELECT {_RGB} FROM part r), y AS (SELECT *, floor(0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b + 0.5::DOUBLE)::BIGINT AS y FROM c)
SELECT p_partkey, printf('#%02x%02x%02x', r, g, b) AS color, printf('#%02x%02x%02x', floor(r * 0.4::DOUBLE + 107 * 0.6::DOUBLE + 0.5::DOUBLE)::BIGINT, floor(g * 0.4::DOUBLE + 114 * 0.6::DOUBLE + 0.5::DOUBLE)::BIGINT, floor(b * 0.4::DOUBLE + 128 * 0.6::DOUBLE + 0.5::DOUBLE)::BIGINT) AS dim,
 printf('#%02x%02x%02x', y, y, y) AS gray, printf('#%02x%02x%02x', floor(r * 0.75::DOUBLE + y * 0.25::DOUBLE + 0.5::DOUBLE)::BIGINT, floor(g * 0.75::DOUBLE + y * 0.25::DOUBLE + 0.5::DOUBLE)::BIGINT, floor(b * 0.75::DOUBLE + y * 0.25::DOUBLE + 0.5::DOUBLE)::BIGINT) AS desat,
 printf('#%02x%02x%02x', floor(r * 0.75::DOUBLE + 0.5::DOUBLE)::BIGINT, floor(g * 0.75::DOUBLE + 0.5::DOUBLE)::BIGINT, floor(b * 0.75::DOUBLE + 0.5::DOUBLE)::BIGINT) AS dark, 'rgba(' || r || ', ' || g || ', ' || b || ', 0.5)' AS half, '#6b7280' AS odd FROM y""")
def colour_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours dimmed, grayed, desaturated, darkened and with transparency."""
    n = F.pmod(F.col("p_partkey") * 7919, F.lit(1 << 24))
    c = F.col("color")
    out = table(spark, sf_dir, "part").select("p_partkey", F.lower(F.concat(F.lit("#"), F.lpad(F.hex(n), 6, "0"))).alias("color"))
    return out.select("p_partkey", "color", D.dimmed(c).alias("dim"), D.grayed(c).alias("gray"), D.desaturated(c).alias("desat"), D.darkened(c).alias("dark"), D.rgba(c, 0.5).alias("half"), D.dimmed(F.lit("dim red")).alias("odd"))


@query(f"""{READINGS_SQL}, s AS (SELECT sensor_id, key, max_by(value, (ts, reading_id)) AS last, max(value) AS most, min(value) AS least, avg(value) AS mean FROM readings GROUP BY ALL),
 q AS (SELECT *, {A.aqi_sql('key', 'last')} AS aqi, {A.aqi_sql('key', 'most')} AS most_aqi FROM s),
 r AS (SELECT *, row_number() OVER (PARTITION BY sensor_id, pollutant ORDER BY ts, reading_id) AS n FROM readings),
 l AS (SELECT r.sensor_id, r.key, string_agg(CASE WHEN most > least THEN least(greatest(trunc((value - least) / (most - least) * 7)::INTEGER, 0), 7) ELSE 4 END::VARCHAR, '' ORDER BY n) AS spark FROM r JOIN s USING (sensor_id, key) WHERE n <= 10 GROUP BY ALL)
SELECT sensor_id, key, round(least, 6) AS least, round(most, 6) AS most, round(mean, 6) AS mean, spark, round(coalesce(least(greatest(aqi / 300.0::DOUBLE * 100.0::DOUBLE, 0), 100), 0), 6) AS aqi_pct,
 round(coalesce(least(greatest(last / CASE WHEN most > 0 THEN most ELSE 1 END * 100.0::DOUBLE, 0), 100), 0), 6) AS spark_pct, round(0.25::DOUBLE + 0.75::DOUBLE * sqrt(coalesce(least(greatest(most_aqi / 300.0::DOUBLE * 100.0::DOUBLE, 0), 100), 0) / 100.0::DOUBLE), 6) AS scale FROM q JOIN l USING (sensor_id, key)""")
def bars_and_sparklines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends and mean of each series, levels of its first ten values, lengths of its bars."""
    r = readings(spark, sf_dir)
    s = r.groupBy("sensor_id", "key").agg(F.max_by("value", F.struct("ts", "reading_id")).alias("last"), F.max("value").alias("most"), F.min("value").alias("least"), F.avg("value").alias("mean"))
    n = F.row_number().over(W.in_order(*W.SERIES))
    first = r.withColumn("n", n).where("n <= 10").join(s, ["sensor_id", "key"])
    level = D.spark_level(F.col("value"), F.col("least"), F.col("most"))
    spark_ = first.groupBy("sensor_id", "key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", level.alias("level")))), lambda x: x["level"].cast("string")), "").alias("spark"))
    s = s.join(spark_, ["sensor_id", "key"])
    k = F.col("key")
    scale = D.spark_scale(A.value_to_aqi(k, F.col("most")), F.col("most").isNotNull())
    return s.select("sensor_id", "key", *(F.round(c, 6).alias(c) for c in ("least", "most", "mean")), "spark", F.round(D.aqi_percent(A.value_to_aqi(k, F.col("last"))), 6).alias("aqi_pct"), F.round(D.spark_percent(F.col("last"), F.col("most")), 6).alias("spark_pct"), F.round(scale, 6).alias("scale"))


_TAG = "CASE WHEN v IS NULL THEN '' WHEN v = floor(v) THEN v::BIGINT::VARCHAR WHEN v < 10 THEN printf('%.1f', v) ELSE floor(v + 0.5::DOUBLE)::BIGINT::VARCHAR END"


@query(f"""WITH o AS (SELECT o_orderkey, o_totalprice / CASE WHEN o_orderkey % 3 = 0 THEN 100000.0::DOUBLE ELSE 1 END AS v, (o_orderkey % 900) / 4.0::DOUBLE AS w, o_orderdate::TIMESTAMP + INTERVAL 1 MILLISECOND * (o_orderkey % 100000) AS t, o_orderkey % 4 AS k FROM orders)
SELECT o_orderkey, {_TAG} AS tag, CASE WHEN w = floor(w) THEN w::BIGINT::VARCHAR ELSE w::VARCHAR END AS plain, strftime(t, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso_ms, strftime(t, '%Y-%m-%d %H:%M:%S') AS shown_at, epoch_ms(t)::BIGINT AS parsed_ms,
 CASE k WHEN 0 THEN '🚍' WHEN 1 THEN '🚃' WHEN 2 THEN '🚃' ELSE '📍' END AS mark, 'Roof ' || o_orderkey AS name, CASE k WHEN 0 THEN 49035 WHEN 1 THEN 49035 WHEN 2 THEN 49049 END AS fips,
 CASE k WHEN 0 THEN '—' WHEN 1 THEN 'not json' ELSE round(w, 4)::VARCHAR || ',' || round(-w, 4)::VARCHAR || ' z' || round(w / 10, 1)::VARCHAR END AS view FROM o""")
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of values, times, names and stored views."""
    k = F.pmod("o_orderkey", F.lit(4))
    o = table(spark, sf_dir, "orders").withColumns({"v": F.col("o_totalprice") / F.when(F.pmod("o_orderkey", F.lit(3)) == 0, 100_000.0).otherwise(1.0), "w": F.pmod("o_orderkey", F.lit(900)) / 4.0,
                                                   "t": F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(secs=F.pmod("o_orderkey", F.lit(100_000)) / 1000)})
    raw = F.when(k == 0, "").when(k == 1, "not json").otherwise(F.to_json(F.struct(F.col("w").alias("lat"), (-F.col("w")).alias("lon"), (F.col("w") / 10).alias("zoom"))))
    iso = T.iso_ms(F.col("t"))
    vendor = F.concat(F.lit("Roof "), F.col("o_orderkey").cast("string"), F.element_at(F.array(F.lit(""), F.lit(" - Powered by UTOPIA Fiber"), F.lit(" power by utopia"), F.lit("")), (k + 1).cast("int")))
    county = F.element_at(F.array(F.lit(" Salt  Lake County"), F.lit("SLC"), F.lit("49049"), F.lit("Nowhere")), (k + 1).cast("int"))
    mark = D.vehicle_mark(F.element_at(F.array(F.lit("bus7"), F.lit("TRX1"), F.lit("trax9"), F.lit("S5")), (k + 1).cast("int")))
    return o.select("o_orderkey", D.tag_value(F.col("v")).alias("tag"), D.collapsed_integer(F.col("w")).alias("plain"), iso.alias("iso_ms"), D.shown_time(F.date_format("t", "yyyy-MM-dd HH:mm:ss 'UTC'")).alias("shown_at"), T.utc_ms(iso).alias("parsed_ms"),
                    mark.alias("mark"), D.without_vendor(vendor).alias("name"), D.county_fips(county).alias("fips"), D.map_view(raw).alias("view"))


@query(f"""{READINGS_SQL}, l AS (SELECT sensor_id, max_by(lat, (ts, reading_id)) AS lat, max_by(lon, (ts, reading_id)) AS lon FROM readings GROUP BY ALL),
 m AS (SELECT *, (lon + 180) / 360.0::DOUBLE AS u, (1 - ln(tan(pi() / 4 + radians(lat) / 2)) / pi()) / 2 AS v FROM l)
SELECT sensor_id, round(u, 9) AS u, round(v, 9) AS v, round(degrees(atan((exp(pi() - 2 * pi() * v) - exp(-(pi() - 2 * pi() * v))) / 2)), 6) AS back_lat, round(u * 360 - 180, 6) AS back_lon,
 round(lat + 2.5::DOUBLE * cos(radians((120 + 90)::DOUBLE)) / 111320.0::DOUBLE, 9) AS right_lat, round(lon + 2.5::DOUBLE * sin(radians((120 + 90)::DOUBLE)) / (111320.0::DOUBLE * cos(radians(lat))), 9) AS right_lon,
 floor(lat / 0.01::DOUBLE + 0.5::DOUBLE)::BIGINT || '|' || floor(lon / 0.01::DOUBLE + 0.5::DOUBLE)::BIGINT || '|' || floor((lat + 1) / 0.01::DOUBLE + 0.5::DOUBLE)::BIGINT || '|nan' AS signature FROM m""")
def projected_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensors in Web Mercator and back, moved to the right of a direction, and signatures of bounds."""
    at = F.struct("ts", "reading_id")
    m = readings(spark, sf_dir).groupBy("sensor_id").agg(F.max_by("lat", at).alias("lat"), F.max_by("lon", at).alias("lon")).withColumn("m", E.mercator(F.col("lat"), F.col("lon")))
    m = m.withColumns({"b": E.from_mercator(F.col("m.u"), F.col("m.v")), "r": E.right_of(F.col("lat"), F.col("lon"), F.lit(120.0), 2.5)})
    signature = E.bounds_signature(F.col("lat"), F.col("lon"), F.col("lat") + 1, F.lit(None).cast("double"), 0.01)
    return m.select("sensor_id", F.round("m.u", 9).alias("u"), F.round("m.v", 9).alias("v"), F.round("b.lat", 6).alias("back_lat"), F.round("b.lon", 6).alias("back_lon"), F.round("r.lat", 9).alias("right_lat"), F.round("r.lon", 9).alias("right_lon"), signature.alias("signature"))


_N = math.sin(math.radians(25.0))
_FR = 6_371_229.0 * math.cos(math.radians(25.0)) * math.tan(math.pi / 4 + math.radians(25.0) / 2) ** _N / _N
_RHO0 = _FR / math.tan(math.pi / 4 + math.radians(25.0) / 2) ** _N


@query(f"""WITH g AS (SELECT p_partkey, (p_partkey % 70) * 13000.0::DOUBLE - 2e6::DOUBLE AS x, (p_partkey // 70 % 70) * 13000.0::DOUBLE + 1e6::DOUBLE AS y, (p_partkey % 50)::DOUBLE AS speed FROM part),
 r AS (SELECT *, sqrt(x * x + ({_RHO0}::DOUBLE - y) ** 2) AS rho, least(greatest((speed - 5) / 20.0::DOUBLE, 0), 1) AS t FROM g)
SELECT p_partkey, round(degrees(2 * atan(({_FR}::DOUBLE / rho) ** {1 / _N}::DOUBLE)) - 90, 6) AS lat, round(-95 + degrees(atan2(x, {_RHO0}::DOUBLE - y)) / {_N}::DOUBLE, 6) AS lon, round(1 + 2 * t * t * (3 - 2 * t), 9) AS stretch,
 round(((0.6::DOUBLE * x + 0.8::DOUBLE * y) / CASE WHEN 0.6::DOUBLE * x + 0.8::DOUBLE * y > 0 THEN 1 + 2 * t * t * (3 - 2 * t) ELSE (1 + 2 * t * t * (3 - 2 * t)) * 0.5::DOUBLE END) ** 2 + (0.6::DOUBLE * y - 0.8::DOUBLE * x) ** 2, 0) AS drawn FROM r""")
def grid_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a Lambert grid, and distances drawn out by the wind."""
    k = F.col("p_partkey")
    g = table(spark, sf_dir, "part").select("p_partkey", (F.pmod(k, F.lit(70)) * 13_000.0 - 2e6).alias("x"), (F.pmod(F.floor(k / 70), F.lit(70)) * 13_000.0 + 1e6).alias("y"), F.pmod(k, F.lit(50)).cast("double").alias("speed"))
    g = g.withColumns({"p": E.from_lambert(F.col("x"), F.col("y")), "s": E.stretch(F.col("speed"), 5.0, 25.0, 3.0)})
    return g.select("p_partkey", F.round("p.lat", 6).alias("lat"), F.round("p.lon", 6).alias("lon"), F.round("s", 9).alias("stretch"), F.round(E.drawn_out(F.col("x"), F.col("y"), F.lit(0.6), F.lit(0.8), F.col("s"), 0.5), 0).alias("drawn"))


@query(f"""{READINGS_SQL}, t AS (SELECT reading_id, lat, lon, lag(lat) OVER w AS alat, lag(lon) OVER w AS alon, lead(lat) OVER w AS clat, lead(lon) OVER w AS clon FROM readings WHERE source = 'mobile' WINDOW w AS (PARTITION BY sensor_id ORDER BY ts, reading_id)),
 p AS (SELECT reading_id, (lon - alon) * cos(radians(alat)) * 111320.0::DOUBLE AS bx, (lat - alat) * 111320.0::DOUBLE AS by_, (clon - alon) * cos(radians(alat)) * 111320.0::DOUBLE AS cx, (clat - alat) * 111320.0::DOUBLE AS cy FROM t WHERE alat IS NOT NULL AND clat IS NOT NULL),
 q AS (SELECT *, cx * cx + cy * cy AS n, least(greatest((bx * cx + by_ * cy) / (cx * cx + cy * cy), 0), 1) AS t FROM p) SELECT reading_id, CASE WHEN n > 1e-6::DOUBLE THEN round(sqrt((bx - cx * t) ** 2 + (by_ - cy * t) ** 2), 3) END AS off_m FROM q""")
def off_the_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each point of a trail is off the line between its neighbours."""
    w = W.in_order("sensor_id")
    t = readings(spark, sf_dir).where("source = 'mobile'").select("reading_id", "lat", "lon", *(f("lat" if c == "lat" else "lon").over(w).alias(f"{p}{c}") for p, f in (("a", F.lag), ("c", F.lead)) for c in ("lat", "lon")))
    t = t.where("alat IS NOT NULL AND clat IS NOT NULL")
    return t.select("reading_id", F.round(E.metres_off_line(*(F.col(c) for c in ("alat", "alon", "lat", "lon", "clat", "clon"))), 3).alias("off_m"))


@query(f"""{READINGS_SQL}, l AS ({_LATEST}), p AS (SELECT sensor_id, max(CASE WHEN key = 'pm2.5' THEN value END) AS pm25, max(CASE WHEN key = 'pm10' THEN value END) AS pm10, max(CASE WHEN key = 'ozone' THEN value END) AS ozone, max(CASE WHEN key = 'no2' THEN value END) AS no2, max(CASE WHEN key = 'co' THEN value END) AS co, count(*) AS n, any_value(value) AS lone FROM l GROUP BY ALL)
SELECT sensor_id, CASE WHEN pm25 IS NOT NULL THEN 'pm2.5' WHEN pm10 IS NOT NULL THEN 'pm10' WHEN ozone IS NOT NULL THEN 'ozone' WHEN no2 IS NOT NULL THEN 'no2' ELSE 'co' END AS primary_key, CASE WHEN pm25 IS NOT NULL THEN {A.color_sql("'pm2.5'", 'pm25')} WHEN pm10 IS NOT NULL THEN {A.color_sql("'pm10'", 'pm10')} WHEN ozone IS NOT NULL THEN {A.color_sql("'ozone'", 'ozone')} WHEN no2 IS NOT NULL THEN {A.color_sql("'no2'", 'no2')} ELSE {A.color_sql("'co'", 'co')} END AS primary_ci,
 concat_ws(' ', CASE WHEN pm25 IS NOT NULL THEN 'pm2.5' END, CASE WHEN pm10 IS NOT NULL THEN 'pm10' END, CASE WHEN ozone IS NOT NULL THEN 'ozone' END, CASE WHEN co IS NOT NULL THEN 'co' END, CASE WHEN no2 IS NOT NULL THEN 'no2' END) AS shown_order, pm25 BETWEEN 0 AND 500 AS scalar_ok FROM p WHERE NOT (n = 1 AND lone <= 0) AND sensor_id <> 'S7'""")
def console_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the console shows of each sensor: its first pollutant and colour, the order of its readings, whether its
    latest particle value is usable; without lone readings that are not positive and without the home sensor (here S7)
    (A9, O13, P11, P12, P14, P15)."""
    l = latest(readings(spark, sf_dir), "sensor_id", "pollutant")  # noqa: E741
    rank = lambda order: F.coalesce(*(F.when(F.col("key") == k, i) for i, k in enumerate(order)), F.lit(100))
    p = l.groupBy("sensor_id").agg(F.min_by(F.struct("key", "value"), rank(["pm2.5", "pm10", "ozone", "no2", "co"])).alias("first"), F.sort_array(F.collect_list(F.struct(rank(["pm2.5", "pm10", "ozone"]).alias("r"), "key"))).alias("order"),  # five at most
                                   F.count("*").alias("n"), F.first("value").alias("only"), F.max(F.when(F.col("key") == "pm2.5", F.col("value"))).alias("pm25"))
    p = p.where(~((F.col("n") == 1) & (F.col("only") <= 0)) & (F.col("sensor_id") != "S7"))
    return p.select("sensor_id", F.col("first.key").alias("primary_key"), A.color_index(F.col("first.key"), F.col("first.value")).alias("primary_ci"), F.array_join(F.transform("order", lambda x: x["key"]), " ").alias("shown_order"), F.col("pm25").between(0, 500).alias("scalar_ok"))


