"""Queries that read feeds, made line by line or document by document from the tables, and snap trails to lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import aqi as A
from ..functions.geo import haversine_sql
from ..operators import graph as G
from ..schema import FEED_CLAMP
from ..sources import feeds
from ..sources.readings import READINGS_SQL, readings, table
from .registry import query


@query(f"""{READINGS_SQL} SELECT date_trunc('minute', ts) AS ts, lpad(sensor_id, 9, '0') AS site_id, CASE WHEN reading_id % 10 = 0 THEN NULL ELSE round(value, 4) END AS value, pollutant AS parameter, count(*) AS n FROM readings WHERE source = 'airnow' AND reading_id % 11 <> 0 AND reading_id % 17 <> 0 GROUP BY ALL""")
def hourly_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly government records from their lines; bad dates and short lines are dropped, bad values null."""
    r = readings(spark, sf_dir).where("source = 'airnow'")
    i = F.col("reading_id")
    date = F.when(i % 11 == 0, "99/99/99").otherwise(F.date_format("ts", "MM/dd/yy"))
    shown = F.when(i % 10 == 0, "n/a").otherwise(F.round("value", 4).cast("string"))
    full = F.concat_ws("|", date, F.date_format("ts", "HH:mm"), F.lpad("sensor_id", 9, "0"), F.lit(" Hawthorne "), F.lit("-7"), "pollutant", F.lit("UG/M3"), shown, F.lit("Agency"))
    lines = r.select(F.when(i % 17 == 0, "too|short").otherwise(full).alias("value"))
    return feeds.hourly(lines).groupBy("ts", "site_id", "value", "parameter").agg(F.count("*").alias("n"))


@query("""SELECT 'A' || c_custkey AS aqsid, c_name AS site_name, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_acctbal END AS elevation, 'UT' AS state_name FROM customer WHERE c_custkey % 9 <> 0""")
def site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monitoring sites from their lines; short ones are dropped, numbers that aren't any are null."""
    k = F.col("c_custkey")
    values = {"aqsid": F.concat(F.lit("A"), k.cast("string")), "site_name": F.col("c_name"), "elevation": F.when(k % 6 == 0, "high").otherwise(F.col("c_acctbal").cast("string")), "state_name": F.lit(" UT ")}
    line = F.concat_ws("|", *(values.get(c, F.lit("x")) for c in feeds.SITE_FIELDS))
    lines = table(spark, sf_dir, "customer").select(F.when(k % 9 == 0, F.substring_index(line, "|", 5)).otherwise(line).alias("value"))
    return feeds.sites(lines).select("aqsid", "site_name", "elevation", "state_name")


_FEED = f"""{READINGS_SQL}, m AS (SELECT *, date_trunc('day', ts) AS day, row_number() OVER (PARTITION BY sensor_id, date_trunc('day', ts), pollutant ORDER BY ts, reading_id) - 1 AS seq FROM readings WHERE source = 'mobile')"""


@query(f"""{_FEED} SELECT sensor_id, pollutant, key, seq::INTEGER AS seq, date_trunc('second', ts) AS ts, round(lat, 6) AS lat, round(lon, 6) AS lon, CASE WHEN reading_id % 13 = 0 THEN NULL WHEN {A.within_sql('key', 'value', FEED_CLAMP)} THEN value END AS value,
 {A.color_sql('key', f"(CASE WHEN reading_id % 13 = 0 THEN NULL WHEN {A.within_sql('key', 'value', FEED_CLAMP)} THEN value END)")} AS ci FROM m""")
def mobile_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the mobile feed, a document for each sensor and day here, with NaN in the text of some."""
    m = readings(spark, sf_dir).where("source = 'mobile'").withColumn("day", F.to_date("ts"))
    one = F.struct("ts", "reading_id", F.col("lat").cast("string").alias("Latitude"), F.col("lon").cast("string").alias("Longitude"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss 'UTC'").alias("TimeUTC"), F.when(F.col("reading_id") % 13 == 0, "NaN").otherwise(F.col("value").cast("string")).alias("Value"))
    s = m.groupBy("sensor_id", "day", "pollutant").agg(F.array_sort(F.collect_list(one)).alias("p"))  # one sensor's day
    lists = F.struct(*(F.col(f"p.{c}").alias(c) for c in ("Latitude", "Longitude", "TimeUTC", "Value")))
    s = s.select("sensor_id", "day", "pollutant", F.create_map("sensor_id", lists).alias("m"))
    docs = s.groupBy("sensor_id", "day").agg(F.map_from_entries(F.collect_list(F.struct("pollutant", "m"))).alias("doc"))  # five at most
    raw = docs.select(F.regexp_replace(F.to_json("doc"), '"NaN"', "NaN").alias("raw"))
    return feeds.mobile_points(raw).select("sensor_id", "pollutant", "key", "seq", "ts", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "value", "ci")


@query("""SELECT 'PA_' || c_custkey AS sensor_id, c_name AS name, 40 + c_custkey / 1e4::DOUBLE AS lat, -112 + c_custkey / 1e4::DOUBLE AS lon, c_acctbal AS value FROM customer WHERE c_custkey % 7 <> 0""")
def community_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Community sensors from columnar responses, a row in each here; without a value they are left out."""
    k = F.col("c_custkey")
    value = F.when(k % 7 == 0, "null").otherwise(F.col("c_acctbal").cast("string"))
    data = F.concat_ws(",", k.cast("string"), F.concat(F.lit('"'), "c_name", F.lit('"')), (40 + k / 1e4).cast("string"), (-112 + k / 1e4).cast("string"), value)
    raw = table(spark, sf_dir, "customer").select(F.concat(F.lit('{"fields":["sensor_index","name","latitude","longitude","pm2.5"],"data":[['), data, F.lit("]]}")).alias("raw"))
    return feeds.community(raw).select("sensor_id", "name", "lat", "lon", "value")


_ROADS = f"""{READINGS_SQL}, n AS (SELECT sensor_id, max_by(lat, (ts, reading_id)) AS lat, max_by(lon, (ts, reading_id)) AS lon FROM readings WHERE source = 'fixed' GROUP BY ALL), r AS (SELECT row_number() OVER (ORDER BY sensor_id) AS edge_id, lat AS alat, lon AS alon, lat + 0.01::DOUBLE AS blat, lon + 0.005::DOUBLE AS blon FROM n)"""


@query(f"""{_ROADS}, p AS (SELECT reading_id AS point_id, lat, lon FROM readings WHERE source <> 'fixed'), d AS (SELECT point_id, edge_id, p.lat, p.lon, alat, alon, blat - alat AS dy, blon - alon AS dx, least(greatest(((p.lat - alat) * (blat - alat) + (p.lon - alon) * (blon - alon)) / ((blat - alat) ** 2 + (blon - alon) ** 2), 0), 1) AS t FROM p, r WHERE abs(p.lat - alat) < 0.1 AND abs(p.lon - alon) < 0.1),
 e AS (SELECT point_id, edge_id, alat + t * dy AS slat, alon + t * dx AS slon, {haversine_sql('lat', 'lon', 'alat + t * dy', 'alon + t * dx')} AS m FROM d) SELECT point_id, round(slat, 6) AS lat, round(slon, 6) AS lon, round(m, 3) AS dist_m FROM e WHERE m <= 2000 QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY m, edge_id) = 1""")
def snapped_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points moved to the nearest of many lines within 2 km."""
    r = readings(spark, sf_dir)
    at = F.struct("ts", "reading_id")
    n = r.where("source = 'fixed'").groupBy("sensor_id").agg(F.max_by("lat", at).alias("alat"), F.max_by("lon", at).alias("alon"))
    edges = n.select(F.col("sensor_id").alias("edge_id"), "alat", "alon", (F.col("alat") + 0.01).alias("blat"), (F.col("alon") + 0.005).alias("blon"))
    points = r.where("source <> 'fixed'").select(F.col("reading_id").alias("point_id"), "lat", "lon")
    s = G.nearest_edge(points, edges, 2_000.0, 1_300.0)
    return s.select("point_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("dist_m", 3).alias("dist_m"))


@query(f"""{READINGS_SQL}, m AS (SELECT sensor_id, lat, lon, trunc(lat / 0.00005::DOUBLE)::BIGINT || ':' || trunc(lon / 0.00005::DOUBLE)::BIGINT AS node, ts, reading_id FROM readings WHERE source = 'mobile'),
 s AS (SELECT node AS a, lead(node) OVER w AS b, {haversine_sql('lat', 'lon', 'lead(lat) OVER w', 'lead(lon) OVER w')} AS d FROM m WINDOW w AS (PARTITION BY sensor_id ORDER BY ts, reading_id))
SELECT least(a, b) AS src, greatest(a, b) AS dst, round(min(d), 3) AS dist_m FROM s WHERE b IS NOT NULL AND a <> b AND d >= 20 GROUP BY ALL""")
def path_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between rounded places of the trails, the shortest of each pair."""
    m = readings(spark, sf_dir).where("source = 'mobile'")
    seq = F.row_number().over(Window.partitionBy("sensor_id").orderBy("ts", "reading_id"))
    _, edges = G.paths_to_graph(m.select(F.col("sensor_id").alias("path_id"), seq.alias("seq"), "lat", "lon"), step=5e-5, least_m=20.0)
    return edges.select("src", "dst", F.round("dist_m", 3).alias("dist_m"))


@query()
def snapped_vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trails moved to lines by distance, direction and continuity, 2.5 m to their right (J16, R6). Not in SQL: which line is
    taken depends on the one before; held against a plain version in the tests."""
    r = readings(spark, sf_dir)
    at = F.struct("ts", "reading_id")
    n = r.where("source = 'fixed'").groupBy("sensor_id").agg(F.max_by("lat", at).alias("alat"), F.max_by("lon", at).alias("alon"))
    edges = n.select(F.col("sensor_id").alias("edge_id"), F.concat("sensor_id", F.lit("a")).alias("src"), F.concat("sensor_id", F.lit("b")).alias("dst"), "alat", "alon", (F.col("alat") + 0.01).alias("blat"), (F.col("alon") + 0.005).alias("blon"))
    m = r.where("source = 'mobile'").select("sensor_id", "reading_id", "ts", "lat", "lon")
    return G.snap_directed(m, edges, "sensor_id", radius_m=3_000.0, longest_m=1_300.0, offset_m=2.5)


@query(f"""{READINGS_SQL}, l AS (SELECT sensor_id, key, max_by(value, (ts, reading_id)) AS value, max_by(lat, (ts, reading_id)) AS lat, max_by(lon, (ts, reading_id)) AS lon FROM readings GROUP BY ALL), q AS (SELECT *, {A.aqi_sql('key', 'value')} * (1 - 0.5::DOUBLE * least(1, sqrt((abs(lat - 40.65::DOUBLE) / 0.15::DOUBLE) ** 2 + (abs(lon + 111.95::DOUBLE) / 0.2::DOUBLE) ** 2))) AS score FROM l WHERE lat BETWEEN 40.5 AND 40.8 AND lon BETWEEN -112.15 AND -111.75)
SELECT key, count(*) AS series, round(max(score), 6) AS score, row_number() OVER (ORDER BY max(score) DESC, key) AS place FROM q WHERE score IS NOT NULL GROUP BY key""")
def view_pollutants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pollutant a view should show: its highest index, weighing less towards the view's edges."""
    at = F.struct("ts", "reading_id")
    l = readings(spark, sf_dir).groupBy("sensor_id", "key").agg(F.max_by("value", at).alias("value"), F.max_by("lat", at).alias("lat"), F.max_by("lon", at).alias("lon"))  # noqa: E741
    l = l.where(F.col("lat").between(40.5, 40.8) & F.col("lon").between(-112.15, -111.75))  # noqa: E741
    dy, dx = F.abs(F.col("lat") - 40.65) / 0.15, F.abs(F.col("lon") + 111.95) / 0.2
    score = A.value_to_aqi(F.col("key"), F.col("value")) * (1.0 - 0.5 * F.least(F.lit(1.0), F.sqrt(dy * dy + dx * dx)))
    g = l.withColumn("score", score).where("score IS NOT NULL").groupBy("key").agg(F.count("*").alias("series"), F.round(F.max("score"), 6).alias("score"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "key")).cast("long"))  # five rows
