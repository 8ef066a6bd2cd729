"""Queries over lines, corridors, aligned series, logs and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import aqi as A
from ..functions import display as D
from ..functions import text as X
from ..functions.geo import haversine_m, haversine_sql
from ..functions.time import seconds
from ..operators import lines as L
from ..operators import logs as O
from ..operators import probes as R
from ..operators import windows as W
from ..schema import FIELD_TOPS
from ..sources.readings import READINGS_SQL, readings, table
from .registry import query
from .sensor_queries import _CELLS, _LAST, grid_cells, latest

_MOBILE = f"{READINGS_SQL}, m AS (SELECT * FROM readings WHERE source = 'mobile')"


def _mobile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings(spark, sf_dir).where("source = 'mobile'")


@query(f"""{_MOBILE}, s AS (SELECT sensor_id, ts, reading_id, lat, lon, lag(lat) OVER w AS alat, lag(lon) OVER w AS alon FROM m WINDOW w AS (PARTITION BY sensor_id ORDER BY ts, reading_id)), d AS (SELECT *, {haversine_sql('alat', 'alon', 'lat', 'lon')} AS d FROM s),
 n AS (SELECT *, CASE WHEN alat IS NULL THEN 0 ELSE floor(d / 20.0::DOUBLE)::INTEGER END AS n FROM d WHERE alat IS NULL OR d > 0), k AS (SELECT *, unnest(range(1, n + 2)) AS k FROM n),
 p AS (SELECT sensor_id, ts, reading_id, k, CASE WHEN alat IS NULL OR k > n THEN lat ELSE alat + (lat - alat) * (k / (n + 1)::DOUBLE) END AS lat, CASE WHEN alat IS NULL OR k > n THEN lon ELSE alon + (lon - alon) * (k / (n + 1)::DOUBLE) END AS lon FROM k)
SELECT sensor_id, row_number() OVER (PARTITION BY sensor_id ORDER BY ts, reading_id, k) AS place, round(lat, 7) AS lat, round(lon, 7) AS lon FROM p QUALIFY place <= 1000""")
def densified_trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trails with a point every 20 m, 1,000 at most (G11; the limit is the operator's)."""
    p = L.densified(_mobile(spark, sf_dir), "sensor_id", spacing_m=20.0, most=1000)
    return p.select("sensor_id", F.col("place").cast("long").alias("place"), F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))


@query()
def simplified_trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the trails that are needed to stay within 30 m of them (G10). Recursive; held against brute force in tests."""
    return L.simplified(_mobile(spark, sf_dir).select("sensor_id", "reading_id", "ts", "lat", "lon"), "sensor_id", epsilon_m=30.0)


@query(f"""{_MOBILE}, s AS (SELECT *, coalesce({haversine_sql('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')}, 0.0::DOUBLE) AS step, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM m WINDOW w AS (PARTITION BY sensor_id ORDER BY ts, reading_id)),
 t AS (SELECT *, sum(step) OVER (PARTITION BY sensor_id ORDER BY ts, reading_id ROWS UNBOUNDED PRECEDING) AS travel, atan2(sin(radians(lon - plon)) * cos(radians(lat)), cos(radians(plat)) * sin(radians(lat)) - sin(radians(plat)) * cos(radians(lat)) * cos(radians(lon - plon))) AS b FROM s),
 g AS (SELECT sensor_id, floor(travel / 500)::BIGINT AS bin, count(*) AS n, avg(lat) AS lat, avg(lon) AS lon, sum(CASE WHEN step > 0 THEN sin(b) END) AS s, sum(CASE WHEN step > 0 THEN cos(b) END) AS c FROM t GROUP BY ALL)
SELECT sensor_id, bin, n, round(lat, 9) AS lat, round(lon, 9) AS lon, CASE WHEN sqrt(s * s + c * c) > 0.01 THEN round((degrees(atan2(s, c)) + 720) % 360, 3) END AS bearing, count(*) OVER (PARTITION BY sensor_id) AS bins, sum(n) OVER (PARTITION BY sensor_id)::BIGINT AS points FROM g""")
def trail_corridors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean places and directions along the trails by stretches of 500 m, and counts of each corridor."""
    c = L.corridors(_mobile(spark, sf_dir), "sensor_id", bin_m=500.0)
    s = L.stats(c, "n", "sensor_id").select("sensor_id", F.col("n").alias("bins"), F.col("total").alias("points"))
    return c.join(s, "sensor_id").select("sensor_id", "bin", "n", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), F.when(F.col("strength") > 0.01, F.round("bearing", 3)).alias("bearing"), "bins", "points")


@query(f"""{_MOBILE}, q AS (SELECT o_orderkey AS probe_id, 'S' || (o_custkey % 38 * 4) AS sensor_id, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * (o_orderkey % 43200) AS ts FROM orders),
 o AS (SELECT *, lead(ts) OVER w AS nts, lead(lat) OVER w AS nlat, lead(lon) OVER w AS nlon FROM m WINDOW w AS (PARTITION BY sensor_id ORDER BY ts, reading_id)), f AS (SELECT sensor_id, min(ts) AS ts, min_by(lat, (ts, reading_id)) AS lat, min_by(lon, (ts, reading_id)) AS lon FROM m GROUP BY ALL),
 j AS (SELECT q.*, o.ts AS bts, o.lat AS blat, o.lon AS blon, nts, nlat, nlon FROM q ASOF LEFT JOIN o ON q.sensor_id = o.sensor_id AND q.ts >= o.ts)
SELECT probe_id, sensor_id, round(CASE WHEN bts IS NULL THEN f.lat WHEN nts IS NULL THEN blat ELSE blat + (nlat - blat) * ((epoch_us(j.ts) - epoch_us(bts))::DOUBLE / (epoch_us(nts) - epoch_us(bts))) END, 7) AS lat, round(CASE WHEN bts IS NULL THEN f.lon WHEN nts IS NULL THEN blon ELSE blon + (nlon - blon) * ((epoch_us(j.ts) - epoch_us(bts))::DOUBLE / (epoch_us(nts) - epoch_us(bts))) END, 7) AS lon FROM j LEFT JOIN f USING (sensor_id)""")
def places_at_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where mobile sensors were at many times, between their points."""
    o = table(spark, sf_dir, "orders")
    q = o.select(F.col("o_orderkey").alias("probe_id"), F.concat(F.lit("S"), (F.pmod("o_custkey", F.lit(38)) * 4).cast("string")).alias("sensor_id"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_interval(mins=F.pmod("o_orderkey", F.lit(43_200)).cast("int"))).alias("ts"))
    return L.along(_mobile(spark, sf_dir), q, "sensor_id").select("probe_id", "sensor_id", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))


@query(f"""{READINGS_SQL}, h AS (SELECT date_trunc('hour', ts) AS hour, key, round(avg(value), 6) AS v FROM readings GROUP BY ALL) SELECT hour, a.v AS lat_v, b.v AS lon_v, c.v AS elev FROM (SELECT * FROM h WHERE key = 'pm2.5') a JOIN (SELECT * FROM h WHERE key = 'pm10') b USING (hour) LEFT JOIN (SELECT * FROM h WHERE key = 'co') c USING (hour)""")
def aligned_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three series at the times that the first two share."""
    h = readings(spark, sf_dir).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "key").agg(F.round(F.avg("value"), 6).alias("v"))
    of = lambda k, name: h.where(F.col("key") == k).select("hour", F.col("v").alias(name))
    return L.aligned({"lat_v": of("pm2.5", "lat_v"), "lon_v": of("pm10", "lon_v"), "elev": of("co", "elev")}, ("elev",), "hour").select("hour", "lat_v", "lon_v", "elev")


@query()
def filled_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily grids of means whose empty cells are filled from their neighbours (V1). Stepwise; held against a plain queue in
    the tests."""
    r = readings(spark, sf_dir)
    iy, ix = ((F.col("lat") - 40.4) * 20.0).cast("int").alias("iy"), ((F.col("lon") + 112.2) * 20.0).cast("int").alias("ix")
    g = r.groupBy(F.to_date("ts").alias("day"), iy, ix).agg(F.round(F.avg("value"), 3).alias("u")).where("iy BETWEEN 0 AND 9 AND ix BETWEEN 0 AND 9")
    return L.flood_filled(g, 10, 10, "day", "u")


@query(f"""{_LAST}, {_CELLS}, p AS (SELECT cell_id, value AS u, -value / 2 AS v, (c.lat - l.lat) ** 2 + (c.lon - l.lon) ** 2 AS d2 FROM cells c, l) SELECT cell_id, round(sum(u / (d2 + 0.001::DOUBLE)) / sum(1 / (d2 + 0.001::DOUBLE)), 5) AS u, round(sum(v / (d2 + 0.001::DOUBLE)) / sum(1 / (d2 + 0.001::DOUBLE)), 5) AS v FROM p WHERE d2 <= 0.04 GROUP BY ALL""")
def wind_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winds of stations on the cells of a grid, within 0.2 degrees here."""
    l = latest(readings(spark, sf_dir).where("pollutant = 'PM25'"), "sensor_id").select("lat", "lon", F.col("value").alias("u"), (-F.col("value") / 2).alias("v"))  # noqa: E741
    return L.wind_on_cells(grid_cells(spark), l, 0.2).select("cell_id", F.round("u", 5).alias("u"), F.round("v", 5).alias("v"))


@query(f"""{READINGS_SQL}, c AS (SELECT *, {D.category_sql('value', FIELD_TOPS)} AS cat FROM readings WHERE key = 'pm2.5'), d AS (SELECT *, CASE WHEN cat IS DISTINCT FROM lag(cat) OVER w THEN 1 ELSE 0 END AS new FROM c WINDOW w AS (PARTITION BY sensor_id ORDER BY ts, reading_id)),
 e AS (SELECT *, sum(new) OVER (PARTITION BY sensor_id ORDER BY ts, reading_id ROWS UNBOUNDED PRECEDING) AS island FROM d), i AS (SELECT sensor_id, island, any_value(cat) AS cat, min(ts) AS since FROM e GROUP BY ALL), n AS (SELECT *, lead(since) OVER (PARTITION BY sensor_id ORDER BY island) AS until, row_number() OVER (PARTITION BY sensor_id ORDER BY island) AS k FROM i)
SELECT sensor_id, cat, CASE WHEN k > 1 THEN since END AS from_ts, until AS to_ts FROM n WHERE (since <= TIMESTAMP '2024-01-15' OR k = 1) AND (until IS NULL OR until > TIMESTAMP '2024-01-15')""")
def stable_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long before and after a moment each sensor's category holds; open at the ends of its series."""
    c = readings(spark, sf_dir).where("key = 'pm2.5'").withColumn("cat", D.category(F.col("value"), FIELD_TOPS))
    return W.stable_ranges(c, "cat", F.lit("2024-01-15").cast("timestamp_ntz"), "sensor_id")


@query(f"""{READINGS_SQL} SELECT reading_id, count(*) OVER w AS n, round(avg(value) OVER w, 6) AS mean, round(max(value) OVER w - min(value) OVER w, 6) AS spread FROM readings WINDOW w AS (PARTITION BY sensor_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW)""")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, mean and spread of the last six hours before each reading (T-13)."""
    us = (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)"))
    w = Window.partitionBy("sensor_id").orderBy(us).rangeBetween(-6 * 3600 * 1_000_000, 0)
    return readings(spark, sf_dir).select("reading_id", F.count("*").over(w).alias("n"), F.round(F.avg("value").over(w), 6).alias("mean"), F.round(F.max("value").over(w) - F.min("value").over(w), 6).alias("spread"))


@query(f"""{READINGS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY sensor_id, key ORDER BY ts DESC, reading_id DESC) AS back, count(*) OVER (PARTITION BY sensor_id, key) AS history_count FROM readings)
SELECT sensor_id, key, max(CASE WHEN back = 1 THEN value END) AS value, any_value(history_count) AS history_count, string_agg(printf('%.3f', value), ' ' ORDER BY back DESC) AS history_tail, CASE WHEN key = 'ozone' THEN 'ppb' ELSE 'µg/m³' END AS unit, CASE WHEN any_value(source) = 'mobile' THEN 'MOBILE' ELSE 'FIXED' END AS type FROM n WHERE back <= 5 GROUP BY sensor_id, key""")
def json_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the view of a sensor shows of each series: value, count, the last five."""
    w = Window.partitionBy("sensor_id", "key")
    n = readings(spark, sf_dir).withColumns({"back": F.row_number().over(w.orderBy(F.desc("ts"), F.desc("reading_id"))), "history_count": F.count("*").over(w)}).where("back <= 5")
    tail = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("b"), "value"))), lambda x: X.fixed(x["value"], 3)), " ")  # five at most
    return n.groupBy("sensor_id", "key").agg(F.max(F.when(F.col("back") == 1, F.col("value"))).alias("value"), F.first("history_count").alias("history_count"), tail.alias("history_tail"), F.when(F.col("key") == "ozone", "ppb").otherwise("µg/m³").alias("unit"), F.when(F.first("source") == "mobile", "MOBILE").otherwise("FIXED").alias("type"))


_LOG = "WITH e AS (SELECT event_id, user_id, ts::TIMESTAMP AS ts, CASE event_type WHEN 'click' THEN 'map_state' WHEN 'view' THEN 'app.view' WHEN 'purchase' THEN 'map_state.__cfgv' ELSE event_type END AS key, (props::JSON ->> 'k') AS value FROM events)"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("event_type") == "click", "map_state").when(F.col("event_type") == "view", "app.view").when(F.col("event_type") == "purchase", "map_state.__cfgv").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), name.alias("key"), F.get_json_object("props", "$.k").alias("value"))


@query(_LOG + """, k AS (SELECT * FROM e WHERE (starts_with(key, 'map_') OR starts_with(key, 'app.')) AND NOT ends_with(key, '.__cfgv')), t AS (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS place FROM k QUALIFY place <= 500)
SELECT event_id, place, key, value, '  localStorage.setItem("' || key || '", "' || value || '");' AS script FROM t""")
def prefs_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 500 entries of stored preferences, with a line of script each (P16, O9, K10, K12, Z16: the limit is the
    feature)."""
    t = O.tail(O.own_prefs(_log(spark, sf_dir), ("map_", "app.")), 500)
    return t.select("event_id", "place", "key", "value", O.script_line(F.col("key"), F.col("value")).alias("script"))


@query(_LOG + """, b AS (SELECT *, time_bucket(INTERVAL 14 DAYS, ts, TIMESTAMP '1970-01-01') AS part, strlen(key) + coalesce(strlen(value), 0) AS size FROM e), c AS (SELECT *, row_number() OVER (PARTITION BY user_id, part ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id, part) AS total, sum(size) OVER (PARTITION BY user_id, part) AS bytes FROM b)
SELECT user_id, part, count(*) AS taken, any_value(total) AS offered, min(event_id) AS first_id, sum(size)::BIGINT AS taken_bytes FROM c WHERE n <= 50 AND bytes <= 65536 GROUP BY ALL""")
def analytics_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each request, a client's 14 days here, of which 50 are taken, and none if they have over 64 KiB."""
    part = F.timestamp_seconds(F.floor(seconds(F.col("ts")) / 1_209_600) * 1_209_600).cast("timestamp_ntz")
    e = _log(spark, sf_dir).withColumns({"part": part, "size": F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))})
    taken = O.capped_batches(e, 50, "user_id", "part", size="size", most_bytes=65_536).groupBy("user_id", "part")
    return taken.agg(F.count("*").alias("taken"), F.first("offered").alias("offered"), F.min("event_id").alias("first_id"), F.sum("size").alias("taken_bytes"))


@query("""WITH f AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS name FROM orders), d AS (SELECT DISTINCT strftime(l_shipdate, '%Y-%m-%d') AS name FROM lineitem)
SELECT name, 'file' AS origin, substr(sha1('https://host/' || name), 1, 12) AS cache FROM f UNION ALL SELECT name, 'table', substr(sha1('https://host/' || name), 1, 12) FROM d WHERE name NOT IN (SELECT name FROM f)""")
def snapshot_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots that are files, and those that only the table has, with the names of their cached copies."""
    f = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("name"))
    d = table(spark, sf_dir, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("name"))
    return O.snapshot_list(f, d).withColumn("cache", O.cache_name(F.concat(F.lit("https://host/"), F.col("name"))))


@query(f"""{READINGS_SQL}, l AS (SELECT sensor_id, any_value(source) AS source, max_by(lat, (ts, reading_id)) AS lat, max_by(lon, (ts, reading_id)) AS lon, max(ts) AS seen FROM readings GROUP BY ALL), k AS (SELECT *, seen < TIMESTAMP '2024-01-29' AS ghosted FROM l WHERE source <> 'purpleair' AND sensor_id <> 'S7' AND (source = 'mobile' OR lat BETWEEN 40.4 AND 41.0 AND lon BETWEEN -112.25 AND -111.8))
SELECT sensor_id, source, ghosted, printf('%-6s %.3f %.3f', sensor_id, lat, lon) AS line FROM k""")
def listed_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensors that the list shows: not community ones, not the home sensor (here S7), fixed ones in the box only, with a
    line of text each (Z27, Z30, P15)."""
    at = F.struct("ts", "reading_id")
    l = readings(spark, sf_dir).groupBy("sensor_id").agg(F.any_value("source").alias("source"), F.max_by("lat", at).alias("lat"), F.max_by("lon", at).alias("lon"), F.max("ts").alias("seen"))  # noqa: E741
    inside = F.col("lat").between(40.4, 41.0) & F.col("lon").between(-112.25, -111.8)
    k = l.where((F.col("source") != "purpleair") & (F.col("sensor_id") != "S7") & ((F.col("source") == "mobile") | inside))
    return k.select("sensor_id", "source", (F.col("seen") < F.lit("2024-01-29").cast("timestamp_ntz")).alias("ghosted"), F.format_string("%-6s %s %s", "sensor_id", X.fixed(F.col("lat"), 3), X.fixed(F.col("lon"), 3)).alias("line"))


@query(f"""{_MOBILE}, t AS (SELECT sensor_id, count(*) AS points, min(ts) AS lo, max(ts) AS hi, {haversine_sql('min(lat)', 'min(lon)', 'max(lat)', 'max(lon)')} AS box_m FROM m GROUP BY ALL), f AS (SELECT min(ts) AS lo, max(ts) AS hi FROM readings WHERE source = 'fixed')
SELECT sensor_id, points, round(box_m, 3) AS box_m, (SELECT least(min(lo), (SELECT lo FROM f)) FROM t WHERE points >= 2 AND box_m >= 50) AS from_ts, (SELECT greatest(max(hi), (SELECT hi FROM f)) FROM t WHERE points >= 2 AND box_m >= 50) AS to_ts FROM t WHERE points >= 2 AND box_m >= 50""")
def playback_trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trails to play, of two points and 50 m at least, and the time from the first to the last of them or of fixed
    sensors' history (Z23)."""
    t = _mobile(spark, sf_dir).groupBy("sensor_id").agg(F.count("*").alias("points"), F.min("ts").alias("lo"), F.max("ts").alias("hi"), haversine_m(F.min("lat"), F.min("lon"), F.max("lat"), F.max("lon")).alias("box_m")).where("points >= 2 AND box_m >= 50")
    f = readings(spark, sf_dir).where("source = 'fixed'").select(F.col("ts").alias("lo"), F.col("ts").alias("hi"))
    span = t.select("lo", "hi").unionByName(f).agg(F.min("lo").alias("from_ts"), F.max("hi").alias("to_ts"))  # one row
    return t.crossJoin(F.broadcast(span)).select("sensor_id", "points", F.round("box_m", 3).alias("box_m"), "from_ts", "to_ts")


@query(f"""{READINGS_SQL}, l AS (SELECT sensor_id, max_by(lat, (ts, reading_id)) AS lat, max_by(lon, (ts, reading_id)) AS lon FROM readings GROUP BY ALL), c AS (SELECT list_sort(list(lat))[count(*) // 2 + 1] AS mlat, list_sort(list(lon))[count(*) // 2 + 1] AS mlon FROM l), d AS (SELECT l.*, {haversine_sql('lat', 'lon', 'mlat', 'mlon')} AS d, mlat, mlon FROM l, c)
SELECT any_value(mlat) AS mid_lat, any_value(mlon) AS mid_lon, count(*) AS inliers, round(min(lat), 6) AS south, round(max(lat), 6) AS north, round(min(lon), 6) AS west, round(max(lon), 6) AS east FROM d WHERE d <= 8000""")
def robust_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of the sensors within 8 km of the upper medians of their places."""
    at = F.struct("ts", "reading_id")
    l = readings(spark, sf_dir).groupBy("sensor_id").agg(F.max_by("lat", at).alias("lat"), F.max_by("lon", at).alias("lon"))  # noqa: E741
    return O.robust_bounds(l, 8_000.0)


@query(f"""{_LAST} SELECT sensor_id, lat, lon, value FROM l QUALIFY row_number() OVER (PARTITION BY trunc(lat / 0.05::DOUBLE), trunc(lon / 0.05::DOUBLE) ORDER BY md5(sensor_id || '-3'), sensor_id) = 1""")
def probed_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sensor of each cell, as chance has it for a seed."""
    l = latest(readings(spark, sf_dir).where("pollutant = 'PM25'"), "sensor_id").select("sensor_id", "lat", "lon", "value")  # noqa: E741
    return R.probe(l, 3)


@query(f"""{READINGS_SQL} SELECT key, a AS aqi, round({A.aqi_to_value_sql('key', 'a')} * CASE WHEN key = 'ozone' THEN 1000.0::DOUBLE ELSE 1 END, 6) AS shown FROM (SELECT DISTINCT key FROM readings), (SELECT range::DOUBLE AS a FROM range(0, 520, 13))""")
def legend_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concentrations of the legend for indexes."""
    a = spark.range(0, 520, 13).select(F.col("id").cast("double").alias("aqi"))
    keys = readings(spark, sf_dir).select("key").distinct()  # five
    return keys.crossJoin(F.broadcast(a)).select("key", "aqi", F.round(D.legend_value(F.col("key"), F.col("aqi")), 6).alias("shown"))


