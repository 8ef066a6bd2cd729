"""Queries over government hours, alerts, moving segments, pages of playback, chunks, deltas and winds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import aqi as A
from ..functions.geo import haversine_sql
from ..functions.time import millis, seconds
from ..operators import government as G
from ..operators import playback as P
from ..operators import probes as R
from ..operators import windows as W
from ..operators.spatial import community_outliers
from ..sources.readings import READINGS_SQL, readings, table
from .registry import query
from .sensor_queries import _LATEST, latest


def _at(t: str):
    return F.lit(t).cast("timestamp_ntz")


_HOURS = f"""{READINGS_SQL}, h AS (SELECT reading_id, CASE WHEN (reading_id // 7) % 3 = 0 THEN '160' ELSE '490' END || lpad(substr(sensor_id, 2), 6, '0') AS site_id, key AS parameter, date_trunc('day', ts) AS hour, ts AS file_ts, value FROM readings WHERE source = 'airnow')"""


def _hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Government rows: a day's rows of one site and parameter stand for one hour that later files correct."""
    r = readings(spark, sf_dir).where("source = 'airnow'")
    state = F.when(F.pmod(F.floor(F.col("reading_id") / 7), F.lit(3)) == 0, "160").otherwise("490")
    return r.select("reading_id", F.concat(state, F.lpad(F.expr("substring(sensor_id, 2)"), 6, "0")).alias("site_id"), F.col("key").alias("parameter"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("hour"), F.col("ts").alias("file_ts"), "value")


@query(f"""{_HOURS}, c AS (SELECT site_id, parameter, hour, max_by(value, (file_ts, reading_id)) AS value, count(*) AS files FROM h WHERE starts_with(site_id, '490') GROUP BY ALL)
SELECT site_id, parameter, hour, value, files, row_number() OVER (PARTITION BY site_id, parameter ORDER BY hour) AS place, {A.color_sql('parameter', 'value')} AS ci, row_number() OVER (PARTITION BY site_id, parameter ORDER BY hour DESC) = 1 AS is_latest FROM c""")
def government_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of each site in the state, where the last file of an hour wins, in their order (A16, P6, T-6)."""
    h = G.corrected_hours(G.in_state(_hours(spark, sf_dir)))
    w = Window.partitionBy("site_id", "parameter")
    return h.select("site_id", "parameter", "hour", "value", "files", F.row_number().over(w.orderBy("hour")).cast("long").alias("place"), A.color_index(F.col("parameter"), F.col("value")).alias("ci"), (F.row_number().over(w.orderBy(F.desc("hour"))) == 1).alias("is_latest"))


_SITES = "sites AS (SELECT '490' || lpad(c_custkey::VARCHAR, 6, '0') AS site_id, c_name AS site_name, c_nationkey AS file FROM customer WHERE c_custkey % 4 = 3)"


@query(f"""{_HOURS}, {_SITES}, k AS (SELECT h.* FROM h WHERE site_id IN (SELECT site_id FROM sites)), l AS (SELECT site_id, parameter, max_by(value, (hour, file_ts, reading_id)) AS latest FROM k GROUP BY ALL),
 o AS (SELECT site_id, parameter, max_by(value, (file_ts, reading_id)) AS old FROM k WHERE hour < TIMESTAMP '2024-01-10' GROUP BY ALL)
SELECT site_id, site_name, parameter, coalesce(old, latest) AS value, old IS NULL AS latest_only FROM l LEFT JOIN o USING (site_id, parameter) JOIN (SELECT site_id, min_by(site_name, file) AS site_name FROM sites GROUP BY ALL) USING (site_id)""")
def government_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of known sites with their names; the latest value where there is no history before a time."""
    c = table(spark, sf_dir, "customer").where("c_custkey % 4 = 3").select(F.concat(F.lit("490"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("site_id"), F.col("c_name").alias("site_name"), F.col("c_nationkey").alias("file"))
    k = G.of_sites(_hours(spark, sf_dir), c)
    last = k.groupBy("site_id", "parameter").agg(F.max_by("value", F.struct("hour", "file_ts", "reading_id")).alias("latest"))
    old = k.where(F.col("hour") < _at("2024-01-10")).groupBy("site_id", "parameter").agg(F.max_by("value", F.struct("file_ts", "reading_id")).alias("old"))
    named = G.first_of_site(c, "site_name", "file")
    return last.join(old, ["site_id", "parameter"], "left").join(named, "site_id").select("site_id", "site_name", "parameter", F.coalesce("old", "latest").alias("value"), F.col("old").isNull().alias("latest_only"))


@query(f"""{READINGS_SQL}, q AS (SELECT *, {A.aqi_sql('key', 'value')} AS aqi FROM readings), b AS (SELECT sensor_id, key, max_by(aqi, (ts, reading_id)) AS aqi FROM q WHERE ts < TIMESTAMP '2024-01-15' GROUP BY ALL), n AS (SELECT sensor_id, key, max_by(aqi, (ts, reading_id)) AS aqi FROM q GROUP BY ALL)
SELECT sensor_id, key, round(n.aqi, 6) AS aqi, {A.level_sql('n.aqi')} AS level, row_number() OVER (ORDER BY n.aqi DESC, sensor_id, key) AS place FROM n ANTI JOIN (SELECT * FROM b WHERE aqi > 100) b USING (sensor_id, key) WHERE n.aqi > 100 ORDER BY n.aqi DESC, sensor_id, key LIMIT 3""")
def new_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three worst series above an index of 100 that weren't so before (W28, Z28: the limit is the feature)."""
    r = readings(spark, sf_dir).withColumn("aqi", A.value_to_aqi(F.col("key"), F.col("value")))
    last = lambda d: d.groupBy("sensor_id", "key").agg(F.max_by("aqi", F.struct("ts", "reading_id")).alias("aqi"))
    top = P.new_alerts(last(r), last(r.where(F.col("ts") < _at("2024-01-15"))), 3)
    place = F.row_number().over(Window.orderBy(F.desc("aqi"), "sensor_id", "key"))  # three rows
    return top.select("sensor_id", "key", F.round("aqi", 6).alias("aqi"), A.aqi_level(F.col("aqi")).alias("level"), place.cast("long").alias("place"))


@query(f"""{READINGS_SQL}, d AS (SELECT sensor_id, ts, reading_id, epoch_us(ts) / 1e6::DOUBLE - lag(epoch_us(ts)) OVER (PARTITION BY sensor_id ORDER BY ts, reading_id) / 1e6::DOUBLE AS s FROM readings),
 n AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY ts DESC, reading_id DESC) AS back, count(*) OVER (PARTITION BY sensor_id) AS c FROM d WHERE s IS NOT NULL)
SELECT sensor_id, count(*) AS intervals, round(least(greatest(sum((1 + 0.5::DOUBLE * (least(c, 10) - back)) * s) / sum(1 + 0.5::DOUBLE * (least(c, 10) - back)), 60), 86400), 3) AS predicted_s FROM n WHERE back <= 10 GROUP BY sensor_id""")
def learned_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval to expect between a sensor's readings: the mean of its last ten, later ones weighing more."""
    return P.learned_interval(readings(spark, sf_dir), "sensor_id").select("sensor_id", "intervals", F.round("predicted_s", 3).alias("predicted_s"))


_MOVING = f"""{READINGS_SQL}, p AS (SELECT *, reading_id % 5 <> 0 AS moving FROM readings WHERE source = 'mobile' AND ts <= TIMESTAMP '2024-01-25'), a AS (SELECT *, row_number() OVER w AS n, sum((NOT moving)::INTEGER) OVER w AS still FROM p WINDOW w AS (PARTITION BY sensor_id ORDER BY ts DESC, reading_id DESC)),
 b AS (SELECT *, min(CASE WHEN moving THEN still END) OVER (PARTITION BY sensor_id) AS first_still FROM a), c AS (SELECT * FROM b WHERE moving AND still = first_still),
 d AS (SELECT *, coalesce({haversine_sql('lat', 'lon', 'lag(lat) OVER w', 'lag(lon) OVER w')}, 0.0::DOUBLE) AS step, row_number() OVER w AS k FROM c WINDOW w AS (PARTITION BY sensor_id ORDER BY n)),
 e AS (SELECT *, sum(step) OVER (PARTITION BY sensor_id ORDER BY n ROWS UNBOUNDED PRECEDING) - step AS before_m FROM d), f AS (SELECT * FROM e WHERE before_m < 60.0 AND k <= 600)"""


@query(f"""{_MOVING}, g AS (SELECT sensor_id, count(*) AS points, sum(step) AS total_m, min(lat) AS south, max(lat) AS north, min(lon) AS west, max(lon) AS east, avg(lat) AS mid_lat, avg(lon) AS mid_lon, min_by(lat, n) AS alat, min_by(lon, n) AS alon, max_by(lat, n) AS blat, max_by(lon, n) AS blon FROM f GROUP BY ALL),
 s AS (SELECT *, {haversine_sql('alat', 'alon', 'blat', 'blon')} AS net FROM g) SELECT sensor_id, points, round(total_m, 3) AS total_m, round(net, 3) AS displacement_m, round(CASE WHEN total_m > 0 THEN net / total_m ELSE 0 END, 6) AS straightness, round(south, 6) AS south, round(north, 6) AS north, round(west, 6) AS west, round(east, 6) AS east,
 round(mid_lat, 6) AS mid_lat, round(mid_lon, 6) AS mid_lon, (points = 2 AND total_m >= 500 AND net >= 500) OR (points >= 3 AND total_m >= 120 AND net >= 60 AND net / total_m >= 0.2) AS counts FROM s""")
def moving_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last moving stretch of each mobile sensor up to a time, cut at 60 m here: its points, lengths, bounds and middle,
    and whether it counts for a view (W24, A25, Z20, Z21)."""
    p = readings(spark, sf_dir).where("source = 'mobile'").where(F.col("ts") <= _at("2024-01-25")).withColumn("moving", F.pmod("reading_id", F.lit(5)) != 0)
    s = P.segment_stats(P.last_moving_segment(p, "sensor_id", most_points=600, most_m=60.0), "sensor_id")
    six = lambda *cs: [F.round(c, 6).alias(c) for c in cs]
    return s.select("sensor_id", "points", F.round("total_m", 3).alias("total_m"), F.round("displacement_m", 3).alias("displacement_m"), *six("straightness", "south", "north", "west", "east", "mid_lat", "mid_lon"), "counts")


@query(f"""{READINGS_SQL}, b AS (SELECT sensor_id, min(epoch_us(ts) // 1000) AS lo, max(epoch_us(ts) // 1000) AS hi FROM readings GROUP BY ALL), c AS (SELECT *, greatest(1, (hi - lo) // 86400000) AS pages FROM b WHERE hi > lo), i AS (SELECT *, least(greatest((epoch_ms(TIMESTAMP '2024-01-20') - lo) // 86400000, 0), pages - 1) AS page, epoch_ms(TIMESTAMP '2024-01-20') AS t FROM c)
SELECT sensor_id, pages::BIGINT AS pages, page::BIGINT AS page, (lo + page * 86400000)::BIGINT AS page_from, (CASE WHEN page = pages - 1 THEN hi ELSE lo + (page + 1) * 86400000 END)::BIGINT AS page_to,
 CASE WHEN t + 43200000 > hi THEN greatest(lo, hi - 86400000) WHEN t - 43200000 < lo THEN lo ELSE t - 43200000 END::BIGINT AS window_from, CASE WHEN t + 43200000 > hi THEN hi WHEN t - 43200000 < lo THEN least(hi, lo + 86400000) ELSE t + 43200000 END::BIGINT AS window_to FROM i""")
def playback_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a day over each sensor's time, the page of a moment, and a window around it."""
    ms = millis(F.col("ts"))
    b = readings(spark, sf_dir).groupBy("sensor_id").agg(F.min(ms).alias("lo"), F.max(ms).alias("hi")).where("hi > lo")
    return P.pages(b, millis(_at("2024-01-20")), 86_400_000)


@query(f"""{READINGS_SQL}, c AS (SELECT sensor_id, time_bucket(INTERVAL 4 HOURS, ts) AS chunk, count(*) AS points, round(min(lat), 6) AS south, round(max(lat), 6) AS north, round(min(lon), 6) AS west, round(max(lon), 6) AS east, round((max(lat) - min(lat)) * (max(lon) - min(lon)) * 1e6::DOUBLE, 6) AS area FROM readings WHERE source = 'mobile' GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY area DESC, chunk) AS priority FROM c QUALIFY priority <= 10""")
def trail_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of four hours of each trail: points, bounds, area; the ten widest (A27, O11, T-11, A31)."""
    c = P.chunks(readings(spark, sf_dir).where("source = 'mobile'"), "sensor_id", hours=4)
    rank = F.row_number().over(Window.partitionBy("sensor_id").orderBy(F.desc("area"), "chunk"))
    return c.withColumn("priority", rank.cast("long")).where("priority <= 10")


@query(f"""{READINGS_SQL}, m AS (SELECT sensor_id, ts, abs(lat - lag(lat) OVER w) > 1e-6::DOUBLE OR abs(lon - lag(lon) OVER w) > 1e-6::DOUBLE AS moved FROM readings WINDOW w AS (PARTITION BY sensor_id ORDER BY ts, reading_id))
SELECT sensor_id, max(ts) AS last_sample, max(CASE WHEN moved THEN ts END) AS last_move, coalesce(max(CASE WHEN moved THEN ts END), max(ts)) AS shown FROM m GROUP BY ALL""")
def last_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each sensor last changed its place, or else its last sample."""
    return P.last_move(readings(spark, sf_dir), "sensor_id")


@query(f"""{READINGS_SQL}, m AS (SELECT * FROM readings WHERE source = 'mobile'), l AS (SELECT sensor_id, max_by(lat, (ts, reading_id)) AS lat, max_by(lon, (ts, reading_id)) AS lon, max(ts) AS head FROM m GROUP BY ALL)
SELECT count(*) AS vehicles, count(*) FILTER (head < TIMESTAMP '2024-01-29') AS ghosted, round(min(lat) FILTER (head >= TIMESTAMP '2024-01-29'), 6) AS south, round(max(lat) FILTER (head >= TIMESTAMP '2024-01-29'), 6) AS north, round(min(lon) FILTER (head >= TIMESTAMP '2024-01-29'), 6) AS west, round(max(lon) FILTER (head >= TIMESTAMP '2024-01-29'), 6) AS east, max(head) AS newest FROM l""")
def head_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of the last places of mobile sensors that aren't ghosts, and the newest time."""
    at = F.struct("ts", "reading_id")
    l = readings(spark, sf_dir).where("source = 'mobile'").groupBy("sensor_id").agg(F.max_by("lat", at).alias("lat"), F.max_by("lon", at).alias("lon"), F.max("ts").alias("head"))  # noqa: E741
    live = F.col("head") >= _at("2024-01-29")
    when = lambda c: F.when(live, F.col(c))
    return l.agg(F.count("*").alias("vehicles"), F.count_if(~live).alias("ghosted"), F.round(F.min(when("lat")), 6).alias("south"), F.round(F.max(when("lat")), 6).alias("north"), F.round(F.min(when("lon")), 6).alias("west"), F.round(F.max(when("lon")), 6).alias("east"), F.max("head").alias("newest"))


@query(f"""{READINGS_SQL}, m AS (SELECT * FROM readings WHERE source = 'mobile'), s AS (SELECT sensor_id, max(ts) AS since FROM m WHERE ts < TIMESTAMP '2024-01-26' GROUP BY ALL), d AS (SELECT m.* FROM m JOIN s USING (sensor_id) WHERE ts > since)
SELECT sensor_id, count(d.reading_id) AS appended, max(d.ts) AS newest, min(d.ts) AS first_new FROM s LEFT JOIN d USING (sensor_id) GROUP BY ALL""")
def trail_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of each trail after the last one that a client has (T-8, Z25, W26)."""
    m = readings(spark, sf_dir).where("source = 'mobile'")
    has = m.where(F.col("ts") < _at("2024-01-26")).groupBy("sensor_id").agg(F.max("ts").alias("since"))
    new = P.since(m, has, "sensor_id").groupBy("sensor_id").agg(F.count("*").alias("n"), F.max("ts").alias("newest"), F.min("ts").alias("first_new"))
    return has.select("sensor_id").join(new, "sensor_id", "left").select("sensor_id", F.coalesce("n", F.lit(0)).alias("appended"), "newest", "first_new")


@query(f"""{READINGS_SQL}, a AS (SELECT sensor_id, max_by(value, (ts, reading_id)) AS value FROM readings WHERE ts < TIMESTAMP '2024-01-25' GROUP BY ALL), b AS (SELECT sensor_id, max_by(value, (ts, reading_id)) AS value FROM readings WHERE ts >= TIMESTAMP '2024-01-29' GROUP BY ALL)
SELECT sensor_id, b.value, a.sensor_id IS NULL AS is_new FROM b LEFT JOIN a USING (sensor_id)""")
def client_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A client's sensors after a delta: those of the delta only, others are dropped (U8)."""
    r = readings(spark, sf_dir)
    last = lambda d: d.groupBy("sensor_id").agg(F.max_by("value", F.struct("ts", "reading_id")).alias("value"))
    return P.replaced(last(r.where(F.col("ts") < _at("2024-01-25"))), last(r.where(F.col("ts") >= _at("2024-01-29"))), "sensor_id")


@query(f"""{READINGS_SQL} SELECT reading_id, trunc(lat * 250)::BIGINT AS cy, trunc(lon * 250)::BIGINT AS cx, ts, value FROM readings WHERE source = 'mobile' QUALIFY row_number() OVER (PARTITION BY trunc(lat * 250), trunc(lon * 250) ORDER BY ts DESC, reading_id DESC) = 1""")
def newest_of_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest point of each cell of 1/250 degree."""
    return P.newest_of_cells(readings(spark, sf_dir).where("source = 'mobile'"), 250.0).select("reading_id", "cy", "cx", "ts", "value")


@query(f"""{READINGS_SQL}, w AS (SELECT reading_id, list(value) OVER x AS win, {A.threshold_sql('key')} AS t FROM readings WINDOW x AS (PARTITION BY sensor_id, pollutant ORDER BY ts, reading_id ROWS 7 PRECEDING)),
 m AS (SELECT *, len(win) AS n, [win[i + 1] - win[i] FOR i IN range(1, len(win))] AS moves FROM w),
 c AS (SELECT *, win[n] - win[1] AS d, win[n] - win[n - 1] AS recent, list_max(win[-3:]) - list_min(win[-3:]) < t * 0.5::DOUBLE AS calm, len([x FOR x IN moves IF x >= greatest(t * 0.2::DOUBLE, 0.1::DOUBLE)]) AS ups, len([x FOR x IN moves IF x <= -greatest(t * 0.2::DOUBLE, 0.1::DOUBLE)]) AS downs FROM m)
SELECT reading_id, CASE WHEN n < 5 OR calm THEN '-' WHEN d > t AND ups > 1 AND recent >= -t * 0.5::DOUBLE THEN '▲' WHEN d < -t AND downs > 1 AND recent <= t * 0.5::DOUBLE THEN '▼' ELSE '-' END AS symbol FROM c""")
def console_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rising or falling by the last 8 samples, and stable if the last 3 are close."""
    return W.console_trend(readings(spark, sf_dir)).select("reading_id", "symbol")


_CLIENTS = "WITH e AS (SELECT user_id AS client_id, epoch(ts::TIMESTAMP) AS t FROM events)"


@query(f"{_CLIENTS}, g AS (SELECT client_id, count(*) AS views FROM e WHERE t >= epoch(TIMESTAMP '2024-01-10 12:00:00') AND t < epoch(TIMESTAMP '2024-01-11 12:00:00') GROUP BY client_id) SELECT *, row_number() OVER (ORDER BY views DESC, client_id) AS place FROM g ORDER BY 3 LIMIT 50")
def viewing_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty clients with most views in a local day from 5 in the morning (A22; the limit is a list's length)."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("client_id"), F.col("ts").cast("timestamp_ntz").alias("ts"))
    top = e.where((F.col("ts") >= _at("2024-01-10 12:00:00")) & (F.col("ts") < _at("2024-01-11 12:00:00"))).groupBy("client_id").agg(F.count("*").alias("views")).orderBy(F.desc("views"), "client_id").limit(50)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("views"), "client_id")).cast("long"))


@query(f"""{READINGS_SQL}, l AS (SELECT sensor_id, lat, lon, value * CASE WHEN substr(sensor_id, 2)::INTEGER % 9 = 2 THEN 9 ELSE 0.5::DOUBLE END AS value FROM readings WHERE pollutant = 'PM25' QUALIFY row_number() OVER (PARTITION BY sensor_id ORDER BY ts DESC, reading_id DESC) = 1),
 p AS (SELECT a.sensor_id, a.value AS own, b.value AS v, b.sensor_id AS other, ((b.lat - a.lat) * 110.57::DOUBLE) ** 2 + ((b.lon - a.lon) * (111.32::DOUBLE * cos(radians(40.7::DOUBLE)))) ** 2 AS d2 FROM l a JOIN l b ON a.sensor_id <> b.sensor_id WHERE a.value >= 500),
 r AS (SELECT sensor_id, CASE WHEN count(*) FILTER (d2 <= 25) >= 3 THEN 25 WHEN count(*) FILTER (d2 <= 100) >= 3 THEN 100 WHEN count(*) FILTER (d2 <= 400) >= 3 THEN 400 WHEN count(*) FILTER (d2 <= 1600) >= 3 THEN 1600 END AS r2 FROM p GROUP BY ALL),
 u AS (SELECT p.*, row_number() OVER (PARTITION BY sensor_id ORDER BY v, other) AS k, count(*) OVER (PARTITION BY sensor_id) AS n FROM p JOIN r USING (sensor_id) WHERE d2 <= r2),
 s AS (SELECT sensor_id, any_value(n) AS n, max(CASE WHEN k = n // 2 + 1 THEN v END) AS med, count(*) FILTER (v >= greatest(15, own / 5)) AS elevated FROM u GROUP BY ALL)
SELECT l.sensor_id, l.value, s.n, s.med, s.elevated, coalesce(value - med >= 30 AND (med < 1 OR value >= 5 * med) AND elevated < 2, false) AS outlier FROM l LEFT JOIN s USING (sensor_id)""")
def community_outlier_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Community values of 500 or more against their neighbours, in a radius that doubles until there are three."""
    l = latest(readings(spark, sf_dir).where("pollutant = 'PM25'"), "sensor_id")  # noqa: E741
    factor = F.when(F.pmod(F.expr("substring(sensor_id, 2)").cast("int"), F.lit(9)) == 2, 9.0).otherwise(0.5)
    return community_outliers(l.select("sensor_id", "lat", "lon", (F.col("value") * factor).alias("value"))).select("sensor_id", "value", "n", "med", "elevated", "outlier")


_WIND = f"""{READINGS_SQL}, f AS (SELECT time_bucket(INTERVAL 6 HOURS, ts) AS slot, trunc((lat - 40.4::DOUBLE) * 10)::BIGINT AS iy, trunc((lon + 112.2::DOUBLE) * 10)::BIGINT AS ix, round(avg(value), 3) AS u, round(avg(-value / 2), 3) AS v FROM readings GROUP BY ALL),
 k AS (SELECT DISTINCT slot FROM f), n AS (SELECT slot, lead(slot) OVER (ORDER BY slot) AS following FROM k),
 q AS (SELECT o_orderkey, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * (o_orderkey % 43200) AS t, (o_orderkey % 5)::BIGINT AS iy, (o_custkey % 5)::BIGINT AS ix FROM orders),
 s AS (SELECT q.*, n.slot, n.following FROM q ASOF JOIN n ON q.t >= n.slot)"""


@query(f"""{_WIND} SELECT o_orderkey, s.slot, a.u AS u0, b.u AS u1, floor(CASE WHEN b.u IS NULL THEN a.u ELSE a.u + (b.u - a.u) * ((epoch_us(t) - epoch_us(s.slot))::DOUBLE / (epoch_us(following) - epoch_us(s.slot))::DOUBLE) END * 1000 + 0.5::DOUBLE) / 1000 AS u,
 floor(CASE WHEN b.v IS NULL THEN a.v ELSE a.v + (b.v - a.v) * ((epoch_us(t) - epoch_us(s.slot))::DOUBLE / (epoch_us(following) - epoch_us(s.slot))::DOUBLE) END * 1000 + 0.5::DOUBLE) / 1000 AS v FROM s LEFT JOIN f a ON a.slot = s.slot AND a.iy = s.iy AND a.ix = s.ix LEFT JOIN f b ON b.slot = s.following AND b.iy = s.iy AND b.ix = s.ix""")
def wind_at_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gridded winds at many times: the last slot at or before, blended with the next one."""
    r = readings(spark, sf_dir)
    slot = F.timestamp_seconds(F.floor(seconds(F.col("ts")) / 21_600) * 21_600).cast("timestamp_ntz")
    f = r.groupBy(slot.alias("slot"), ((F.col("lat") - 40.4) * 10).cast("long").alias("iy"), ((F.col("lon") + 112.2) * 10).cast("long").alias("ix")).agg(F.round(F.avg("value"), 3).alias("u"), F.round(F.avg(-F.col("value") / 2), 3).alias("v"))
    o = table(spark, sf_dir, "orders")
    minute = F.pmod("o_orderkey", F.lit(43_200)).cast("int")
    q = o.select("o_orderkey", (_at("2024-01-01") + F.make_interval(mins=minute)).alias("t"), F.pmod("o_orderkey", F.lit(5)).cast("long").alias("iy"), F.pmod("o_custkey", F.lit(5)).cast("long").alias("ix"))
    return R.blended_fields(q, f, "o_orderkey").select("o_orderkey", "slot", "u0", "u1", "u", "v")


@query(f"""{_WIND}, g AS (SELECT iy, ix, avg(u) AS u FROM f GROUP BY ALL), p AS (SELECT p_partkey, least(greatest(p_partkey % 700 / 100.0::DOUBLE - 1, 0), 3.999::DOUBLE) AS fx, least(greatest(p_partkey % 600 / 100.0::DOUBLE - 1, 0), 3.999::DOUBLE) AS fy FROM part),
 c AS (SELECT *, floor(fx)::BIGINT AS x0, floor(fy)::BIGINT AS y0, fx - floor(fx) AS tx, fy - floor(fy) AS ty FROM p)
SELECT p_partkey, round(a.u * (1 - tx) * (1 - ty) + b.u * tx * (1 - ty) + d.u * (1 - tx) * ty + e.u * tx * ty, 6) AS u FROM c LEFT JOIN g a ON a.iy = y0 AND a.ix = x0 LEFT JOIN g b ON b.iy = y0 AND b.ix = least(x0 + 1, 4) LEFT JOIN g d ON d.iy = least(y0 + 1, 4) AND d.ix = x0 LEFT JOIN g e ON e.iy = least(y0 + 1, 4) AND e.ix = least(x0 + 1, 4)""")
def bilinear_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid's values between its points."""
    r = readings(spark, sf_dir)
    slot = F.timestamp_seconds(F.floor(seconds(F.col("ts")) / 21_600) * 21_600)
    f = r.groupBy(slot.alias("slot"), ((F.col("lat") - 40.4) * 10).cast("long").alias("iy"), ((F.col("lon") + 112.2) * 10).cast("long").alias("ix")).agg(F.round(F.avg("value"), 3).alias("u"))
    g = f.groupBy("iy", "ix").agg(F.avg("u").alias("u"))
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", (F.pmod(k, F.lit(700)) / 100.0 - 1).alias("fx"), (F.pmod(k, F.lit(600)) / 100.0 - 1).alias("fy"))
    return R.bilinear(p, g, 5, 5, "u").select("p_partkey", F.round("u", 6).alias("u"))


_PROBE = f"{READINGS_SQL}, l AS (SELECT sensor_id, max_by(lat, (ts, reading_id)) AS lat, max_by(lon, (ts, reading_id)) AS lon, max_by(value, (ts, reading_id)) AS value FROM readings GROUP BY ALL)"


@query(f"""{_PROBE}, t AS (SELECT round(40.4::DOUBLE + iy * 0.05::DOUBLE, 6) AS south, round(-112.25::DOUBLE + ix * 0.05::DOUBLE, 6) AS west FROM range(12) a(iy), range(11) b(ix))
SELECT south, west, count(l.sensor_id) AS sensors FROM t LEFT JOIN l ON round(40.4::DOUBLE + floor((lat - 40.4::DOUBLE) / 0.05::DOUBLE) * 0.05::DOUBLE, 6) = south AND round(-112.25::DOUBLE + floor((lon + 112.25::DOUBLE) / 0.05::DOUBLE) * 0.05::DOUBLE, 6) = west GROUP BY ALL""")
def discovery_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that tile a box, empty ones too, with the sensors in each (M4)."""
    at = F.struct("ts", "reading_id")
    l = readings(spark, sf_dir).groupBy("sensor_id").agg(F.max_by("lat", at).alias("lat"), F.max_by("lon", at).alias("lon"))  # noqa: E741
    return R.discovery_cells(l, 40.4, 41.0, -112.25, -111.7, 0.05)


@query(f"""{_PROBE}, c AS (SELECT sensor_id AS centre, lat AS clat, lon AS clon FROM l WHERE value >= 80), k AS (SELECT c.*, i, 0.006::DOUBLE + 0.039::DOUBLE * i / 7.0::DOUBLE AS r, 2 * pi() * i / 8 AS a FROM c, range(8) t(i)),
 s AS (SELECT *, clat + r * sin(a) AS tlat, clon + r * cos(a) / cos(radians(clat)) AS tlon FROM k),
 d AS (SELECT centre, i, l.sensor_id, (l.lat - tlat) ** 2 + ((l.lon - tlon) * cos(radians(clat))) ** 2 AS d2 FROM s, l WHERE l.sensor_id <> centre), n AS (SELECT centre, i, sensor_id FROM d QUALIFY row_number() OVER (PARTITION BY centre, i ORDER BY round(d2, 12), sensor_id) = 1)
SELECT centre, sensor_id, count(*) AS rays FROM n GROUP BY ALL""")
def frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sensors to ask next around changed ones: nearest to the tips of eight rays, never the centre."""
    at = F.struct("ts", "reading_id")
    l = readings(spark, sf_dir).groupBy("sensor_id").agg(F.max_by("lat", at).alias("lat"), F.max_by("lon", at).alias("lon"), F.max_by("value", at).alias("value"))  # noqa: E741
    return R.frontier(l.where("value >= 80"), l, spokes=8, r_min=0.006, r_max=0.045)


_KNN = f"{READINGS_SQL}, l AS (SELECT * FROM ({_LATEST}) WHERE pollutant = 'PM25'), cells AS (SELECT iy * 40 + ix AS cell_id, 40.4::DOUBLE + (iy + 0.5::DOUBLE) * 0.02::DOUBLE AS lat, -112.2::DOUBLE + (ix + 0.5::DOUBLE) * 0.02::DOUBLE AS lon FROM range(30) a(iy), range(40) b(ix))"


@query(f"""{_KNN}, p AS (SELECT cell_id, value AS v, sensor_id, {haversine_sql('c.lat', 'c.lon', 'l.lat', 'l.lon')} AS d FROM cells c, l), k AS (SELECT * FROM p WHERE d <= 6000 QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY d, sensor_id) <= 8)
SELECT cell_id, round(sum((1 - d * d / 36e6::DOUBLE) ** 2 / (d * d + 1) * v) / sum((1 - d * d / 36e6::DOUBLE) ** 2 / (d * d + 1)), 5) AS c, round(least(1, 2 * sum(exp(-d * d / 8e6::DOUBLE))), 5) AS fade FROM k GROUP BY ALL HAVING sum((1 - d * d / 36e6::DOUBLE) ** 2 / (d * d + 1)) >= 1e-12::DOUBLE""")
def nearest_eight_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field by the eight nearest sensors of each cell, and how far it fades (V3)."""
    from .sensor_queries import grid_cells

    l = latest(readings(spark, sf_dir).where("pollutant = 'PM25'"), "sensor_id").select("sensor_id", "lat", "lon", "value")  # noqa: E741
    return R.nearest_field(grid_cells(spark), l, 6000.0, k=8, two_sigma_sq=8e6).select("cell_id", F.round("c", 5).alias("c"), F.round("fade", 5).alias("fade"))


@query(f"""{READINGS_SQL}, l AS ({_LATEST}), q AS (SELECT *, CASE WHEN key IN ('pm2.5', 'pm10') THEN 'pm' ELSE key END AS grp, {A.aqi_sql('key', 'value')} AS aqi FROM l), s AS (SELECT sensor_id, grp, any_value(lat) AS lat, any_value(lon) AS lon, max(aqi) AS aqi FROM (SELECT sensor_id, grp, aqi, max_by(lat, (ts, reading_id)) OVER (PARTITION BY sensor_id) AS lat, max_by(lon, (ts, reading_id)) OVER (PARTITION BY sensor_id) AS lon FROM q) WHERE aqi IS NOT NULL GROUP BY ALL),
 cells AS (SELECT iy * 40 + ix AS cell_id, 40.4::DOUBLE + (iy + 0.5::DOUBLE) * 0.02::DOUBLE AS lat, -112.2::DOUBLE + (ix + 0.5::DOUBLE) * 0.02::DOUBLE AS lon FROM range(30) a(iy), range(40) b(ix)),
 p AS (SELECT cell_id, grp, aqi, exp(-0.5::DOUBLE * ({haversine_sql('c.lat', 'c.lon', 's.lat', 's.lon')} / 2500.0::DOUBLE) ** 2) AS w, {haversine_sql('c.lat', 'c.lon', 's.lat', 's.lon')} AS d FROM cells c, s), f AS (SELECT cell_id, grp, sum(w * aqi) / sum(w) AS aqi, sum(w) AS w FROM p WHERE d <= 7500 GROUP BY ALL HAVING sum(w) >= 0.001::DOUBLE)
SELECT cell_id, round(max(aqi), 5) AS aqi, count(*) AS groups, round(max(max(aqi)) OVER (), 5) AS field_max FROM f GROUP BY ALL""")
def worst_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest index of the fields of particles and gases in each cell, and over the view."""
    from .sensor_queries import grid_cells

    l = latest(readings(spark, sf_dir), "sensor_id", "pollutant").withColumn("aqi", A.value_to_aqi(F.col("key"), F.col("value")))  # noqa: E741
    at = l.groupBy("sensor_id").agg(F.max_by(F.struct("lat", "lon"), F.struct("ts", "reading_id")).alias("at"))
    group = F.when(F.col("key").isin("pm2.5", "pm10"), "pm").otherwise(F.col("key"))
    s = l.where("aqi IS NOT NULL").groupBy("sensor_id", group.alias("grp")).agg(F.max("aqi").alias("aqi")).join(at, "sensor_id").select("sensor_id", "grp", "at.lat", "at.lon", "aqi")
    f = R.worst_field(grid_cells(spark), s, 2500.0)
    most = f.agg(F.round(F.max("aqi"), 5).alias("field_max"))  # one row
    return f.join(F.broadcast(most)).select("cell_id", F.round("aqi", 5).alias("aqi"), "groups", "field_max")
