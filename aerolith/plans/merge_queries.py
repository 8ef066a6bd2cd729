"""Queries over merged feeds, series cleaned of jumps, strings, grids and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.aqi import is_plausible, within_sql
from ..functions.geo import haversine_m, haversine_sql
from ..operators import graph as G
from ..operators import merge as M
from ..operators.spatial import near_pairs
from ..schema import PLAUSIBLE
from ..sources.readings import READINGS_SQL, readings, table
from .registry import query
from .sensor_queries import latest

_LATEST = "SELECT * FROM readings QUALIFY row_number() OVER (PARTITION BY sensor_id, pollutant ORDER BY ts DESC, reading_id DESC) = 1"


@query(f"""{READINGS_SQL}, s AS (SELECT DISTINCT sensor_id, source FROM readings), n AS (SELECT 'S' || c_custkey AS sensor_id, CASE WHEN c_custkey % 3 = 0 THEN '  ' ELSE c_name END AS custom FROM customer),
 p AS (SELECT DISTINCT 'S' || s_suppkey AS sensor_id FROM supplier WHERE s_suppkey % 5 = 0)
SELECT s.sensor_id, source, coalesce(nullif(trim(custom), ''), upper(source) || ' ' || s.sensor_id) AS name, p.sensor_id IS NOT NULL AS pinned FROM s LEFT JOIN n USING (sensor_id) LEFT JOIN p ON p.sensor_id = s.sensor_id""")
def named_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensors with custom names and pins."""
    s = readings(spark, sf_dir).select("sensor_id", "source").distinct().withColumn("name", F.concat(F.upper("source"), F.lit(" "), F.col("sensor_id")))
    key = F.col("c_custkey")
    names = table(spark, sf_dir, "customer").select(F.concat(F.lit("S"), key.cast("string")).alias("sensor_id"), F.when(F.pmod(key, F.lit(3)) == 0, "  ").otherwise(F.col("c_name")).alias("custom"))
    pinned = table(spark, sf_dir, "supplier").where("s_suppkey % 5 = 0").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("sensor_id"))
    return M.with_names(s, names, pinned).select("sensor_id", "source", "name", "pinned")


@query(f"""{READINGS_SQL}, l AS ({_LATEST}), k AS (SELECT *, round(floor(lat * 20::DOUBLE) / 20, 3) AS py, round(floor(lon * 20::DOUBLE) / 20, 3) AS px FROM l), own AS (SELECT py, px, max(sensor_id) AS target FROM k WHERE source = 'fixed' GROUP BY ALL),
 placed AS (SELECT coalesce(target, i.sensor_id) AS sensor_id, key, CASE WHEN target IS NULL THEN 'added' ELSE 'merged' END AS origin, min_by(value, i.sensor_id) AS value FROM (SELECT * FROM k WHERE source = 'airnow') i LEFT JOIN own USING (py, px) GROUP BY ALL)
SELECT sensor_id, key, value, 'own' AS origin FROM k WHERE source = 'fixed' UNION ALL SELECT sensor_id, key, value, origin FROM placed WHERE NOT EXISTS (SELECT 1 FROM k WHERE source = 'fixed' AND k.sensor_id = placed.sensor_id AND k.key = placed.key)""")
def merged_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Government readings merged into fixed sensors at the same place."""
    l = latest(readings(spark, sf_dir), "sensor_id", "pollutant").select("sensor_id", "source", "lat", "lon", "key", "value")  # noqa: E741
    l = l.withColumns({"lat": F.floor(F.col("lat") * 20) / 20, "lon": F.floor(F.col("lon") * 20) / 20})  # so that some share a place
    return M.merge_by_place(l.where("source = 'fixed'"), l.where("source = 'airnow'"))


@query(f"""{READINGS_SQL}, c AS (SELECT sensor_id, max_by(value, (ts, reading_id)) AS value, max(ts) AS ts FROM readings WHERE source = 'purpleair' AND ts < TIMESTAMP '2024-01-06' GROUP BY ALL),
 f AS (SELECT sensor_id, max_by(value, (ts, reading_id)) AS value, max(ts) AS ts FROM readings WHERE source = 'purpleair' AND ts >= TIMESTAMP '2024-01-28' GROUP BY ALL)
SELECT coalesce(c.sensor_id, f.sensor_id) AS sensor_id, CASE WHEN f.sensor_id IS NULL THEN c.value ELSE f.value END AS value, CASE WHEN f.sensor_id IS NULL THEN c.ts ELSE f.ts END AS ts,
 CASE WHEN c.sensor_id IS NULL THEN 'new' WHEN f.sensor_id IS NULL THEN 'kept' ELSE 'updated' END AS state FROM c FULL JOIN f ON c.sensor_id = f.sensor_id""")
def upserted_community(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached community sensors with what was fetched later."""
    r = readings(spark, sf_dir).where("source = 'purpleair'")
    last = lambda d: d.groupBy("sensor_id").agg(F.max_by("value", F.struct("ts", "reading_id")).alias("value"), F.max("ts").alias("ts"))
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    return M.upserted(last(r.where(F.col("ts") < at("2024-01-06"))), last(r.where(F.col("ts") >= at("2024-01-28"))), "sensor_id", ["value", "ts"])


@query(f"""{READINGS_SQL} SELECT sensor_id, max(ts) AS last_seen, count(*) AS readings FROM readings WHERE source <> 'mobile' AND sensor_id NOT IN (SELECT sensor_id FROM readings WHERE ts >= TIMESTAMP '2024-01-29') GROUP BY ALL""")
def offline_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensors with a history that aren't live (J17, U4, T-14)."""
    r = readings(spark, sf_dir)
    gone = M.offline(r.where("source <> 'mobile'"), r.where(F.col("ts") >= F.lit("2024-01-29").cast("timestamp_ntz")))
    return r.join(gone, "sensor_id", "left_semi").groupBy("sensor_id").agg(F.max("ts").alias("last_seen"), F.count("*").alias("readings"))


@query("""WITH e AS (SELECT user_id, event_type AS key, ts, event_id, (props::JSON ->> 'k') AS value FROM events), a AS (SELECT user_id, key, max_by(value, (ts, event_id)) AS old FROM e WHERE ts < TIMESTAMP '2024-01-15' GROUP BY ALL),
 b AS (SELECT user_id, key, max_by(value, (ts, event_id)) AS new FROM e WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY ALL) SELECT user_id, key, old, new FROM a FULL JOIN b USING (user_id, key) WHERE old IS DISTINCT FROM new""")
def preference_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys whose last value changed from one period to the next, out of JSON."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("key"), F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", F.get_json_object("props", "$.k").alias("value"))
    last = lambda d: d.groupBy("user_id", "key").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    return M.map_changes(last(e.where(F.col("ts") < cut)), last(e.where(F.col("ts") >= cut)), "user_id").select("user_id", "key", "old", "new")


@query(f"""{READINGS_SQL}, v AS (SELECT *, value * CASE WHEN reading_id % 7 = 0 THEN 40 ELSE 1 END AS v FROM readings WHERE key = 'pm2.5'),
 e AS (SELECT *, lag(v) OVER w AS p FROM v WINDOW w AS (PARTITION BY sensor_id, key ORDER BY ts, reading_id)),
 f AS (SELECT *, CASE WHEN p IS NOT NULL AND greatest(v, p) / greatest(least(v, p), 0.1::DOUBLE) >= 8 AND greatest(v, p) >= 500 THEN (v > p)::INTEGER WHEN v < 500 THEN 0 END AS event FROM e),
 g AS (SELECT *, coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY sensor_id, key ORDER BY ts, reading_id ROWS UNBOUNDED PRECEDING), 0) = 1 AS flag FROM f)
SELECT reading_id, sensor_id, v AS value, flag, NOT flag AND {within_sql('key', 'v', PLAUSIBLE)} AS kept FROM g""")
def history_without_cliffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values on the high side of impossible jumps, and what is left of a history."""
    r = readings(spark, sf_dir).where("key = 'pm2.5'").withColumn("value", F.col("value") * F.when(F.pmod("reading_id", F.lit(7)) == 0, 40).otherwise(1))
    f = M.cliff_flags(r)
    return f.select("reading_id", "sensor_id", "value", "flag", (~F.col("flag") & is_plausible(F.col("key"), F.col("value"))).alias("kept"))


@query(f"""{READINGS_SQL}, r AS (SELECT *, ts AS recorded_at, time_bucket(INTERVAL 1 HOUR, ts) AS hour, floor(value / 50) AS band FROM readings), a AS (SELECT *, row_number() OVER (PARTITION BY sensor_id, key, hour ORDER BY recorded_at, reading_id) = 1 AS first_in,
 row_number() OVER w > 1 AND band IS NOT DISTINCT FROM lag(band) OVER w AND hour IS NOT DISTINCT FROM lag(hour) OVER w AS same FROM r WINDOW w AS (PARTITION BY sensor_id, key ORDER BY recorded_at, reading_id))
SELECT reading_id, sensor_id, key, hour, band FROM a WHERE CASE WHEN source = 'airnow' THEN first_in ELSE NOT same END""")
def accepted_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly readings that a history takes in (W19, T-7)."""
    r = readings(spark, sf_dir).withColumns({"recorded_at": F.col("ts"), "ts": F.date_trunc("hour", "ts").cast("timestamp_ntz"), "value": F.floor(F.col("value") / 50).cast("double")})
    return M.accepted_history(r).select("reading_id", "sensor_id", "key", F.col("ts").alias("hour"), F.col("value").alias("band"))


@query(f"""{READINGS_SQL}, s AS (SELECT sensor_id, any_value(source) AS source, max(ts) AS last, max_by(lat, (ts, reading_id)) AS lat, max_by(lon, (ts, reading_id)) AS lon FROM readings GROUP BY sensor_id), t AS (SELECT *, last < TIMESTAMP '2024-01-29' AS ghosted, length(sensor_id) = 2 AS pinned FROM s)
SELECT sensor_id, row_number() OVER (ORDER BY ghosted DESC, pinned DESC, sensor_id) AS by_state, row_number() OVER (ORDER BY CASE WHEN pinned THEN 0 WHEN source = 'mobile' AND NOT ghosted THEN 1 WHEN source = 'mobile' THEN 3 ELSE 2 END, lower(sensor_id)) AS by_tier,
 row_number() OVER (ORDER BY lat DESC NULLS LAST, sensor_id) AS by_north, row_number() OVER (ORDER BY round({haversine_sql('lat', 'lon', '40.7608::DOUBLE', '(-111.891)::DOUBLE')}, 3), sensor_id) AS by_distance FROM t""")
def sensor_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the sensors in the lists' orders (O2-O6); a list holds one row for each sensor."""
    s = readings(spark, sf_dir).groupBy("sensor_id").agg(F.any_value("source").alias("source"), F.max("ts").alias("last"), F.max_by("lat", F.struct("ts", "reading_id")).alias("lat"), F.max_by("lon", F.struct("ts", "reading_id")).alias("lon"))
    s = s.withColumns({"ghosted": F.col("last") < F.lit("2024-01-29").cast("timestamp_ntz"), "pinned": F.length("sensor_id") == 2})
    tier = F.when(F.col("pinned"), 0).when((F.col("source") == "mobile") & ~F.col("ghosted"), 1).when(F.col("source") == "mobile", 3).otherwise(2)
    far = F.round(haversine_m(F.col("lat"), F.col("lon"), F.lit(40.7608), F.lit(-111.891)), 3)
    n = lambda *by: F.row_number().over(Window.orderBy(*by)).cast("long")
    return s.select("sensor_id", n(F.desc("ghosted"), F.desc("pinned"), "sensor_id").alias("by_state"), n(tier, F.lower("sensor_id")).alias("by_tier"), n(F.desc_nulls_last("lat"), "sensor_id").alias("by_north"), n(far, "sensor_id").alias("by_distance"))


@query(f"SELECT page_id, length({X.sanitised_sql('html')}) AS n_chars, {X.sanitised_sql('html')} AS clean FROM pages")
def sanitised_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings cut and freed of what must not be stored."""
    clean = X.sanitised(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(clean).cast("long").alias("n_chars"), clean.alias("clean"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal >= 100 THEN lpad(printf('%.0f', round(c_acctbal, 0)), greatest(5, length(printf('%.0f', round(c_acctbal, 0))))::INTEGER, ' ') WHEN c_acctbal >= 10 THEN lpad(printf('%.1f', round(c_acctbal, 1)), greatest(5, length(printf('%.1f', round(c_acctbal, 1))))::INTEGER, ' ')
 ELSE lpad(printf('%.2f', c_acctbal), greatest(5, length(printf('%.2f', c_acctbal)))::INTEGER, ' ') END AS shown, CASE WHEN length(c_name || ' of ' || c_mktsegment) > 25 THEN left(c_name || ' of ' || c_mktsegment, 24) || '…' ELSE c_name || ' of ' || c_mktsegment END AS name,
 sha256('salt' || c_name) AS visitor, regexp_replace(left(regexp_replace(c_name, '[^A-Za-z0-9-]', '', 'g'), 20), '', '') AS safe FROM customer""")
def displayed_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and names as lists show them, hashed and safe names."""
    full = F.concat(F.col("c_name"), F.lit(" of "), F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", X.display_value(F.col("c_acctbal")).alias("shown"), X.short_name(full).alias("name"), X.visitor_hash(F.col("c_name"), "salt").alias("visitor"), X.safe_date(F.col("c_name")).alias("safe"))


@query(f"""{READINGS_SQL} SELECT trunc((lat - 40.4::DOUBLE) * 50::DOUBLE)::BIGINT AS iy, trunc((lon + 112.2::DOUBLE) * 50::DOUBLE)::BIGINT AS ix, round(avg(value), 3) AS u, count(*) AS n FROM readings WHERE (lat - 40.4::DOUBLE) * 50::DOUBLE > -1 AND (lon + 112.2::DOUBLE) * 50::DOUBLE > -1 GROUP BY ALL""")
def binned_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by grid cell, rounded towards the box's corner (A19, V1's first step)."""
    y, x = (F.col("lat") - 40.4) * 50.0, (F.col("lon") + 112.2) * 50.0
    return readings(spark, sf_dir).where((y > -1) & (x > -1)).groupBy(y.cast("long").alias("iy"), x.cast("long").alias("ix")).agg(F.round(F.avg("value"), 3).alias("u"), F.count("*").alias("n"))


_SENSORS = f"{READINGS_SQL}, s AS (SELECT sensor_id, max_by(lat, (ts, reading_id)) AS lat, max_by(lon, (ts, reading_id)) AS lon FROM readings GROUP BY ALL)"


def _sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings(spark, sf_dir).groupBy("sensor_id").agg(F.max_by("lat", F.struct("ts", "reading_id")).alias("lat"), F.max_by("lon", F.struct("ts", "reading_id")).alias("lon"))


@query(_SENSORS.replace("WITH ", "WITH RECURSIVE ", 1) + f""", e AS (SELECT a.sensor_id AS a, b.sensor_id AS b FROM s a, s b WHERE {haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 2500),
 c(node, root) AS (SELECT sensor_id, sensor_id FROM s UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.node) SELECT node, min(root) AS component FROM c GROUP BY ALL""")
def sensor_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of sensors that are within 2.5 km of each other."""
    return G.near_groups(_sensors(spark, sf_dir).withColumnRenamed("sensor_id", "node"), 2500.0)


@query(_SENSORS + f""", o AS (SELECT o_orderkey AS point_id, 40.4::DOUBLE + (o_custkey % 500)::DOUBLE / 1e3::DOUBLE AS lat, -112.2::DOUBLE + (o_orderkey % 500)::DOUBLE / 1e3::DOUBLE AS lon FROM orders),
 d AS (SELECT point_id, sensor_id, {haversine_sql('o.lat', 'o.lon', 's.lat', 's.lon')} AS d FROM o, s)
SELECT point_id, sensor_id AS node, round(d, 3) AS dist_m FROM d WHERE d <= 3000 QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY d, sensor_id) = 1""")
def nearest_sensor_of_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest sensor of many places."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("point_id"), (F.lit(40.4) + F.pmod("o_custkey", F.lit(500)) / 1e3).alias("lat"), (F.lit(-112.2) + F.pmod("o_orderkey", F.lit(500)) / 1e3).alias("lon"))
    return G.nearest_node(o, _sensors(spark, sf_dir).withColumnRenamed("sensor_id", "node"), 3000.0).select("point_id", "node", F.round("dist_m", 3).alias("dist_m"))


@query("""SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1997-03-01' AND o_orderdate < TIMESTAMP '1997-04-01'""")
def archived_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one calendar month, end excluded."""
    from ..operators.store import month_of

    o = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))
    return month_of(o, 1997, 3, "o_orderdate").select("o_orderkey", "o_custkey", "o_orderdate")


@query()
def clean_trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mobile sensors' trails, by local day, without repeats, spikes and parked ends (W6-W10). Not in SQL: what is kept
    depends on what was kept before; held against a plain version in the tests."""
    from ..functions.time import day_5am
    from ..operators.trails import clean_trails as run

    r = readings(spark, sf_dir).where("source = 'mobile'").select("sensor_id", day_5am(F.col("ts")).cast("string").alias("day"), "reading_id", "ts", "lat", "lon", "value")
    return run(r, "sensor_id", "day")


@query()
def mobility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each mobile sensor stands still (W12). Not in SQL, as above."""
    from ..functions.time import day_5am
    from ..operators.trails import mobility as run

    r = readings(spark, sf_dir).where("source = 'mobile'").select("sensor_id", day_5am(F.col("ts")).cast("string").alias("day"), "reading_id", "ts", "lat", "lon")
    return run(r, "sensor_id", "day")


@query()
def committed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings that change the band by enough since the last committed one (W20). Not in SQL, as above."""
    from ..functions.aqi import color_index
    from ..operators.trails import committed_changes as run

    r = readings(spark, sf_dir).where("source = 'purpleair'").select("sensor_id", "key", "reading_id", "ts", "value", color_index(F.col("key"), F.col("value")).alias("ci"))
    return run(r, "sensor_id", "key")
