"""Queries on corridors: what a mobile sensor has passed in a week is a path, its points directed by the point before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import bearing_deg, haversine_sql
from ..functions.time import seconds
from ..operators import corridors as C
from ..session import stored
from ..sources.readings import READINGS_SQL, readings
from .registry import query


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    week = F.floor(seconds(F.col("ts")) / 604_800)
    m = readings(spark, sf_dir).where("source = 'mobile'").withColumns({"chunk": week, "path": F.concat_ws(":", "sensor_id", week.cast("string"))})
    w = Window.partitionBy("path").orderBy("ts", "reading_id")
    course = bearing_deg(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    rows = m.select("path", "chunk", F.row_number().over(w).alias("seq"), "lat", "lon", F.lit(0.0).alias("elev"), course.alias("course"))
    return stored(rows.where("course IS NOT NULL"), "paths")


_AXIAL = "least(abs(x.course - y.course) % 180, 180 - abs(x.course - y.course) % 180)"
_COURSE = "(degrees(atan2(sin(radians(lon - plon)) * cos(radians(lat)), cos(radians(plat)) * sin(radians(lat)) - sin(radians(plat)) * cos(radians(lat)) * cos(radians(lon - plon)))) + 360) % 360"
#: Paths' points, their corridors: one path after the other, with the list of leaders so far.
_CORRIDORS = f"""{READINGS_SQL.replace("WITH", "WITH RECURSIVE", 1)}, g AS (SELECT *, sensor_id || ':' || floor(epoch_us(ts) / 1e6 / 604800)::BIGINT AS path FROM readings WHERE source = 'mobile'), h AS (SELECT path, ts, reading_id, lat, lon, lag(lat) OVER o AS plat, lag(lon) OVER o AS plon FROM g WINDOW o AS (PARTITION BY path ORDER BY ts, reading_id)),
 pt AS MATERIALIZED (SELECT path, lat, lon, {_COURSE} AS course, row_number() OVER (PARTITION BY path ORDER BY ts, reading_id) - 1 AS i, count(*) OVER (PARTITION BY path) AS n FROM h WHERE plat IS NOT NULL),
 md AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY path) AS k FROM pt WHERE n >= 3 AND i = n // 2),
 nr AS MATERIALIZED (SELECT x.k AS a, y.k AS b, {haversine_sql("x.lat", "x.lon", "y.lat", "y.lon")} AS m FROM md x JOIN md y ON x.k < y.k AND abs(x.lat - y.lat) < 0.001 AND {_AXIAL} <= 45 WHERE m <= 40),
 ms AS MATERIALIZED (SELECT k, list(a) FILTER (a IS NOT NULL) AS found FROM md LEFT JOIN nr ON b = k GROUP BY k),
 rec(k, led) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT ms.k, CASE WHEN list_has_any(coalesce(found, []), led) THEN led ELSE list_append(led, ms.k) END FROM rec JOIN ms ON ms.k = rec.k + 1),
 ld AS MATERIALIZED (SELECT unnest(led) AS k FROM (SELECT led FROM rec ORDER BY k DESC LIMIT 1)),
 cr AS MATERIALIZED (SELECT x.path, coalesce(y.path, x.path) AS corridor FROM md x LEFT JOIN (SELECT b, a FROM nr JOIN ld ON a = ld.k QUALIFY row_number() OVER (PARTITION BY b ORDER BY m, a) = 1) f ON f.b = x.k LEFT JOIN md y ON y.k = f.a)"""
_CENTRES = f"""{_CORRIDORS}, cp AS MATERIALIZED (SELECT corridor, lat, lon, course FROM pt JOIN cr USING (path)),
 ct AS MATERIALIZED (SELECT corridor, avg(lat) AS lat, avg(lon) AS lon, count(*) AS n, (degrees(atan2(sum(sin(radians(course * 2))), sum(cos(radians(course * 2))))) / 2 + 180) % 180 AS course FROM cp GROUP BY corridor)"""


@query(f"""{_CORRIDORS} SELECT path, corridor FROM cr""")
def path_corridors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which path leads the corridor that a path is in."""
    return C.corridors(_paths(spark, sf_dir))


@query(f"""{_CENTRES}, rk AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY n DESC, corridor) AS k FROM ct), nm AS MATERIALIZED (SELECT x.k AS a, y.k AS b FROM rk x JOIN rk y ON x.k < y.k AND abs(x.lat - y.lat) < 0.001 AND {_AXIAL} <= 30 WHERE {haversine_sql("x.lat", "x.lon", "y.lat", "y.lon")} <= 60),
 mm AS MATERIALIZED (SELECT k, list(a) FILTER (a IS NOT NULL) AS found FROM rk LEFT JOIN nm ON b = k GROUP BY k),
 re2(k, led) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT mm.k, CASE WHEN list_has_any(coalesce(found, []), led) THEN led ELSE list_append(led, mm.k) END FROM re2 JOIN mm ON mm.k = re2.k + 1),
 l2 AS (SELECT unnest(led) AS k FROM (SELECT led FROM re2 ORDER BY k DESC LIMIT 1))
SELECT x.corridor, coalesce(y.corridor, x.corridor) AS merged, x.n AS points, round(x.course, 3) AS axis FROM rk x LEFT JOIN (SELECT b, min(a) AS a FROM nm JOIN l2 ON a = l2.k GROUP BY b) f ON f.b = x.k LEFT JOIN rk y ON y.k = f.a""")
def merged_corridors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corridors with their points and axis, and the larger one that takes them in."""
    paths = _paths(spark, sf_dir)
    points = stored(paths.join(C.corridors(paths), "path"), "points")
    return C.merged(points).join(C.centres(points), "corridor").select("corridor", "merged", F.col("n").alias("points"), F.round("course", 3).alias("axis"))


@query(f"""{_CENTRES}, al AS (SELECT cp.corridor, cp.lat, cp.lon, (cp.lat - ct.lat) * cos(radians(ct.course)) + (cp.lon - ct.lon) * sin(radians(ct.course)) AS along FROM cp JOIN ct USING (corridor)), en AS (SELECT *, min(along) OVER c AS low, max(along) OVER c AS high FROM al WINDOW c AS (PARTITION BY corridor)),
 bn AS (SELECT corridor, CASE WHEN high - low < 15 / 111000::DOUBLE THEN 0 ELSE floor((along - low) / (15 / 111000::DOUBLE)) END AS bin, avg(lat) AS lat, avg(lon) AS lon FROM en GROUP BY ALL), ln AS (SELECT {haversine_sql("lag(lat) OVER o", "lag(lon) OVER o", "lat", "lon")} AS m FROM bn WINDOW o AS (PARTITION BY corridor ORDER BY bin)), t AS (SELECT coalesce(sum(m), 0) AS m FROM ln),
 pa AS (SELECT {haversine_sql("x.lat", "x.lon", "y.lat", "y.lon")} AS m, abs(round(x.course * 100) % 18000 - round(y.course * 100) % 18000) AS gap FROM ct x JOIN ct y ON x.corridor < y.corridor),
 se AS (SELECT count(*) FILTER (m < 50) AS near, count(*) AS checks FROM pa WHERE least(gap, 18000 - gap) < 2000)
SELECT (SELECT count(*) FROM ct) AS corridors, (SELECT sum(n)::BIGINT FROM ct) AS points, round(m, 3) AS length_m, round(CASE WHEN m > 10500 THEN 7000 / m ELSE least(1, m / 7000) END, 6) AS coverage, round(1 - near / greatest(1, checks)::DOUBLE, 6) AS separation FROM t, se""")
def corridor_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of 7 km the corridors' centre lines cover, and how many parallel ones keep apart."""
    paths = _paths(spark, sf_dir)
    q = C.quality(paths.join(C.corridors(paths), "path"), expected_m=7_000.0)
    return q.select("corridors", "points", F.round("length_m", 3).alias("length_m"), F.round("coverage", 6).alias("coverage"), F.round("separation", 6).alias("separation"))


@query()
def corridors_by_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corridors built week by week, until their quality suffices (R13). Not in SQL: the rounds depend on what they find; held
    against a plain loop in the tests."""
    paths = _paths(spark, sf_dir)
    weeks = [r[0] for r in paths.select("chunk").distinct().orderBy("chunk").collect()]  # weeks of the table
    points, _ = C.built(paths, weeks, min_coverage=0.9, expected_m=7_000.0)
    return points.groupBy("corridor").agg(F.count("*").alias("points"), F.countDistinct("path").alias("paths"))
