"""Queries that follow a graph of lines between the places of readings.

The graph joins the places of sensors that stand still to those within 5 km. A vehicle is what is read in a district, in four
shares, by time; so its places are a few kilometres apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import cell, haversine_m, haversine_sql
from ..operators import graph as G
from ..operators import routes as R
from ..operators.spatial import near_pairs
from ..session import stored
from ..sources.readings import READINGS_SQL, readings
from .registry import query

REACH_M, SNAP_M = 5_000.0, 1_500.0


def line_net(r: DataFrame) -> tuple[DataFrame, DataFrame]:
    nodes = stored(r.where("source <> 'mobile'").groupBy("lat", "lon").agg(F.min("sensor_id").alias("node")), "nodes")
    p = near_pairs(nodes, nodes, REACH_M).where("a.node < b.node")
    edges = p.select(F.concat_ws("|", "a.node", "b.node").alias("edge_id"), F.col("a.node").alias("src"), F.col("b.node").alias("dst"), F.round(F.col("dist_m") * 1000).cast("long").alias("dist"), *(F.col(f"{s}.{c}").alias(f"{s}{c}") for s in "ab" for c in ("lat", "lon")))
    return nodes, stored(edges, "edges")


def _trails(r: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readings of vehicles, and those that are near an edge, on it; places are snapped once."""
    vehicle = F.concat_ws(":", cell(F.col("lat"), 0.1).cast("string"), cell(F.col("lon"), 0.1).cast("string"), F.pmod("reading_id", F.lit(4)).cast("string"))
    trail = r.select(vehicle.alias("vehicle"), "reading_id", "ts", "lat", "lon")
    places = stored(trail.groupBy("lat", "lon").agg(F.min("reading_id").alias("point_id")), "places")
    on = G.nearest_edge(places, edges, SNAP_M, REACH_M).join(edges.select("edge_id", "src", "dst"), "edge_id")
    at = places.select("lat", "lon", "point_id").join(on.select("point_id", F.col("lat").alias("on_lat"), F.col("lon").alias("on_lon"), "src", "dst"), "point_id")
    snaps = trail.join(at, ["lat", "lon"]).select("reading_id", F.col("on_lat").alias("lat"), F.col("on_lon").alias("lon"), "src", "dst")
    return trail, stored(snaps, "snaps")


def _pairs(trail: DataFrame, snaps: DataFrame) -> DataFrame:
    o = Window.partitionBy("vehicle").orderBy("ts", "reading_id")
    s = snaps.select("reading_id", F.struct("lat", "lon", "src", "dst").alias("s"))
    before = {f"p{c}": F.lag(c).over(o) for c in ("s", "lat", "lon", "ts")}
    p = trail.join(s, "reading_id", "left").withColumns(before).where("s IS NOT NULL AND ps IS NOT NULL")
    return p.select(F.col("reading_id").alias("pair_id"), F.col("plat").alias("lat0"), F.col("plon").alias("lon0"), F.col("pts").alias("ts0"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), F.col("ts").alias("ts1"), *(F.col(f"ps.{a}").alias(b) for a, b in (("lat", "slat"), ("lon", "slon"), ("src", "sa"), ("dst", "sb"))), *(F.col(f"s.{a}").alias(b) for a, b in (("lat", "elat"), ("lon", "elon"), ("src", "ea"), ("dst", "eb"))))


_DEGREES = REACH_M / 111_000 + 0.001
_ON = "least(greatest(((p.lat - alat) * (blat - alat) + (p.lon - alon) * (blon - alon)) / ((blat - alat) ** 2 + (blon - alon) ** 2), 0), 1)"
#: The graph's nodes and edges (m: metres, dist: millimetres).
NET_SQL = f"""{READINGS_SQL.replace("WITH", "WITH RECURSIVE", 1)}, n AS MATERIALIZED (SELECT min(sensor_id) AS node, lat, lon FROM readings WHERE source <> 'mobile' GROUP BY lat, lon),
 ed AS MATERIALIZED (SELECT * FROM (SELECT a.node AS src, b.node AS dst, a.node || '|' || b.node AS edge_id, {haversine_sql("a.lat", "a.lon", "b.lat", "b.lon")} AS m, round({haversine_sql("a.lat", "a.lon", "b.lat", "b.lon")} * 1000)::BIGINT AS dist, a.lat AS alat, a.lon AS alon, b.lat AS blat, b.lon AS blon FROM n a JOIN n b ON a.node < b.node AND abs(a.lat - b.lat) < {_DEGREES}::DOUBLE) WHERE m <= {REACH_M})"""
#: Vehicles' readings with their place on an edge (null: none) and the pairs of these, up to legs' edges.
_WORLD = f"""{NET_SQL},
 pl AS (SELECT DISTINCT lat, lon FROM readings),
 sn AS MATERIALIZED (SELECT * FROM (SELECT p.lat AS plat, p.lon AS plon, src, dst, edge_id, alat + {_ON} * (blat - alat) AS slat, alon + {_ON} * (blon - alon) AS slon FROM pl p JOIN ed ON p.lat BETWEEN least(alat, blat) - 0.02 AND greatest(alat, blat) + 0.02)
  WHERE {haversine_sql("plat", "plon", "slat", "slon")} <= {SNAP_M} QUALIFY row_number() OVER (PARTITION BY plat, plon ORDER BY {haversine_sql("plat", "plon", "slat", "slon")}, edge_id) = 1),
 tr AS MATERIALIZED (SELECT floor(lat / 0.1::DOUBLE)::BIGINT || ':' || floor(lon / 0.1::DOUBLE)::BIGINT || ':' || reading_id % 4 AS vehicle, reading_id, ts, lat, lon, slat, slon, src, dst FROM readings LEFT JOIN sn ON lat = plat AND lon = plon),
 lg AS (SELECT *, lag(lat) OVER o AS lat0, lag(lon) OVER o AS lon0, lag(ts) OVER o AS ts0, lag(slat) OVER o AS pslat, lag(slon) OVER o AS pslon, lag(src) OVER o AS pa, lag(dst) OVER o AS pb, row_number() OVER o AS place FROM tr WINDOW o AS (PARTITION BY vehicle ORDER BY ts, reading_id)),
 pr AS MATERIALIZED (SELECT reading_id AS pair_id, lat0, lon0, ts0, lat AS lat1, lon AS lon1, ts AS ts1, pslat AS slat, pslon AS slon, pa AS a1, pb AS a2, slat AS elat, slon AS elon, src AS b1, dst AS b2, {haversine_sql("pslat", "pslon", "slat", "slon")} AS direct_m,
  CASE WHEN pa IN (src, dst) THEN pa WHEN pb IN (src, dst) THEN pb END AS shared FROM lg WHERE src IS NOT NULL AND pa IS NOT NULL),
 adj AS MATERIALIZED (SELECT src AS a, dst AS b, dist AS w FROM ed UNION ALL SELECT dst, src, dist FROM ed), dg AS (SELECT a AS node, count(*) AS deg FROM adj GROUP BY a), adj0 AS MATERIALIZED (SELECT a, b, w, false AS own FROM adj UNION ALL SELECT node, node, 0, true FROM dg),
 st AS (SELECT DISTINCT a1, a2 FROM pr WHERE shared IS NULL), le AS MATERIALIZED (SELECT DISTINCT a1, a2, b1, b2 FROM pr WHERE shared IS NULL)"""
#: Shortest ways: 40 relaxations from every edge, then the first goal within 100 ends of edges, then back along the parents.
_SHORTEST = """, rx(a1, a2, node, best, k) AS (SELECT a1, a2, unnest([a1, a2]), {'d': 0::BIGINT, 'pd': 0::BIGINT, 'parent': ''}, 0 FROM st UNION ALL
  SELECT a1, a2, b, min(CASE WHEN own THEN best ELSE {'d': best.d + w, 'pd': best.d, 'parent': node} END), k + 1 FROM rx JOIN adj0 ON node = a WHERE k < 40 GROUP BY a1, a2, b, k),
 sp AS MATERIALIZED (SELECT a1, a2, node, best.d AS d, best.parent AS parent, coalesce(sum(deg) OVER (PARTITION BY a1, a2 ORDER BY best.d, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM rx JOIN dg USING (node) WHERE k = 40),
 gl AS (SELECT a1, a2, b1, b2, node, d FROM le JOIN sp USING (a1, a2) WHERE node IN (b1, b2) QUALIFY row_number() OVER (PARTITION BY a1, a2, b1, b2 ORDER BY d, node) = 1 AND seen < 100),
 bk(a1, a2, b1, b2, d, node, back) AS (SELECT a1, a2, b1, b2, d, node, 0 FROM gl UNION ALL SELECT bk.a1, bk.a2, b1, b2, bk.d, parent, back + 1 FROM bk JOIN sp ON sp.a1 = bk.a1 AND sp.a2 = bk.a2 AND sp.node = bk.node WHERE parent <> ''),
 wy AS MATERIALIZED (SELECT a1, a2, b1, b2, d / 1000::DOUBLE AS path_m, node, lat, lon, row_number() OVER (PARTITION BY a1, a2, b1, b2 ORDER BY back DESC) AS seq FROM bk JOIN n USING (node)),"""
_OFF = "least(greatest(CASE WHEN (elat - slat) ** 2 + (elon - slon) ** 2 < 1e-14 THEN 0 ELSE ((lat - slat) * (elat - slat) + (lon - slon) * (elon - slon)) / ((elat - slat) ** 2 + (elon - slon) ** 2) END, 0), 1)"
#: Nodes of the pairs' ways that pass the checks.
_ROUTES = f"""{_SHORTEST} cn AS (SELECT pair_id, path_m, node, lat, lon, seq, path_m > direct_m * 1.8::DOUBLE AND direct_m > 30 OR {haversine_sql("lat", "lon", f"(slat + {_OFF} * (elat - slat))", f"(slon + {_OFF} * (elon - slon))")} > greatest(150, direct_m * 0.5::DOUBLE) AS bad FROM pr JOIN wy USING (a1, a2, b1, b2) WHERE shared IS NULL),
 rt AS MATERIALIZED (SELECT pair_id, path_m, node, lat, lon, seq FROM cn QUALIFY NOT bool_or(bad) OVER (PARTITION BY pair_id) UNION ALL SELECT pair_id, NULL, node, lat, lon, 1 FROM pr JOIN n ON node = shared WHERE NOT (a1 = b1 AND a2 = b2))"""


@query(f"""{_WORLD}{_ROUTES} SELECT pair_id, round(direct_m, 3) AS direct_m, CASE WHEN a1 = b1 AND a2 = b2 THEN '' ELSE way END AS way, round(path_m, 3) AS path_m FROM pr LEFT JOIN (SELECT pair_id, string_agg(node, ' ' ORDER BY seq) AS way, max(path_m) AS path_m FROM rt GROUP BY pair_id) USING (pair_id)""")
def routed_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest way along the graph between a vehicle's places, within 100 edges, without long detours."""
    r = readings(spark, sf_dir)
    nodes, edges = line_net(r)
    w = R.routes(_pairs(*_trails(r, edges)), nodes, edges, metres=0.001)
    return w.select("pair_id", F.round("direct_m", 3).alias("direct_m"), F.array_join(F.transform("way", lambda n: n["node"]), " ").alias("way"), F.round("path_m", 3).alias("path_m"))


@query(f"""{_WORLD}, rx(a1, a2, node, best, k) AS (SELECT a1, a2, unnest([a1, a2]), {{'d': 0, 'path': [unnest([a1, a2])]}}, 0 FROM st UNION ALL
  SELECT a1, a2, b, min(CASE WHEN own THEN best ELSE {{'d': best.d + 1, 'path': list_append(best.path, b)}} END), k + 1 FROM rx JOIN adj0 ON node = a WHERE k < 30 GROUP BY a1, a2, b, k),
 sp AS (SELECT a1, a2, node, best, coalesce(sum(deg) OVER (PARTITION BY a1, a2 ORDER BY best ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM rx JOIN dg USING (node) WHERE k = 30),
 gl AS (SELECT a1, a2, b1, b2, best.path AS path FROM le JOIN sp USING (a1, a2) WHERE node IN (b1, b2) QUALIFY row_number() OVER (PARTITION BY a1, a2, b1, b2 ORDER BY best) = 1 AND seen < 100),
 q AS (SELECT pr.*, CASE WHEN a1 = b1 AND a2 = b2 THEN [] WHEN shared IS NOT NULL THEN [shared] ELSE coalesce(path, []) END AS way, {haversine_sql("lat0", "lon0", "lat1", "lon1")} AS gps_m FROM pr LEFT JOIN gl USING (a1, a2, b1, b2)),
 x AS (SELECT pair_id, 0 AS seq, slat AS lat, slon AS lon FROM q UNION ALL SELECT pair_id, seq, n.lat, n.lon FROM (SELECT pair_id, unnest(way) AS node, generate_subscripts(way, 1) AS seq FROM q) JOIN n USING (node) UNION ALL SELECT pair_id, 1000, elat, elon FROM q),
 y AS (SELECT *, lag(lat) OVER o AS plat, lag(lon) OVER o AS plon FROM x WINDOW o AS (PARTITION BY pair_id ORDER BY seq)),
 z AS (SELECT pair_id, seq, lat, lon, plat, plon, {haversine_sql("plat", "plon", "lat", "lon")} AS m, gps_m, ts0, ts1 FROM y JOIN q USING (pair_id) WHERE gps_m >= 30 AND ts1 > ts0),
 g AS (SELECT *, floor(m / 25)::INTEGER AS cut FROM z WHERE plat IS NULL OR m > 0 QUALIFY coalesce(sum(m) OVER (PARTITION BY pair_id), 0) <= gps_m * 3),
 d AS (SELECT *, unnest(range(1, coalesce(cut, 0) + 2)) AS k FROM g),
 e AS (SELECT pair_id, ts0, ts1, k = coalesce(cut, 0) + 1 AS ends, CASE WHEN plat IS NULL OR k = cut + 1 THEN lat ELSE plat + (lat - plat) * (k / (cut + 1)::DOUBLE) END AS lat, CASE WHEN plat IS NULL OR k = cut + 1 THEN lon ELSE plon + (lon - plon) * (k / (cut + 1)::DOUBLE) END AS lon, row_number() OVER (PARTITION BY pair_id ORDER BY seq, k) - 1 AS i FROM d),
 f AS (SELECT * FROM e QUALIFY i < 19 OR i = min(CASE WHEN i >= 19 AND ends THEN i END) OVER (PARTITION BY pair_id)),
 h AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY i) - 1 AS seq, count(*) OVER (PARTITION BY pair_id) AS c FROM f)
SELECT pair_id, seq, round(lat, 6) AS lat, round(lon, 6) AS lon, ts0 + to_microseconds(1000 * floor((epoch_us(ts1) / 1e6 - epoch_us(ts0) / 1e6) * (seq / (c - 1)::DOUBLE) * 1000 + 1e-6)::BIGINT) AS ts FROM h WHERE seq > 0""")
def traced_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points along the way with the fewest steps between a vehicle's places, with times."""
    r = readings(spark, sf_dir)
    nodes, edges = line_net(r)
    t = R.traced(_pairs(*_trails(r, edges)), nodes, edges)
    return t.select("pair_id", F.col("seq").cast("long").alias("seq"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "ts")


@query(f"""{_WORLD}{_ROUTES}, x AS (SELECT pair_id, seq, lat, lon FROM rt UNION ALL SELECT pair_id, 0, slat, slon FROM pr UNION ALL SELECT pair_id, 1000, elat, elon FROM pr), s AS (SELECT *, coalesce({haversine_sql("lag(lat) OVER o", "lag(lon) OVER o", "lat", "lon")}, 0) AS m FROM x WHERE pair_id IN (SELECT pair_id FROM rt) WINDOW o AS (PARTITION BY pair_id ORDER BY seq)),
 c AS (SELECT *, sum(m) OVER (PARTITION BY pair_id ORDER BY seq) AS so_far, sum(m) OVER (PARTITION BY pair_id) AS total FROM s)
SELECT vehicle, reading_id, round(c.lat, 6) AS lat, round(c.lon, 6) AS lon, ts0 + to_microseconds(1000 * floor((epoch_us(ts) / 1e6 - epoch_us(ts0) / 1e6) * (so_far / total) * 1000 + 1e-6)::BIGINT) AS ts, seq::INTEGER AS corner, false AS moved FROM c JOIN lg ON pair_id = reading_id WHERE seq BETWEEN 1 AND 999 AND total > 0
UNION ALL SELECT vehicle, reading_id, round(CASE WHEN moved THEN slat ELSE lat END, 6), round(CASE WHEN moved THEN slon ELSE lon END, 6), ts, NULL, moved FROM (SELECT *, src IS NOT NULL AND (place = 1 OR reading_id IN (SELECT pair_id FROM rt)) AS moved FROM lg)""")
def road_trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicles' trails on the graph, with the corners of the shortest ways between their places."""
    r = readings(spark, sf_dir)
    nodes, edges = line_net(r)
    trail, snaps = _trails(r, edges)
    t = R.on_roads(trail, snaps, nodes, edges, "vehicle", metres=0.001)
    return t.select("vehicle", "reading_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "ts", "corner", "moved")
