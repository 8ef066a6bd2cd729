"""Queries that clean the graph of places that stand still (see route_queries); elevations are made from the sensor's number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import haversine_sql
from ..operators import line_graph as L
from ..sources.readings import readings
from .registry import query
from .route_queries import NET_SQL, line_net

_ADJ = f"{NET_SQL}, adj AS (SELECT src AS a, dst AS b, dist / 1000::DOUBLE AS m FROM ed UNION ALL SELECT dst, src, dist / 1000::DOUBLE FROM ed)"


def _net(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes, edges = line_net(readings(spark, sf_dir))
    number = F.substring("node", 2, 18).cast("long")
    return nodes.select("node", "lat", "lon", (F.pmod(number * 7, F.lit(60))).cast("double").alias("elev")), edges.select("src", "dst", (F.col("dist") / 1000.0).alias("dist_m"))


def _shown(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", F.round("dist_m", 3).alias("dist_m"))


@query(f"""{_ADJ}, rr(src, dst, pos, k) AS (SELECT src, dst, src, 0 FROM ed WHERE dist > 3000000 AND dist <= 4500000 UNION SELECT rr.src, rr.dst, b, k + 1 FROM rr JOIN adj ON pos = a WHERE k < 4 AND NOT (least(a, b) = rr.src AND greatest(a, b) = rr.dst))
SELECT src, dst, round(dist / 1000::DOUBLE, 3) AS dist_m FROM ed WHERE dist <= 4500000 AND NOT EXISTS (SELECT 1 FROM rr WHERE rr.src = ed.src AND rr.dst = ed.dst AND pos = ed.dst)""")
def edges_without_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges, but for those over 4.5 km, and those over 3 km between places that four other edges join."""
    return _shown(L.without_long_edges(_net(spark, sf_dir)[1], most_m=3_000.0, force_m=4_500.0, hops=4))


@query(f"""{_ADJ} SELECT src, dst, round(dist / 1000::DOUBLE, 3) AS dist_m FROM ed WHERE NOT EXISTS (SELECT 1 FROM adj x JOIN adj y ON x.b = y.a WHERE x.a = src AND y.b = dst AND x.b <> dst AND x.m + y.m < dist / 1000::DOUBLE * 1.5::DOUBLE)""")
def edges_without_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges, but for those that two others replace at 1.5 times the length."""
    return _shown(L.without_skip_edges(_net(spark, sf_dir)[1]))


@query()
def edges_of_uncrowded_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges when nodes have kept the two most opposite and one more (R12). Not in SQL: a node's edges depend on what the
    nodes before it have left; held against a plain loop in the tests."""
    return _shown(L.pruned_crowded_nodes(*_net(spark, sf_dir)))


@query(f"""{_ADJ}, e AS (SELECT *, (substr(node, 2)::BIGINT * 7 % 60)::DOUBLE AS elev FROM n), near AS (SELECT a.node AS a, b.node AS b FROM e a JOIN e b ON a.node <> b.node AND (abs(a.elev - b.elev) < 20 OR a.elev = 0 OR b.elev = 0) WHERE {haversine_sql("a.lat", "a.lon", "b.lat", "b.lon")} < 3000),
 rr(node, r) AS (SELECT node, node FROM n UNION SELECT rr.node, b FROM rr JOIN near ON r = a), c AS (SELECT node, min(r) AS c FROM rr GROUP BY node), mid AS (SELECT c, avg(lat) AS lat, avg(lon) AS lon FROM c JOIN n USING (node) GROUP BY c),
 mv AS (SELECT DISTINCT least(x.c, y.c) AS src, greatest(x.c, y.c) AS dst FROM ed JOIN c x ON x.node = src JOIN c y ON y.node = dst WHERE x.c <> y.c)
SELECT src, dst, round({haversine_sql("a.lat", "a.lon", "b.lat", "b.lon")}, 3) AS dist_m FROM mv JOIN mid a ON a.c = src JOIN mid b ON b.c = dst""")
def edges_of_merged_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges when places nearer than 3 km, and alike in elevation, have become one in their middle."""
    return _shown(L.collapsed_parallel_nodes(*_net(spark, sf_dir), radius_m=3_000.0)[1])


@query(f"""{NET_SQL}, own AS (SELECT src AS a, dst AS b FROM ed WHERE dist <= 2500000 UNION ALL SELECT dst, src FROM ed WHERE dist <= 2500000), rr(node, r) AS (SELECT node, node FROM n UNION SELECT rr.node, b FROM rr JOIN own ON r = a), c AS MATERIALIZED (SELECT node, min(r) AS c FROM rr GROUP BY node),
 p AS (SELECT a.node AS src, b.node AS dst, {haversine_sql("a.lat", "a.lon", "b.lat", "b.lon")} AS m FROM n a JOIN n b ON a.node < b.node), q AS MATERIALIZED (SELECT src, dst, m, x.c AS ca, y.c AS cb FROM p JOIN c x ON x.node = src JOIN c y ON y.node = dst WHERE m < 7000 AND x.c <> y.c QUALIFY row_number() OVER (PARTITION BY least(x.c, y.c), greatest(x.c, y.c) ORDER BY m, src, dst) = 1),
 s AS MATERIALIZED (SELECT ca, cb, m FROM q UNION ALL SELECT cb, ca, m FROM q UNION ALL SELECT DISTINCT c, c, 0.0::DOUBLE FROM c),
 mm(a, b, m, k) AS (SELECT DISTINCT c, c, 0.0::DOUBLE, 0 FROM c UNION ALL SELECT mm.a, s.cb, min(greatest(mm.m, s.m)), k + 1 FROM mm JOIN s ON s.ca = mm.b WHERE k < 80 GROUP BY mm.a, s.cb, k)
SELECT src, dst, round(dist / 1000::DOUBLE, 3) AS dist_m FROM ed WHERE dist <= 2500000 UNION ALL SELECT src, dst, round(q.m, 3) FROM q JOIN mm ON a = ca AND b = cb AND k = 80 AND mm.m >= q.m""")
def edges_between_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of 2.5 km at most, and the shortest below 7 km that join what they leave apart."""
    nodes, edges = _net(spark, sf_dir)
    return _shown(L.bridged_components(nodes, edges.where("dist_m <= 2500"), radius_m=7_000.0))
