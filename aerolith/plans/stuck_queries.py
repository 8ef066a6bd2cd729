"""Query on sensors that stand still: readings are put in classes of 100, as the table's values never repeat."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stuck import standing_since, stuck_sensors
from ..sources.readings import READINGS_SQL, readings
from .registry import query

_KM = (110.57, 111.32 * math.cos(math.radians(40.7)))
_D2 = f"((y.lat - x.lat) * {_KM[0]}::DOUBLE) ** 2 + ((y.lon - x.lon) * {_KM[1]}::DOUBLE) ** 2"


@query(f"""{READINGS_SQL.replace("WITH", "WITH RECURSIVE", 1)}, c AS (SELECT *, floor(value / 100) AS v, lag(floor(value / 100)) OVER o AS p, row_number() OVER o AS i FROM readings WINDOW o AS (PARTITION BY sensor_id ORDER BY ts, reading_id)),
 t AS (SELECT sensor_id, max_by(lat, i) AS lat, max_by(lon, i) AS lon, max_by(value, i) AS value, max(ts) FILTER (v IS DISTINCT FROM p OR i = 1) AS since, max(ts) AS last_ts, count(*) AS n FROM c GROUP BY sensor_id),
 s AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY sensor_id) AS k, n >= 2 AND last_ts - since >= INTERVAL 1 HOUR AS cand FROM t),
 nb AS MATERIALIZED (SELECT x.k, y.k AS o, x.value AS own, y.value AS v, list_position([{_D2} <= r * r FOR r IN [5, 10, 20, 40]], true) AS ring FROM s x JOIN s y ON x.k <> y.k AND x.cand WHERE {_D2} <= 1600),
 nl AS MATERIALIZED (SELECT s.k, s.cand, coalesce(own, 0) AS own, list({{'o': o, 'v': v, 'ring': ring}}) FILTER (o IS NOT NULL) AS ns FROM s LEFT JOIN nb USING (k) GROUP BY ALL),
 rec(k, gone) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT k, CASE WHEN cand AND len(w) >= 3 AND own - med >= 10 AND (med < 1 OR own >= 1.2::DOUBLE * med) AND len(list_filter(w, lambda z: z >= greatest(15, own / 1.5::DOUBLE))) < 3 THEN list_append(gone, k) ELSE gone END
  FROM (SELECT *, list_sort(w)[len(w) // 2 + 1] AS med FROM (SELECT k, cand, own, gone, [z.v FOR z IN live IF z.ring <= first] AS w FROM (SELECT *, list_min([r FOR r IN [1, 2, 3, 4] IF len(list_filter(live, lambda z: z.ring <= r)) >= 3]) AS first
   FROM (SELECT nl.k, nl.cand, nl.own, rec.gone, [z FOR z IN coalesce(nl.ns, []) IF NOT list_contains(rec.gone, z.o)] AS live FROM rec JOIN nl ON nl.k = rec.k + 1)))))
SELECT sensor_id, since AS stuck, round(value, 3) AS value FROM s WHERE k IN (SELECT unnest(gone) FROM (SELECT gone FROM rec ORDER BY k DESC LIMIT 1))""")
def stuck_community(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensors that have stood still above their neighbours for an hour, the verdicts in the order of the sensors."""
    r = readings(spark, sf_dir).withColumn("class", F.floor(F.col("value") / 100))
    s = standing_since(r, "sensor_id", value="class", latest=("lat", "lon", "value")).where("sensor_id IS NOT NULL")
    s = s.withColumns({"place": F.col("sensor_id"), "outlier": F.lit(False)})
    return stuck_sensors(s, ratio=1.2, share=1.5, agree=3).withColumn("value", F.round("value", 3))
