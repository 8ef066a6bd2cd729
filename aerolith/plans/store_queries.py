"""Queries over stores: wind snapshots, retention, recovery after a restart, fields drawn out by winds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_sql
from ..functions.time import day_5am_sql
from ..operators import spatial as S
from ..operators import store as K
from ..operators import winds as V
from ..session import shared_dir, stored
from ..sources.readings import READINGS_SQL, readings
from ..streaming import readings as T
from .registry import query
from .sensor_queries import _CELLS, _LAST, grid_cells, latest


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"""{READINGS_SQL}, w AS (SELECT *, time_bucket(INTERVAL 6 HOURS, ts) AS slot FROM readings),
 g AS (SELECT slot, trunc((lat - 40.4::DOUBLE) * 10) AS iy, trunc((lon + 112.2::DOUBLE) * 10) AS ix, round(avg(value), 3) AS u FROM w WHERE hour(slot) IN (6, 18) GROUP BY ALL),
 s AS (SELECT slot, 'points' AS kind, value AS u FROM w WHERE hour(slot) NOT IN (6, 18) UNION ALL SELECT slot, 'grid', u FROM g)
SELECT CAST(slot AS DATE) AS date, strftime(slot, '%H%M') AS key, any_value(kind) AS kind, count(*) AS n, min(u) AS least, max(u) AS most FROM s GROUP BY slot""")
def wind_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winds of every six hours saved as points, then half of them again as grids, which replace them, and read back
    (K9, S23, Z1)."""
    slot = F.timestamp_seconds(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 21_600_000_000) * 21_600)
    w = readings(spark, sf_dir).withColumn("slot", slot)
    w = w.select(F.to_date("slot").alias("date"), F.date_format("slot", "HHmm").alias("key"), "lat", "lon", F.col("value").alias("u"), (-F.col("value") / 2).alias("v"))
    iy, ix = ((F.col("lat") - 40.4) * 10).cast("long"), ((F.col("lon") + 112.2) * 10).cast("long")
    g = w.where(F.col("key").isin("0600", "1800")).groupBy("date", "key", iy.alias("iy"), ix.alias("ix")).agg(F.round(F.avg("u"), 3).alias("u"), F.round(F.avg("v"), 3).alias("v"))
    g = g.select("date", "key", F.lit("grid").alias("kind"), (F.lit(40.4) + (F.col("iy") + 0.5) / 10).alias("lat"), (F.lit(-112.2) + (F.col("ix") + 0.5) / 10).alias("lon"), "u", "v")
    path = _folder(spark, "winds")
    V.save_snapshots(w.select("date", "key", F.lit("points").alias("kind"), "lat", "lon", "u", "v"), path)
    V.save_snapshots(g, path)
    return V.saved_snapshots(spark, path).groupBy("date", "key").agg(F.first("kind").alias("kind"), F.count("*").alias("n"), F.min("u").alias("least"), F.max("u").alias("most"))


@query(f"""{READINGS_SQL}, t AS (SELECT 'readings' AS name, ts::DATE AS date FROM readings UNION ALL SELECT 'trail_points', ts::DATE FROM readings WHERE source = 'mobile' UNION ALL SELECT 'daily_snapshots', ts::DATE FROM readings WHERE source = 'fixed'),
 m AS (SELECT max(ts::DATE) AS newest FROM readings), d AS (SELECT name, date, count(*) AS n FROM t GROUP BY ALL)
SELECT name, date, n, CASE WHEN name = 'daily_snapshots' OR date > newest - 20 THEN n ELSE 0 END AS by_age, CASE WHEN name = 'daily_snapshots' OR date > newest - 10 THEN n ELSE 0 END AS by_size, CASE WHEN name = 'daily_snapshots' OR date > newest - 10 THEN NULL WHEN date > newest - 20 THEN 'size' ELSE 'age' END AS rule FROM d, m""")
def retained_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each day of a store before and after retention: 20 days, then half of that as the store is beyond its size;
    daily snapshots stay. The journal says what went by which rule (K7, K8)."""
    r = readings(spark, sf_dir)
    newest = str(r.agg(F.to_date(F.max("ts"))).first()[0])
    root, names = _folder(spark, "retained"), {"readings": r, "trail_points": r.where("source = 'mobile'"), "daily_snapshots": r.where("source = 'fixed'")}

    def counts(column: str) -> DataFrame:
        out = None
        for name in names:
            t = spark.read.parquet(f"{root}/{name}").groupBy(F.lit(name).alias("name"), "date").agg(F.count("*").alias(column))
            out = t if out is None else out.unionByName(t)
        return stored(out, "counts")

    for name, rows in names.items():
        K.replace_days(rows.withColumn("date", F.to_date("ts")), f"{root}/{name}")
    n = counts("n")
    K.drop_old_days(spark, root, ["readings", "trail_points"], newest, 20)
    by_age = counts("by_age")
    K.drop_old_days(spark, root, ["readings", "trail_points"], newest, 20, most_mb=0)
    out = n.join(by_age, ["name", "date"], "left").join(counts("by_size"), ["name", "date"], "left").fillna(0, ["by_age", "by_size"])
    return out.join(K.journal(spark, root).select(F.col("table").alias("name"), "date", "rule"), ["name", "date"], "left")


_RESTART = f"{READINGS_SQL}, m AS (SELECT max(ts) - INTERVAL 6 HOURS AS restart FROM readings)"


def _restart(rows: DataFrame) -> str:
    return str(rows.agg(F.max("ts") - F.expr("INTERVAL 6 HOURS")).first()[0])


@query(f"""{_RESTART}, s AS (SELECT sensor_id, max_by(lat, (ts, reading_id)) AS lat, max(ts) AS last, count(DISTINCT ts) AS points FROM readings, m WHERE source = 'mobile' AND ts <= restart AND {day_5am_sql('ts')} = {day_5am_sql('restart')} GROUP BY ALL),
 l AS (SELECT sensor_id, max_by(lat, (ts, reading_id)) AS lat, max(ts) AS last, count(DISTINCT ts) AS points FROM readings, m WHERE source = 'mobile' AND ts > restart GROUP BY ALL),
 w AS (SELECT epoch_us(greatest((SELECT max(last) FROM l), (SELECT max(last) FROM s))) // 1000 - 2700000 AS mark)
SELECT sensor_id, epoch_us(coalesce(l.last, s.last)) AS last_us, coalesce(l.lat, s.lat) AS lat, coalesce(s.points, 0) + coalesce(l.points, 0) AS points, l.sensor_id IS NULL AS ghosted,
 epoch_us(coalesce(l.last, restart)) // 1000 + 2700000 < mark AS gone FROM s FULL JOIN l USING (sensor_id), m, w""")
def recovered_vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicles after a restart six hours before the end: seeded from the store as ghosts, then fed the rows since as a
    stream; the last state of each (T-14)."""
    r = readings(spark, sf_dir)
    now = _restart(r)
    live = r.where((F.col("source") == "mobile") & (F.col("ts") > F.lit(now).cast("timestamp_ntz"))).withColumn("ts", F.col("ts").cast("timestamp"))
    tables = [stored(x, "stream") for x in (live, T.day_seed(r, now).withColumn("ts", F.col("ts").cast("timestamp")))]
    streams = [spark.readStream.schema(x.schema).parquet(x.stored_path) for x in tables]
    out = _folder(spark, "recovered")
    # a batch that is done again replaces its own folder
    written = T.recovered_states(*streams, now).writeStream.outputMode("update").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True)
    written.foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{out}/states/batch={k}")).start().awaitTermination()
    states = spark.read.schema(f"{T.RECOVERED}, batch long").parquet(f"{out}/states")
    newest = F.row_number().over(Window.partitionBy("sensor_id").orderBy(F.desc("batch")))
    return states.withColumn("n", newest).where("n = 1").select("sensor_id", "last_us", "lat", "points", "ghosted", "gone")


@query(f"""{_RESTART}, h AS (SELECT r.*, row_number() OVER (PARTITION BY sensor_id, pollutant ORDER BY ts DESC, reading_id DESC) AS n FROM readings r, m WHERE source <> 'mobile' AND ts <= restart AND {day_5am_sql('ts')} = {day_5am_sql('restart')})
SELECT reading_id, sensor_id, pollutant, ts, value FROM h WHERE n <= 2880""")
def hydrated_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a restart six hours before the end finds in the store of the local day's fixed readings (T-14)."""
    r = readings(spark, sf_dir)
    return T.hydrated_history(r, _restart(r)).select("reading_id", "sensor_id", "pollutant", "ts", "value")


@query(f"""{_LAST}, {_CELLS}, b AS (SELECT trunc((lat - 40.4::DOUBLE) * 10)::BIGINT AS iy, trunc((lon + 112.2::DOUBLE) * 10)::BIGINT AS ix, round((avg(value) - 50) / 10, 3) AS u, round((avg(value) FILTER (key = 'ozone') - 50) / 10, 3) AS v FROM readings GROUP BY ALL),
 w AS (SELECT c.*, u, v, coalesce(sqrt(u * u + v * v), 0) AS speed FROM cells c LEFT JOIN b ON b.iy = trunc((lat - 40.4::DOUBLE) * 10)::BIGINT AND b.ix = trunc((lon + 112.2::DOUBLE) * 10)::BIGINT),
 t AS (SELECT *, least(greatest((speed - 0.3::DOUBLE) / (5.0::DOUBLE - 0.3::DOUBLE), 0), 1) AS t FROM w),
 s AS (SELECT *, CASE WHEN speed < 0.3::DOUBLE THEN 1 ELSE 1 + 1.5::DOUBLE * t * t * (3 - 2 * t) END AS stretch FROM t),
 p AS (SELECT s.cell_id, s.stretch, s.stretch > 1.001::DOUBLE AS blown, u / speed AS wx, v / speed AS wy, l.value AS val, CASE WHEN l.source = 'mobile' THEN 1 ELSE 10 END AS weight, {haversine_sql('s.lat', 's.lon', 'l.lat', 'l.lon')} AS d,
  (s.lat - l.lat) * {S.M_PER_DEG}::DOUBLE AS dy, (s.lon - l.lon) * {S.M_PER_DEG}::DOUBLE * cos(radians(s.lat)) AS dx FROM s, l),
 a AS (SELECT *, dx * wx + dy * wy AS along, dy * wx - dx * wy AS across FROM p),
 k AS (SELECT *, CASE WHEN blown THEN (along / (CASE WHEN along > 0 THEN stretch ELSE stretch * 0.5::DOUBLE END)) ** 2 + across ** 2 ELSE d * d END AS d2 FROM a WHERE d <= 6000 OR (blown AND d <= 6000 * stretch AND along > 0)),
 e AS (SELECT cell_id, stretch, val, weight * exp(-d2 / (2 * 2000.0::DOUBLE * 2000.0::DOUBLE)) AS w FROM k)
SELECT cell_id, round(stretch, 6) AS stretch, round(sum(w * val) / sum(w), 5) AS c FROM e GROUP BY cell_id, e.stretch HAVING sum(w) >= 0.001::DOUBLE""")
def wind_kernel_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field by Gaussian weights that each cell's own wind draws out (V4, V6)."""
    r = readings(spark, sf_dir)
    iy, ix = ((F.col("lat") - 40.4) * 10).cast("long").alias("iy"), ((F.col("lon") + 112.2) * 10).cast("long").alias("ix")
    ozone = F.avg(F.when(F.col("key") == "ozone", F.col("value")))
    b = r.groupBy(iy, ix).agg(F.round((F.avg("value") - 50) / 10, 3).alias("u"), F.round((ozone - 50) / 10, 3).alias("v"))
    cells = grid_cells(spark).select("*", iy, ix).join(b, ["iy", "ix"], "left").select("cell_id", "lat", "lon", "u", "v")
    l = latest(r.where("pollutant = 'PM25'"), "sensor_id").select("lat", "lon", "value", F.when(F.col("source") == "mobile", 1).otherwise(10).alias("weight"))  # noqa: E741
    return S.wind_kernel_field(cells, l, 2000.0).select("cell_id", F.round("stretch", 6).alias("stretch"), F.round("c", 5).alias("c"))
