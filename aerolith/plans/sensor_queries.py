"""Queries over readings: index, quality, windows and neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import aqi as A
from ..functions.geo import angle_between, bearing_deg, haversine_m, haversine_sql
from ..functions.time import day_5am, day_5am_sql, day_midnight, day_midnight_sql, slot_15min
from ..operators import spatial as S
from ..operators import windows as W
from ..schema import FEED_CLAMP, PRIORITY
from ..sources.readings import READINGS_SQL, readings
from .registry import query

_RANK = "CASE pollutant " + " ".join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(PRIORITY)) + " END"


def with_aqi(df: DataFrame) -> DataFrame:
    return df.withColumn("aqi", A.value_to_aqi(F.col("key"), F.col("value")))


def latest(df: DataFrame, *by: str) -> DataFrame:
    """The last reading of each key."""
    names = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*names), F.struct("ts", "reading_id")).alias("r")).select(*by, "r.*")


_LATEST = "SELECT * FROM readings QUALIFY row_number() OVER (PARTITION BY sensor_id, pollutant ORDER BY ts DESC, reading_id DESC) = 1"


@query(f"""{READINGS_SQL}, a AS (SELECT *, {A.aqi_sql('key', 'value')} AS aqi, {day_5am_sql('ts')}::VARCHAR AS day, {_RANK} AS rank FROM readings WHERE {A.plausible_sql('key', 'value')})
SELECT day, sensor_id, pollutant, value, round(aqi, 6) AS aqi, {A.level_sql('aqi')} AS level FROM a QUALIFY row_number() OVER (PARTITION BY day, sensor_id ORDER BY aqi DESC NULLS LAST, rank, ts, reading_id) = 1""")
def worst_pollutant_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst plausible reading of each sensor and local day from 5 in the morning."""
    r = with_aqi(readings(spark, sf_dir).where(A.is_plausible(F.col("key"), F.col("value")))).withColumn("day", day_5am(F.col("ts")).cast("string"))
    rank = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("pollutant"))
    # by least: higher index first, then the pollutants' order, then the earlier reading
    best = r.groupBy("day", "sensor_id").agg(F.min_by(F.struct("pollutant", "value", "aqi"), F.struct(-F.coalesce("aqi", F.lit(-1.0)), rank, "ts", "reading_id")).alias("b"))
    return best.select("day", "sensor_id", "b.pollutant", "b.value", F.round("b.aqi", 6).alias("aqi"), A.aqi_level(F.col("b.aqi")).alias("level"))


@query(f"""{READINGS_SQL} SELECT reading_id, key, round({A.aqi_sql('key', 'value')}, 6) AS aqi, {A.level_sql(A.aqi_sql('key', 'value'))} AS level, {A.color_sql('key', 'value')} AS ci,
 {A.threshold_sql('key')} AS threshold, round({A.aqi_to_value_sql('key', A.aqi_sql('key', 'value'))}, 6) AS back FROM readings""")
def aqi_and_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index, level, colour, trend threshold and the concentration of the index, of each reading."""
    k, v = F.col("key"), F.col("value")
    r = with_aqi(readings(spark, sf_dir))
    return r.select("reading_id", "key", F.round("aqi", 6).alias("aqi"), A.aqi_level(F.col("aqi")).alias("level"), A.color_index(k, v).alias("ci"), A.trend_threshold(k).alias("threshold"), F.round(A.aqi_to_value(k, F.col("aqi")), 6).alias("back"))


@query(f"""{READINGS_SQL} SELECT source, pollutant, count(*) AS n, count(*) FILTER ({A.plausible_sql('key', 'value')}) AS plausible, count(CASE WHEN {A.within_sql('key', 'value', FEED_CLAMP)} THEN value END) AS after_clamp,
 count(*) FILTER (value <= 0) AS not_positive FROM readings GROUP BY ALL""")
def plausibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many readings are plausible, and left by the feed's clamp."""
    k, v = F.col("key"), F.col("value")
    return readings(spark, sf_dir).groupBy("source", "pollutant").agg(F.count("*").alias("n"), F.count_if(A.is_plausible(k, v)).alias("plausible"), F.count(A.clamp_feed(k, v)).alias("after_clamp"), F.count_if(v <= 0).alias("not_positive"))


@query(f"{READINGS_SQL} SELECT {day_5am_sql('ts')}::VARCHAR AS day_5am, {day_midnight_sql('ts')}::VARCHAR AS day_midnight, time_bucket(INTERVAL 15 MINUTES, ts) AS slot, count(*) AS n FROM readings GROUP BY ALL")
def local_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings by both local days and by quarter of an hour (T1, T2, T9, T-11)."""
    r = readings(spark, sf_dir)
    return r.groupBy(day_5am(F.col("ts")).cast("string").alias("day_5am"), day_midnight(F.col("ts")).cast("string").alias("day_midnight"), slot_15min(F.col("ts")).alias("slot")).agg(F.count("*").alias("n"))


@query(f"{READINGS_SQL} SELECT reading_id, sensor_id, source, ts, pollutant, value FROM readings WHERE source = 'purpleair' AND ts >= TIMESTAMP '2024-01-10' ORDER BY ts DESC, reading_id DESC LIMIT 10000")
def stored_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest 10,000 readings of a source since a time (P1, O1: the limit is the feature)."""
    r = readings(spark, sf_dir).where((F.col("source") == "purpleair") & (F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")))
    return r.orderBy(F.desc("ts"), F.desc("reading_id")).limit(10_000).select("reading_id", "sensor_id", "source", "ts", "pollutant", "value")


@query(f"{READINGS_SQL} SELECT sensor_id, ts, pollutant, value, reading_id, meta FROM readings WHERE source <> 'mobile' AND ts >= TIMESTAMP '2024-01-20'")
def fixed_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of all but mobile sensors since a time."""
    r = readings(spark, sf_dir)
    return r.where((F.col("source") != "mobile") & (F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz"))).select("sensor_id", "ts", "pollutant", "value", "reading_id", "meta")


@query(f"""{READINGS_SQL}, s AS (SELECT DISTINCT sensor_id FROM readings), p AS (SELECT DISTINCT sensor_id, {day_midnight_sql('ts')}::VARCHAR AS day FROM readings WHERE source = 'purpleair')
SELECT s.sensor_id, count(DISTINCT p.day) AS days, min(p.day) AS first_day, max(p.day) AS last_day, coalesce(bool_or(p.day = '2024-01-10'), false) AS on_day FROM s LEFT JOIN p ON starts_with(p.sensor_id, s.sensor_id) GROUP BY ALL""")
def has_readings_on_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On which days there are community readings whose sensor's id begins with another's id, for every id."""
    r = readings(spark, sf_dir)
    seen = r.where("source = 'purpleair'").select("sensor_id", day_midnight(F.col("ts")).cast("string").alias("day")).distinct()
    # each id stands for all its beginnings, so the join is on equality
    begin = F.explode(F.transform(F.sequence(F.lit(1), F.length("sensor_id")), lambda n: F.substring(F.col("sensor_id"), F.lit(1), n)))
    seen = seen.select("day", begin.alias("sensor_id")).distinct()
    days = seen.groupBy("sensor_id").agg(F.count("*").alias("days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.bool_or(F.col("day") == "2024-01-10").alias("on_day"))
    return r.select("sensor_id").distinct().join(days, "sensor_id", "left").na.fill(0, ["days"]).na.fill(False, ["on_day"])


@query(f"""{READINGS_SQL} SELECT pollutant, count(*) AS n, count(DISTINCT sensor_id) AS sensors, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, median(value) AS med,
 list_sort(list(value))[count(*) // 2 + 1] AS upper_med, round(greatest(1.0::DOUBLE, 1.4826::DOUBLE * mad(value)), 6) AS sigma FROM readings GROUP BY ALL""")
def pollutant_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, mean, ends, both medians and the robust spread by pollutant (A1-A3, A10-A12). The exact percentiles
    count equal values, so what is merged grows with the different values, not with the rows."""
    r = readings(spark, sf_dir)
    n = r.groupBy("pollutant").agg(F.count("*").alias("n"), F.countDistinct("sensor_id").alias("sensors"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.expr("percentile(value, 0.5)").alias("med"))
    by_value = r.groupBy("pollutant", "value").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("pollutant").orderBy("value"))
    upper = by_value.withColumn("upto", upto).join(n.select("pollutant", "n"), "pollutant").where("upto > floor(n / 2)").groupBy("pollutant").agg(F.min("value").alias("upper_med"))
    dev = r.join(F.broadcast(n.select("pollutant", "med")), "pollutant").groupBy("pollutant").agg(F.expr("percentile(abs(value - med), 0.5)").alias("mad"))
    return n.join(upper, "pollutant").join(dev, "pollutant").select("*", F.round(F.greatest(F.lit(1.0), F.lit(1.4826) * F.col("mad")), 6).alias("sigma")).drop("mad")


@query(f"{READINGS_SQL}, l AS ({_LATEST}) SELECT sensor_id, " + ", ".join(f"max(CASE WHEN pollutant = '{p}' THEN value END) AS {p.lower()}" for p in ("PM25", "PM10", "OZNE", "NO2", "CO")) + " FROM l GROUP BY ALL")
def latest_by_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value of each pollutant, a row for each sensor."""
    r = readings(spark, sf_dir)
    last = lambda p: F.max_by(F.when(F.col("pollutant") == p, F.col("value")), F.when(F.col("pollutant") == p, F.struct("ts", "reading_id"))).alias(p.lower())
    return r.groupBy("sensor_id").agg(*map(last, ("PM25", "PM10", "OZNE", "NO2", "CO")))


@query(f"""{READINGS_SQL} SELECT {day_midnight_sql('ts')}::VARCHAR AS day, count(DISTINCT sensor_id) AS stations, round(avg(value), 4) AS mean_speed, max(value) AS max_speed, max(ts) AS last_ts,
 round((degrees(atan2(sum(sin(radians((reading_id * 7 % 360)::DOUBLE))), sum(cos(radians((reading_id * 7 % 360)::DOUBLE))))) + 720.0::DOUBLE) % 360.0::DOUBLE, 3) AS direction FROM readings WHERE pollutant = 'CO' GROUP BY ALL""")
def wind_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and greatest speed, stations, last time and the circular mean of directions by day."""
    r = readings(spark, sf_dir).where("pollutant = 'CO'")
    turn = F.radians((F.pmod(F.col("reading_id") * 7, F.lit(360))).cast("double"))
    direction = F.pmod(F.degrees(F.atan2(F.sum(F.sin(turn)), F.sum(F.cos(turn)))) + 720.0, F.lit(360.0))
    return r.groupBy(day_midnight(F.col("ts")).cast("string").alias("day")).agg(F.countDistinct("sensor_id").alias("stations"), F.round(F.avg("value"), 4).alias("mean_speed"), F.max("value").alias("max_speed"), F.max("ts").alias("last_ts"), F.round(direction, 3).alias("direction"))


_LAST = f"{READINGS_SQL}, l AS (SELECT * FROM readings WHERE pollutant = 'PM25' QUALIFY row_number() OVER (PARTITION BY sensor_id ORDER BY ts DESC, reading_id DESC) = 1)"


@query(f"""{_LAST}, p AS (SELECT a.sensor_id, b.sensor_id AS other, b.value AS v, {haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS d FROM l a, l b WHERE a.sensor_id <> b.sensor_id),
 near AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY d, other) AS rank FROM p WHERE d <= 80000),
 chosen AS (SELECT sensor_id, CASE WHEN d <= 15000 THEN 15000 WHEN d <= 27000 THEN 27000 WHEN d <= 48600 THEN 48600 ELSE 80000 END AS r FROM near WHERE rank = 3),
 used AS (SELECT near.* FROM near JOIN chosen USING (sensor_id) WHERE d <= r AND rank <= 20),
 s AS (SELECT sensor_id, count(*) AS n, median(v) AS med, greatest(1.0::DOUBLE, 1.4826::DOUBLE * mad(v)) AS sigma FROM used GROUP BY ALL)
SELECT l.sensor_id, l.value, s.n, s.med, round(s.sigma, 6) AS sigma, coalesce(value > med AND (value - med) / sigma >= 6 AND value / greatest(1.0::DOUBLE, med) >= 3 AND value - med >= 150, false) AS outlier FROM l LEFT JOIN s USING (sensor_id)""")
def spatial_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last particle values against those around them."""
    l = latest(readings(spark, sf_dir).where("pollutant = 'PM25'"), "sensor_id").select("sensor_id", "lat", "lon", "value")  # noqa: E741
    return S.spatial_outliers(l).select("sensor_id", "value", "n", "med", F.round("sigma", 6).alias("sigma"), "outlier")


@query(f"""{_LAST}, p AS (SELECT a.sensor_id, b.value AS v, {haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS d FROM l a, l b WHERE a.sensor_id <> b.sensor_id)
SELECT l.sensor_id, count(p.d) FILTER (d <= 5000) AS within_5km, count(p.d) FILTER (d <= 10000) AS within_10km, round(min(d), 3) AS nearest_m, count(*) FILTER (d <= 5000 AND v >= greatest(15, l.value / 5)) AS high_within_5km FROM l LEFT JOIN (SELECT * FROM p WHERE d <= 10000) p USING (sensor_id) GROUP BY ALL""")
def neighbour_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours by distance, the nearest, and those that are high as well."""
    l = latest(readings(spark, sf_dir).where("pollutant = 'PM25'"), "sensor_id").select("sensor_id", "lat", "lon", "value")  # noqa: E741
    n = S.neighbour_counts(l).select("sensor_id", F.col("near").alias("within_5km"), F.col("far").alias("within_10km"), F.round("nearest_m", 3).alias("nearest_m"), F.col("high").alias("high_within_5km"))
    return l.select("sensor_id").join(n, "sensor_id", "left").na.fill(0, ["within_5km", "within_10km", "high_within_5km"])


@query(f"{_LAST} SELECT sensor_id, value, trunc(lat / 0.05::DOUBLE)::BIGINT AS cy, trunc(lon / 0.05::DOUBLE)::BIGINT AS cx FROM l QUALIFY row_number() OVER (PARTITION BY trunc(lat / 0.05::DOUBLE), trunc(lon / 0.05::DOUBLE) ORDER BY value DESC, sensor_id) = 1")
def thinned_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest last value of each grid cell."""
    l = latest(readings(spark, sf_dir).where("pollutant = 'PM25'"), "sensor_id")  # noqa: E741
    return S.thinned(l, 0.05).select("sensor_id", "value", "cy", "cx")


@query(f"""{READINGS_SQL}, l AS ({_LATEST}), g AS (SELECT pollutant, sensor_id, value FROM l WHERE source = 'mobile' AND pollutant IN ('PM25', 'PM10', 'OZNE') AND value >= 0),
 m AS (SELECT pollutant, median(value) AS med, count(*) AS peers FROM g GROUP BY ALL HAVING count(*) > 3),
 f AS (SELECT *, CASE WHEN med > 0 THEN value / med ELSE 'inf'::DOUBLE END AS times FROM g JOIN m USING (pollutant) WHERE value >= CASE pollutant WHEN 'PM25' THEN 50 ELSE 100 END AND (med <= 0 OR value > med * 8)),
 broken AS (SELECT DISTINCT sensor_id FROM f JOIN (SELECT pollutant, count(DISTINCT sensor_id) AS c FROM f GROUP BY ALL) USING (pollutant) WHERE pollutant = 'OZNE' OR (times >= 40 AND c = 1))
SELECT DISTINCT sensor_id, sensor_id IN (SELECT sensor_id FROM broken) AS broken FROM readings WHERE source = 'mobile'""")
def broken_mobile_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mobile sensors whose last readings can't be of this air."""
    r = readings(spark, sf_dir).where("source = 'mobile'")
    broken = S.broken_mobile(latest(r, "sensor_id", "pollutant")).withColumn("broken", F.lit(True))
    return r.select("sensor_id").distinct().join(broken, "sensor_id", "left").select("sensor_id", F.coalesce("broken", F.lit(False)).alias("broken"))


@query(f"""{READINGS_SQL}, s AS (SELECT *, coalesce({haversine_sql('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')}, 0.0::DOUBLE) AS step FROM readings WHERE source = 'mobile' WINDOW w AS (PARTITION BY sensor_id ORDER BY ts, reading_id))
SELECT reading_id, sensor_id, round(step, 3) AS step_m, round(sum(step) OVER w, 3) AS travel_m, round(max(step) OVER w, 3) AS max_step_m FROM s WINDOW w AS (PARTITION BY sensor_id ORDER BY ts, reading_id)""")
def trail_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances along each mobile sensor's trail."""
    s = W.steps(readings(spark, sf_dir).where("source = 'mobile'"), "sensor_id")
    return s.select("reading_id", "sensor_id", *(F.round(c, 3).alias(c) for c in ("step_m", "travel_m", "max_step_m")))


@query(f"""{READINGS_SQL} SELECT reading_id, sensor_id, last_value(CASE WHEN pollutant = 'PM25' THEN value END IGNORE NULLS) OVER w AS carried,
 coalesce(last_value(CASE WHEN pollutant = 'PM25' THEN value END IGNORE NULLS) OVER w, first_value(CASE WHEN pollutant = 'PM25' THEN value END IGNORE NULLS) OVER (PARTITION BY sensor_id ORDER BY ts, reading_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS filled
 FROM readings WINDOW w AS (PARTITION BY sensor_id ORDER BY ts, reading_id ROWS UNBOUNDED PRECEDING)""")
def carried_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each point of a sensor with the particle value that holds there."""
    r = readings(spark, sf_dir).withColumn("pm", F.when(F.col("pollutant") == "PM25", F.col("value")))
    return r.select("reading_id", "sensor_id", W.carried_forward("pm", "sensor_id").alias("carried"), W.filled("pm", "sensor_id").alias("filled"))


@query(f"{READINGS_SQL} SELECT sensor_id, pollutant, reading_id, ts, value FROM readings QUALIFY row_number() OVER (PARTITION BY sensor_id, pollutant ORDER BY ts DESC, reading_id DESC) <= 5")
def recent_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 5 readings of each series."""
    return W.last_n(readings(spark, sf_dir), 5, *W.SERIES).select("sensor_id", "pollutant", "reading_id", "ts", "value")


@query(f"""{READINGS_SQL}, w AS (SELECT reading_id, sensor_id, pollutant, max(value) OVER x AS hi, min(value) OVER x AS lo, count(value) OVER x AS n FROM readings WINDOW x AS (PARTITION BY sensor_id, pollutant ORDER BY ts, reading_id ROWS 9 PRECEDING))
SELECT reading_id, hi > 500 AND lo < 2 AS overflow, n >= 10 AND lo > 500 AND hi - lo < 0.05::DOUBLE * hi AS stuck, hi - lo AS spread FROM w""")
def overflow_and_stuck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensors that overflow or are stuck."""
    x = W.in_order(*W.SERIES).rowsBetween(-9, 0)
    r = W.overflow_and_stuck(readings(spark, sf_dir)).withColumn("spread", F.max("value").over(x) - F.min("value").over(x))
    return r.select("reading_id", "overflow", "stuck", "spread")


@query(f"""{READINGS_SQL}, c AS (SELECT *, floor(value / 100) AS band FROM readings), d AS (SELECT *, CASE WHEN lag(band) OVER w IS NULL OR band = lag(band) OVER w THEN 0 ELSE 1 END AS changed FROM c WINDOW w AS (PARTITION BY sensor_id, pollutant ORDER BY ts, reading_id)),
 e AS (SELECT *, sum(changed) OVER (PARTITION BY sensor_id, pollutant ORDER BY ts, reading_id ROWS UNBOUNDED PRECEDING) AS run FROM d)
SELECT sensor_id, pollutant, run::BIGINT AS run, min(ts) AS run_start, max(ts) AS run_end, count(*) AS n, max(ts) - min(ts) >= INTERVAL 1 HOUR AS frozen FROM e GROUP BY sensor_id, pollutant, run""")
def frozen_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of equal bands of values, and whether they last an hour."""
    r = W.equal_runs(readings(spark, sf_dir).withColumn("band", F.floor(F.col("value") / 100)), "band", *W.SERIES)
    return r.groupBy("sensor_id", "pollutant", "run").agg(F.min("ts").alias("run_start"), F.max("ts").alias("run_end"), F.count("*").alias("n"), (F.max("run_s") >= 3600).alias("frozen"))


@query(f"""{READINGS_SQL}, d AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER w > 43200000000 OR {haversine_sql('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} > 80.0 AS cut FROM readings WHERE source = 'mobile' WINDOW w AS (PARTITION BY sensor_id ORDER BY ts, reading_id)),
 e AS (SELECT *, sum(coalesce(cut, false)::INTEGER) OVER (PARTITION BY sensor_id ORDER BY ts, reading_id ROWS UNBOUNDED PRECEDING) AS session FROM d)
SELECT sensor_id, session::BIGINT AS session, count(*) AS points, min(ts) AS first_ts, max(ts) AS last_ts FROM e GROUP BY ALL""")
def trail_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trails cut at gaps in time and jumps in place (W23, T-12)."""
    s = W.sessions(readings(spark, sf_dir).where("source = 'mobile'"), 43_200.0, 80.0, "sensor_id")
    return s.groupBy("sensor_id", "session").agg(F.count("*").alias("points"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(f"""{READINGS_SQL}, w AS (SELECT *, list(value) OVER x AS win, {A.threshold_sql('key')} AS t FROM readings WINDOW x AS (PARTITION BY sensor_id, pollutant ORDER BY ts, reading_id ROWS 14 PRECEDING)),
 m AS (SELECT *, len(win) AS n, [win[i + 1] - win[i] FOR i IN range(1, len(win))] AS moves FROM w),
 c AS (SELECT *, win[n] - win[1] AS d, win[n] - win[n - 1] AS recent, list_max(win) - list_min(win) < greatest(t * 1.5::DOUBLE, 2.0::DOUBLE) OR list_max(win[-5:]) - list_min(win[-5:]) < t AS calm,
  len([x FOR x IN moves IF x >= greatest(t * 0.2::DOUBLE, 0.1::DOUBLE)]) AS ups, len([x FOR x IN moves IF x <= -greatest(t * 0.2::DOUBLE, 0.1::DOUBLE)]) AS downs FROM m WHERE n >= 5)
SELECT reading_id, (CASE WHEN calm THEN 0 WHEN d > t AND ups > 1 THEN CASE WHEN recent < -t * 0.5::DOUBLE THEN 0 ELSE 1 END WHEN d < -t AND downs > 1 THEN CASE WHEN recent > t * 0.5::DOUBLE THEN 0 ELSE -1 END ELSE 0 END)::INTEGER AS trend,
 round(CASE WHEN calm THEN 0.0::DOUBLE ELSE d END, 6) AS delta, round(win[n] + CASE WHEN calm THEN 0.0::DOUBLE ELSE d END, 6) AS predicted FROM c""")
def trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rising, falling or stable over the last 15 readings, and the value it leads to."""
    r = W.trend(readings(spark, sf_dir)).where("trend IS NOT NULL")
    return r.select("reading_id", "trend", F.round("delta", 6).alias("delta"), F.round("predicted", 6).alias("predicted"))


@query(f"""{READINGS_SQL}, p AS (SELECT 'S' || (o_custkey % 150) AS sensor_id, o_orderkey AS probe_id, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * (o_orderkey % 43200) AS ts FROM orders),
 f AS (SELECT * FROM readings WHERE pollutant = 'PM25')
SELECT p.probe_id, p.sensor_id, p.ts, f.value, f.ts AS as_of_ts FROM p ASOF LEFT JOIN f ON p.sensor_id = f.sensor_id AND p.ts >= f.ts""")
def as_of_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value at or before a time, of many sensors and times."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    minute = F.pmod("o_orderkey", F.lit(43_200)).cast("int")
    probes = o.select(F.concat(F.lit("S"), F.pmod("o_custkey", F.lit(150)).cast("string")).alias("sensor_id"), F.col("o_orderkey").alias("probe_id"),
                      (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_interval(mins=minute)).alias("ts"))
    return W.as_of(probes, readings(spark, sf_dir).where("pollutant = 'PM25'"), "value", "sensor_id").select("probe_id", "sensor_id", "ts", "value", "as_of_ts")


@query(f"""{READINGS_SQL}, g AS (SELECT max(epoch_us(ts)) AS now FROM readings), a AS (SELECT sensor_id, max(epoch_us(ts)) AS last FROM readings GROUP BY ALL), b AS (SELECT sensor_id, (now - last)::DOUBLE / 1e6::DOUBLE AS age_s FROM a, g)
SELECT sensor_id, round(age_s, 3) AS age_s, age_s > 2700 AS stale, round(CASE WHEN age_s / 86400 <= 0.8 THEN 1.0::DOUBLE WHEN age_s / 86400 >= 1 THEN NULL WHEN ((1 - age_s / 86400) / 0.2::DOUBLE) ** 2 > 0.01 THEN ((1 - age_s / 86400) / 0.2::DOUBLE) ** 2 END, 6) AS weight FROM b""")
def staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age against the feed's last time, staleness after 45 minutes, and fading over a day."""
    from ..functions.time import seconds

    r = readings(spark, sf_dir)
    last = r.groupBy("sensor_id").agg(F.max("ts").alias("last"))
    now = last.agg(F.max("last").alias("now"))  # one row
    b = last.crossJoin(F.broadcast(now)).select("sensor_id", (seconds(F.col("now")) - seconds(F.col("last"))).alias("age_s"))
    return b.select("sensor_id", F.round("age_s", 3).alias("age_s"), (F.col("age_s") > 2700).alias("stale"), F.round(W.fade_weight(F.col("age_s"), 86_400.0), 6).alias("weight"))


_CELLS = "cells AS (SELECT iy * 40 + ix AS cell_id, 40.4::DOUBLE + (iy + 0.5::DOUBLE) * 0.02::DOUBLE AS lat, -112.2::DOUBLE + (ix + 0.5::DOUBLE) * 0.02::DOUBLE AS lon FROM range(30) a(iy), range(40) b(ix))"


def grid_cells(spark: SparkSession, rows: int = 30, columns: int = 40) -> DataFrame:
    n = spark.range(rows * columns)
    iy, ix = F.floor(F.col("id") / columns), F.pmod("id", F.lit(columns))
    return n.select(F.col("id").alias("cell_id"), (F.lit(40.4) + (iy + 0.5) * 0.02).alias("lat"), (F.lit(-112.2) + (ix + 0.5) * 0.02).alias("lon"))


@query(f"""{_LAST}, {_CELLS}, p AS (SELECT cell_id, value AS v, {haversine_sql('c.lat', 'c.lon', 'l.lat', 'l.lon')} / 6000.0::DOUBLE AS q FROM cells c, l)
SELECT cell_id, round(sum((1 - q * q) ** 2 / (q * q + 1e-4::DOUBLE) * v) / sum((1 - q * q) ** 2 / (q * q + 1e-4::DOUBLE)), 5) AS c FROM p WHERE q <= 1 GROUP BY ALL""")
def inverse_distance_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of concentrations by inverse distances, cut at a radius (V2)."""
    l = latest(readings(spark, sf_dir).where("pollutant = 'PM25'"), "sensor_id").select("lat", "lon", "value")  # noqa: E741
    return S.inverse_distance_field(grid_cells(spark), l, 6000.0).select("cell_id", F.round("c", 5).alias("c"))


@query(f"""{_LAST}, {_CELLS}, p AS (SELECT cell_id, value AS v, CASE WHEN source = 'mobile' THEN 1 ELSE 10 END AS weight, {haversine_sql('c.lat', 'c.lon', 'l.lat', 'l.lon')} AS d FROM cells c, l)
SELECT cell_id, round(sum(weight * exp(-0.5::DOUBLE * (d / 2500.0::DOUBLE) ** 2) * v) / sum(weight * exp(-0.5::DOUBLE * (d / 2500.0::DOUBLE) ** 2)), 5) AS c FROM p WHERE d <= 7500 GROUP BY ALL""")
def kernel_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of concentrations by Gaussian weights, fixed sensors ten times a mobile one's (V4, V6)."""
    l = latest(readings(spark, sf_dir).where("pollutant = 'PM25'"), "sensor_id").select("lat", "lon", "value", F.when(F.col("source") == "mobile", 1).otherwise(10).alias("weight"))  # noqa: E741
    return S.kernel_field(grid_cells(spark), l, 2500.0).select("cell_id", F.round("c", 5).alias("c"))


@query(f"""{_LAST}, p AS (SELECT a.sensor_id, b.sensor_id AS other, {haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS d FROM l a, l b WHERE a.sensor_id <> b.sensor_id)
SELECT sensor_id, other, round(d, 3) AS dist_m, rank FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY d, other) AS rank FROM p WHERE d <= 20000) WHERE rank <= 8""")
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 8 nearest sensors within 20 km."""
    l = latest(readings(spark, sf_dir).where("pollutant = 'PM25'"), "sensor_id").select("sensor_id", "lat", "lon")  # noqa: E741
    p = S.nearest_k(l, l.withColumnRenamed("sensor_id", "other"), "sensor_id", "other", 8, 20_000.0, but_itself=True)
    return p.select("sensor_id", "other", F.round("dist_m", 3).alias("dist_m"), F.col("rank").cast("long").alias("rank"))


@query(f"""{READINGS_SQL}, s AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM readings WHERE source = 'mobile' WINDOW w AS (PARTITION BY sensor_id ORDER BY ts, reading_id)),
 b AS (SELECT reading_id, (degrees(atan2(sin(radians(lon - plon)) * cos(radians(lat)), cos(radians(plat)) * sin(radians(lat)) - sin(radians(plat)) * cos(radians(lat)) * cos(radians(lon - plon)))) + 360.0::DOUBLE) % 360.0::DOUBLE AS bearing FROM s WHERE plat IS NOT NULL AND (plat <> lat OR plon <> lon))
SELECT reading_id, round(bearing, 3) AS bearing, round(least(abs(bearing - 90), 360 - abs(bearing - 90)), 3) AS from_east FROM b""")
def bearings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction of each step of a trail."""
    w = W.in_order("sensor_id")
    s = readings(spark, sf_dir).where("source = 'mobile'").withColumns({"plat": F.lag("lat").over(w), "plon": F.lag("lon").over(w)})
    s = s.where("plat IS NOT NULL AND (plat <> lat OR plon <> lon)").withColumn("b", bearing_deg(F.col("plat"), F.col("plon"), F.col("lat"), F.col("lon")))
    return s.select("reading_id", F.round("b", 3).alias("bearing"), F.round(angle_between(F.col("b"), F.lit(90.0)), 3).alias("from_east"))
