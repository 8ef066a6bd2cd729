"""Readings as streams: windows with late data, dedup, sessions, and vehicles' state (T-2 to T-5, T-7, T-11, T-12, T-14, T-15, K1)."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.time import ZONE, day_5am
from ..session import ship


def windowed_means(stream: DataFrame, late: str = "30 minutes", width: str = "15 minutes") -> DataFrame:
    """Count and mean by pollutant and window; what comes later than ``late`` is dropped (T-11, T-15)."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "pollutant").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "pollutant", "n", "mean")


def deduplicated(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Each sensor's pollutant once for each time (T-7)."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["sensor_id", "pollutant", "ts"])


def trail_sessions(stream: DataFrame, gap: str = "5 minutes", late: str = "30 minutes") -> DataFrame:
    """Stretches of a sensor's points without a gap (T-12)."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "sensor_id").agg(F.count("*").alias("points")).select("sensor_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "points")


STATE = "last_ts timestamp, lat double, lon double, points long"
OUT = "sensor_id string, last_ts timestamp, lat double, lon double, points long, added long, gone boolean"


def vehicle_states(stream: DataFrame, ttl_minutes: int = 45, late: str = "45 minutes") -> DataFrame:
    """The state of each vehicle after each batch: its last place, how many points it has had, how many are new; points
    at or before the last one are dropped (T-2, T-5). A vehicle without points for the time to live is given out once
    more as gone, and forgotten (T-3)."""

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, lat, lon, n = state.get
            state.remove()
            yield pd.DataFrame([[key[0], last, lat, lon, n, 0, True]], columns=names)
            return
        last, lat, lon, n = state.get if state.exists else (None, None, None, 0)
        p = pd.concat(batches).sort_values(["ts", "reading_id"])
        p = p.drop_duplicates("ts", keep="last")
        new = p if last is None else p[p.ts > pd.Timestamp(last)]
        if len(new):
            last, lat, lon, n = new.ts.iloc[-1].to_pydatetime(), float(new.lat.iloc[-1]), float(new.lon.iloc[-1]), n + len(new)
            state.update((last, lat, lon, n))
        at = int(pd.Timestamp(last).timestamp() * 1000) + ttl_minutes * 60_000
        state.setTimeoutTimestamp(max(at, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([[key[0], last, lat, lon, n, len(new), False]], columns=names)

    ship(stream.sparkSession)
    names = [c.split()[0] for c in OUT.split(", ")]
    return stream.where("ts IS NOT NULL").withWatermark("ts", late).groupBy("sensor_id").applyInPandasWithState(update, OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def hydrated_history(store: DataFrame, now: str, most: int = 2_880, more: dict[str, int] | None = None) -> DataFrame:
    """After a restart at ``now`` (UTC): what the store has of the local day from non-mobile sensors, the newest ``most``
    rows of each sensor and pollutant; sensors in ``more`` have limits of their own (T-14)."""
    at = F.lit(now).cast("timestamp_ntz")
    rows = store.where((F.col("source") != "mobile") & (F.col("ts") <= at) & (F.col("ts") > at - F.expr("INTERVAL 26 HOURS")) & (day_5am(F.col("ts")) == day_5am(at)))
    limit = F.lit(most)
    for sensor, n in (more or {}).items():
        limit = F.when(F.col("sensor_id") == sensor, n).otherwise(limit)
    newest = F.row_number().over(Window.partitionBy("sensor_id", "pollutant").orderBy(F.desc("ts"), F.desc("reading_id")))
    return rows.withColumn("_n", newest).where(F.col("_n") <= limit).drop("_n")


def day_seed(store: DataFrame, now: str) -> DataFrame:
    """sensor_id, ts, lat, lon, points: last place of each vehicle that the store has on the local day of a restart at
    ``now``, and its number of points; what ``recovered_states`` begins with (T-14)."""
    at = F.lit(now).cast("timestamp_ntz")
    rows = store.where((F.col("source") == "mobile") & (F.col("ts") <= at) & (F.col("ts") > at - F.expr("INTERVAL 26 HOURS")) & (day_5am(F.col("ts")) == day_5am(at)))
    last = F.max(F.struct("ts", "reading_id", "lat", "lon")).alias("last")
    return rows.groupBy("sensor_id").agg(last, F.countDistinct("ts").alias("points")).select("sensor_id", "last.ts", "last.lat", "last.lon", "points")


RECOVERED = "sensor_id string, last_us long, lat double, lon double, points long, added long, ghosted boolean, gone boolean"


def recovered_states(live: DataFrame, seed: DataFrame, now: str, ttl_minutes: int = 45, late: str = "45 minutes") -> DataFrame:
    """Vehicles' states that go on from a store's after a restart at ``now`` (T-14). live and seed are streams; seed has
    the columns of ``day_seed``, live those of readings, and ts is a timestamp in both.

    A seeded vehicle is a ghost with its stored place and number of points until a live row of it comes, in the same batch
    or later; points at or before the stored one aren't counted again. A seed for a vehicle that has a state already is
    ignored, so a seed given twice does no harm. Vehicles without a live row for the time to live, ghosts from the restart
    on, are given out as gone and forgotten. last_us: time of the last point in microseconds."""
    began = int(pd.Timestamp(now, tz="UTC").timestamp() * 1_000_000)

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, lat, lon, n, ghost, _ = state.get
            state.remove()
            yield pd.DataFrame([[key[0], last, lat, lon, n, 0, ghost, True]], columns=names)
            return
        p = pd.concat(batches).sort_values(["us", "reading_id"])
        live, seeds = p[p.points.isna()], p[p.points.notna()]
        last, lat, lon, n, ghost, seen = state.get if state.exists else (None, None, None, 0, True, began)
        if last is None and len(seeds):
            x = seeds.iloc[-1]
            last, lat, lon, n = int(x.us), float(x.lat), float(x.lon), int(x.points)
        new = live.drop_duplicates("us", keep="last")
        new = new if last is None else new[new.us > last]
        if len(live):
            ghost, seen = False, max(int(live.us.iloc[-1]), 0 if ghost else seen)
        if len(new):
            last, lat, lon, n = int(new.us.iloc[-1]), float(new.lat.iloc[-1]), float(new.lon.iloc[-1]), n + len(new)
        state.update((last, lat, lon, n, ghost, seen))
        state.setTimeoutTimestamp(max(seen // 1000 + ttl_minutes * 60_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([[key[0], last, lat, lon, n, len(new), ghost, False]], columns=names)

    ship(live.sparkSession)
    names = [c.split()[0] for c in RECOVERED.split(", ")]
    us = F.unix_micros("ts").alias("us")
    rows = live.where("ts IS NOT NULL").select("sensor_id", "ts", us, "lat", "lon", F.lit(None).cast("double").alias("points"), "reading_id")
    seeds = seed.select("sensor_id", "ts", us, "lat", "lon", F.col("points").cast("double").alias("points"), F.lit(-1).cast("long").alias("reading_id"))
    both = rows.unionByName(seeds).withWatermark("ts", late)
    return both.groupBy("sensor_id").applyInPandasWithState(update, RECOVERED, "last_us long, lat double, lon double, points long, ghosted boolean, seen_us long", "update", GroupStateTimeout.EventTimeTimeout)


TRAIL = "sensor_id string, points long, added long, first_ts timestamp, last_ts timestamp, trail string"


def vehicle_trails(stream: DataFrame, most: int = 5_000, late: str = "45 minutes") -> DataFrame:
    """Each vehicle's trail after each batch, as JSON of (milliseconds, lat, lon) (T-2). A batch that begins no later than
    the trail replaces it; of any other only points after the trail's last one are added. Points before the local day of
    the newest one, which begins at 5 in the morning, are dropped, and so are the oldest beyond ``most`` (T-4)."""

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = json.loads(state.get[0]) if state.exists else []
        p = pd.concat(batches).sort_values(["ts", "reading_id"]).drop_duplicates("ts", keep="last")
        new = [[int(t.timestamp() * 1000), float(a), float(o)] for t, a, o in zip(p.ts, p.lat, p.lon)]
        if old and new[0][0] > old[0][0]:
            new = old + [x for x in new if x[0] > old[-1][0]]
        day = pd.Timestamp(new[-1][0], unit="ms", tz="UTC").tz_convert(ZONE)
        since = (day - pd.Timedelta(hours=5)).normalize().tz_localize(None) + pd.Timedelta(hours=5)
        since = since.tz_localize(ZONE, nonexistent="shift_forward", ambiguous=True).timestamp() * 1000
        trail = [x for x in new if x[0] >= since][-most:]
        state.update((json.dumps(trail),))
        known = {x[0] for x in old}
        first, last = (pd.Timestamp(x[0], unit="ms") for x in (trail[0], trail[-1]))
        yield pd.DataFrame([[key[0], len(trail), sum(x[0] not in known for x in trail), first, last, json.dumps(trail)]], columns=names)

    ship(stream.sparkSession)
    names = [c.split()[0] for c in TRAIL.split(", ")]
    rows = stream.where("ts IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL").withWatermark("ts", late)
    return rows.groupBy("sensor_id").applyInPandasWithState(update, TRAIL, "trail string", "update", GroupStateTimeout.NoTimeout)


def store_batches(stream: DataFrame, path: str, checkpoint: str):
    """Appends each micro-batch to the store; exactly once by the checkpoint (K1)."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("source").trigger(availableNow=True).start()
