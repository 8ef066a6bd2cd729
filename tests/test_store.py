import datetime as dt
import json
import math

import pandas as pd
import pytest

from aerolith.functions.time import day_5am
from aerolith.operators import spatial, store, winds
from aerolith.streaming import readings as s

WINDS = "date date, key string, kind string, lat double, lon double, u double, v double"
DAY = dt.date(2024, 1, 1)


def saved(spark, path, **options):
    return sorted((r.key, r.kind, r.u) for r in winds.saved_snapshots(spark, path, **options).collect())


def test_wind_files(spark, tmp_path):
    box = {"latMin": 40.0, "latMax": 41.0, "lonMin": -112.0, "lonMax": -110.0}
    grid = {"gw": 2, "gh": 1, "bounds": box, "uGrid": [1.0, 2.0], "vGrid": [3.0, 4.0]}
    points = [{"lat": 40.0, "lon": -111.0, "u": 5.0, "v": 6.0}]
    files = {"0015.json": {"grid": grid, "points": points}, "0030.json": {"points": points, "ts": 1}, "0045.json": {"points": []}, "wind.json": {"points": points}, "0100.json": {}}
    for name, d in files.items():
        (tmp_path / name).write_text(json.dumps(d, indent=1))
    (tmp_path / "0115.json").write_text('{"points": [{"lat"')
    (tmp_path / "0130.json").write_text("")
    got = sorted(tuple(r) for r in winds.wind_files(spark, str(tmp_path)).collect())
    assert got == [("0015", "grid", 40.5, -111.5, 1.0, 3.0), ("0015", "grid", 40.5, -110.5, 2.0, 4.0), ("0030", "points", 40.0, -111.0, 5.0, 6.0)]


def test_snapshots_are_whole_or_absent(spark, tmp_path):
    path = str(tmp_path / "w")
    rows = lambda *x: spark.createDataFrame([(DAY, k, kind, 40.0, -111.0, u, 0.0) for k, kind, u in x], WINDS)
    assert saved(spark, path) == []
    winds.save_snapshots(rows(("0015", "points", 1.0), ("0030", "points", 2.0)), path)
    lost = winds.write_version(rows(("0015", "grid", 9.0), ("0100", "grid", 9.0)), path)  # its writer was killed before the commit
    assert saved(spark, path) == [("0015", "points", 1.0), ("0030", "points", 2.0)]
    winds.save_snapshots(rows(("0015", "grid", 3.0), ("0015", "points", 4.0)), path)  # replaces, and the grid counts
    want = [("0015", "grid", 3.0), ("0030", "points", 2.0)]
    assert saved(spark, path) == want == saved(spark, path, date="2024-01-01") and saved(spark, path, date="2024-01-02") == []
    for _ in range(2):
        winds.commit_version(spark, path, lost)
    assert saved(spark, path) == [("0015", "grid", 9.0), ("0030", "points", 2.0), ("0100", "grid", 9.0)]
    assert len(list((tmp_path / "w" / "commits").glob("0*"))) == 3


def test_a_failed_task_leaves_no_snapshot(spark, tmp_path):
    path = str(tmp_path / "w")

    def fails(batches):
        yield from batches
        raise RuntimeError("lost")

    rows = spark.createDataFrame([(DAY, f"{k:04}", "grid", 40.0, -111.0, 1.0, 0.0) for k in range(8)], WINDS).repartition(4)
    with pytest.raises(Exception, match="lost"):
        winds.save_snapshots(rows.mapInArrow(fails, WINDS), path)
    assert saved(spark, path) == []


def days_of(spark, path):
    return {r.date.day for r in spark.read.parquet(path).select("date").distinct().collect()}


def test_old_days_are_dropped_once(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    rows = spark.createDataFrame([(i, dt.date(2024, 1, i)) for i in range(1, 21)], "id int, date date")
    for t in ("readings", "daily"):
        store.replace_days(rows, f"{root}/{t}")
    assert store.drop_old_days(spark, root, ["readings", "absent"], "2024-01-20", 10, most_mb=100) == 10
    assert days_of(spark, f"{root}/readings") == set(range(11, 21)) and days_of(spark, f"{root}/daily") == set(range(1, 21))
    assert store.drop_old_days(spark, root, ["readings"], "2024-01-20", 10) == 0 and store.journal(spark, root).count() == 10
    # stopped after the journal was written, before anything was deleted
    planned = [(f, store.journal(spark, root).where(f"date = '2024-01-{f:02}'").count()) for f in (11, 15)]
    assert planned == [(11, 0), (15, 0)]
    fs = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    at = [spark._jvm.org.apache.hadoop.fs.Path(f"{root}/readings/date=2024-01-{d}") for d in range(11, 16)]
    size = [fs.getContentSummary(x).getLength() for x in at]
    spark.createDataFrame([("readings", dt.date(2024, 1, d), n, "size") for d, n in zip(range(11, 16), size)], store.JOURNAL).write.mode("append").parquet(f"{root}/_dropped")
    assert store.drop_old_days(spark, root, ["readings"], "2024-01-20", 10, most_mb=0) == 5
    assert days_of(spark, f"{root}/readings") == set(range(16, 21))
    assert sorted((r.date.day, r.rule) for r in store.journal(spark, root).collect()) == [(d, "age") for d in range(1, 11)] + [(d, "size") for d in range(11, 16)]


LIVE = "reading_id long, sensor_id string, ts timestamp, lat double, lon double"
SEED = "sensor_id string, ts timestamp, lat double, lon double, points long"


def at(minute):
    return pd.Timestamp("2024-01-01 10:00:00") + pd.Timedelta(minutes=minute)


def test_states_go_on_after_a_restart(spark, tmp_path):
    live, seed = str(tmp_path / "live"), str(tmp_path / "seed")
    add = lambda path, schema, *rows: spark.createDataFrame(pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]), schema).coalesce(1).write.mode("append").parquet(path)

    def states():
        out = []
        q = s.recovered_states(spark.readStream.schema(LIVE).parquet(live), spark.readStream.schema(SEED).parquet(seed), "2024-01-01 10:00:00")
        q.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(lambda df, _: out.extend(df.collect())).start().awaitTermination(180)
        return {r.sensor_id: (r.lat, r.points, r.added, r.ghosted, r.gone) for r in out}

    add(seed, SEED, ("V1", at(-9), 40.1, -111.0, 7), ("V2", at(-8), 40.2, -111.0, 5))
    add(live, LIVE, (1, "V1", at(-9), 41.0, -111.0), (2, "V1", at(1), 40.5, -111.0), (3, "V3", at(2), 40.3, -111.0))
    assert states() == {"V1": (40.5, 8, 1, False, False), "V2": (40.2, 5, 0, True, False), "V3": (40.3, 1, 1, False, False)}
    # the stream stops and starts again; a seed that comes again is ignored, a ghost is seen without a new point
    add(seed, SEED, ("V1", at(0), 49.0, -111.0, 70))
    add(live, LIVE, (4, "V2", at(-8), 40.2, -111.0))
    assert states() == {"V1": (40.5, 8, 0, False, False), "V2": (40.2, 5, 0, False, False)}
    add(live, LIVE, (5, "V3", at(200), 40.4, -111.0))
    got = states()
    assert got["V3"] == (40.4, 2, 1, False, False) and got["V1"][4] and got["V2"][4]


def test_history_of_the_local_day(spark):
    rows = [(i, "Home" if i % 2 else "F", "fixed" if i % 7 else "mobile", "PM25", at(-20 * i).to_pydatetime(), 1.0) for i in range(-3, 90)]
    df = spark.createDataFrame(rows, "reading_id long, sensor_id string, source string, pollutant string, ts timestamp_ntz, value double")
    got = {r.reading_id for r in s.hydrated_history(df, "2024-01-01 10:00:00", 4, {"Home": 6}).collect()}
    day = df.select(day_5am(df.ts).alias("d"), "reading_id").collect()
    today = {r.reading_id for r in day if r.d == dt.date(2023, 12, 31)}  # 10:00 UTC is 3:00 there
    ok = [i for i in range(0, 90) if i % 7 and i in today]
    assert got == set([i for i in ok if not i % 2][:4] + [i for i in ok if i % 2][:6])


def test_wind_draws_a_field_out(spark):
    places = [(i, 40.5 + 0.004 * (i // 20), -112.0 + 0.005 * (i % 20), *w) for i in range(200) for w in [[(None, None), (0.1, 0.0), (2.0, -1.0), (0.0, 9.0)][i % 4]]]
    sensors = [(40.51, -111.95, 30.0, 1), (40.53, -111.97, 90.0, 10)]
    cells = spark.createDataFrame(places, "cell_id int, lat double, lon double, u double, v double")
    got = {r.cell_id: (r.c, r.w_sum) for r in spatial.wind_kernel_field(cells, spark.createDataFrame(sensors, "lat double, lon double, value double, weight int"), 1000.0).collect()}
    want = {}
    for i, lat, lon, u, v in places:
        speed, total, sum_ = math.hypot(u or 0, v or 0), 0.0, 0.0
        t = min(max((speed - 0.3) / 4.7, 0), 1)
        k = 1 + 1.5 * t * t * (3 - 2 * t)
        for la, lo, value, weight in sensors:
            dy, dx = (lat - la) * spatial.M_PER_DEG, (lon - lo) * spatial.M_PER_DEG * math.cos(math.radians(lat))
            d = math.hypot(dx, dy)
            along, across = (dx * u + dy * v) / speed if speed else 0, (dy * u - dx * v) / speed if speed else 0
            if d > 3000 and not (k > 1.001 and d <= 3000 * k and along > 0):
                continue
            d2 = (along / (k if along > 0 else k / 2)) ** 2 + across**2 if k > 1.001 else d * d
            w = weight * math.exp(-d2 / 2e6)
            total, sum_ = total + w, sum_ + w * value
        if total >= 0.001:
            want[i] = (sum_ / total, total)
    assert got.keys() == want.keys()
    assert all(got[i] == pytest.approx(want[i], rel=2e-3) for i in want)


def test_snapshots_are_read_without_moving_rows_by_version(spark, tmp_path):
    """Two versions would be two tasks that hold all rows."""
    from pyspark.sql import functions as F

    path = str(tmp_path / "winds")
    df = spark.createDataFrame([("2026-01-01", "0000", "points", 40.0, -111.0, 1.0, 2.0)], "date string, key string, kind string, lat double, lon double, u double, v double")
    winds.save_snapshots(df.withColumn("date", F.to_date("date")), path)
    out = winds.saved_snapshots(spark, path)
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 1
