import json

from pyspark.sql import functions as F

from aerolith.functions.time import day_5am, parse_utc, slot_15min
from aerolith.sources import feeds


def raw(spark, *objects):
    return spark.createDataFrame([(o if isinstance(o, str) else json.dumps(o),) for o in objects], "raw string")


def bus(times, values, n=3):
    return {"Latitude": [40.0 + i / 1000 for i in range(n)], "Longitude": [-111.0 - i / 1000 for i in range(n)], "TimeUTC": times, "Value": values, "ValueColor": ["#00ff00"] * n}


def test_mobile_feed(spark):
    t = [f"2025-12-29 10:0{i}:00 UTC" for i in range(3)]
    feed = {"PM25": {"VarUnit": "ug/m3", "LastUpdateUTC": "x", "BUS01": bus(t, ["5.0", "6.0", "7.0"]), "BUS02": bus(t[1:], ["1200", None])}, "OZNE": {"BUS01": bus(t, ["None", "30", "250"])}}
    p = feeds.mobile_points(raw(spark, feed))
    got = {(r.sensor_id, r.pollutant, r.seq): r for r in p.collect()}
    assert len(got) == 9
    assert got["BUS01", "PM25", 0].value == 5.0 and got["BUS01", "PM25", 0].ci == 2 and str(got["BUS01", "PM25", 0].ts) == "2025-12-29 10:00:00"
    assert got["BUS02", "PM25", 0].t is None and got["BUS02", "PM25", 1].value is None  # short lists stand at the right; 1200 can't be
    assert got["BUS01", "OZNE", 0].value is None and got["BUS01", "OZNE", 1].value == 30 and got["BUS01", "OZNE", 2].value is None
    tracks = feeds.tracks(p).where("sensor_id = 'BUS01'").orderBy("ts").collect()
    assert [(r.pm25, r.ozne) for r in tracks] == [(5.0, 30.0), (6.0, 30.0), (7.0, 30.0)]
    assert feeds.tracks(p, 2).where("sensor_id = 'BUS01'").count() == 2
    assert feeds.mobile_points(raw(spark, "{}", "no json")).count() == 0


def test_fixed_feed_and_not_a_number(spark):
    feed = '{"PM25": {"S1": {"Latitude": "40.1", "Longitude": "-111", "Value": NaN, "TimeUTC": "2025-12-29 21:58 UTC"}}, "TEMP": {"S1": {"Latitude": 1, "Longitude": 1, "Value": 3}}, "NO2": {"S2": {"Value": 3}}}'
    got = feeds.fixed_readings(raw(spark, feed)).collect()
    assert [(r.sensor_id, r.key, r.value, str(r.ts)) for r in got] == [("S1", "pm2.5", None, "2025-12-29 21:58:00")]


def test_times(spark):
    cases = {"2025-12-12 10:11:12 UTC": "2025-12-12 10:11:12", "2025-12-12T10:11:12Z": "2025-12-12 10:11:12", "2025-12-29 21:58 UTC": "2025-12-29 21:58:00", "2026-01-09T00:10:00.000Z": "2026-01-09 00:10:00",
             "2026-01-01T00:00:00+00:00Z": "None", "": "None", None: "None", "2026-01-01T05:00:00-07:00": "2026-01-01 12:00:00", "junk": "None"}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", parse_utc(F.col("t")).alias("ts"))
    assert {r.t: str(r.ts) for r in df.collect()} == cases
    days = spark.sql("SELECT timestamp_ntz'2026-03-08 10:59:59' a, timestamp_ntz'2026-03-08 12:00:00' b, timestamp_ntz'2026-03-08 15:37:42' c")
    r = days.select(day_5am(F.col("a")).cast("string").alias("a"), day_5am(F.col("b")).cast("string").alias("b"), slot_15min(F.col("c")).cast("string").alias("c")).first()
    assert tuple(r) == ("2026-03-07", "2026-03-08", "2026-03-08 15:30:00")


def test_pipe_files(spark):
    line = "|".join(f"f{i}" for i in range(8)) + "|40.5|-111.9|x|-7|US|m|n|49|UT|490035|SALT LAKE"
    lines = spark.createDataFrame([(line,), ("too|short",)], "value string")
    s = feeds.sites(lines).collect()
    assert len(s) == 1 and s[0].latitude == 40.5 and s[0].elevation is None and s[0].county_name == "SALT LAKE"
    hours = spark.createDataFrame([("01/09/26|13:00|490353006|Hawthorne|-7|PM2.5|UG/M3|12.5|Utah",), ("01/09/26|14:00|490353006|Hawthorne|-7|PM2.5|UG/M3|bad|Utah",), ("xx|14:00|a|b|c|d|e|1|g",)], "value string")
    h = feeds.hourly(hours).orderBy("ts").collect()
    assert [(str(r.ts), r.value) for r in h] == [("2026-01-09 13:00:00", 12.5), ("2026-01-09 14:00:00", None)]
    paths = spark.range(1).select(feeds.hour_paths("2026-01-09 23:00:00", "2026-01-10 01:00:00", "yyyyMMddHH").alias("p")).first().p
    assert paths == ["2026010923", "2026011000", "2026011001"]


def test_community_graph_and_log(spark, tmp_path):
    r = feeds.community(raw(spark, {"fields": ["sensor_index", "name", "latitude", "longitude", "pm2.5"], "data": [[100, "TestSensor", 40.76, -111.89, 2.5], [101, "x", 40, -111, None]]})).collect()
    assert [(x.sensor_id, x.name, x.value, x.last_seen) for x in r] == [("PA_100", "TestSensor", 2.5, None)]
    nodes, edges = feeds.road_graph(raw(spark, {"nodes": [[0, 0], [0, 0.001, 5]], "adj": [[[1, 111]], [[0, 111]]]}))
    assert nodes.count() == 2 and {(e.src, e.dst, e.dist_m) for e in edges.collect()} == {(0, 1, 111.0), (1, 0, 111.0)}
    (tmp_path / "log").write_text('{"ts": 1.5, "client_id": "a"}\n\nbroken\n{"ts": 2, "client_id": "b"}\n')
    assert sorted(x.client_id for x in feeds.ndjson(spark, str(tmp_path / "log"), "ts double, client_id string").collect()) == ["a", "b"]
