import pandas as pd

from aerolith.streaming import readings as s

SCHEMA = "reading_id long, sensor_id string, source string, pollutant string, ts timestamp, lat double, lon double, value double"


def write(spark, path, rows):
    pdf = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
    spark.createDataFrame(pdf, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def row(i, minute, sensor="V1", value=1.0):
    return (i, sensor, "mobile", "PM25", pd.Timestamp("2024-01-01 10:00:00") + pd.Timedelta(minutes=minute), 40.0 + i / 1000, -111.0, value)


def run(spark, query, tmp_path, mode):
    out = []
    q = query.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(lambda df, _: out.extend(df.collect())).start()
    q.awaitTermination(180)
    return out


def test_windows_equal_the_batch(spark, tmp_path):
    path = str(tmp_path / "in")
    write(spark, path, [row(i, i * 4, value=float(i)) for i in range(30)])
    got = run(spark, s.windowed_means(spark.readStream.schema(SCHEMA).parquet(path)), tmp_path, "append")
    batch = {(r.start, r.n, r["mean"]) for r in s.windowed_means(spark.read.parquet(path)).collect()}
    assert got and {(r.start, r.n, r["mean"]) for r in got} <= batch


def test_dedup_and_sessions(spark, tmp_path):
    path = str(tmp_path / "in")
    write(spark, path, [row(1, 0), row(2, 0), row(3, 1), row(4, 60), row(5, 200)])
    stream = spark.readStream.schema(SCHEMA).parquet(path)
    assert len(run(spark, s.deduplicated(stream), tmp_path, "append")) == 4
    got = run(spark, s.trail_sessions(stream), tmp_path / "b", "append")
    assert sorted(r.points for r in got) == [1, 3]


def test_vehicle_state_over_batches(spark, tmp_path):
    path = str(tmp_path / "in")
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(path)
    write(spark, path, [row(1, 0), row(2, 1), row(3, 0, "V2")])
    first = {r.sensor_id: (r.points, r.added, r.gone) for r in run(spark, s.vehicle_states(stream()), tmp_path, "update")}
    assert first == {"V1": (2, 2, False), "V2": (1, 1, False)}
    write(spark, path, [row(4, 1), row(5, 0.5), row(6, 90)])  # not after the last one; and a later one
    second = run(spark, s.vehicle_states(stream()), tmp_path, "update")
    assert ("V1", 3, 1, False) in {(r.sensor_id, r.points, r.added, r.gone) for r in second}
    write(spark, path, [row(7, 200)])
    third = run(spark, s.vehicle_states(stream()), tmp_path, "update")
    assert ("V2", 1, 0, True) in {(r.sensor_id, r.points, r.added, r.gone) for r in second + third}


def test_vehicle_trails_over_batches(spark, tmp_path):
    path = str(tmp_path / "in")
    stream = lambda: s.vehicle_trails(spark.readStream.schema(SCHEMA).parquet(path), most=4)
    points = lambda: [(r.points, r.added) for r in run(spark, stream(), tmp_path, "update")]
    write(spark, path, [row(1, 0), row(2, 1), row(3, 1)])
    assert points() == [(2, 2)]
    write(spark, path, [row(4, 1), row(5, 2), row(6, 3), row(7, 4)])  # one is known
    assert points() == [(4, 3)]
    write(spark, path, [row(8, -5), row(9, 5)])  # from before the trail on: it is replaced
    assert points() == [(2, 2)]
    write(spark, path, [row(10, 20 * 60)])  # the next local day
    assert points() == [(1, 1)]


def test_store_batches(spark, tmp_path):
    path = str(tmp_path / "in")
    write(spark, path, [row(1, 0), row(2, 1)])
    for _ in range(2):
        q = s.store_batches(spark.readStream.schema(SCHEMA).parquet(path), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
