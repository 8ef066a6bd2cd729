import json
import math
import random
from collections import deque

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aerolith.functions import display as D
from aerolith.operators import lines as L
from aerolith.operators import logs as O
from aerolith.operators import probes as R
from aerolith.operators.spatial import near_pairs
from aerolith.operators.trails import metres


def queue_fill(cells, height, width):
    got = dict(cells)
    q = deque(sorted(cells))
    while q:
        y, x = q.popleft()
        for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1)):
            at = (y + dy, x + dx)
            if 0 <= at[0] < height and 0 <= at[1] < width and at not in got:
                got[at] = got[y, x]
                q.append(at)
    return got


def test_flood_fill_like_a_queue(spark):
    rng = random.Random(2)
    grids = {g: {(rng.randrange(6), rng.randrange(7)): float(i) for i in range(n)} for g, n in (("a", 1), ("b", 4), ("c", 9))}
    rows = [(g, y, x, v) for g, c in grids.items() for (y, x), v in c.items()]
    got = L.flood_filled(spark.createDataFrame(rows, "g string, iy int, ix int, u double"), 6, 7, "g", "u").collect()
    assert len(got) == 3 * 42
    for g, c in grids.items():
        assert {(r.iy, r.ix): r.u for r in got if r.g == g} == queue_fill(c, 6, 7)


def recursive(xy, eps):
    if len(xy) <= 2:
        return xy
    (ay, ax), (by, bx) = xy[0], xy[-1]
    n = math.hypot(by - ay, bx - ax)
    off = [math.hypot(p[0] - ay, p[1] - ax) if n < 1e-10 else abs((by - ay) * (ax - p[1]) - (ay - p[0]) * (bx - ax)) / n for p in xy[1:-1]]
    i = max(range(len(off)), key=lambda k: off[k])
    if off[i] * 111_000 > eps:
        return recursive(xy[: i + 2], eps)[:-1] + recursive(xy[i + 1 :], eps)
    return [xy[0], xy[-1]]


@pytest.mark.parametrize("seed", range(8))
def test_simplified_like_recursion(seed):
    rng = random.Random(seed)
    xy = [(40 + rng.uniform(0, 0.01), -111 + i / 1000) for i in range(40)]
    assert [xy[i] for i in L.simplify(np.array(xy), 200.0)] == recursive(xy, 200.0)


def test_neighbours_near_the_poles_and_across_180(spark):
    rng = random.Random(5)
    places = [(i, rng.choice([-1, 1]) * rng.uniform(85, 89.9), rng.uniform(-180, 180)) for i in range(120)] + [(200 + i, rng.uniform(-1, 1), rng.choice([-1, 1]) * rng.uniform(179.6, 180)) for i in range(60)]
    df = spark.createDataFrame(places, "id int, lat double, lon double")
    got = [(r.a, r.b) for r in near_pairs(df, df, 60_000.0).select("a.id", "b.id").toDF("a", "b").collect()]
    want = {(a[0], b[0]) for a in places for b in places if metres(a[1], a[2], b[1], b[2]) <= 60_000.0}
    assert len(got) == len(set(got)) and set(got) == want


def test_json_leaves(spark):
    deep = {}
    for _ in range(60):
        deep = {"d": deep}
    texts = [json.dumps({"a": {"b": ["<script>x", 1, None, True]}, "k" * 300: "ok\u0001"}), "[1]", "not json", None, "", json.dumps({"x": deep, "y": "JavaScript: z"})]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, raw string")
    got = {(r.id, r.path): (r.kind, r.text) for r in O.sanitised_json(df, "raw", ["id"]).collect()}
    assert got == {(0, "a.b[0]"): ("string", "[REMOVED]>x"), (0, "a.b[1]"): ("number", "1"), (0, "a.b[2]"): ("null", None), (0, "a.b[3]"): ("boolean", "true"), (0, "k" * 200): ("string", "ok"), (5, "y"): ("string", "[REMOVED] z")}


def test_store_sizes_and_pruning(spark, tmp_path):
    df = spark.createDataFrame([(i, f"2026-01-{i:02d}") for i in range(1, 21)], "x int, date string").withColumn("date", F.to_date("date"))
    O.pruned(df, str(tmp_path / "a"), "2026-01-20", 8)
    O.pruned(df, str(tmp_path / "b"), "2026-01-20", 8, size_mb=2000, most_mb=1024)
    assert spark.read.parquet(str(tmp_path / "a")).count() == 8 and spark.read.parquet(str(tmp_path / "b")).count() == 4
    assert O.stored_mb(spark, str(tmp_path / "a")) > 0 and O.stored_files(spark, str(tmp_path / "a")).count() >= 8


def test_probe_takes_one_of_each_cell(spark):
    df = spark.createDataFrame([(f"S{i}", 40 + (i % 4) * 0.05 + 0.01, -111.0) for i in range(40)], "sensor_id string, lat double, lon double")
    picks = [frozenset(r.sensor_id for r in R.probe(df, seed).collect()) for seed in range(3)]
    assert all(len(p) == 4 for p in picks) and len(set(picks)) > 1


def test_labels(spark):
    df = spark.createDataFrame(pd.DataFrame({"v": [None, 3.0, 3.14, 12.6, 99.5]}))
    assert [r.t for r in df.select(D.tag_value(F.col("v")).alias("t")).collect()][1:] == ["3", "3.1", "13", "100"]
    fips = [r.f for r in spark.createDataFrame([("Salt Lake County",), ("slc",), ("49035",), ("48001",), ("",), (None,), ("san pete",)], "n string").select(D.county_fips(F.col("n")).alias("f")).collect()]
    assert fips == [49035, 49035, 49035, None, None, None, 49039]


def test_snapping_by_direction_and_continuity(spark):
    from aerolith.operators.graph import snap_directed

    # two parallel lines north, of two edges each, and one that crosses them
    edges = [("w1", 1, 2, 40.0, -111.001, 40.01, -111.001), ("w2", 2, 3, 40.01, -111.001, 40.02, -111.001), ("e1", 4, 5, 40.0, -111.0, 40.01, -111.0), ("e2", 5, 6, 40.01, -111.0, 40.02, -111.0), ("x", 7, 8, 40.00505, -111.003, 40.00505, -110.998)]
    trail = [("v", i, pd.Timestamp("2026-01-01") + pd.Timedelta(minutes=i), 40.001 + i * 0.002, -111.00045 if i == 4 else -111.0008) for i in range(8)]
    away = [("far", 100 + i, pd.Timestamp("2026-01-01") + pd.Timedelta(minutes=i), 41.0 + i * 0.01, -111.0) for i in range(4)]
    points = spark.createDataFrame(pd.DataFrame(trail + away, columns=["sensor_id", "reading_id", "ts", "lat", "lon"])).repartition(3)
    lines = spark.createDataFrame(edges, "edge_id string, src int, dst int, alat double, alon double, blat double, blon double")
    got = {r.reading_id: r for r in snap_directed(points, lines, "sensor_id", radius_m=120.0, longest_m=1200.0).collect()}
    # the crossing line is nearest to point 2 but not in its direction; the eastern one to point 4, but not connected
    assert [got[i].edge_id for i in range(8)] == ["w1"] * 5 + ["w2"] * 3 and all(abs(got[i].lon + 111.001) < 1e-9 for i in range(8))
    assert not any(i >= 100 for i in got)
    moved = {r.reading_id: r for r in snap_directed(points, lines, "sensor_id", radius_m=120.0, longest_m=1200.0, offset_m=10.0).collect()}
    assert all(moved[i].lon > got[i].lon for i in range(8))


def test_fixed_digits_are_those_of_the_double(spark):
    """Python's formatting is exact, as printf is: 40.4125 and 3.05 are a little less or more than they look."""
    from aerolith.functions import text as X

    rng = random.Random(5)
    values = [40.4125, 40.4285, -112.1845, 3.05, 0.25, 0.35, 2.5, 0.0005, 0.0004, 0.0, -0.0004, 999.9995, 1e11 + 0.125, 1e13, None]
    values += [round(rng.uniform(-200, 500), 4) for _ in range(2000)] + [rng.randrange(-4000, 4000) / 16 for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", *(X.fixed(F.col("v"), k).alias(f"d{k}") for k in (1, 3)))
    for r in df.collect():
        assert (r.d1, r.d3) == ((None, None) if r.v is None else (f"{r.v:.1f}", f"{r.v:.3f}"))


def test_places_along_a_long_trail_in_one_pass(spark):
    n = 20_000
    points = spark.range(n).select(F.lit("s").alias("k"), F.timestamp_seconds(F.col("id") * 100).cast("timestamp_ntz").alias("ts"), (F.col("id") / 1000).alias("lat"), (-F.col("id") / 500).alias("lon"))
    probes = spark.range(-1, n + 1).select(F.lit("s").alias("k"), F.col("id").alias("probe_id"), F.timestamp_seconds(F.col("id") * 100 + 25).cast("timestamp_ntz").alias("ts"))
    out = L.along(points, probes, "k")
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()  # such a frame is gone through for each row
    for r in out.collect():
        x = min(max(r.probe_id + 0.25, 0), n - 1)
        assert abs(r.lat - x / 1000) < 1e-9 and abs(r.lon + x / 500) < 1e-9
