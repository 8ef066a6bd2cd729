import math
import random
from datetime import datetime, timedelta

import pytest

from aerolith.operators import stuck as S

T0 = datetime(2026, 1, 10)
SCHEMA = "sensor_id string, place long, lat double, lon double, value double, outlier boolean, since timestamp_ntz, last_ts timestamp_ntz, n long"


def plain(rows):
    """One sensor after the other, leaving out those flagged so far."""
    rows = sorted(rows, key=lambda r: r[1])
    gone, out = {r[0] for r in rows if r[5]}, {}
    for r in rows:
        if r[0] in gone or r[8] < 2 or r[6] is None or (r[7] - r[6]).total_seconds() < 3600:
            continue
        km = 5.0
        while True:
            near = [o[4] for o in rows if o[0] != r[0] and o[0] not in gone and ((o[2] - r[2]) * 110.57) ** 2 + ((o[3] - r[3]) * 111.32 * math.cos(math.radians(40.7))) ** 2 <= km * km]
            if len(near) >= 3 or km >= 40:
                break
            km *= 2
        if len(near) < 3:
            continue
        med = sorted(near)[len(near) // 2]
        if r[4] - med < 10 or (med >= 1 and r[4] < 2 * med) or sum(v >= max(15.0, r[4] / 5) for v in near) >= 2:
            continue
        gone.add(r[0])
        out[r[0]] = r[6]
    return out


@pytest.mark.parametrize("seed", [2])
def test_like_one_after_the_other(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i, place in enumerate(rng.sample(range(1000), 90)):
        still = rng.choice([0, 59, 60, 300])
        rows.append((f"s{i}", place, 40 + rng.random() * rng.choice([0.1, 1.5]), -111 - rng.random() * rng.choice([0.1, 1.5]), rng.choice([0.5, 4.0, 4.0, 5.0, 6.0, 7.0, 9.0, 14.0, 30.0, 60.0, 400.0]), rng.random() < 0.05, T0 if rng.random() < 0.95 else None, T0 + timedelta(minutes=still), rng.choice([1, 9, 9])))
    want = plain(rows)
    got = {r.sensor_id: r.stuck for r in S.stuck_sensors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want and len(want) > 2


@pytest.mark.parametrize("first, want", [("p", {"p", "q"}), ("q", {"p"})])
def test_a_flag_changes_later_verdicts(spark, first, want):
    """q is high beside r and p; without p, r alone doesn't speak for it."""
    values = {"p": 400.0, "q": 60.0, "r": 60.0, "x": 4.0, "y": 5.0, "z": 6.0, "w": 5.0}
    rows = [(k, 0 if k == first else i + 1, 40.0 + i / 1000, -111.0, v, False, T0, T0 + timedelta(hours=2 if k in "pq" else 0), 5) for i, (k, v) in enumerate(values.items())]
    assert set(plain(rows)) == want
    assert {r.sensor_id for r in S.stuck_sensors(spark.createDataFrame(rows, SCHEMA)).collect()} == want


def test_standing_since(spark):
    rows = [("a", 1, T0, 5.0), ("a", 2, T0 + timedelta(hours=1), 7.0), ("a", 3, T0 + timedelta(hours=2), 7.0), ("b", 4, T0, 1.0), ("b", 5, T0 + timedelta(hours=5), 1.0), ("c", 6, T0, 2.0), ("c", 7, T0 + timedelta(hours=1), None), ("d", 8, T0, 3.0)]
    got = {r.sensor_id: tuple(r)[1:] for r in S.standing_since(spark.createDataFrame(rows, "sensor_id string, reading_id long, ts timestamp_ntz, value double"), "sensor_id").collect()}
    h = lambda k: T0 + timedelta(hours=k)
    assert got == {"a": (h(1), h(2), 3), "b": (T0, h(5), 2), "c": (None, h(1), 2), "d": (T0, T0, 1)}


def test_no_sensors(spark):
    assert S.stuck_sensors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_few_rounds_among_many(spark, monkeypatch):
    """600 sensors, each near all others, half of them as high: no verdict depends on another, so none waits for one."""
    rng, tables = random.Random(3), []
    rows = [(f"s{i}", i, 40 + rng.random() / 100, -111.0, rng.choice([5.0, 400.0]), False, T0, T0 + timedelta(hours=2), 9) for i in range(600)]
    stored = S.stored
    monkeypatch.setattr(S, "stored", lambda df, name: (tables.append(name), stored(df, name))[1])
    got = {r.sensor_id: r.stuck for r in S.stuck_sensors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == plain(rows) and len(tables) < 30


def test_neighbours_are_counted_not_stored(spark, monkeypatch):
    """60 sensors, each near all others, all too low to speak for one: no table has a row for each pair."""
    rng, tables = random.Random(4), []
    rows = [(f"s{i}", i, 40 + rng.random() / 100, -111.0, rng.choice([1.0, 1.5, 2.0, 13.0, 14.0]), False, T0, T0 + timedelta(hours=2), 9) for i in range(60)]
    stored = S.stored

    def counting(df, name):
        out = stored(df, name)
        tables.append(out.count())
        assert tables[-1] <= 4 * 60
        return out

    monkeypatch.setattr(S, "stored", counting)
    got = {r.sensor_id: r.stuck for r in S.stuck_sensors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == plain(rows) and len(got) > 2 and tables


def test_far_neighbours_at_the_equator(spark):
    """Within 40 km on the plane, farther on the sphere."""
    rows = [(f"s{i}", i, 0.0, lon, v, False, T0, T0 + timedelta(hours=2), 9) for i, (lon, v) in enumerate([(10.0, 90.0), (10.45, 2.0), (10.45, 3.0), (10.45, 4.0)])]
    assert plain(rows).keys() == {"s0"}
    assert [r.sensor_id for r in S.stuck_sensors(spark.createDataFrame(rows, SCHEMA)).collect()] == ["s0"]


def test_cells_in_parts(spark):
    rng = random.Random(5)
    rows = [(f"s{i}", i, 40 + i % 12 + rng.random() / 50, -111.0, rng.choice([1.0, 2.0, 3.0, 4.0, 30.0, 200.0]) if i % 5 else 2.0, False, T0, T0 + timedelta(minutes=rng.choice([30, 90, 90])), 9) for i in range(200)]
    got = {r.sensor_id: r.value for r in S.stuck_sensors(spark.createDataFrame(rows, SCHEMA), most=30).collect()}
    assert got.keys() == plain(rows).keys() and got and all(got[r[0]] == r[4] for r in rows if r[0] in got)


def test_standing_since_with_the_latest(spark):
    rows = [("a", 1, T0, 5.0, 1.0), ("a", 2, T0, 5.0, 3.0), ("b", 4, T0 + timedelta(hours=5), None, 2.0), ("b", 3, T0, 1.0, 9.0)]
    got = S.standing_since(spark.createDataFrame(rows, "sensor_id string, reading_id long, ts timestamp_ntz, value double, lat double"), "sensor_id", latest=("value", "lat"))
    assert {tuple(r) for r in got.collect()} == {("a", T0, T0, 2, 5.0, 3.0), ("b", None, T0 + timedelta(hours=5), 2, None, 2.0)}


def test_nobody_is_counted_for_a_low_sensor(spark, monkeypatch):
    """Only the last is 10 above any other."""
    counted, stored = [], S.stored

    def noted(df, name):
        out = stored(df, name)
        if name == "counts":
            counted.append({r.sensor_id for r in out.collect()})
        return out

    rows = [(f"s{i}", i, 40 + i / 10000, -111.0, v, False, T0, T0 + timedelta(hours=2), 9) for i, v in enumerate([2.0, 3.0, 9.0, 11.0, 11.9, 12.5])]
    monkeypatch.setattr(S, "stored", noted)
    assert {r.sensor_id: r.stuck for r in S.stuck_sensors(spark.createDataFrame(rows, SCHEMA)).collect()} == plain(rows)
    assert counted and all(c == {"s5"} for c in counted)
