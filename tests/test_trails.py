import random

import numpy as np
import pandas as pd
import pytest

from aerolith.operators import trails as t


def frame(places, step_s=60, start="2026-01-09 12:00:00"):
    ts = pd.date_range(start, periods=len(places), freq=f"{step_s}s")
    return pd.DataFrame({"sensor_id": "B", "reading_id": range(len(places)), "ts": ts, "lat": [p[0] for p in places], "lon": [p[1] for p in places]})


def test_tiny_steps_and_spikes():
    assert len(t.clean(frame([(40, -111), (40.0000001, -111.0000001), (40.001, -111.001)]))) == 2
    got = t.clean(frame([(40, -111), (40.1, -111.1), (40.0001, -111.0001), (40.0002, -111.0002)]))
    assert 40.1 not in got.lat.values
    normal = [(40 + i / 1000, -111) for i in range(4)]
    assert len(t.clean(frame(normal))) == 4


def test_plateau_spike_goes():
    places = [(40 + i / 1000, -111.0) for i in range(6)]
    far = [(40.1, -111.0), (40.1001, -111.0), (40.1002, -111.0)]
    got = t.clean(frame(places[:3] + far + [(40.0021, -111.0)] + places[3:]))
    assert (got.lat < 40.05).all() and len(got) == 7


def test_parked_end_is_collapsed():
    rng = random.Random(1)
    moving = [(40 + i / 500, -111.0) for i in range(10)]
    parked = [(40.02 + rng.uniform(0, 5e-5), -111.0 + rng.uniform(0, 5e-5)) for _ in range(30)]
    got = t.clean(frame(moving + parked))
    assert len(got) < 14 and got.ts.iloc[-1] == frame(moving + parked).ts.iloc[-1]
    one = t.collapse_end(frame([(40, -111)] * 20), 40.0, -111.0, 50, 12)
    assert len(one) == 2 and one.ts.iloc[0] < one.ts.iloc[-1]
    assert len(t.collapse_end(frame([(40 + i / 100, -111) for i in range(15)]), 40.0, -111.0)) == 15
    assert len(t.collapse_end(frame([(40, -111)] * 2), 40.0, -111.0)) == 2


def plain(places, c=t.Cleaning()):
    """Both kinds of spikes looked for over and over, each time from the beginning."""
    pts = places[:1]
    for p in places[1:]:
        if t.metres(*pts[-1], *p) > c.same_m:
            pts.append(p)
    while len(pts) >= 4:
        for i in range(1, len(pts) - 1):
            if min(t.metres(*pts[i - 1], *pts[i]), t.metres(*pts[i], *pts[i + 1])) >= c.out_m and t.metres(*pts[i - 1], *pts[i + 1]) <= c.back_m:
                del pts[i]
                break
        else:
            return pts
    return pts


@pytest.mark.parametrize("seed", range(20))
def test_lone_spikes_like_a_plain_version(seed):
    rng = random.Random(seed)
    places = [(40 + i / 1500 + rng.uniform(0, 1e-5), -111 + (rng.choice([0.01, 0.02]) if rng.random() < 0.15 else 0)) for i in range(60)]
    c = t.Cleaning(plateau_m=0.0)
    got = t.clean(frame(places), c)
    assert list(zip(got.lat, got.lon)) == plain(places)


def test_passes_alternate_until_nothing_changes():
    near = [(40 + i / 1000, -111.0) for i in range(8)]
    # a plateau within which one point jumps on: the lone spike goes first, then the plateau
    far = [(40.1, -111.0), (40.1001, -111.0), (40.3, -111.0), (40.1001, -111.00005), (40.1002, -111.0)]
    got = t.clean(frame(near[:4] + far + [(40.0031, -111.0)] + near[4:]))
    assert (got.lat < 40.05).all() and len(got) == 9


@pytest.mark.parametrize("seed", range(5))
def test_never_longer_and_no_spike_left(seed):
    rng = random.Random(seed)
    places = [(40 + i / 2000 + rng.uniform(0, 1e-4), -111 + (0.01 if rng.random() < 0.1 else 0)) for i in range(80)]
    got = t.clean(frame(places))
    assert len(got) <= 80
    xy = list(zip(got.lat, got.lon))
    assert not any(f(xy, i, t.Cleaning()) for f in (t.lone_spike, t.plateau_spike) for i in range(1, len(xy) - 1))


def rule(places, step_s=60):
    f = frame(places, step_s)
    return t.classify(f.lat.to_numpy(float), f.lon.to_numpy(float), f.ts.astype("datetime64[ns]").astype("int64").to_numpy() / 1e9)


def test_mobility():
    assert t.classify(np.array([np.nan]), np.array([1.0]), np.array([0.0]))["immobile"] is None
    one = rule([(40.7, -111.9)])
    assert one["immobile"] and one["stable_lat"] == 40.7
    assert rule([(40.7, -111.9)] * 20)["rule"] == "calm"
    rng = random.Random(2)
    assert rule([(40.7 + rng.uniform(0, 1e-4), -111.9) for _ in range(15)])["immobile"]
    assert not rule([(40.7 + i / 200, -111.9) for i in range(20)])["immobile"]
    assert not rule([(40.7, -111.9), (40.702, -111.9)])["immobile"]
    assert rule([(40.7, -111.9), (40.7001, -111.9), (40.7, -111.9)])["rule"] == "sparse"
    assert rule([(40.7 + (i % 2) * 6e-4, -111.9) for i in range(9)])["rule"] == "low coverage"


def test_on_spark_as_on_one_trail(spark):
    rng = random.Random(3)
    parts = [frame([(40 + i / 1000 + rng.uniform(0, 1e-4), -111) for i in range(20)]).assign(sensor_id=f"B{k}") for k in range(4)]
    df = spark.createDataFrame(pd.concat(parts).sample(frac=1, random_state=1)).repartition(3)
    assert t.clean_trails(df, "sensor_id").count() == sum(len(t.clean(p)) for p in parts)
    got = {r.sensor_id: r.immobile for r in t.mobility(df, "sensor_id").collect()}
    assert got == {f"B{k}": rule(list(zip(p.lat, p.lon)))["immobile"] for k, p in enumerate(parts)}


def test_state_against_the_last_kept(spark):
    rows = [("A", i, pd.Timestamp("2026-01-01") + pd.Timedelta(seconds=60 * i), v, c) for i, (v, c) in enumerate([(1.0, 1), (2.0, 2), (4.0, 2), (4.5, 3), (7.0, 3), (7.0, 3)])]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["sensor_id", "reading_id", "ts", "value", "ci"]))
    assert sorted(r.reading_id for r in t.committed_changes(df, "sensor_id").collect()) == [0, 2, 4]
    assert sorted(r.reading_id for r in t.accept_community(df, "sensor_id").collect()) == [0, 1, 2, 3, 4]
