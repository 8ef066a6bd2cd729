import math
import random

import pytest

from aerolith.operators import corridors as C
from aerolith.operators.trails import metres

SCHEMA = "path long, seq int, lat double, lon double, elev double, course double, chunk string"


def m(a, b):
    return float(metres(a[0], a[1], b[0], b[1]))


def axial(a, b):
    d = abs(a - b) % 180
    return min(d, 180 - d)


def axis(courses):
    return math.degrees(math.atan2(sum(math.sin(math.radians(2 * c)) for c in courses), sum(math.cos(math.radians(2 * c)) for c in courses))) / 2 % 180


def world(seed, n=120):
    rng = random.Random(seed)
    lines = [(40 + rng.random() / 300, -111 - rng.random() / 300, rng.choice([0, 0, 20, 75]), rng.random() * 180) for _ in range(14)]
    rows = []
    for p in range(n):
        y, x, e, c = rng.choice(lines)
        y, x = y + rng.gauss(0, 1.2e-4), x + rng.gauss(0, 1.2e-4)
        back = rng.random() < 0.5
        for s in range(rng.choice([2, 3, 5, 8])):
            t = s * 2e-4 * (-1 if back else 1)
            rows.append((p, s, y + t * math.cos(math.radians(c)), x + t * math.sin(math.radians(c)), float(e), (c + 180 * back + rng.gauss(0, 5)) % 360, f"c{p * 4 // n}"))
    return rows


def by_path(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r[2:6])
    return out


def plain_corridors(paths, order=None, known=()):
    """One path after the other: with the nearest leader that matches, or leading."""
    led, of = list(known), {}
    for p in order or sorted(paths):
        pts = paths[p]
        if len(pts) < 3:
            continue
        a = pts[len(pts) // 2]
        fits = []
        for q in led:
            b = paths[q][len(paths[q]) // 2]
            if m(a, b) <= 40 and axial(a[3], b[3]) <= 45 and not (abs(a[2] - b[2]) > 30 and a[2] > 0 and b[2] > 0):
                fits.append((m(a, b), led.index(q), q))
        of[p] = min(fits)[2] if fits else p
        if not fits:
            led.append(p)
    return of


def points_of(paths, of):
    out = {}
    for p, c in of.items():
        out.setdefault(c, []).extend(paths[p])
    return out


def centre(pts):
    return tuple(sum(p[k] for p in pts) / len(pts) for k in range(3)) + (axis([p[3] for p in pts]),)


def plain_merged(groups):
    cs, led, to = {c: centre(p) for c, p in groups.items()}, [], {}
    for c in sorted(groups, key=lambda c: (-len(groups[c]), c)):
        near = [q for q in led if m(cs[c], cs[q]) <= 60 and axial(cs[c][3], cs[q][3]) <= 30]
        to[c] = near[0] if near else c
        led += [] if near else [c]
    return to


def plain_quality(groups, expected):
    length, cs = 0.0, {c: centre(p) for c, p in groups.items()}
    for c, pts in groups.items():
        y, x, _, a = cs[c]
        at = sorted(((p[0] - y) * math.cos(math.radians(a)) + (p[1] - x) * math.sin(math.radians(a)), p[:2]) for p in pts)
        bins = {}
        for d, p in at:
            bins.setdefault(0 if at[-1][0] - at[0][0] < 15 / 111_000 else math.floor((d - at[0][0]) / (15 / 111_000)), []).append(p)
        line = [tuple(sum(p[k] for p in bins[b]) / len(bins[b]) for k in (0, 1)) for b in sorted(bins)]
        length += sum(map(m, line, line[1:]))
    pairs = [(a, b) for a in cs for b in cs if a < b and min(g := abs(round(cs[a][3] * 100) - round(cs[b][3] * 100)) % 18_000, 18_000 - g) < 2_000]
    near = sum(m(cs[a], cs[b]) < 50 for a, b in pairs)
    coverage = expected / length if length > expected * 1.5 else min(1, length / expected)
    return len(groups), sum(map(len, groups.values())), length, coverage, 1 - near / max(1, len(pairs))


@pytest.mark.parametrize("seed", [0])
def test_corridors_merging_and_quality_like_plain(spark, seed):
    rows = world(seed)
    paths = by_path(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    found = C.corridors(df)
    want = plain_corridors(paths)
    assert {r.path: r.corridor for r in found.collect()} == want and 14 < len(set(want.values())) < len(want) - 14
    points = df.join(found, "path")
    groups = points_of(paths, want)
    to = plain_merged(groups)
    assert {r.corridor: r.merged for r in C.merged(points).collect()} == to and len(set(to.values())) < len(to)
    for expected in (500.0, 50_000.0):
        q = C.quality(points, expected_m=expected).first()
        assert tuple(q) == pytest.approx(plain_quality(groups, expected), abs=1e-6)


def test_rounds_until_the_quality_suffices(spark):
    rows = world(7)
    paths, chunk = by_path(rows), {r[0]: r[6] for r in rows}
    of, to, want = {}, {}, []
    for k, name in enumerate(["c2", "c0", "c3", "c1"], 1):
        new = [p for p in sorted(paths) if chunk[p] == name]
        led = sorted({q for q in of.values()})
        got = plain_corridors({p: paths[p] for p in [*led, *new]}, new, led)
        of |= got
        for q in set(got.values()):
            to.setdefault(q, q)
        if k % 3 == 0:
            step = plain_merged(points_of(paths, {p: to[q] for p, q in of.items()}))
            to = {q: step[c] for q, c in to.items()}
        want.append((name, *plain_quality(points_of(paths, {p: to[q] for p, q in of.items()}), 9_000.0)))
        if want[-1][4] >= 0.5 and want[-1][5] >= 0.8:
            break
    points, log = C.built(spark.createDataFrame(rows, SCHEMA), ["c2", "c0", "c3", "c1"], expected_m=9_000.0)
    assert [x[0] for x in log] == [x[0] for x in want]
    for a, b in zip(log, want):
        assert a[1:] == pytest.approx(b[1:], abs=1e-6)
    groups = points_of(paths, {p: to[q] for p, q in of.items()})
    assert sorted((r.path, r.corridor) for r in points.select("path", "corridor").distinct().collect()) == sorted((p, to[q]) for p, q in of.items() if len(groups[to[q]]) >= 5)


def test_no_paths(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert C.corridors(df).count() == 0 and C.built(df, [])[0].count() == 0
    assert tuple(C.quality(df.withColumn("corridor", df.path)).first())[:2] == (0, 0)
