import heapq
import math
import random
from collections import deque
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from aerolith.operators import routes as R
from aerolith.operators.trails import metres

T0 = datetime(2026, 1, 10, 12)
PAIRS = "pair_id long, lat0 double, lon0 double, ts0 timestamp_ntz, lat1 double, lon1 double, ts1 timestamp_ntz, slat double, slon double, sa long, sb long, elat double, elon double, ea long, eb long"


def m(a, b):
    return float(metres(*a, *b))


def graph(rng, n, links):
    at = {i: (40 + rng.random() / 50, -111 - rng.random() / 50) for i in range(n)}
    edges = {}
    for i in range(n):
        for j in sorted(at, key=lambda j: m(at[i], at[j]))[1 : 1 + links]:
            edges[min(i, j), max(i, j)] = round(m(at[i], at[j]) * 1000) + 1
    return at, edges


def adjacency(edges):
    adj = {}
    for (a, b), w in sorted(edges.items()):
        adj.setdefault(a, []).append((b, w))
        adj.setdefault(b, []).append((a, w))
    return {k: sorted(v) for k, v in adj.items()}


def dijkstra(adj, start, goal, budget):
    """The way and its length, with at most so many ends of edges looked at before the goal is taken."""
    heap, dist, seen = [(0, s, [s]) for s in sorted(start)], dict.fromkeys(start, 0), 0
    while heap and seen < budget:
        d, at, path = heapq.heappop(heap)
        if at in goal:
            return path, d
        if d > dist[at]:
            continue
        seen += len(adj[at])
        for to, w in adj[at]:
            if d + w < dist.get(to, math.inf):
                dist[to] = d + w
                heapq.heappush(heap, (d + w, to, path + [to]))
    return None


def fewest(adj, start, goal, budget):
    queue, met, seen = deque((s, [s]) for s in sorted(start)), set(start), 0
    while queue and seen < budget:
        at, path = queue.popleft()
        if at in goal:
            return path, len(path) - 1
        for to, _ in adj[at]:
            seen += 1
            if seen < budget and to not in met:
                met.add(to)
                queue.append((to, path + [to]))
    return None


def tables(spark, at, edges):
    nodes = spark.createDataFrame([(i, *p) for i, p in at.items()], "node long, lat double, lon double")
    return nodes, spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src long, dst long, dist long")


@pytest.mark.parametrize("seed, budget", [(1, 100), (3, 10_000)])
def test_ways_like_plain_searches(spark, seed, budget):
    rng = random.Random(seed)
    at, edges = graph(rng, 60, 2)
    edges |= {(100, 101): 5, (101, 102): 5, (100, 103): 5, (102, 103): 5}  # two equal ways, apart from the rest
    adj, every = adjacency(edges), sorted(edges)
    legs = [(k, *a, *b) for k in range(80) if not set(a := rng.choice(every)) & set(b := rng.choice(every))] + [(900, 100, 100, 102, 102), (901, 100, 101, 0, 1)]
    _, e = tables(spark, at, edges)
    df = spark.createDataFrame([(*x, None) for x in legs], "leg long, a1 long, a2 long, b1 long, b2 long, most double")
    for hops, plain in ((False, dijkstra), (True, fewest)):
        got = {}
        for r in sorted(R.ways(df, e, by_hops=hops, most_edges=budget).collect(), key=lambda r: (r.leg, r.seq)):
            got.setdefault(r.leg, ([], r.total))[0].append(r.node)
        want = {k: plain(adj, {a, b}, {c, d}, budget) for k, a, b, c, d in legs}
        assert got == {k: v for k, v in want.items() if v} and got and (budget > 100 or len(got) < len(legs))


def snapped(rng, at, edges, n):
    """Pairs of places on edges."""
    out = []
    for k in range(n):
        ends = []
        for _ in range(2):
            a, b = rng.choice(sorted(edges))
            if rng.random() < 0.5:
                a, b = b, a
            t = rng.random()
            ends.append((at[a][0] + t * (at[b][0] - at[a][0]), at[a][1] + t * (at[b][1] - at[a][1]), a, b))
        if k % 9 == 0:
            ends[1] = ends[0]
        (y0, x0, a, b), (y1, x1, c, d) = ends
        out.append((k, y0 + 1e-4, x0, T0, y1, x1 + 1e-4, T0 + timedelta(seconds=rng.choice([0, 10, 61, 600])), y0, x0, a, b, y1, x1, c, d))
    return out


def plain_route(at, adj, p, budget=100):
    s, a, e, b = p[7:9], set(p[9:11]), p[11:13], set(p[13:15])
    if a == b:
        return []
    if a & b:
        return [*(a & b)]
    found, direct = dijkstra(adj, a, b, budget), m(s, e)
    if not found or (direct > 30 and found[1] / 1000 > 1.8 * direct):
        return None
    for n in found[0]:
        dy, dx = e[0] - s[0], e[1] - s[1]
        t = 0 if dy * dy + dx * dx < 1e-14 else min(1, max(0, ((at[n][0] - s[0]) * dy + (at[n][1] - s[1]) * dx) / (dy * dy + dx * dx)))
        if m(at[n], (s[0] + t * dy, s[1] + t * dx)) > max(150, direct / 2):
            return None
    return found[0]


def test_routes_like_plain(spark):
    rng = random.Random(5)
    at, edges = graph(rng, 80, 3)
    nodes, e = tables(spark, at, edges)
    pairs = snapped(rng, at, edges, 150)
    got = {r.pair_id: None if r.way is None else [x.node for x in r.way] for r in R.routes(spark.createDataFrame(pairs, PAIRS), nodes, e, metres=0.001).collect()}
    want = {p[0]: plain_route(at, adjacency(edges), p) for p in pairs}
    assert got == want and sum(w is None for w in want.values()) > 10 and sum(len(w or []) > 2 for w in want.values()) > 10


def plain_dense(path, spacing, most):
    out = [path[0]]
    for a, b in zip(path, path[1:]):
        n = int(m(a, b) // spacing)
        for k in range(1, n + 1):
            if len(out) < most - 1:
                out.append((a[0] + (b[0] - a[0]) * k / (n + 1), a[1] + (b[1] - a[1]) * k / (n + 1)))
        if len(out) < most:
            out.append(b)
    return out


def plain_trace(at, adj, p):
    direct, s, e, a, b = m(p[1:3], p[4:6]), p[7:9], p[11:13], set(p[9:11]), set(p[13:15])
    if direct < 30 or p[6] <= p[3]:
        return []
    found = [] if a == b else [*(a & b)] if a & b else (fewest(adj, a, b, 100) or [[]])[0]
    path = [s]
    for q in [*(at[n] for n in found), e]:
        if q != path[-1]:
            path.append(q)
    if sum(map(m, path, path[1:])) > 3 * direct:
        return []
    dense = plain_dense(path, 25.0, 20)
    return [(k, round(q[0], 9), round(q[1], 9), p[3] + timedelta(milliseconds=math.floor((p[6] - p[3]).total_seconds() * (k / (len(dense) - 1)) * 1000 + 1e-6))) for k, q in enumerate(dense) if k]


def test_traces_like_plain(spark):
    rng = random.Random(6)
    at, edges = graph(rng, 80, 3)
    nodes, e = tables(spark, at, edges)
    pairs = snapped(rng, at, edges, 120)
    got = {}
    for r in R.traced(spark.createDataFrame(pairs, PAIRS), nodes, e).collect():
        got.setdefault(r.pair_id, []).append((r.seq, round(r.lat, 9), round(r.lon, 9), r.ts))
    want = {p[0]: w for p in pairs if (w := plain_trace(at, adjacency(edges), p))}
    assert {k: sorted(v) for k, v in got.items()} == want and len(want) > 30 and len(want) < len(pairs)


L_ROAD = {0: (40.0, -111.0), 1: (40.0, -110.995), 2: (40.005, -110.995)}
BEND = {0: (40.000, -111.000), 1: (40.002, -110.998), 2: (40.005, -110.996), 3: (40.008, -110.994), 4: (40.010, -110.990)}


@pytest.mark.parametrize("at, first, last, most", [(L_ROAD, (0, 1), (1, 2), 30), (BEND, (0, 1), (3, 4), 50)])
def test_corner_and_bend_are_followed(spark, at, first, last, most):
    edges = {(i, i + 1): int(m(at[i], at[i + 1]) * 1000) for i in range(len(at) - 1)}
    s, e = at[0], at[len(at) - 1]
    pair = (1, *s, T0, *e, T0 + timedelta(minutes=5), *s, *first, *e, *last)
    got = R.traced(spark.createDataFrame([pair], PAIRS), *tables(spark, at, edges), max_points=most).orderBy("seq").collect()
    assert len(got) > 3 and got[-1].ts == T0 + timedelta(minutes=5) and (got[-1].lat, got[-1].lon) == e
    for n in at.values():
        assert n == s or min(m(n, (r.lat, r.lon)) for r in got) < 30


def test_near_places_and_times_that_stand_still_have_no_trace(spark):
    at, edges = {0: (40.0, -111.0), 1: (40.0, -110.99)}, {(0, 1): 900_000}
    near = (1, 40.0, -111.0, T0, 40.0001, -111.0001, T0 + timedelta(minutes=1), 40.0, -111.0, 0, 1, 40.0, -111.0, 0, 1)
    still = (2, 40.0, -111.0, T0, 40.0, -110.99, T0, 40.0, -111.0, 0, 1, 40.0, -110.99, 0, 1)
    assert R.traced(spark.createDataFrame([near, still], PAIRS), *tables(spark, at, edges)).count() == 0


def test_trails_get_the_corners_of_their_ways(spark):
    rng = random.Random(8)
    at, edges = graph(rng, 80, 3)
    adj = adjacency(edges)
    places = [(p[7:9], p[9], p[10]) for p in snapped(rng, at, edges, 60)]
    rows, snaps = [], []
    for k, (q, a, b) in enumerate(places):
        rows.append((f"v{k % 3}", k, T0 + timedelta(seconds=7 * k), q[0] + 1e-4, q[1]))
        if k % 5:
            snaps.append((k, *q, a, b))
    nodes, e = tables(spark, at, edges)
    got = R.on_roads(spark.createDataFrame(rows, "sensor_id string, reading_id long, ts timestamp_ntz, lat double, lon double"), spark.createDataFrame(snaps, "reading_id long, lat double, lon double, src long, dst long"), nodes, e, "sensor_id", metres=0.001)
    by, want = {s[0]: s for s in snaps}, []
    for v in range(3):
        own = [r for r in rows if r[0] == f"v{v}"]
        for i, r in enumerate(own):
            s, before = by.get(r[1]), by.get(own[i - 1][1]) if i else None
            way = None
            if s and before:
                way = plain_route(at, adj, (0,) * 7 + (before[1], before[2], before[3], before[4], s[1], s[2], s[3], s[4]))
            if way:
                path = [before[1:3], *(at[n] for n in way), s[1:3]]
                far = [0.0]
                for a, b in zip(path, path[1:]):
                    far.append(far[-1] + m(a, b))
                t0, t1 = own[i - 1][2], r[2]
                want += [(r[1], k, round(at[n][0], 9), round(at[n][1], 9), t0 + timedelta(milliseconds=math.floor((t1 - t0).total_seconds() * (far[k] / far[-1]) * 1000 + 1e-6)), False) for k, n in enumerate(way, 1)]
            moved = bool(s and (way or not i))
            want.append((r[1], None, round((s if moved else r[2:])[1], 9), round((s if moved else r[2:])[2], 9), r[2], moved))
    found = [(r.reading_id, r.corner, round(r.lat, 9), round(r.lon, 9), r.ts, r.moved) for r in got.collect()]
    assert sorted(found, key=str) == sorted(want, key=str) and len(found) > len(rows)


def test_no_pairs(spark):
    nodes, e = tables(spark, L_ROAD, {(0, 1): 5})
    empty = spark.createDataFrame([], PAIRS)
    assert R.routes(empty, nodes, e).count() == 0 and R.traced(empty, nodes, e).count() == 0


def test_densified_steps_without_length(spark):
    rows = [("p", i, 40.0 + (i // 2) * 0.001, -111.0) for i in range(8)]
    got = R.densified(spark.createDataFrame(rows, "p string, seq int, lat double, lon double"), "p", max_points=7).orderBy("seq").collect()
    want = plain_dense([(40.0 + i * 0.001, -111.0) for i in range(4)], 25.0, 7)
    assert [(round(r.lat, 9), r.lon) for r in got] == [(round(a, 9), b) for a, b in want] and {r.n for r in got} == {len(want)}


def test_long_steps_make_no_more_points_than_stay(spark):
    """A step of 20,000 km has 800,000 spacings; 20 points stay, so no more are made."""
    from aerolith.operators.routes import densified

    paths = spark.createDataFrame([(k, s, 0.0, float(x)) for k in range(200) for s, x in enumerate((0.0, 0.001, 0.001, 170.0))], "path int, seq int, lat double, lon double")
    got = {}
    for r in densified(paths, "path").collect():
        got.setdefault(r.path, []).append((r.seq, r.n, round(r.lon, 6)))
    assert len(got) == 200
    for rows in got.values():
        rows.sort()
        assert [r[0] for r in rows] == list(range(20)) and {r[1] for r in rows} == {20} and rows[0][2] == 0 and rows[-1][2] == 170.0 and rows[5][2] == 0.001
