import math
import random

import pytest

from aerolith.operators import line_graph as L
from aerolith.operators.trails import metres


def m(a, b):
    return float(metres(a[0], a[1], b[0], b[1]))


def bearing(lat1, lon1, lat2, lon2):
    a, b, d = math.radians(lat1), math.radians(lat2), math.radians(lon2 - lon1)
    return math.degrees(math.atan2(math.sin(d) * math.cos(b), math.cos(a) * math.sin(b) - math.sin(a) * math.cos(b) * math.cos(d))) % 360


def world(seed, n=70, links=4):
    rng = random.Random(seed)
    at = {i: (40 + rng.random() / 60, -111 - rng.random() / 60, rng.choice([0.0, 5.0, 30.0, 60.0])) for i in range(n)}
    edges = {}
    for i in at:
        for j in sorted(at, key=lambda j: m(at[i], at[j]))[1 : 1 + rng.randint(0, links)]:
            edges[min(i, j), max(i, j)] = m(at[i], at[j]) * rng.choice([1, 1.3])
    return at, edges


def tables(spark, at, edges):
    return spark.createDataFrame([(i, *p) for i, p in at.items()], "node long, lat double, lon double, elev double"), spark.createDataFrame([(*k, d) for k, d in edges.items()], "src long, dst long, dist_m double")


def as_dict(df):
    rows = df.collect()
    assert len({(r.src, r.dst) for r in rows}) == len(rows)
    return {(r.src, r.dst): round(r.dist_m, 6) for r in rows}


def rounded(edges):
    return {k: round(d, 6) for k, d in edges.items()}


def adjacent(edges):
    adj = {}
    for (a, b), d in edges.items():
        adj.setdefault(a, {})[b] = d
        adj.setdefault(b, {})[a] = d
    return adj


def steps(edges, a, b):
    adj, level, met, k = adjacent({e: d for e, d in edges.items() if e != (a, b)}), {a}, {a}, 0
    while level and b not in met:
        level, k = {y for x in level for y in adj.get(x, {})} - met, k + 1
        met |= level
    return k if b in met else 10**9


@pytest.mark.parametrize("hops", [5])
def test_long_edges(spark, hops):
    at, edges = world(hops)
    want = {e: d for e, d in edges.items() if d <= 200 or (d <= 420 and steps(edges, *e) > hops)}
    got = as_dict(L.without_long_edges(tables(spark, at, edges)[1], most_m=200.0, force_m=420.0, hops=hops))
    assert got == rounded(want) and len(want) < len(edges) and any(d > 200 for d in want.values())


def test_skip_edges(spark):
    at, edges = world(3)
    adj = adjacent(edges)
    want = {(a, c): d for (a, c), d in edges.items() if not any(b != c and c in adj[b] and x + adj[b][c] < 1.5 * d for b, x in adj[a].items())}
    assert as_dict(L.without_skip_edges(tables(spark, at, edges)[1])) == rounded(want) and len(want) < len(edges)


def plain_prune(at, edges, most):
    adj = adjacent(edges)
    for i in sorted(adj):
        if len(adj[i]) <= most:
            continue
        own = sorted(adj[i].items())
        best, keep = 0, None
        for x, (j, d) in enumerate(own):
            for k, e in own[x + 1 :]:
                turn = abs(bearing(*at[i][:2], *at[j][:2]) - bearing(*at[i][:2], *at[k][:2]))
                score = min(turn, 360 - turn) - (d + e) / 1000
                if score > best:
                    best, keep = score, {j, k}
        if keep:
            rest = sorted((d, j) for j, d in own if j not in keep)
            keep |= {j for _, j in rest[: 1 if most >= 3 else 0]}
            for j, _ in own:
                if j not in keep:
                    del adj[i][j], adj[j][i]
    return {(a, b): d for a in adj for b, d in adj[a].items() if a < b}


@pytest.mark.parametrize("most", [3])
def test_crowded_nodes_as_one_after_the_other(spark, most):
    at, edges = world(11, n=40, links=6)
    at |= {k: (41.0 + k / 1e5, -111.0, 0.0) for k in range(100, 106)}  # all on one side: none is opposite
    edges |= {(100, k): 10.0 * k for k in range(101, 106)}
    want = plain_prune(at, edges, most)
    assert as_dict(L.pruned_crowded_nodes(*tables(spark, at, edges), most=most)) == rounded(want) and len(want) < len(edges)


def test_parallel_nodes(spark):
    at, edges = world(5)
    group = {i: i for i in at}
    for _ in at:
        for i in at:
            for j in at:
                near = m(at[i], at[j]) < 120 and (abs(at[i][2] - at[j][2]) < 20 or 0 in (at[i][2], at[j][2]))
                if i == j or near:
                    group[i] = min(group[i], group[j])
    members = {g: [at[i] for i in at if group[i] == g] for g in set(group.values())}
    middle = {g: tuple(sum(x[k] for x in ms) / len(ms) for k in range(3)) for g, ms in members.items()}
    want = {(min(a, b), max(a, b)): m(middle[a], middle[b]) for (i, j) in edges if (a := group[i]) != (b := group[j])}
    nodes, got = L.collapsed_parallel_nodes(*tables(spark, at, edges), radius_m=120.0)
    assert {r.node: tuple(round(x, 9) for x in r[1:]) for r in nodes.collect()} == {g: tuple(round(x, 9) for x in p) for g, p in middle.items()}
    assert as_dict(got) == rounded(want) and 5 < len(middle) < len(at) - 5


def test_components_are_bridged(spark):
    at, edges = world(9, links=1)
    part = {i: i for i in at}

    def join(a, b):
        old, new = part[a], part[b]
        for i in part:
            if part[i] == old:
                part[i] = new

    for a, b in edges:
        join(a, b)
    before, want = len(set(part.values())), dict(edges)
    for d, a, b in sorted((m(at[a], at[b]), a, b) for a in at for b in at if a < b):
        if d < 220 and part[a] != part[b]:
            want[a, b] = d
            join(a, b)
    assert as_dict(L.bridged_components(*tables(spark, at, edges), radius_m=220.0)) == rounded(want)
    assert before - 1 > len(want) - len(edges) > 5


def test_no_edges(spark):
    nodes, edges = tables(spark, {1: (40.0, -111.0, 0.0)}, {})
    for got in (L.without_long_edges(edges), L.without_skip_edges(edges), L.pruned_crowded_nodes(nodes, edges), L.collapsed_parallel_nodes(nodes, edges)[1], L.bridged_components(nodes, edges)):
        assert got.count() == 0
