"""Cleaning the graph of a line: long and skipping edges, crowded nodes, parallel nodes, gaps between components.

nodes: node, lat, lon, elev. edges: src, dst (src < dst, each pair once), dist_m. Every step takes and gives such tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import bearing_deg, haversine_m
from ..session import discard, stored
from .components import connected_components
from .spatial import near_pairs


def both_ways(edges: DataFrame) -> DataFrame:
    """node, to, dist_m from both ends of each edge."""
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("to"), "dist_m").unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("to"), "dist_m"))


def without_long_edges(edges: DataFrame, *, most_m: float = 500.0, force_m: float = 800.0, hops: int = 6) -> DataFrame:
    """Edges over force_m go, and those over most_m whose ends are joined by up to ``hops`` other edges.

    Only long edges are followed, from both ends to the middle: a row for each node within half the hops of an end. All
    edges are judged by the graph as it was."""
    to = both_ways(edges).select(F.col("node").alias("at"), "to")
    own = (F.least("at", "to") == F.col("src")) & (F.greatest("at", "to") == F.col("dst"))
    long = edges.where((F.col("dist_m") > most_m) & (F.col("dist_m") <= force_m)).select("src", "dst")
    halves = []
    for start, steps in (("src", (hops + 1) // 2), ("dst", hops // 2)):
        met = long.select("src", "dst", F.col(start).alias("at"))
        for _ in range(steps):
            on = met.join(to, "at").where(~own).select("src", "dst", F.col("to").alias("at"))
            met = met.unionByName(on).distinct()
        halves.append(met)
    around = halves[0].join(halves[1], ["src", "dst", "at"]).select("src", "dst").distinct()
    return edges.where(F.col("dist_m") <= force_m).join(around, ["src", "dst"], "left_anti")


def without_skip_edges(edges: DataFrame, *, ratio: float = 1.5) -> DataFrame:
    """Edges a-c go if for some b the edges a-b and b-c are shorter together than ``ratio`` times a-c. All edges are judged
    by the graph as it was. Triangles are found at the edges to be judged, by two joins."""
    to = both_ways(edges)
    ab = edges.select("src", "dst", F.col("dist_m").alias("ac")).join(to.select(F.col("node").alias("src"), F.col("to").alias("b"), F.col("dist_m").alias("ab")), "src").where((F.col("b") != F.col("dst")) & (F.col("ab") < F.col("ac") * ratio))
    abc = ab.join(to.select(F.col("node").alias("b"), F.col("to").alias("dst"), F.col("dist_m").alias("bc")), ["b", "dst"])
    skip = abc.where(F.col("ab") + F.col("bc") < F.col("ac") * ratio).select("src", "dst").distinct()
    return edges.join(skip, ["src", "dst"], "left_anti")


def pruned_crowded_nodes(nodes: DataFrame, edges: DataFrame, *, most: int = 3) -> DataFrame:
    """Nodes with more than ``most`` edges keep the two that are most opposite, less a degree for each 1,000 m of them, and
    the shortest of the others (if most is 3 or more).

    Nodes are taken in their order, as each one's edges depend on what the ones before have left. A node can be settled
    when no node before it is crowded and joined to it; all such nodes are settled in one round, and nodes that aren't
    crowded never become so. Pairs of a node's edges are compared, so that work grows with the square of its degree."""
    place = nodes.select("node", "lat", "lon")
    edges, done = stored(edges.select("src", "dst", "dist_m"), "edges"), None
    while True:
        to = both_ways(edges)
        crowded = to.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > most).select("node")
        if done is not None:
            crowded = crowded.join(done, "node", "left_anti")
        crowded = stored(crowded, "crowded")
        if crowded.isEmpty():
            return edges
        waits = to.where("to < node").join(crowded, "node", "left_semi").join(crowded.withColumnRenamed("node", "to"), "to", "left_semi").select("node").distinct()
        ready = crowded.join(waits, "node", "left_anti")
        own = to.join(ready, "node", "left_semi").join(place, "node").join(place.select(F.col("node").alias("to"), F.col("lat").alias("tlat"), F.col("lon").alias("tlon")), "to")
        own = stored(own.select("node", "to", "dist_m", bearing_deg(F.col("lat"), F.col("lon"), F.col("tlat"), F.col("tlon")).alias("course")), "crowded_edges")
        x, y = own.alias("x"), own.alias("y")
        turn = F.abs(F.col("x.course") - F.col("y.course"))
        score = F.least(turn, 360.0 - turn) - (F.col("x.dist_m") + F.col("y.dist_m")) / 1000.0
        pairs = x.join(y, (F.col("x.node") == F.col("y.node")) & (F.col("x.to") < F.col("y.to"))).where(score > 0)
        best = pairs.groupBy(F.col("x.node").alias("node")).agg(F.min(F.struct((-score).alias("s"), F.col("x.to").alias("a"), F.col("y.to").alias("b"))).alias("m")).select("node", "m.a", "m.b")
        rest = own.join(best, "node").where("to <> a AND to <> b").withColumn("i", F.row_number().over(Window.partitionBy("node").orderBy("dist_m", "to")))
        gone = rest.where(F.col("i") > (1 if most >= 3 else 0)).select(F.least("node", "to").alias("src"), F.greatest("node", "to").alias("dst")).distinct()
        edges, before = stored(edges.join(gone, ["src", "dst"], "left_anti"), "edges"), edges
        settled = stored(ready if done is None else done.unionByName(ready), "settled")
        for t in (before, crowded, own, *([done] if done is not None else [])):
            discard(t)
        done = settled


def collapsed_parallel_nodes(nodes: DataFrame, edges: DataFrame, *, radius_m: float = 50.0, elev_m: float = 20.0) -> tuple[DataFrame, DataFrame]:
    """Nodes within the radius, over any number of steps, become one in their middle; its name is the smallest of them.

    Two nodes count only if their elevations are near each other, or one's is 0. Edges are measured anew."""
    same = (F.abs(F.col("a.elev") - F.col("b.elev")) < elev_m) | (F.col("a.elev") == 0) | (F.col("b.elev") == 0)
    pairs = near_pairs(nodes, nodes, radius_m).where((F.col("a.node") < F.col("b.node")) & (F.col("dist_m") < radius_m) & same)
    groups = connected_components(pairs.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")))
    of = stored(nodes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")), "nodes")
    middle = stored(of.groupBy("component").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.avg("elev").alias("elev")).withColumnRenamed("component", "node"), "middles")
    name = of.select("node", "component")
    moved = edges.join(name.withColumnsRenamed({"node": "src", "component": "a"}), "src").join(name.withColumnsRenamed({"node": "dst", "component": "b"}), "dst").where("a <> b")
    moved = moved.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
    end = lambda c, s: middle.select(F.col("node").alias(c), F.col("lat").alias(f"{s}lat"), F.col("lon").alias(f"{s}lon"))
    dist = haversine_m(F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon"))
    return middle, moved.join(end("src", "a"), "src").join(end("dst", "b"), "dst").select("src", "dst", dist.alias("dist_m"))


def bridged_components(nodes: DataFrame, edges: DataFrame, *, radius_m: float = 500.0) -> DataFrame:
    """Edges and the shortest new ones, below the radius, that join what components they can.

    As if the two nearest components were joined again and again. In a round, every component takes its nearest other one
    (by distance and nodes); the number of components at least halves each time that one finds another."""
    near = near_pairs(nodes.select("node", "lat", "lon"), nodes.select("node", "lat", "lon"), radius_m).where((F.col("a.node") < F.col("b.node")) & (F.col("dist_m") < radius_m))
    near = stored(near.select(F.col("a.node").alias("src"), F.col("b.node").alias("dst"), "dist_m"), "near")
    found = connected_components(edges, "src", "dst")
    of = stored(nodes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("c")), "components")
    new = None
    while True:
        pairs = near.join(of.withColumnsRenamed({"node": "src", "c": "ca"}), "src").join(of.withColumnsRenamed({"node": "dst", "c": "cb"}), "dst").where("ca <> cb")
        across = stored(pairs.select("src", "dst", "dist_m", "ca", "cb"), "near")  # pairs inside a component don't come back
        best = F.min(F.struct("dist_m", "src", "dst", "ca", "cb")).alias("m")
        ends = across.select("*", F.explode(F.array("ca", "cb")).alias("c"))
        taken = stored(ends.groupBy("c").agg(best).select("m.*").distinct(), "bridges")
        near = across.drop("ca", "cb")
        if taken.isEmpty():
            out = edges.select("src", "dst", "dist_m")
            return out if new is None else out.unionByName(new)
        new = taken.select("src", "dst", "dist_m") if new is None else new.unionByName(taken.select("src", "dst", "dist_m"))
        joined = connected_components(taken, "ca", "cb").withColumnsRenamed({"node": "c", "component": "to"})
        of = stored(of.join(joined, "c", "left").select("node", F.coalesce("to", "c").alias("c")), "components")
