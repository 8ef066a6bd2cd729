"""Ways along a graph between snapped points: bounded shortest paths, traces and trails with corners.

A leg is a pair of edges, from which and to which a way is looked for; pairs of points with the same edges share one. Its
state is a row for each node met: the distance and the node before. A relaxation joins the rows that have just improved
with the edges, and keeps the best row of each node. A leg's rows are bounded: nodes are ordered as a best-first search
would take them, and one is dropped if the nodes before it have ``most_edges`` ends of edges or more, if a goal comes before
it, or if it is farther than the longest detour allowed. (Distances only shrink, so what is dropped for good reason stays
so.) Found ways are laid out by doubling the pointers to the node before. No graph or leg is in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_m, project_to_segment
from ..functions.time import seconds
from ..session import discard, stored

#: Relaxations between two stored tables.
HOPS = 2


def neighbours(edges: DataFrame) -> DataFrame:
    """src, dst, w, deg (of dst), own: each edge from both ends, and each node to itself (own)."""
    both = edges.select("src", "dst", F.col("dist").alias("w")).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("dist").alias("w")))
    degree = both.groupBy(F.col("src").alias("dst")).agg(F.count("*").alias("deg"))
    to = both.join(degree, "dst").select("src", "dst", "w", "deg", F.lit(False).alias("own"))
    return stored(to.unionByName(degree.select(F.col("dst").alias("src"), "dst", F.lit(None).alias("w"), "deg", F.lit(True).alias("own"))), "neighbours")


def relaxed(state: DataFrame, to: DataFrame, by_hops: bool, most_edges: int) -> DataFrame:
    """One step of all legs: improved rows are led on to their neighbours, and every node keeps its best row."""
    live = F.col("fresh") & (F.col("node") != F.col("b1")) & (F.col("node") != F.col("b2"))
    step = F.lit(1) if by_hops else F.col("w")
    row = F.when(F.col("own"), F.struct("d", "rank", "parent", F.lit(False).alias("fresh"))).otherwise(
        F.struct((F.col("d") + step).cast(state.schema["d"].dataType).alias("d"), F.col("place" if by_hops else "d").cast(state.schema["rank"].dataType).alias("rank"), F.col("node").alias("parent"), F.lit(True).alias("fresh")))
    met = state.join(to.withColumnRenamed("deg", "dst_deg"), (F.col("node") == F.col("src")) & (F.col("own") | live)).select("leg", "b1", "b2", "most", F.col("dst").alias("node"), F.col("dst_deg").alias("deg"), row.alias("row"))
    best = met.groupBy("leg", "node").agg(F.min("row").alias("row"), *(F.first(c).alias(c) for c in ("b1", "b2", "most", "deg")))
    best = best.select("leg", "b1", "b2", "most", "node", "deg", "row.*")
    key = ["d", "rank", "node"] if by_hops else ["d", "node"]
    w = Window.partitionBy("leg").orderBy(*key)
    goal = F.min(F.when((F.col("node") == F.col("b1")) | (F.col("node") == F.col("b2")), F.struct(*key))).over(Window.partitionBy("leg"))
    seen = F.coalesce(F.sum("deg").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    best = best.withColumns({"place": F.row_number().over(w), "goal": goal, "seen": seen})
    keep = (F.col("seen") < most_edges) & (F.col("goal").isNull() | (F.struct(*key) <= F.col("goal"))) & (F.col("most").isNull() | (F.col("d") <= F.col("most")))
    return best.where(keep).drop("goal", "seen")


def ways(legs: DataFrame, edges: DataFrame, *, by_hops: bool = False, most_edges: int = 100) -> DataFrame:
    """leg, seq (from 0), node, total of the best way from a1 or a2 to b1 or b2, for legs that have one.

    legs: leg, a1, a2, b1, b2, most (longest way, null: any). edges: src, dst, dist (a number above 0; whole numbers make
    equal ways exactly equal), each pair once. A way's nodes include both ends; the start edge itself counts nothing. The
    goal must come before ``most_edges`` ends of edges have been looked at, in the order of distance and node (of hops: as
    a queue would take them, with neighbours by their name). Of equally long ways the one is taken whose last step starts
    from the node that comes first."""
    to = neighbours(edges)
    kind = edges.schema["dist"].dataType.simpleString()
    d = F.lit(0).cast("long" if by_hops else kind)
    degree = to.where("own").select(F.col("src").alias("node"), "deg")
    state = legs.select("leg", "b1", "b2", "most", F.explode(F.array_distinct(F.array("a1", "a2"))).alias("node")).join(degree, "node")
    place = F.row_number().over(Window.partitionBy("leg").orderBy("node"))
    state = stored(state.select("leg", "b1", "b2", "most", "node", "deg", d.alias("d"), d.alias("rank"), F.lit(None).cast(edges.schema["src"].dataType).alias("parent"), F.lit(True).alias("fresh"), place.alias("place")), "ways")
    while True:  # as often as a way has steps, most_edges at most
        new = state
        for _ in range(HOPS):
            new = relaxed(new, to, by_hops, most_edges)
        new = stored(new, "ways")
        discard(state)
        state = new
        if state.where("fresh AND node <> b1 AND node <> b2").isEmpty():
            break
    goals = state.where("node = b1 OR node = b2")  # one a leg: what comes after it was dropped
    path = stored(goals.select("leg", "node", F.lit(0).alias("back"), F.col("d").alias("total")), "path")
    up = stored(state.where("parent IS NOT NULL").select("leg", "node", F.col("parent").alias("up")).join(goals.select("leg"), "leg", "left_semi"), "up")
    far = 1
    while True:  # once for each bit of a way's length
        more = stored(path.join(up, ["leg", "node"]).select("leg", F.col("up").alias("node"), (F.col("back") + far).alias("back"), "total"), "path")
        if more.isEmpty():
            break
        path = path.unionByName(more)
        up = stored(up.alias("x").join(up.alias("y"), (F.col("x.leg") == F.col("y.leg")) & (F.col("x.up") == F.col("y.node"))).select("x.leg", "x.node", "y.up"), "up")
        far *= 2
    last = F.max("back").over(Window.partitionBy("leg"))
    return path.select("leg", (last - F.col("back")).alias("seq"), "node", "total")


def _ends(pairs: DataFrame) -> DataFrame:
    """Ends of edges in order, and how a pair's edges meet: shared_node (null: they don't), same_edge."""
    a1, a2, b1, b2 = F.least("sa", "sb"), F.greatest("sa", "sb"), F.least("ea", "eb"), F.greatest("ea", "eb")
    p = pairs.withColumns({"a1": a1, "a2": a2, "b1": b1, "b2": b2})
    shared = F.when(F.col("a1").isin(F.col("b1"), F.col("b2")), F.col("a1")).when(F.col("a2").isin(F.col("b1"), F.col("b2")), F.col("a2"))
    return p.withColumns({"same_edge": (F.col("a1") == F.col("b1")) & (F.col("a2") == F.col("b2")), "shared_node": shared, "direct_m": haversine_m(F.col("slat"), F.col("slon"), F.col("elat"), F.col("elon"))})


def _way_of_pairs(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, most: Column, by_hops: bool, most_edges: int, names: list[str]) -> DataFrame:
    """The pairs with way: their nodes (an array of seq, node, lat, lon; empty on one edge, null: none found) and total."""
    p = _ends(pairs)
    ends = ["a1", "a2", "b1", "b2"]
    legs = p.where("shared_node IS NULL").groupBy(*ends).agg(F.when(F.count(most) == F.count("*"), F.max(most)).alias("most"))
    legs = stored(legs.withColumn("leg", F.monotonically_increasing_id()), "legs")
    found = ways(legs, edges, by_hops=by_hops, most_edges=most_edges).join(nodes.select("node", "lat", "lon"), "node")
    # most_edges nodes at most
    found = found.groupBy("leg").agg(F.sort_array(F.collect_list(F.struct((F.col("seq") + 1).alias("seq"), "node", "lat", "lon"))).alias("way"), F.max("total").alias("total"))
    found = stored(legs.join(found, "leg").drop("leg", "most"), "found")
    corner = nodes.select(F.col("node").alias("corner"), F.array(F.struct(F.lit(1).alias("seq"), "node", "lat", "lon")).alias("at_corner"))
    out = p.join(found, ends, "left").join(corner, (F.col("shared_node") == F.col("corner")) & ~F.col("same_edge"), "left")
    none = F.array().cast(found.schema["way"].dataType)
    return out.withColumn("way", F.when(F.col("same_edge"), none).when(F.col("shared_node").isNotNull(), F.col("at_corner")).otherwise(F.col("way"))).select(*names, "shared_node", "same_edge", "direct_m", "way", "total")


def routes(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, *, metres: float = 1.0, most_edges: int = 100, detour: float = 1.8, least_m: float = 30.0, aside_m: float = 150.0, aside: float = 0.5) -> DataFrame:
    """pairs with direct_m, way and path_m: the shortest way between the snapped ends.

    pairs: slat, slon, sa, sb (a place and the ends of its edge), elat, elon, ea, eb, and columns of their own. way is an
    array of seq, node, lat, lon without the ends themselves: empty where both are on one edge, the corner where the edges
    share a node, else the shortest way (path_m) from an end of one edge to one of the other; null where there is none within
    most_edges, where it is longer than the detour allowed of more than least_m, or where a node of it is farther from the
    straight line than aside_m and a part of its length. metres: one unit of edges.dist in metres."""
    most = F.when(F.col("direct_m") > least_m, F.col("direct_m") * detour / metres)
    w = _way_of_pairs(pairs, nodes, edges, most, False, most_edges, pairs.columns)
    path_m = F.col("total") * metres
    limit = F.greatest(F.lit(aside_m), F.col("direct_m") * aside)

    def off(n: Column) -> Column:
        on = project_to_segment(n["lat"], n["lon"], F.col("slat"), F.col("slon"), F.col("elat"), F.col("elon"))
        return haversine_m(n["lat"], n["lon"], on["lat"], on["lon"]) > limit

    bad = F.col("shared_node").isNull() & (((F.col("direct_m") > least_m) & (path_m > F.col("direct_m") * detour)) | F.exists("way", off))
    return w.select(*pairs.columns, "direct_m", F.when(~F.coalesce(bad, F.lit(False)), F.col("way")).alias("way"), F.when(~F.coalesce(bad, F.lit(False)), path_m).alias("path_m"))


def densified(paths: DataFrame, *by: str, spacing_m: float = 25.0, max_points: int = 20) -> DataFrame:
    """by, seq (from 0), n, lat, lon: points of paths (by, seq, lat, lon) and more between them, at most max_points.

    A step of several spacings is cut evenly; points beyond the number are left out, but for the end of the step then under
    way. Steps without length have no points of their own."""
    w = Window.partitionBy(*by).orderBy("seq")
    steps = paths.withColumns({"plat": F.lag("lat").over(w), "plon": F.lag("lon").over(w)})
    far = haversine_m(F.col("plat"), F.col("plon"), F.col("lat"), F.col("lon"))
    steps = steps.withColumn("far", far).where("plat IS NULL OR far > 0")
    inner = F.when(F.col("plat").isNull(), 0).otherwise(F.floor(F.col("far") / max(1.0, spacing_m)))
    steps = steps.withColumn("inner", inner.cast("int"))
    # points of a step are counted before they are made, so that a long one makes no more than stay
    before = F.coalesce(F.sum(F.col("inner") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum(F.col("inner") + 1).over(Window.partitionBy(*by))
    steps = steps.withColumns({"before": before, "n": F.least(total, F.lit(max_points))}).where(F.col("before") < max_points)
    early = F.least(F.col("inner") + 1, max_points - 1 - F.col("before")).cast("int")
    ks = F.when(early > 0, F.sequence(F.lit(1), early)).otherwise(F.array().cast("array<int>"))
    k = F.explode(F.when(early <= F.col("inner"), F.concat(ks, F.array(F.col("inner") + 1))).otherwise(ks)).alias("k")
    at = steps.select("*", k)
    part = F.col("k") / (F.col("inner") + 1)
    ends = F.col("k") == F.col("inner") + 1
    along = lambda a, b: F.when(ends, F.col(b)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * part)
    i = F.least(F.col("before") + F.col("k") - 1, F.lit(max_points - 1)).cast("int")
    return at.select(*by, i.alias("seq"), "n", along("plat", "lat").alias("lat"), along("plon", "lon").alias("lon"))


def _as_path(w: DataFrame, *by: str) -> DataFrame:
    """by, seq, lat, lon: the start, the way's nodes and the end, without repeats of the place before."""
    place = lambda lat, lon: F.struct(F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    inner = F.transform(F.coalesce("way", F.array().cast(w.schema["way"].dataType)), lambda n: F.struct(n["lat"].alias("lat"), n["lon"].alias("lon")))
    every = F.concat(F.array(place("slat", "slon")), inner, F.array(place("elat", "elon")))
    # shuffled before its places are rows: the windows over them need no other shuffle
    rows = w.select(*by, every.alias("every")).repartition(F.col(by[0])).select(*by, F.posexplode("every").alias("seq", "p")).select(*by, "seq", "p.lat", "p.lon")
    o = Window.partitionBy(*by).orderBy("seq")
    return rows.withColumns({"plat": F.lag("lat").over(o), "plon": F.lag("lon").over(o)}).where("plat IS NULL OR lat <> plat OR lon <> plon").drop("plat", "plon")


def traced(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, *, most_edges: int = 100, least_m: float = 30.0, longest: float = 3.0, spacing_m: float = 25.0, max_points: int = 20) -> DataFrame:
    """pair_id, seq (from 1), lat, lon, ts: points along the graph from one place to another, the first left out.

    pairs: as in ``routes``, with pair_id, lat0, lon0, ts0, lat1, lon1, ts1 (the places before snapping). The way with the
    fewest steps is followed; without one the points go straight. Times are shared evenly among the points. Pairs have none
    that are nearer than least_m, don't go forward in time, or whose way is longer than ``longest`` times the direct one."""
    direct = haversine_m(F.col("lat0"), F.col("lon0"), F.col("lat1"), F.col("lon1"))
    p = pairs.where((direct >= least_m) & (F.col("ts1") > F.col("ts0")) & F.col("sa").isNotNull() & F.col("ea").isNotNull())
    w = _way_of_pairs(p, nodes, edges, F.lit(None).cast("double"), True, most_edges, p.columns)
    w = w.withColumn("gps_m", direct)
    points = _as_path(w, "pair_id", "gps_m", "ts0", "ts1")
    by = Window.partitionBy("pair_id").orderBy("seq")
    step = haversine_m(F.lag("lat").over(by), F.lag("lon").over(by), F.col("lat"), F.col("lon"))
    points = points.withColumn("step", step).withColumn("m", F.sum("step").over(Window.partitionBy("pair_id")))
    points = points.where(~F.coalesce(F.col("m") > F.col("gps_m") * longest, F.lit(False)))
    points = densified(points, "pair_id", "ts0", "ts1", spacing_m=spacing_m, max_points=max_points)
    return points.where("seq > 0").select("pair_id", "seq", "lat", "lon", between(F.col("ts0"), F.col("ts1"), F.col("seq") / (F.col("n") - 1)).alias("ts"))


def between(t0: Column, t1: Column, part: Column) -> Column:
    """The time so far between two, in whole milliseconds."""
    ms = F.floor((seconds(t1) - seconds(t0)) * part * 1000.0 + 1e-6)
    return t0 + F.make_dt_interval(secs=(ms / 1000.0).cast("decimal(18,6)"))


def on_roads(points: DataFrame, snaps: DataFrame, nodes: DataFrame, edges: DataFrame, *by: str, **options) -> DataFrame:
    """Trails moved to the graph, with its corners between their points (R7): by, reading_id, ts, lat, lon, corner, moved.

    points: by, reading_id, ts, lat, lon. snaps: reading_id, lat, lon, src, dst (the place on an edge; points without one
    stay). Between two snapped points the shortest way's nodes become points of the later reading, timed by distance. A
    point is moved if a way led to it (the first if it is snapped); where there is none, or both are on one edge, it stays."""
    o = Window.partitionBy(*by).orderBy("ts", "reading_id")
    s = snaps.select("reading_id", F.struct("lat", "lon", "src", "dst").alias("s"))
    p = points.join(s, "reading_id", "left").withColumns({"before": F.lag("s").over(o), "t0": F.lag("ts").over(o), "first": F.row_number().over(o) == 1})
    p = stored(p, "trail")
    pairs = p.where("s IS NOT NULL AND before IS NOT NULL").select("reading_id", "t0", "ts", *(F.col(f"before.{a}").alias(b) for a, b in (("lat", "slat"), ("lon", "slon"), ("src", "sa"), ("dst", "sb"))), *(F.col(f"s.{a}").alias(b) for a, b in (("lat", "elat"), ("lon", "elon"), ("src", "ea"), ("dst", "eb"))))
    w = stored(routes(pairs, nodes, edges, **options).where(F.size("way") > 0), "routes")
    path = w.select("reading_id", "t0", "ts", F.size("way").alias("k"), F.posexplode(F.concat(F.array(F.struct(F.lit(0).alias("seq"), F.col("slat").alias("lat"), F.col("slon").alias("lon"))), F.transform("way", lambda n: F.struct(n["seq"].alias("seq"), n["lat"].alias("lat"), n["lon"].alias("lon"))), F.array(F.struct(F.lit(0).alias("seq"), F.col("elat").alias("lat"), F.col("elon").alias("lon"))))).alias("seq", "n"))
    path = path.select("reading_id", "t0", "ts", "k", "seq", "n.lat", "n.lon")
    along = Window.partitionBy("reading_id").orderBy("seq")
    step = F.coalesce(haversine_m(F.lag("lat").over(along), F.lag("lon").over(along), F.col("lat"), F.col("lon")), F.lit(0.0))
    path = path.withColumn("step", step).withColumns({"so_far": F.sum("step").over(along), "total": F.sum("step").over(Window.partitionBy("reading_id"))})
    corners = path.where("seq BETWEEN 1 AND k AND total > 0").select("reading_id", between(F.col("t0"), F.col("ts"), F.col("so_far") / F.col("total")).alias("ts"), "lat", "lon", "seq")
    corners = corners.join(points.select(*by, "reading_id"), "reading_id").select(*by, "reading_id", "ts", "lat", "lon", F.col("seq").alias("corner"), F.lit(False).alias("moved"))
    led = p.join(w.select("reading_id", F.lit(True).alias("led")), "reading_id", "left").withColumn("moved", F.coalesce((F.col("led") | F.col("first")) & F.col("s").isNotNull(), F.lit(False)))
    own = led.select(*by, "reading_id", "ts", F.when(F.col("moved"), F.col("s.lat")).otherwise(F.col("lat")).alias("lat"), F.when(F.col("moved"), F.col("s.lon")).otherwise(F.col("lon")).alias("lon"), F.lit(None).cast("int").alias("corner"), "moved")
    return own.unionByName(corners)
