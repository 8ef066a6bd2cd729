"""Corridors of lines from many passes: clusters of paths, their merging, centre lines and quality.

paths: path (ordered), seq, lat, lon, elev, course (degrees). Directions are axial: both ways along a line are one. What
goes one after the other is a choice of leaders: in the order of the paths, one leads unless it matches an earlier leader.
That is settled in rounds: a path without an unsettled match before it leads, and whatever matches it doesn't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_m
from ..session import discard, stored
from .spatial import near_pairs

METRES_PER_DEGREE = 111_000.0


def axial_angle(a: Column, b: Column) -> Column:
    """Angle of two axes, 0 to 90."""
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(d, 180.0 - d)


def axis_of(course: Column) -> Column:
    """Mean axis of a group's directions, 0 to 180."""
    return F.pmod(F.degrees(F.atan2(F.sum(F.sin(F.radians(course * 2.0))), F.sum(F.cos(F.radians(course * 2.0))))) / 2.0 + 180.0, F.lit(180.0))


def leaders(nodes: DataFrame, matches: DataFrame) -> DataFrame:
    """id of the leaders. nodes: id, place (no ties). matches: a, b (ids, either way round)."""
    place = nodes.select("id", "place")
    p = matches.join(place.withColumnsRenamed({"id": "a", "place": "pa"}), "a").join(place.withColumnsRenamed({"id": "b", "place": "pb"}), "b")
    first, then = F.when(F.col("pa") < F.col("pb"), F.col("a")).otherwise(F.col("b")), F.when(F.col("pa") < F.col("pb"), F.col("b")).otherwise(F.col("a"))
    p = stored(p.where("pa <> pb").select(first.alias("first"), then.alias("then")).distinct(), "matches")
    left, out = stored(nodes.select("id"), "unsettled"), None
    while not left.isEmpty():
        new = stored(left.join(p.select(F.col("then").alias("id")).distinct(), "id", "left_anti"), "leaders")
        gone = p.join(new.withColumnRenamed("id", "first"), "first").select(F.col("then").alias("id")).distinct()
        rest = stored(left.join(new, "id", "left_anti").join(gone, "id", "left_anti"), "unsettled")
        open_ = stored(p.join(rest.withColumnRenamed("id", "first"), "first", "left_semi").join(rest.withColumnRenamed("id", "then"), "then", "left_semi"), "matches")
        discard(left)
        discard(p)
        left, p, out = rest, open_, new if out is None else out.unionByName(new)
    return nodes.select("id").limit(0) if out is None else out


def middles(paths: DataFrame, least: int = 3) -> DataFrame:
    """path, lat, lon, elev, course of the middle point of paths with enough points, and n (points)."""
    w = Window.partitionBy("path")
    rows = paths.withColumns({"i": F.row_number().over(w.orderBy("seq")) - 1, "n": F.count("*").over(w)})
    return rows.where((F.col("n") >= least) & (F.col("i") == F.floor(F.col("n") / 2))).select("path", "lat", "lon", "elev", "course", "n")


def _like(turn: float, elev_m: float | None) -> Column:
    """Whether a pair (a, b) has a like axis and elevation; an elevation of 0 or less is unknown."""
    ok = axial_angle(F.col("a.course"), F.col("b.course")) <= turn
    if elev_m is None:
        return ok
    return ok & ~((F.abs(F.col("a.elev") - F.col("b.elev")) > elev_m) & (F.col("a.elev") > 0) & (F.col("b.elev") > 0))


def corridors(paths: DataFrame, *, width_m: float = 40.0, turn: float = 45.0, elev_m: float = 30.0, least: int = 3) -> DataFrame:
    """path, corridor: the path that leads its corridor. A path follows the nearest earlier leader (by their middles) within
    the width, of a like axis and elevation; equal distances go to the earlier one. Short paths have none."""
    mid = stored(middles(paths, least), "middles")
    p = near_pairs(mid, mid, width_m).where((F.col("a.path") < F.col("b.path")) & _like(turn, elev_m))
    p = stored(p.select(F.col("a.path").alias("a"), F.col("b.path").alias("b"), "dist_m"), "near")
    led = stored(leaders(mid.select(F.col("path").alias("id"), F.col("path").alias("place")), p.select("a", "b")), "leaders")
    nearest = p.join(led.withColumnRenamed("id", "a"), "a").groupBy("b").agg(F.min(F.struct("dist_m", "a")).alias("m")).select(F.col("b").alias("path"), "m.a")
    out = mid.select("path").join(nearest, "path", "left").join(led.select(F.col("id").alias("path"), F.lit(True).alias("leads")), "path", "left")
    return out.select("path", F.when(F.col("leads"), F.col("path")).otherwise(F.col("a")).alias("corridor"))


def centres(points: DataFrame) -> DataFrame:
    """corridor, lat, lon, elev, course (axis), n of points (corridor, lat, lon, elev, course)."""
    mean = [F.avg(c).alias(c) for c in ("lat", "lon", "elev")]
    return points.groupBy("corridor").agg(*mean, axis_of(F.col("course")).alias("course"), F.count("*").alias("n"))


def merged(points: DataFrame, *, width_m: float = 60.0, turn: float = 30.0) -> DataFrame:
    """corridor, merged: corridors with more points take in those with fewer, near them and of a like axis.

    Centres and axes are those before merging. A corridor that matches several goes to the one with the most points."""
    c = stored(centres(points), "centres")
    p = near_pairs(c, c, width_m).where((F.col("a.corridor") < F.col("b.corridor")) & _like(turn, None))
    p = stored(p.select(F.col("a.corridor").alias("a"), F.col("b.corridor").alias("b")), "near")
    place = F.struct((-F.col("n")).alias("n"), F.col("corridor").alias("id"))
    nodes = c.select(F.col("corridor").alias("id"), place.alias("place"))
    led = stored(leaders(nodes, p), "leaders")
    both = p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b")))
    take = both.join(led.withColumnRenamed("id", "a"), "a").join(nodes.withColumnsRenamed({"id": "a"}), "a").groupBy("b").agg(F.min("place").alias("m")).select(F.col("b").alias("corridor"), F.col("m.id").alias("to"))
    # what leads matches no other leader
    return c.select("corridor").join(take, "corridor", "left").select("corridor", F.coalesce("to", "corridor").alias("merged"))


def centre_lines(points: DataFrame, *, bin_m: float = 15.0) -> DataFrame:
    """corridor, seq, lat, lon, elev: means of the points in bins along the corridor's axis."""
    c = centres(points).select("corridor", F.col("lat").alias("clat"), F.col("lon").alias("clon"), F.radians("course").alias("axis"))
    at = points.select("corridor", "lat", "lon", "elev").join(c, "corridor")
    at = at.withColumn("along", (F.col("lat") - F.col("clat")) * F.cos("axis") + (F.col("lon") - F.col("clon")) * F.sin("axis"))
    ends = at.groupBy("corridor").agg(F.min("along").alias("low"), F.max("along").alias("high"))
    size = bin_m / METRES_PER_DEGREE
    at = at.join(ends, "corridor").withColumn("bin", F.when(F.col("high") - F.col("low") < size, F.lit(0)).otherwise(F.floor((F.col("along") - F.col("low")) / size)))
    # a last point that begins a bin of its own belongs to the one before
    last = F.floor((F.col("high") - F.col("low")) / size)
    at = at.withColumn("bin", F.when((F.col("bin") > 0) & (F.col("bin") == last) & (F.col("high") - F.col("low") == last * size), F.col("bin") - 1).otherwise(F.col("bin")))
    means = at.groupBy("corridor", "bin").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.avg("elev").alias("elev"))
    return means.select("corridor", F.row_number().over(Window.partitionBy("corridor").orderBy("bin")).alias("seq"), "lat", "lon", "elev")


def quality(points: DataFrame, *, expected_m: float = 70_000.0, apart_m: float = 50.0, turn: float = 20.0, bin_m: float = 15.0) -> DataFrame:
    """One row: corridors, points, length_m, coverage, separation.

    coverage is the centre lines' length of what is expected; more than half as much again counts against it. separation is
    the part of parallel pairs of corridors whose centres aren't nearer than apart_m. Parallel pairs are counted by axes in
    hundredths of a degree (18,000 at most), without making the pairs."""
    line = centre_lines(points, bin_m=bin_m)
    w = Window.partitionBy("corridor").orderBy("seq")
    length = line.select(haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")).alias("m")).agg(F.coalesce(F.sum("m"), F.lit(0.0)).alias("length_m"))
    c = stored(centres(points).withColumn("axis", F.pmod(F.round(F.col("course") * 100), F.lit(18_000)).cast("int")), "centres")
    steps = int(turn * 100)
    count = c.groupBy("axis").agg(F.count("*").alias("k"))
    round_ = count.select("k", F.explode(F.array(F.col("axis") - 18_000, F.col("axis"), F.col("axis") + 18_000)).alias("axis"))
    beside = F.sum("k").over(Window.orderBy("axis").rangeBetween(-steps + 1, steps - 1))  # three turns of 18,000 axes at most
    checks = round_.withColumn("beside", beside).where("axis >= 0 AND axis < 18000").agg(F.coalesce((F.sum(F.col("k") * (F.col("beside") - 1)) / 2), F.lit(0.0)).alias("checks"))
    gap = F.pmod(F.abs(F.col("a.axis") - F.col("b.axis")), F.lit(18_000))
    near = near_pairs(c, c, apart_m).where((F.col("a.corridor") < F.col("b.corridor")) & (F.col("dist_m") < apart_m) & (F.least(gap, 18_000 - gap) < steps)).agg(F.count("*").alias("near"))
    total = c.agg(F.count("*").alias("corridors"), F.coalesce(F.sum("n"), F.lit(0)).alias("points"))
    m = F.col("length_m")
    coverage = F.when(m > expected_m * 1.5, expected_m / m).otherwise(F.least(F.lit(1.0), m / expected_m))
    one = total.crossJoin(length).crossJoin(checks).crossJoin(near)  # a row each
    return one.select("corridors", "points", "length_m", coverage.alias("coverage"), (1.0 - F.col("near") / F.greatest(F.lit(1.0), F.col("checks"))).alias("separation"))


def built(paths: DataFrame, chunks: list, *, chunk: str = "chunk", min_coverage: float = 0.5, min_separation: float = 0.8, merge_every: int = 3, least_points: int = 5, expected_m: float = 70_000.0) -> tuple[DataFrame, list[tuple]]:
    """Corridors from chunks of paths, taken in their order until the quality suffices (R13), and a row for each round.

    State between rounds is a table: path, corridor. New paths are matched with the leaders so far and each other; every
    few rounds corridors are merged; small ones go at the end. Gives corridor's points and (chunk, quality) of each round."""
    log, known, points = [], None, None
    for k, name in enumerate(chunks, 1):
        new = paths.where(F.col(chunk) == name)
        if known is not None:  # the leaders so far come first, by their own middles
            new = new.unionByName(paths.join(known.select(F.col("leader").alias("path")).distinct(), "path", "left_semi"))
        earlier = F.lit(True) if known is None else F.col(chunk) != name
        order = new.groupBy("path").agg(F.min(F.when(earlier & F.lit(known is not None), 0).otherwise(1)).alias("late"))
        keyed = new.join(order, "path").withColumn("path", F.struct("late", "path"))
        found = corridors(keyed).select(F.col("path.path").alias("path"), F.col("corridor.path").alias("leader"), F.col("path.late").alias("late"))
        fresh = found.where("late = 1").select("path", "leader")
        if known is None:
            known = stored(fresh.withColumn("corridor", F.col("leader")), "corridors")
        else:
            of = known.groupBy("leader").agg(F.min("corridor").alias("corridor"))
            known = stored(known.unionByName(fresh.join(of, "leader", "left").select("path", "leader", F.coalesce("corridor", "leader").alias("corridor"))), "corridors")
        points = paths.join(known, "path")
        if k % merge_every == 0:
            to = stored(merged(points), "merged")
            known = stored(known.join(to, "corridor").select("path", "leader", F.col("merged").alias("corridor")), "corridors")
            points = paths.join(known, "path")
        q = quality(points, expected_m=expected_m).first()
        log.append((name, *q))
        if q.coverage >= min_coverage and q.separation >= min_separation:
            break
    if points is None:
        return paths.withColumn("corridor", F.col("path")).limit(0), log
    size = F.count("*").over(Window.partitionBy("corridor"))
    return points.withColumn("size", size).where(F.col("size") >= least_points).drop("size", "leader"), log
