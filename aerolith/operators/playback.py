"""What a view shows over time: segments, pages, deltas, alerts (A18, A23, A25, A27, J21, T-8, U8, W24, W26, W28-W30, Z20, Z21, Z25)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_m, truncated_cell
from ..functions.time import seconds
from .windows import in_order


def new_alerts(now: DataFrame, before: DataFrame, n: int, least: float = 100.0) -> DataFrame:
    """The n highest of the keys above an index that weren't above it before (W28). Both: sensor_id, key, aqi."""
    old = before.where(F.col("aqi") > least).select("sensor_id", "key")
    return now.where(F.col("aqi") > least).join(old, ["sensor_id", "key"], "left_anti").orderBy(F.desc("aqi"), "sensor_id", "key").limit(n)


def learned_interval(df: DataFrame, *by: str, last: int = 10, step: float = 0.5, least: float = 60.0, most: float = 86_400.0) -> DataFrame:
    """Mean of the last intervals between rows, the oldest of them weighing 1 and each later one a step more, within bounds
    (A23, W29)."""
    d = df.select(*by, "ts", "reading_id", (seconds(F.col("ts")) - F.lag(seconds(F.col("ts"))).over(in_order(*by))).alias("s")).where("s IS NOT NULL")
    back = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("ts"), F.desc("reading_id")))
    d = d.withColumn("back", back).where(F.col("back") <= last)
    weight = 1.0 + step * (F.count("*").over(Window.partitionBy(*by)) - F.col("back"))
    d = d.withColumn("w", weight)
    return d.groupBy(*by).agg(F.count("*").alias("intervals"), F.least(F.greatest(F.sum(F.col("w") * F.col("s")) / F.sum("w"), F.lit(least)), F.lit(most)).alias("predicted_s"))


def last_moving_segment(points: DataFrame, *by: str, most_points: int = 600, most_m: float = 5_000.0) -> DataFrame:
    """The last points in a row that are moving, newest first (n), with the step to the one before in that order; cut
    where they are too many or the way has become too long, its last point included (W24)."""
    back = Window.partitionBy(*by).orderBy(F.desc("ts"), F.desc("reading_id"))
    upto = back.rowsBetween(Window.unboundedPreceding, 0)
    p = points.withColumns({"n": F.row_number().over(back), "still": F.sum((~F.col("moving")).cast("int")).over(upto)})
    p = p.withColumn("first_still", F.min(F.when(F.col("moving"), F.col("still"))).over(Window.partitionBy(*by))).where(F.col("moving") & (F.col("still") == F.col("first_still")))
    w = Window.partitionBy(*by).orderBy("n")
    step = F.coalesce(haversine_m(F.col("lat"), F.col("lon"), F.lag("lat").over(w), F.lag("lon").over(w)), F.lit(0.0))
    p = p.withColumns({"step": step, "k": F.row_number().over(w)})
    p = p.withColumn("before_m", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("step"))
    return p.where((F.col("before_m") < most_m) & (F.col("k") <= most_points)).drop("still", "first_still", "k")


def segment_stats(segment: DataFrame, *by: str) -> DataFrame:
    """Points, way, displacement, straightness, bounds, middle, and whether the segment counts for a view."""
    g = segment.groupBy(*by).agg(
        F.count("*").alias("points"), F.sum("step").alias("total_m"), F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"),
        F.avg("lat").alias("mid_lat"), F.avg("lon").alias("mid_lon"), F.min_by(F.struct("lat", "lon"), "n").alias("a"), F.max_by(F.struct("lat", "lon"), "n").alias("b"))
    g = g.withColumn("displacement_m", haversine_m(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))).drop("a", "b")
    g = g.withColumn("straightness", F.when(F.col("total_m") > 0, F.col("displacement_m") / F.col("total_m")).otherwise(0.0))
    two = (F.col("points") == 2) & (F.col("total_m") >= 500) & (F.col("displacement_m") >= 500)
    more = (F.col("points") >= 3) & (F.col("total_m") >= 120) & (F.col("displacement_m") >= 60) & (F.col("straightness") >= 0.2)
    return g.withColumn("counts", two | more)


def pages(bounds: DataFrame, at_ms: Column, size_ms: int) -> DataFrame:
    """Pages of bounds (lo, hi, in ms), the page of a moment and its ends (the last page goes on to the end), and a window
    of the same size around the moment that stays inside (W30)."""
    b = bounds.withColumn("pages", F.greatest(F.lit(1), F.floor((F.col("hi") - F.col("lo")) / size_ms)).cast("long"))
    b = b.withColumn("page", F.least(F.greatest(F.floor((at_ms - F.col("lo")) / size_ms), F.lit(0)), F.col("pages") - 1).cast("long"))
    start = F.col("lo") + F.col("page") * size_ms
    b = b.withColumns({"page_from": start, "page_to": F.when(F.col("page") == F.col("pages") - 1, F.col("hi")).otherwise(start + size_ms)})
    late, early = at_ms + size_ms // 2 > F.col("hi"), at_ms - size_ms // 2 < F.col("lo")
    b = b.withColumns({
        "window_from": F.when(late, F.greatest(F.col("lo"), F.col("hi") - size_ms)).when(early, F.col("lo")).otherwise(at_ms - size_ms // 2),
        "window_to": F.when(late, F.col("hi")).when(early, F.least(F.col("hi"), F.col("lo") + size_ms)).otherwise(at_ms + size_ms // 2),
    })
    return b.drop("lo", "hi")


def chunks(points: DataFrame, *by: str, hours: int = 4) -> DataFrame:
    """Points, bounds and area (millionths of square degrees) of each trail by chunks of time (A27, T-11)."""
    chunk = F.timestamp_seconds(F.floor(seconds(F.col("ts")) / (3600 * hours)) * (3600 * hours)).cast("timestamp_ntz")
    g = points.groupBy(*by, chunk.alias("chunk")).agg(F.count("*").alias("points"), F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"))
    g = g.withColumn("area", F.round((F.col("north") - F.col("south")) * (F.col("east") - F.col("west")) * 1e6, 6))
    return g.select(*by, "chunk", "points", *(F.round(c, 6).alias(c) for c in ("south", "north", "west", "east")), "area")


def last_move(points: DataFrame, *by: str, eps: float = 1e-6) -> DataFrame:
    """Time of the last sample, of the last change of place, and of that or else of the sample."""
    w = in_order(*by)
    moved = (F.abs(F.col("lat") - F.lag("lat").over(w)) > eps) | (F.abs(F.col("lon") - F.lag("lon").over(w)) > eps)
    g = points.withColumn("moved", moved).groupBy(*by).agg(F.max("ts").alias("last_sample"), F.max(F.when(F.col("moved"), F.col("ts"))).alias("last_move"))
    return g.withColumn("shown", F.coalesce("last_move", "last_sample"))


def since(points: DataFrame, has: DataFrame, *by: str) -> DataFrame:
    """Points after the time that a client has of their trail (T-8, W26, Z25). has: by, since."""
    return points.join(has, list(by)).where(F.col("ts") > F.col("since")).drop("since")


def replaced(before: DataFrame, delta: DataFrame, *by: str) -> DataFrame:
    """The delta's rows, and whether they are new; rows of other keys are dropped (U8)."""
    old = before.select(*by, F.lit(True).alias("_old")).distinct()
    return delta.join(old, list(by), "left").select(*delta.columns, F.col("_old").isNull().alias("is_new"))


def newest_of_cells(points: DataFrame, per_degree: float) -> DataFrame:
    """The newest point of each grid cell."""
    p = points.withColumns({"cy": truncated_cell(F.col("lat") * per_degree, 1.0), "cx": truncated_cell(F.col("lon") * per_degree, 1.0)})
    names = [c for c in p.columns if c not in ("cy", "cx")]
    return p.groupBy("cy", "cx").agg(F.max_by(F.struct(*names), F.struct("ts", "reading_id")).alias("p")).select("cy", "cx", "p.*")
