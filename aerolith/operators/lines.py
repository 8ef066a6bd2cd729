"""Lines and grids: densifying, simplifying, corridors, places along a trail, filled and interpolated fields
(A28, G10, G11, J20, U5, V1, V10, V13, W25, Z19)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import bearing_deg, haversine_m
from ..functions.time import seconds
from ..session import ship, stored
from .trails import whole_trails
from .trails import in_order as sorted_trails
from .trails import starts
from .windows import in_order, steps


def densified(points: DataFrame, *by: str, spacing_m: float, most: int) -> DataFrame:
    """by, place, lat, lon: the points of each line with evenly spaced ones between them; no more than ``most`` of a line,
    and adjacent equal ones once (G11)."""
    w = in_order(*by)
    p = points.select(*by, "ts", "reading_id", "lat", "lon", F.lag("lat").over(w).alias("alat"), F.lag("lon").over(w).alias("alon"))
    d = haversine_m(F.col("alat"), F.col("alon"), F.col("lat"), F.col("lon"))
    p = p.withColumns({"first": F.col("alat").isNull(), "d": d}).where(F.col("first") | (F.col("d") > 0))
    n = F.when(F.col("first"), 0).otherwise(F.floor(F.col("d") / max(1.0, spacing_m))).cast("int")
    p = p.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.when(F.col("first"), 1).otherwise(F.least(F.lit(1), F.col("n") + 1)), F.col("n") + 1)))
    t = F.col("k") / (F.col("n") + 1)
    at = lambda c: F.when(F.col("first") | (F.col("k") > F.col("n")), F.col(c)).otherwise(F.col(f"a{c}") + (F.col(c) - F.col(f"a{c}")) * t).alias(c)
    place = F.row_number().over(Window.partitionBy(*by).orderBy("ts", "reading_id", "k"))
    return p.select(*by, "ts", "reading_id", "k", at("lat"), at("lon")).withColumn("place", place).where(F.col("place") <= most).drop("ts", "reading_id", "k")


def simplify(xy: np.ndarray, epsilon_m: float) -> np.ndarray:
    """Places of the points that a line keeps if none may be further off than epsilon (Douglas-Peucker, in degrees; G10)."""
    keep, todo = {0, len(xy) - 1}, [(0, len(xy) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        p, d = xy[a + 1 : b] - xy[a], xy[b] - xy[a]
        n = math.hypot(*d)
        off = np.hypot(p[:, 0], p[:, 1]) if n < 1e-10 else np.abs(d[0] * p[:, 1] - d[1] * p[:, 0]) / n
        i = int(off.argmax())
        if off[i] * 111_000 > epsilon_m:
            keep.add(a + 1 + i)
            todo += [(a, a + 1 + i), (a + 1 + i, b)]
    return np.array(sorted(keep))


def simplified(points: DataFrame, *by: str, epsilon_m: float) -> DataFrame:
    """The points that stay of each line (G10); a line is one trail, which bounds it."""
    ship(points.sparkSession)
    keys = list(by)

    def run(batches):
        for pdf in whole_trails(batches, keys):
            xy, first = pdf[["lat", "lon"]].to_numpy(float), starts(pdf, keys)
            yield pdf.iloc[np.concatenate([a + simplify(xy[a:b], epsilon_m) for a, b in zip(first, [*first[1:], len(pdf)])])]

    return sorted_trails(points.where("lat IS NOT NULL AND lon IS NOT NULL"), *by).mapInPandas(run, points.schema)


def corridors(points: DataFrame, *by: str, bin_m: float = 15.0) -> DataFrame:
    """Means of place and direction of each stretch of so many metres along a trail, and how many steps' worth its directions
    agree (strength; A28)."""
    w = in_order(*by)
    p = steps(points, *by).withColumns({"bin": F.floor(F.col("travel_m") / bin_m), "b": F.radians(bearing_deg(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")))})
    p = p.withColumns({"s": F.when(F.col("step_m") > 0, F.sin("b")), "c": F.when(F.col("step_m") > 0, F.cos("b"))})
    g = p.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.sum("s").alias("s"), F.sum("c").alias("c"))
    return g.select(*by, "bin", "n", "lat", "lon", F.pmod(F.degrees(F.atan2("s", "c")) + 360.0, F.lit(360.0)).alias("bearing"), F.sqrt(F.col("s") * F.col("s") + F.col("c") * F.col("c")).alias("strength"))


def stats(df: DataFrame, value: str, *by: str) -> DataFrame:
    """n, sum, least, most and mean."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"))


def along(points: DataFrame, probes: DataFrame, *by: str) -> DataFrame:
    """Where each trail was at a time, on the line between the points before and after; its ends beyond them.
    probes: by, probe_id, ts. One shuffle by the keys, as for as-of values."""
    a = points.select(*by, "ts", F.lit(0).alias("_p"), "lat", "lon", F.lit(None).cast("long").alias("probe_id"))
    b = probes.select(*by, "ts", F.lit(1).alias("_p"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), "probe_id")
    order = Window.partitionBy(*by).orderBy("ts", "_p", F.col("lat").asc_nulls_last(), F.col("lon").asc_nulls_last())
    here = F.when(F.col("_p") == 0, F.struct("ts", "lat", "lon"))
    before = F.last(here, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    # the next point is the last one so far in the opposite order: a frame that ends at the trail's end would be gone
    # through again for each row
    back = Window.partitionBy(*by).orderBy(F.desc("ts"), F.desc("_p"), F.col("lat").desc_nulls_first(), F.col("lon").desc_nulls_first())
    after = F.last(here, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    p = a.unionByName(b).withColumns({"x": before, "y": after}).where("_p = 1")
    t = (seconds(F.col("ts")) - seconds(F.col("x.ts"))) / (seconds(F.col("y.ts")) - seconds(F.col("x.ts")))
    at = lambda c: F.when(F.col("x").isNull(), F.col(f"y.{c}")).when(F.col("y").isNull(), F.col(f"x.{c}")).otherwise(F.col(f"x.{c}") + (F.col(f"y.{c}") - F.col(f"x.{c}")) * t).alias(c)
    return p.select("probe_id", *by, "ts", at("lat"), at("lon"))


def aligned(series: dict[str, DataFrame], optional: tuple[str, ...], *by: str) -> DataFrame:
    """by and a column for each series (by, its name) at the times that all have, but for the optional ones."""
    out = None
    for name, df in sorted(series.items(), key=lambda kv: kv[0] in optional):
        out = df if out is None else out.join(df, list(by), "left" if name in optional else "inner")
    return out


def flood_filled(grid: DataFrame, height: int, width: int, grid_id: str, value: str) -> DataFrame:
    """Empty cells get the value of the nearest filled one, stepwise from cell to cell; of several as near, of the one that
    was filled first, where filled cells come in rows and neighbours above, below, left, right (V1). grid: grid_id, iy, ix,
    value. A round for each step; a grid has height * width cells."""
    w = Window.partitionBy(grid_id)
    done = grid.select(grid_id, "iy", "ix", value).withColumn("rank", F.row_number().over(w.orderBy("iy", "ix")))
    edge, out = done, done.drop("rank")
    moves = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for k, (dy, dx) in enumerate(((-1, 0), (1, 0), (0, -1), (0, 1))))))
    while True:
        near = edge.select(grid_id, "iy", "ix", value, "rank", moves.alias("m")).select(grid_id, (F.col("iy") + F.col("m.dy")).alias("iy"), (F.col("ix") + F.col("m.dx")).alias("ix"), value, F.struct("rank", "m.k").alias("by"))
        near = near.where(F.col("iy").between(0, height - 1) & F.col("ix").between(0, width - 1)).join(out.select(grid_id, "iy", "ix"), [grid_id, "iy", "ix"], "left_anti")
        near = near.groupBy(grid_id, "iy", "ix").agg(F.min_by(value, "by").alias(value), F.min("by").alias("by"))
        edge = stored(near.withColumn("rank", F.row_number().over(w.orderBy("by"))).drop("by"), "edge")
        if edge.isEmpty():
            return out
        out = stored(out.unionByName(edge.drop("rank")), "filled")


def wind_on_cells(cells: DataFrame, winds: DataFrame, cutoff_deg: float = 1.0) -> DataFrame:
    """cell_id, u, v: winds weighed by their inverse squared distance in degrees, within a cutoff."""
    at = lambda p, c: F.floor(F.col(f"{p}.{c}") / cutoff_deg).alias(f"c{c}")
    a = cells.select(F.struct("*").alias("a")).select("a", at("a", "lat"), at("a", "lon"))
    b = winds.select(F.struct("*").alias("b")).select("b", at("b", "lat"), at("b", "lon"))
    for c in ("clat", "clon"):
        b = b.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
    dy, dx = F.col("a.lat") - F.col("b.lat"), F.col("a.lon") - F.col("b.lon")
    p = a.join(b, ["clat", "clon"]).select("a.cell_id", "b.u", "b.v", (dy * dy + dx * dx).alias("d2")).where(F.col("d2") <= cutoff_deg * cutoff_deg)
    p = p.withColumn("w", 1.0 / (F.col("d2") + 0.001))
    return p.groupBy("cell_id").agg((F.sum(F.col("w") * F.col("u")) / F.sum("w")).alias("u"), (F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"))
