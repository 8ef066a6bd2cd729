"""Which sensors to ask next, and fields on grids."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import truncated_cell
from ..functions.time import seconds
from ..session import stored
from .spatial import M_PER_DEG, kernel_field, near_pairs, nearest_k


def probe(sensors: DataFrame, seed: int, size: float = 0.05) -> DataFrame:
    """One sensor of each cell, another one for another seed."""
    s = sensors.withColumns({"cy": truncated_cell(F.col("lat"), size), "cx": truncated_cell(F.col("lon"), size)})
    names = [c for c in sensors.columns]
    return s.groupBy("cy", "cx").agg(F.min_by(F.struct(*names), F.struct(F.md5(F.concat("sensor_id", F.lit(f"-{seed}"))), "sensor_id")).alias("s")).select("s.*")


def discovery_cells(sensors: DataFrame, south: float, north: float, west: float, east: float, size: float) -> DataFrame:
    """south, west, sensors of every cell of a box, empty ones too (M4)."""
    rows, columns = math.ceil(round((north - south) / size, 6)), math.ceil(round((east - west) / size, 6))
    n = sensors.sparkSession.range(rows * columns)
    corner = lambda y, x: [F.round(south + y * size, 6).alias("south"), F.round(west + x * size, 6).alias("west")]
    cells = n.select(*corner(F.floor(F.col("id") / columns), F.pmod("id", F.lit(columns))))
    known = sensors.select(*corner(F.floor((F.col("lat") - south) / size), F.floor((F.col("lon") - west) / size))).groupBy("south", "west").agg(F.count("*").alias("sensors"))
    return cells.join(known, ["south", "west"], "left").select("south", "west", F.coalesce("sensors", F.lit(0)).alias("sensors"))


def frontier(centres: DataFrame, sensors: DataFrame, *, spokes: int = 8, r_min: float = 0.006, r_max: float = 0.045, reach_m: tuple = (8_000.0, 40_000.0, 200_000.0)) -> DataFrame:
    """centre, sensor_id, rays: the sensor nearest to the tip of each ray of a centre, other than it (M2). Tips without a
    sensor in one reach are looked up in the next."""
    k = F.explode(F.sequence(F.lit(0), F.lit(spokes - 1))).alias("i")
    # centres of one place have the same tips, of which two sensors are enough: the second is for the first itself
    places = stored(centres.where("lat IS NOT NULL AND lon IS NOT NULL").select("lat", "lon").distinct(), "places")
    two = F.row_number().over(Window.partitionBy("lat", "lon").orderBy("sensor_id"))
    few = stored(sensors.where("lat IS NOT NULL AND lon IS NOT NULL").select("sensor_id", "lat", "lon").withColumn("n", two).where("n <= 2").drop("n"), "few")
    r = F.lit(r_min) + F.lit(r_max - r_min) * F.col("i") / float(max(1, spokes - 1))
    turn = F.lit(2 * math.pi) * F.col("i") / spokes
    t = places.select(F.col("lat").alias("clat"), F.col("lon").alias("clon"), k)
    tips = t.select("clat", "clon", "i", F.cos(F.radians("clat")).alias("k"), (F.col("clat") + r * F.sin(turn)).alias("lat"), (F.col("clon") + r * F.cos(turn) / F.cos(F.radians("clat"))).alias("lon"))
    # short reaches first: what they find stands if it is nearer than anything beyond can be on the tip's plane
    reaches = [x for x in (reach_m[0] / 64, reach_m[0] / 16, reach_m[0] / 4) if x >= 50] + list(reach_m)
    found = None
    for reach in reaches:
        p = near_pairs(tips, few, reach)
        dy, dx = F.col("b.lat") - F.col("a.lat"), (F.col("b.lon") - F.col("a.lon")) * F.col("a.k")
        p = p.select("a.clat", "a.clon", "a.i", F.round(dy * dy + dx * dx, 12).alias("d2"), F.col("b.sensor_id").alias("sensor_id"))
        w = Window.partitionBy("clat", "clon", "i")
        near = p.withColumn("rank", F.row_number().over(w.orderBy("d2", "sensor_id"))).where("rank <= 2").withColumns({"n": F.count("*").over(w), "most": F.max("d2").over(w)})
        sure = (F.col("n") == 2) & (F.col("most") < (0.9 * reach / M_PER_DEG) ** 2)
        near = stored(near.where(sure if reach < reach_m[0] else F.lit(True)).drop("most"), "tips")
        # from the given reaches on, a single sensor counts; it is searched further for the one centre that it is itself
        tips = tips.join(near.where("n = 2").select("clat", "clon", "i"), ["clat", "clon", "i"], "left_anti")
        found = near.withColumn("reach", F.lit(float(reach))) if found is None else found.unionByName(near.withColumn("reach", F.lit(float(reach))))
    c = centres.select(F.col("sensor_id").alias("centre"), F.col("lat").alias("clat"), F.col("lon").alias("clon"))
    best = c.join(found, ["clat", "clon"]).where("centre <> sensor_id").groupBy("centre", "i").agg(F.min_by("sensor_id", F.struct("reach", "rank")).alias("sensor_id"))
    return best.groupBy("centre", "sensor_id").agg(F.count("*").alias("rays"))


def blended_fields(asked: DataFrame, fields: DataFrame, key: str) -> DataFrame:
    """u and v of a cell at a time: those of the last slot at or before it, going over to the next slot's.
    asked: key, t, iy, ix. fields: slot, iy, ix, u, v. A cell that one slot lacks has the other's, if that is the earlier."""
    slots = fields.select("slot").distinct()
    slots = slots.withColumn("following", F.lead("slot").over(Window.orderBy("slot")))  # a row for each quarter of an hour or more
    # which slot is in force is found by the day, as no slot lasts longer than until the next one
    span = slots.select("slot", "following", F.explode(F.sequence(F.to_date("slot"), F.to_date(F.coalesce("following", F.col("slot") + F.expr("INTERVAL 7 DAYS"))))).alias("day"))
    q = asked.withColumn("day", F.to_date("t")).join(span, "day").where((F.col("t") >= F.col("slot")) & (F.col("following").isNull() | (F.col("t") < F.col("following"))))
    a = fields.select("slot", "iy", "ix", F.col("u").alias("u0"), F.col("v").alias("v0"))
    b = fields.select(F.col("slot").alias("following"), "iy", "ix", F.col("u").alias("u1"), F.col("v").alias("v1"))
    q = q.join(a, ["slot", "iy", "ix"], "left").join(b, ["following", "iy", "ix"], "left")
    part = (seconds(F.col("t")) - seconds(F.col("slot"))) / (seconds(F.col("following")) - seconds(F.col("slot")))
    mix = lambda c: F.when(F.col(f"{c}1").isNull(), F.col(f"{c}0")).otherwise(F.col(f"{c}0") + (F.col(f"{c}1") - F.col(f"{c}0")) * part)
    blend = lambda c: (F.floor(mix(c) * 1000 + 0.5) / 1000).alias(c)
    return q.select(key, "slot", "u0", "u1", blend("u"), blend("v"))


def bilinear(points: DataFrame, grid: DataFrame, height: int, width: int, value: str) -> DataFrame:
    """Values at places (fx, fy) between the points of a grid, which ends at its edges."""
    fx, fy = (F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(n - 1.001)) for c, n in (("fx", width), ("fy", height)))
    p = points.withColumns({"fx": fx, "fy": fy}).withColumns({"x0": F.floor("fx"), "y0": F.floor("fy")})
    p = p.withColumns({"tx": F.col("fx") - F.col("x0"), "ty": F.col("fy") - F.col("y0")})
    out = F.lit(0.0)
    for dy in (0, 1):
        for dx in (0, 1):
            g = grid.select(F.col("iy").alias("_y"), F.col("ix").alias("_x"), F.col(value).alias(f"_v{dy}{dx}"))
            p = p.join(g, (F.col("_y") == F.least(F.col("y0") + dy, F.lit(height - 1))) & (F.col("_x") == F.least(F.col("x0") + dx, F.lit(width - 1))), "left").drop("_y", "_x")
            out = out + F.col(f"_v{dy}{dx}") * (F.col("tx") if dx else 1 - F.col("tx")) * (F.col("ty") if dy else 1 - F.col("ty"))
    return p.withColumn(value, out).drop("x0", "y0", "tx", "ty", *(f"_v{a}{b}" for a in (0, 1) for b in (0, 1)))


def nearest_field(cells: DataFrame, sensors: DataFrame, radius_m: float, k: int = 8, two_sigma_sq: float = 8e6) -> DataFrame:
    """cell_id, c, fade: by the k nearest sensors, with weights that fall to 0 at the radius (V3)."""
    p = nearest_k(cells, sensors.withColumnRenamed("value", "v"), "cell_id", "sensor_id", k, radius_m, values=("v",))
    d2 = F.col("dist_m") * F.col("dist_m")
    t = 1.0 - d2 / (radius_m * radius_m)
    p = p.withColumns({"w": t * t / (d2 + 1.0), "g": F.exp(-d2 / two_sigma_sq)})
    return p.groupBy("cell_id").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("c"), F.least(F.lit(1.0), 2.0 * F.sum("g")).alias("fade"), F.sum("w").alias("w")).where("w >= 1e-12").drop("w")


def worst_field(cells: DataFrame, sensors: DataFrame, sigma_m: float) -> DataFrame:
    """cell_id, aqi, groups: of the fields of each group of pollutants, the highest where it has cover (V5). sensors: grp,
    lat, lon, aqi."""
    out = None
    for g in ("pm", "ozone", "no2", "co"):
        s = sensors.where(F.col("grp") == g).select("lat", "lon", F.col("aqi").alias("value"), F.lit(1.0).alias("weight"))
        f = kernel_field(cells, s, sigma_m).select("cell_id", "c")
        out = f if out is None else out.unionByName(f)
    return out.groupBy("cell_id").agg(F.max("c").alias("aqi"), F.count("*").alias("groups"))
