"""Sensors whose value has long stood still above their neighbours' (J9): each verdict leaves out the sensors flagged before.

A sensor's neighbours are those within the first radius that has enough of them, but for flagged ones. A verdict needs no
list of them, only how many there are, how many are so low that a median among them is low enough, and how many are as high.
Most sensors are settled in their cell, which is so small that any neighbourhood in it has all of it: enough others as high
that can't be flagged before them speak for them. For the rest, neighbours are counted as they are met and never stored.
Earlier ones whose own verdict is open are counted apart: a sensor is settled once its verdict is the same whatever becomes
of these, and each round brings the counts of the open ones up to date with what it settled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import cell
from ..functions.time import seconds
from ..session import discard, stored
from .spatial import KM_PER_DEG
from .windows import in_order


def standing_since(readings: DataFrame, *by: str, value: str = "value", latest: tuple[str, ...] = ()) -> DataFrame:
    """by, since, last_ts, n: from when on the latest value has stood still, and how many readings there are; and columns of
    the latest reading. A null at the end stands for nothing: since is null."""
    w = in_order(*by)
    r = readings.withColumns({"_prev": F.lag(value).over(w), "_n": F.row_number().over(w)})
    turn = F.max(F.when(~F.col(value).eqNullSafe(F.col("_prev")) | (F.col("_n") == 1), F.struct("ts", "_n"))).alias("turn")
    last = F.max(F.struct("ts", "_n", F.col(value).alias("_v"), *latest)).alias("last")
    g = r.groupBy(*by).agg(turn, last, F.count("*").alias("n"))
    return g.select(*by, F.when(F.col("last._v").isNotNull(), F.col("turn.ts")).alias("since"), F.col("last.ts").alias("last_ts"), "n", *(F.col(f"last.{c}").alias(c) for c in latest))


def _unsettled(sensors: DataFrame, side_km: float, floor: float, share: float, agree: int, most: int) -> DataFrame:
    """The candidates that ``agree`` sure others of their cell don't speak for: no candidates, or later ones.

    Where there are more than ``most`` sensors, cells are first dealt to parts, which keep only what may count in a whole
    cell: a value that ``agree`` sure others of the part reach is never among the highest of anyone's sure ones."""
    at = [cell(F.col("lat") * KM_PER_DEG[0], side_km), cell(F.col("lon") * KM_PER_DEG[1], side_km)]
    parts = 1 + sensors.count() // most
    for of in [parts, 1] if parts > 1 else [1]:
        # before a row: no candidates, then later ones
        w = Window.partitionBy(*at, F.pmod(F.xxhash64("sensor_id"), F.lit(of))).orderBy("candidate", F.desc("place")).rowsBetween(Window.unboundedPreceding, -1)
        sensors = sensors.withColumn("_top", F.lit(float("nan")))  # the greatest value
        for _ in range(agree):  # the highest before a row, the second, and so on; null: there are fewer
            sensors = sensors.withColumn("_top", F.max(F.when(F.col("_top").isNotNull(), F.least("value", "_top"))).over(w))
        open_ = F.col("candidate") & ~F.coalesce(F.col("_top") >= F.greatest(F.lit(floor), F.col("value") / share), F.lit(False))
        speaks = (F.col("value") >= floor) & ~F.coalesce(F.col("_top") >= F.col("value"), F.lit(False))
        sensors = sensors.where(open_ if of == 1 else open_ | speaks).drop("_top")
    return sensors


def _pairs(few: DataFrame, many: DataFrame, radius_km: float) -> DataFrame:
    """Rows of ``few`` (as they are) with those of ``many`` (o_ before the names) within the radius on a plane, and d2. Others
    meet in cells as wide as the radius; a row of ``few`` is sent to nine."""
    def at(name: str, axis: int):
        return cell(F.col(name) * KM_PER_DEG[axis], radius_km * 1.000001)

    y, x = at("lat", 0), at("lon", 1)
    few = few.withColumn("cy", F.explode(F.sequence(y - 1, y + 1))).withColumn("cx", F.explode(F.sequence(x - 1, x + 1)))
    many = many.select(*(F.col(c).alias(f"o_{c}") for c in many.columns)).withColumns({"cy": at("o_lat", 0), "cx": at("o_lon", 1)})
    dy, dx = (F.col("o_lat") - F.col("lat")) * KM_PER_DEG[0], (F.col("o_lon") - F.col("lon")) * KM_PER_DEG[1]
    p = many.join(few, ["cy", "cx"]).where(F.col("sensor_id") != F.col("o_sensor_id")).withColumn("d2", dy * dy + dx * dx)
    return p.where(F.col("d2") <= radius_km * radius_km)


COUNTS = ("n", "low", "high", "open", "open_low", "open_high")


def stuck_sensors(latest: DataFrame, *, least_s: float = 3_600.0, ladder_km: tuple = (5.0, 10.0, 20.0, 40.0), min_neighbors: int = 3, diff: float = 10.0, ratio: float = 2.0, floor: float = 15.0, share: float = 5.0, agree: int = 2, most: int = 1_000_000) -> DataFrame:
    """sensor_id, stuck (since), value, of the sensors found stuck.

    latest: sensor_id, place (order, no ties), lat, lon, value, outlier (flagged already), since, last_ts, n. A candidate has
    stood still for least_s, over two readings at least. It is stuck if it is diff above its neighbours' median (the upper
    one), ratio times it where that is 1 or more, and fewer than ``agree`` neighbours are as high as its value's share or
    the floor. ``most``: sensors up to which cells aren't dealt to parts."""
    still = (F.col("n") >= 2) & F.col("since").isNotNull() & (seconds(F.col("last_ts")) - seconds(F.col("since")) >= least_s)
    rows = latest.select("sensor_id", "place", "lat", "lon", "value", "since", F.coalesce(still, F.lit(False)).alias("candidate"))
    there = (F.abs("lat") < float("inf")) & (F.abs("lon") < float("inf"))  # neither null nor NaN
    rows = stored(rows.where(~F.col("outlier") & there & F.col("value").isNotNull()), "sensors")
    side_km = ladder_km[0] / 2**0.5 * 0.999999  # no two places of a cell are farther from each other than the first radius
    own, d2 = F.col("value"), F.col("d2")
    above = lambda v: (own - v >= diff) & ((v < 1) | (own >= v * ratio))  # noqa: E731  # holds for all values up to some one, so for the median if for more than half
    lowest = F.lit(rows.agg(F.min("value")).first()[0])
    open_ = stored(_unsettled(rows.drop("since"), side_km, floor, share, agree, most).where(above(lowest)).drop("candidate"), "unsettled")
    others = rows.select("sensor_id", "place", "lat", "lon", "value").join(open_.select("sensor_id", F.lit(True).alias("waits")), "sensor_id", "left")

    low, high = above(F.col("o_value")), F.col("o_value") >= F.greatest(F.lit(floor), own / share)
    ring = F.lit(1)
    for r in ladder_km[:-1]:
        ring = ring + (d2 > r * r).cast("int")

    def counted(pairs: DataFrame, sure, waiting) -> DataFrame:
        """sensor_id, ring, COUNTS: what a pair adds to those that can't be flagged, and to those whose verdict is open."""
        tests = [F.lit(1), low.cast("int"), high.cast("int")]
        sums = [F.sum(part * t).alias(c) for c, (part, t) in zip(COUNTS, [(part, t) for part in (sure, waiting) for t in tests])]
        return pairs.groupBy("sensor_id", ring.alias("ring")).agg(*sums)

    left, tally, reach = open_, None, None
    for k, r in enumerate(ladder_km):  # only those that lack sure neighbours go on to the next radius
        waiting = (F.col("o_waits").isNotNull() & (F.col("o_place") < F.col("place"))).cast("int")
        t = stored(counted(_pairs(left, others, r), 1 - waiting, waiting), "counts")
        enough = t.groupBy("sensor_id").agg(F.sum("n").alias("n")).where(F.col("n") >= min_neighbors).select("sensor_id")
        last = k == len(ladder_km) - 1
        done = left if last else left.join(enough, "sensor_id", "left_semi")
        t = t.join(done.select("sensor_id"), "sensor_id", "left_semi")
        tally = t if tally is None else tally.unionByName(t)
        done = done.withColumn("reach", F.lit(k))
        reach = done if reach is None else reach.unionByName(done)
        if last or (left := stored(left.join(enough, "sensor_id", "left_anti"), "unsettled")).isEmpty():
            break
    open_, tally, flagged = stored(reach, "unsettled"), stored(tally, "counts"), None
    while not open_.isEmpty():
        # within each ring
        w = Window.partitionBy("sensor_id").orderBy("ring").rowsBetween(Window.unboundedPreceding, 0)
        c = tally.groupBy("sensor_id", "ring").agg(*(F.sum(c).alias(c) for c in COUNTS)).select("sensor_id", "ring", *(F.sum(c).over(w).alias(c) for c in COUNTS))
        first = F.min(F.when(F.col("n") + F.col("open") >= min_neighbors, F.struct("ring", "high"))).alias("first")  # no neighbourhood is smaller,
        full = F.min(F.when(F.col("n") >= min_neighbors, F.struct("ring", *COUNTS))).alias("full")  # and none is larger
        c = open_.join(c.groupBy("sensor_id").agg(first, full), "sensor_id", "left")
        sure, same = F.col("full"), F.coalesce(F.col("first.ring") == F.col("full.ring"), F.lit(False))
        half = lambda n: F.floor(n / 2) + 1
        never = F.col("first").isNull() | (F.col("first.high") >= agree) | (same & (sure.low + sure.open_low < half(sure.n + sure.open_low)))
        always = same & (sure.high + sure.open_high < agree) & (sure.low >= half(sure.n + sure.open - sure.open_low))
        now = stored(c.withColumn("bad", F.when(never, False).when(always, True)).select(*open_.columns, "bad"), "verdicts")
        discard(open_)
        new = now.where("bad").select("sensor_id")
        flagged = new if flagged is None else flagged.unionByName(new)
        open_ = now.where("bad IS NULL").drop("bad")
        settled, gained = now.where("bad IS NOT NULL").drop("reach"), None
        reaches = [k for (k,) in open_.select("reach").distinct().collect()]  # as many as radii at most
        for k in reaches:
            p = _pairs(open_.where(F.col("reach") == k), settled, ladder_km[k]).where("o_place < place")
            t = counted(p, F.when(F.col("o_bad"), 0).otherwise(1), F.lit(-1))
            gained = t if gained is None else gained.unionByName(t)
        if gained is None:
            break
        tally, before = stored(tally.join(open_.select("sensor_id"), "sensor_id", "left_semi").unionByName(gained), "counts"), tally
        discard(before)
        open_ = stored(open_, "unsettled")
    out = rows.select("sensor_id", F.col("since").alias("stuck"), "value")
    return out.limit(0) if flagged is None else out.join(flagged, "sensor_id", "left_semi")
