"""Sequences by sensor and pollutant as window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aqi import trend_threshold
from ..functions.geo import haversine_m
from ..functions.time import seconds

SERIES = ("sensor_id", "pollutant")


def in_order(*by: str, order: tuple[str, ...] = ("ts", "reading_id")):
    return Window.partitionBy(*by).orderBy(*order)


def carried_forward(value: str, *by: str) -> Column:
    """The last known value so far (W3); a reading counts at its own time."""
    return F.last(value, ignorenulls=True).over(in_order(*by).rowsBetween(Window.unboundedPreceding, 0))


def filled(value: str, *by: str) -> Column:
    """Carried forward, and before the first known value that one."""
    first = F.first(value, ignorenulls=True).over(in_order(*by).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.coalesce(carried_forward(value, *by), first)


def last_n(df: DataFrame, n: int, *by: str) -> DataFrame:
    """The latest n rows of each series."""
    w = Window.partitionBy(*by).orderBy(F.desc("ts"), F.desc("reading_id"))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def without_repeats(df: DataFrame, *by: str, same: tuple[str, ...]) -> DataFrame:
    """Rows that differ from the one before in any of the columns."""
    w = in_order(*by)
    before = [F.col(c).eqNullSafe(F.lag(c).over(w)) for c in same]
    all_same = before[0]
    for c in before[1:]:
        all_same = all_same & c
    return df.withColumn("_same", (F.row_number().over(w) > 1) & all_same).where(~F.col("_same")).drop("_same")


def steps(df: DataFrame, *by: str) -> DataFrame:
    """Metres from the row before, summed up, and from the first row."""
    w = in_order(*by)
    step = F.coalesce(haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")), F.lit(0.0))
    df = df.withColumn("step_m", step)
    whole = w.rowsBetween(Window.unboundedPreceding, 0)
    net = haversine_m(F.first("lat").over(whole), F.first("lon").over(whole), F.col("lat"), F.col("lon"))
    return df.withColumns({"travel_m": F.sum("step_m").over(whole), "net_m": net, "max_step_m": F.max("step_m").over(whole)})


def overflow_and_stuck(df: DataFrame, value: str = "value") -> DataFrame:
    """Over the last 10 values: some above 500 and some below 2; or all above 500 and within 5 percent."""
    w = in_order(*SERIES).rowsBetween(-9, 0)
    hi, lo, n = F.max(value).over(w), F.min(value).over(w), F.count(value).over(w)
    return df.withColumns({"overflow": (hi > 500) & (lo < 2), "stuck": (n >= 10) & (lo > 500) & ((hi - lo) < 0.05 * hi)})


def equal_runs(df: DataFrame, value: str, *by: str) -> DataFrame:
    """run: number of the stretch of equal values; run_start; run_s: seconds since then."""
    w = in_order(*by)
    changed = F.when(F.row_number().over(w) == 1, 0).when(F.col(value).eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)
    df = df.withColumn("_changed", changed).withColumn("run", F.sum("_changed").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_changed")
    start = F.min("ts").over(Window.partitionBy(*by, "run"))
    return df.withColumn("run_start", start).withColumn("run_s", seconds(F.col("ts")) - seconds(F.col("run_start")))


def sessions(df: DataFrame, gap_s: float, jump_m: float, *by: str) -> DataFrame:
    """session: a new one after a gap in time or a jump in place."""
    w = in_order(*by)
    gap = seconds(F.col("ts")) - F.lag(seconds(F.col("ts"))).over(w)
    jump = haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    cut = F.coalesce(((gap > gap_s) | (jump > jump_m)).cast("int"), F.lit(0))
    return df.withColumn("_cut", cut).withColumn("session", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_cut")


def fade_weight(age_s: Column, window_s: float) -> Column:
    """1 until four fifths of the window, then down to 0 as a square; null at or below 0.01."""
    u = age_s / window_s
    out = F.when(u <= 0.8, 1.0).when(u >= 1.0, 0.0).otherwise(((1.0 - u) / 0.2) * ((1.0 - u) / 0.2))
    return F.when(out > 0.01, out)


def trend(df: DataFrame, value: str = "value", samples: int = 15) -> DataFrame:
    """trend (-1, 0, 1), delta and predicted value from the last samples, 5 at least (W17). Needs key."""
    w = in_order(*SERIES).rowsBetween(-(samples - 1), 0)
    df = df.withColumns({"_w": F.collect_list(value).over(w), "_t": trend_threshold(F.col("key"))})
    n, t, win = F.size("_w"), F.col("_t"), F.col("_w")
    last5 = F.slice(win, F.greatest(n - 4, F.lit(1)), 5)
    moves = F.zip_with(F.slice(win, 2, F.greatest(n - 1, F.lit(0))), F.slice(win, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: b - a)
    noise = F.greatest(t * 0.2, F.lit(0.1))
    ups = F.size(F.filter(moves, lambda d: d >= noise))
    downs = F.size(F.filter(moves, lambda d: d <= -noise))
    now, delta = F.element_at(win, -1), F.element_at(win, -1) - F.element_at(win, 1)
    recent = now - F.get(win, n - 2)
    calm = ((F.array_max(win) - F.array_min(win)) < F.greatest(t * 1.5, F.lit(2.0))) | ((F.array_max(last5) - F.array_min(last5)) < t)
    sign = F.when(calm, 0).when((delta > t) & (ups > 1), F.when(recent < -t * 0.5, 0).otherwise(1)).when((delta < -t) & (downs > 1), F.when(recent > t * 0.5, 0).otherwise(-1)).otherwise(0)
    shown = F.when(calm, 0.0).otherwise(delta)
    known = n >= 5
    return df.withColumns({"trend": F.when(known, sign), "delta": F.when(known, shown), "predicted": F.when(known, now + shown)}).drop("_w", "_t")


def stable_ranges(df: DataFrame, category: str, at: Column, *by: str) -> DataFrame:
    """by, category, from_ts, to_ts: the stretch of equal categories that holds at a time; before the first row its own
    stretch. from_ts is null if the stretch is the first, to_ts if it is the last (W27)."""
    w = in_order(*by)
    new = F.when(F.row_number().over(w) == 1, 1).when(F.col(category).eqNullSafe(F.lag(category).over(w)), 0).otherwise(1)
    p = df.withColumn("_new", new).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    i = p.groupBy(*by, "_island").agg(F.first(category).alias(category), F.min("ts").alias("since"))
    i = i.withColumn("to_ts", F.lead("since").over(Window.partitionBy(*by).orderBy("_island")))
    first = F.col("_island") == 1
    i = i.where(((F.col("since") <= at) | first) & (F.col("to_ts").isNull() | (F.col("to_ts") > at)))
    return i.select(*by, category, F.when(~first, F.col("since")).alias("from_ts"), "to_ts")


def console_trend(df: DataFrame, value: str = "value", samples: int = 8) -> DataFrame:
    """symbol: rising, falling or stable by the last samples, 5 at least; stable if the last three are close."""
    w = in_order(*SERIES).rowsBetween(-(samples - 1), 0)
    df = df.withColumns({"_w": F.collect_list(value).over(w), "_t": trend_threshold(F.col("key"))})
    n, t, win = F.size("_w"), F.col("_t"), F.col("_w")
    last3 = F.slice(win, F.greatest(n - 2, F.lit(1)), 3)
    moves = F.zip_with(F.slice(win, 2, F.greatest(n - 1, F.lit(0))), F.slice(win, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: b - a)
    noise = F.greatest(t * 0.2, F.lit(0.1))
    ups, downs = F.size(F.filter(moves, lambda d: d >= noise)), F.size(F.filter(moves, lambda d: d <= -noise))
    delta, recent = F.element_at(win, -1) - F.element_at(win, 1), F.element_at(win, -1) - F.get(win, n - 2)
    calm = (F.array_max(last3) - F.array_min(last3)) < t * 0.5
    up, down = (delta > t) & (ups > 1) & (recent >= -t * 0.5), (delta < -t) & (downs > 1) & (recent <= t * 0.5)
    return df.withColumn("symbol", F.when((n < 5) | calm, "-").when(up, "▲").when(down, "▼").otherwise("-")).drop("_w", "_t")


def as_of(probes: DataFrame, facts: DataFrame, value: str, *by: str) -> DataFrame:
    """Each probe with the last value at or before its time, and that value's time; null before the first.
    One shuffle by the keys: both sides are put in one order, where a fact comes before a probe of the same time."""
    a = facts.select(*by, "ts", F.lit(0).alias("_probe"), F.col(value).alias("_v"), F.lit(None).cast("long").alias("probe_id"))
    b = probes.select(*by, "ts", F.lit(1).alias("_probe"), F.lit(None).cast(facts.schema[value].dataType).alias("_v"), "probe_id")
    w = Window.partitionBy(*by).orderBy("ts", "_probe", F.col("_v").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    found = F.last(F.when(F.col("_probe") == 0, F.struct("ts", "_v"))  , ignorenulls=True).over(w)
    return a.unionByName(b).withColumn("_f", found).where("_probe = 1").select("probe_id", *by, "ts", F.col("_f._v").alias(value), F.col("_f.ts").alias("as_of_ts"))
