"""Trails whose cleaning depends on what was kept before.

Rows are dealt by their trail's key and sorted in Spark; a task goes through its sorted batches and works trail by trail.
A trail to clean or to classify is one sensor's points in one local day, which bounds it; only the trail that a batch
ends in is held for the next one. Rules that look at the last kept row alone carry just that from batch to batch, so a
series of any length passes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

EARTH_M = 6_371_000.0


def metres(lat1, lon1, lat2, lon2):
    p1, p2 = np.radians(lat1), np.radians(lat2)
    a = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(np.subtract(lon2, lon1)) / 2) ** 2
    return 2 * EARTH_M * np.arctan2(np.sqrt(a), np.sqrt(np.maximum(1 - a, 0)))


def far(a: tuple, b: tuple) -> float:
    """Metres between two places."""
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * EARTH_M * math.atan2(math.sqrt(h), math.sqrt(max(1 - h, 0.0)))


def in_order(df: DataFrame, *by: str) -> DataFrame:
    return df.repartition(*by).sortWithinPartitions(*by, F.col("ts").asc_nulls_last(), "reading_id")


def starts(pdf: pd.DataFrame, by: list[str]) -> np.ndarray:
    """Places where a new key begins, 0 first."""
    new = np.zeros(len(pdf), bool)
    new[:1] = True
    for c in by:
        x = pdf[c].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def whole_trails(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """The same rows in batches that end with a trail."""
    held = None
    for pdf in batches:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if len(pdf):
            last = starts(pdf, by)[-1]
            if last:
                yield pdf.iloc[:last]
            held = pdf.iloc[last:].reset_index(drop=True)
    if held is not None and len(held):
        yield held


@dataclass(frozen=True)
class Cleaning:
    """Metres and seconds of the cleaning steps."""

    same_m: float = 2.0
    out_m: float = 55.0
    back_m: float = 22.0
    plateau_m: float = 30.0
    tail: int = 24
    parked_m: float = 90.0
    parked_points: int = 12
    parked_s: float = 60.0
    parked_travel_m: float = 260.0
    scan: int = 1200


def apart(xy: list[tuple], least: float) -> list[int]:
    """Places of the points that are further than ``least`` from the last one kept."""
    kept: list[int] = []
    for i, p in enumerate(xy):
        if not kept or far(xy[kept[-1]], p) > least:
            kept.append(i)
    return kept


def lone_spike(xy: list[tuple], i: int, c: Cleaning) -> int:
    """1 if point i leaves the trail and the next one is back."""
    if i + 1 >= len(xy) or far(xy[i - 1], xy[i]) < c.out_m or far(xy[i], xy[i + 1]) < c.out_m:
        return 0
    return int(far(xy[i - 1], xy[i + 1]) <= c.back_m)


def plateau_spike(xy: list[tuple], i: int, c: Cleaning) -> int:
    """How many points from i on, each near the one before, are away until the trail is back."""
    if i + 2 >= len(xy) or far(xy[i - 1], xy[i]) < c.out_m:
        return 0
    j = i + 1
    while j < len(xy) and far(xy[j - 1], xy[j]) <= c.plateau_m:
        j += 1
    n = j - i
    if n < 2 or j >= len(xy) or far(xy[j - 1], xy[j]) < c.out_m:
        return 0
    return n if far(xy[i - 1], xy[j]) <= min(c.back_m * n, c.out_m) else 0


def without_spikes(xy: list[tuple], c: Cleaning) -> list[int]:
    """Places of the points left when neither kind of spike remains; only the last ``scan`` points are looked at."""
    at, xy = list(range(len(xy))), list(xy)
    first = max(1, len(at) - max(20, c.scan))
    before = None
    while before != len(at):
        before = len(at)
        for spike in (lone_spike, plateau_spike):
            i = first
            while i < len(at) - 1:
                n = spike(xy, i, c)
                if n:
                    del at[i : i + n], xy[i : i + n]
                    i = max(first, i - 2)
                else:
                    i += 1
    return at


def parked_from(xy: np.ndarray, centre: np.ndarray, radius: float, scan: int) -> int:
    """First point of the stretch at the end that stays within a radius of a centre."""
    away = metres(xy[:-1, 0], xy[:-1, 1], *centre) > radius
    away[: max(0, len(xy) - scan)] = True
    out = np.flatnonzero(away)
    return int(out[-1]) + 1 if len(out) else 0


def cleaned(lat: np.ndarray, lon: np.ndarray, seconds: np.ndarray, c: Cleaning = Cleaning()) -> tuple[np.ndarray, np.ndarray | None]:
    """Which points stay of a trail without repeats, spikes and the crowd of a parked end (W6-W9). A parked end becomes its
    first point and its last one, which is put at the end's middle (returned beside)."""
    at = np.flatnonzero(np.isfinite(lat) & np.isfinite(lon))
    if len(at) < 2:
        return at, None
    at = at[apart(list(zip(lat[at].tolist(), lon[at].tolist())), c.same_m)]
    if len(at) < 4:
        return at, None
    at = at[without_spikes(list(zip(lat[at].tolist(), lon[at].tolist())), c)]
    if len(at) < c.parked_points + 2:
        return at, None
    xy, t = np.stack([lat[at], lon[at]], 1), seconds[at]
    centre = np.median(xy[-max(6, c.tail) :], axis=0)
    k = parked_from(xy, centre, c.parked_m, max(100, c.scan))
    brief = t[-1] - t[k] < c.parked_s  # never with an unknown time
    if len(at) - k < c.parked_points or brief or metres(xy[k:-1, 0], xy[k:-1, 1], xy[k + 1 :, 0], xy[k + 1 :, 1]).sum() > c.parked_travel_m:
        return at, None
    return np.append(at[: k + 1], at[-1]), centre


def clean(points: pd.DataFrame, c: Cleaning = Cleaning(), by: list[str] | None = None) -> pd.DataFrame:
    """Trails, one after the other and each in order, cleaned."""
    lat, lon, t = points.lat.to_numpy(float).copy(), points.lon.to_numpy(float).copy(), epoch(points.ts)
    cuts = [*(starts(points, by) if by else [0]), len(points)]
    kept, moved = [], []
    for a, b in zip(cuts, cuts[1:]):
        at, centre = cleaned(lat[a:b], lon[a:b], t[a:b], c)
        kept.append(a + at)
        if centre is not None:
            moved.append((a + at[-1], centre))
    for i, centre in moved:
        lat[i], lon[i] = centre
    return points.assign(lat=lat, lon=lon).iloc[np.concatenate(kept)]


def epoch(ts: pd.Series) -> np.ndarray:
    t = ts.astype("datetime64[ns]")
    return np.where(t.notna(), t.astype("int64") / 1e9, np.nan)


def collapse_end(p: pd.DataFrame, lat: float, lon: float, radius: float = 70.0, least: int = 10) -> pd.DataFrame:
    """A parked end around a known centre becomes its first point and one at the centre."""
    if len(p) < least + 2:
        return p
    at = parked_from(p[["lat", "lon"]].to_numpy(float), np.array([lat, lon]), radius, len(p))
    if len(p) - at < least:
        return p
    end = p.iloc[[-1]].assign(lat=float(lat), lon=float(lon))
    return pd.concat([p.iloc[: at + 1], end], ignore_index=True)


def clean_trails(df: DataFrame, *by: str, cleaning: Cleaning = Cleaning()) -> DataFrame:
    ship(df.sparkSession)
    keys = list(by)
    return in_order(df, *by).mapInPandas(lambda batches: (clean(pdf, cleaning, keys) for pdf in whole_trails(batches, keys)), df.schema)


@dataclass(frozen=True)
class Mobility:
    """Fixed values of the classifier: minutes, samples, metres."""

    lookback_min: int = 15
    coverage_min: int = 12
    samples: int = 6
    travel_m: float = 250.0
    step_m: float = 150.0
    box_m: float = 300.0
    radius_m: float = 220.0
    net_m: float = 260.0
    proof_step_m: float = 60.0
    proof_net_m: float = 100.0
    idle_radius_m: float = 120.0
    proof_speed: float = 2.0
    calm_travel_m: float = 100.0
    calm_step_m: float = 20.0
    calm_box_m: float = 60.0
    calm_radius_m: float = 30.0


def trimmed(x: np.ndarray, more_than: int) -> np.ndarray:
    x = np.sort(x)
    return x[1:-1] if len(x) > more_than else x


def box_diagonal(xy: np.ndarray) -> float:
    """Diagonal of the bounding box, without the outermost values of more than four points."""
    if len(xy) < 2:
        return 0.0
    spans = [np.ptp(trimmed(xy[:, k], 4)) * 111_320.0 for k in (0, 1)]
    return float(np.hypot(spans[0], spans[1] * np.cos(np.radians(xy[:, 0].mean()))))


class Path:
    """Measures of a stretch of a trail."""

    def __init__(self, xy: np.ndarray):
        self.xy = xy
        self.steps = metres(xy[:-1, 0], xy[:-1, 1], xy[1:, 0], xy[1:, 1]) if len(xy) > 1 else np.zeros(0)
        self.net = float(metres(*xy[0], *xy[-1])) if len(xy) else 0.0
        self.middle = np.median(xy, axis=0) if len(xy) else np.full(2, np.nan)

    @property
    def most(self) -> float:
        return float(self.steps.max(initial=0.0))

    @property
    def robust_radius(self) -> float:
        return float(trimmed(metres(self.xy[:, 0], self.xy[:, 1], *self.middle), 3)[-1])

    def radius_from_mean(self) -> float:
        return float(metres(self.xy[:, 0], self.xy[:, 1], *self.xy.mean(axis=0)).max())


def classify(lat: np.ndarray, lon: np.ndarray, ts: np.ndarray, m: Mobility = Mobility()) -> dict:
    """Whether a sensor stands still, and where (W12). ts: seconds, NaN unknown. Without any place: not known (null)."""
    good = np.isfinite(lat) & np.isfinite(lon)
    xy, ts = np.stack([lat, lon], 1)[good], np.asarray(ts, float)[good]
    n = len(xy)
    moving = {"immobile": False, "samples": n, "stable_lat": None, "stable_lon": None, "rule": "moving"}
    if not n:
        return moving | {"immobile": None, "rule": "no places"}
    idle = lambda at, rule, samples=n: {"immobile": True, "samples": samples, "stable_lat": float(at[0]), "stable_lon": float(at[1]), "rule": rule}
    path = Path(xy)
    if n < m.samples:
        if n == 1:
            return idle(xy[0], "single")
        seconds = ts[-1] - ts[-2]
        speed = path.steps[-1] / seconds if seconds > 0 else 0.0
        proven = path.net >= m.proof_net_m or path.steps.sum() >= 1.5 * m.proof_net_m or speed >= m.proof_speed or (path.most >= m.proof_step_m and path.net >= m.proof_net_m / 2)
        return moving if proven else idle(path.middle, "sparse")
    tail = Path(xy[-m.samples :])
    if tail.steps.sum() <= m.calm_travel_m and tail.most <= m.calm_step_m and box_diagonal(tail.xy) <= m.calm_box_m and tail.radius_from_mean() <= m.calm_radius_m:
        return idle(tail.xy.mean(axis=0), "calm", m.samples)
    known = ts[np.isfinite(ts)]
    recent = ~(ts < known[-1] - 60 * m.lookback_min) if len(known) else np.ones(n, bool)
    path, times = Path(xy[recent]), ts[recent][np.isfinite(ts[recent])]
    moving["samples"] = len(path.xy)
    if len(path.xy) < m.samples:
        return moving
    if len(times):
        if max(times[-1] - times[0], 0.0) / 60 < m.coverage_min:
            proven = path.net >= m.proof_net_m or (path.most >= m.proof_step_m and path.net >= m.proof_net_m / 2) or path.robust_radius >= m.idle_radius_m
            return moving if proven else idle(path.middle, "low coverage", len(path.xy))
    elif len(path.xy) < m.lookback_min // 2:
        return moving
    inner = trimmed(path.steps, 2)
    by_travel = inner.sum() < m.travel_m and inner.max() < m.step_m and box_diagonal(path.xy) < m.box_m
    by_radius = path.robust_radius < m.radius_m and path.net < m.net_m
    return idle(path.middle, "window", len(path.xy)) if by_travel or by_radius else moving


def mobility(df: DataFrame, *by: str, rules: Mobility = Mobility()) -> DataFrame:
    """One row per group: immobile, samples, stable_lat, stable_lon, rule."""
    keys = ", ".join(f"{b} {df.schema[b].dataType.simpleString()}" for b in by)

    def run(batches):
        for pdf in whole_trails(batches, list(by)):
            lat, lon, t = pdf.lat.to_numpy(float), pdf.lon.to_numpy(float), epoch(pdf.ts)
            first = starts(pdf, list(by))
            found = [classify(lat[a:b], lon[a:b], t[a:b], rules) for a, b in zip(first, [*first[1:], len(pdf)])]
            yield pd.concat([pdf[list(by)].iloc[first].reset_index(drop=True), pd.DataFrame(found)], axis=1)

    ship(df.sparkSession)
    return in_order(df, *by).mapInPandas(run, f"{keys}, immobile boolean, samples int, stable_lat double, stable_lon double, rule string")


def kept_by_the_last(df: DataFrame, by: tuple[str, ...], column: str, takes: Callable) -> DataFrame:
    """Rows that are taken in, given value and ``column`` of the last row taken in of their key (none at first)."""
    keys = list(by)

    def run(batches):
        key, last = None, None
        for pdf in batches:
            kept = []
            for i, row in enumerate(zip(zip(*(pdf[c] for c in keys)), pdf["value"], pdf[column])):
                if row[0] != key:
                    key, last = row[0], None
                if last is None or takes(row[1:], last):
                    kept.append(i)
                    last = row[1:]
            yield pdf.iloc[kept]

    ship(df.sparkSession)
    return in_order(df, *by).mapInPandas(run, df.schema)


def committed_changes(df: DataFrame, *by: str, least: float = 2.5) -> DataFrame:
    """Rows whose band (ci) differs from that of the last committed row and whose value does by ``least``."""
    return kept_by_the_last(df, by, "ci", lambda now, last: now[1] != last[1] and abs(now[0] - last[0]) >= least)


def accept_community(df: DataFrame, *by: str, gap_s: float = 300.0) -> DataFrame:
    """Community readings that differ from the last accepted one or come some time after it."""
    return kept_by_the_last(df, by, "ts", lambda now, last: now[0] != last[0] or (now[1] - last[1]).total_seconds() >= gap_s)
