"""Index and colour of concentrations, as column expressions and as SQL of the same tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BREAKPOINTS, COLOR_BANDS, FEED_CLAMP, LEVELS, PLAUSIBLE, SPELLINGS, TREND_THRESHOLD

#: Concentrations are cut down to steps of one over this before the bands are looked up.
STEPS = {"pm2.5": 10.0, "co": 10.0, "pm10": 1.0, "no2": 1.0, "ozone": 1000.0}


def number(text: Column) -> Column:
    """A finite number, or null."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def pollutant_key(name: Column) -> Column:
    """One spelling for each pollutant; others trimmed and in lower case (F1)."""
    key = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    out = key
    for k, spellings in SPELLINGS.items():
        out = F.when(key.isin(spellings), k).otherwise(out)
    return out


def _by_key(key: Column, of: dict, other: Column) -> Column:
    out = None
    for k, value in of.items():
        out = F.when(key == k, value) if out is None else out.when(key == k, value)
    return out.otherwise(other)


def _null() -> Column:
    return F.lit(None).cast("double")


def value_to_aqi(key: Column, value: Column, *, ozone_zero_is_null: bool = False) -> Column:
    """Index of a concentration of a pollutant_key (F2): between the bands' ends linear, beyond the table its ends.
    Ozone comes in ppb. ozone_zero_is_null: ozone at or below 0 has none (F2b)."""
    of = {}
    for k, bands in BREAKPOINTS.items():
        v = value / 1000.0 if k == "ozone" else value
        v = F.floor(v * STEPS[k]).cast("double") / STEPS[k]
        out = F.when(F.isnan(value), _null()).when(v < bands[0][0], float(bands[0][2]))
        for lo, hi, i, j in bands:
            out = out.when((v >= lo) & (v <= hi), F.lit(float(j - i) / (hi - lo)) * (v - lo) + float(i))
        of[k] = out.when(v > bands[-1][1], float(bands[-1][3]))
    if ozone_zero_is_null:
        of["ozone"] = F.when(value > 0, of["ozone"])
    return _by_key(key, of, _null())


def aqi_sql(key: str, value: str) -> str:
    out = "CASE"
    for k, bands in BREAKPOINTS.items():
        v = f"({value} / 1000.0::DOUBLE)" if k == "ozone" else value
        v = f"(floor({v} * {STEPS[k]}::DOUBLE) / {STEPS[k]}::DOUBLE)"
        out += f" WHEN {key} = '{k}' THEN CASE WHEN {v} < {bands[0][0]}::DOUBLE THEN {bands[0][2]}::DOUBLE"
        for lo, hi, i, j in bands:
            out += f" WHEN {v} BETWEEN {lo}::DOUBLE AND {hi}::DOUBLE THEN ({j - i}::DOUBLE / ({hi}::DOUBLE - {lo}::DOUBLE)) * ({v} - {lo}::DOUBLE) + {i}::DOUBLE"
        out += f" WHEN {v} > {bands[-1][1]}::DOUBLE THEN {bands[-1][3]}::DOUBLE END"
    return out + " END"


def aqi_to_value(key: Column, aqi: Column) -> Column:
    """The concentration of an index (F4), ozone in ppm; above the table its end."""
    of = {}
    for k, bands in BREAKPOINTS.items():
        out = F.when(aqi < 0, _null())
        for lo, hi, i, j in bands:
            out = out.when(aqi <= j, F.lit((hi - lo) / float(j - i)) * (F.greatest(aqi, F.lit(float(i))) - float(i)) + lo)
        of[k] = out.when(aqi > bands[-1][3], bands[-1][1])
    return _by_key(key, of, _null())


def aqi_to_value_sql(key: str, aqi: str) -> str:
    out = "CASE"
    for k, bands in BREAKPOINTS.items():
        out += f" WHEN {key} = '{k}' THEN CASE WHEN {aqi} < 0 THEN NULL"
        for lo, hi, i, j in bands:
            out += f" WHEN {aqi} <= {j} THEN (({hi}::DOUBLE - {lo}::DOUBLE) / {j - i}::DOUBLE) * (greatest({aqi}, {i}::DOUBLE) - {i}::DOUBLE) + {lo}::DOUBLE"
        out += f" ELSE {bands[-1][1]}::DOUBLE END"
    return out + " END"


def aqi_level(aqi: Column) -> Column:
    """Label of an index; null is unknown, above the table the last."""
    out = F.when(aqi.isNull(), "Unknown")
    for top, label in LEVELS:
        out = out.when(aqi <= top, label)
    return out.otherwise(LEVELS[-1][1])


def level_sql(aqi: str) -> str:
    return f"CASE WHEN {aqi} IS NULL THEN 'Unknown' " + " ".join(f"WHEN {aqi} <= {top} THEN '{label}'" for top, label in LEVELS) + f" ELSE '{LEVELS[-1][1]}' END"


def color_index(key: Column, value: Column) -> Column:
    """Place in the palette of a concentration, which is not cut down first (F6-F8); 0 unknown."""
    of = {}
    for k, bands in COLOR_BANDS.items():
        out = F.when(value.isNull(), 0)
        for top, i in bands:
            out = out.when(value <= top, i)
        of[k] = out.otherwise(11)
    return _by_key(key, of, F.lit(0)).cast("int")


def color_sql(key: str, value: str) -> str:
    out = f"CASE WHEN {value} IS NULL THEN 0"
    for k, bands in COLOR_BANDS.items():
        out += f" WHEN {key} = '{k}' THEN CASE " + " ".join(f"WHEN {value} <= {top}::DOUBLE THEN {i}" for top, i in bands) + " ELSE 11 END"
    return f"({out} ELSE 0 END)::INTEGER"


def _within(key: Column, value: Column, bounds: dict) -> Column:
    return _by_key(key, {k: value.between(lo, hi) for k, (lo, hi) in bounds.items()}, F.lit(True))


def is_plausible(key: Column, value: Column) -> Column:
    """Finite and within the pollutant's bounds; pollutants without bounds only need to be finite."""
    return F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")) & _within(key, value, PLAUSIBLE), F.lit(False))


def clamp_feed(key: Column, value: Column) -> Column:
    """Null where the mobile feed's value can't be (P10)."""
    return F.when(_within(key, value, FEED_CLAMP), value)


def within_sql(key: str, value: str, bounds: dict) -> str:
    return "CASE " + " ".join(f"WHEN {key} = '{k}' THEN {value} BETWEEN {lo}::DOUBLE AND {hi}::DOUBLE" for k, (lo, hi) in bounds.items()) + " ELSE true END"


def plausible_sql(key: str, value: str) -> str:
    return f"coalesce(isfinite({value}) AND {within_sql(key, value, PLAUSIBLE)}, false)"


def trend_threshold(key: Column) -> Column:
    return _by_key(key, {k: F.lit(v) for k, v in TREND_THRESHOLD.items()}, F.lit(1.0))


def threshold_sql(key: str) -> str:
    return "CASE " + " ".join(f"WHEN {key} = '{k}' THEN {v}::DOUBLE" for k, v in TREND_THRESHOLD.items()) + " ELSE 1.0::DOUBLE END"
