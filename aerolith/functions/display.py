"""Colours, bars and labels of values, as column expressions and SQL (F2d, F9-F12, F14, F15, X3, X9, X11, X15, P18, Z17, Z26)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BREAKPOINTS, COUNTY_FIPS, PALETTE, SENTINEL_BANDS, VENDOR_SUFFIX
from .aqi import aqi_to_value
from .text import fixed

GRAY = "#6b7280"


def half_up(x: Column) -> Column:
    """Whole number, halves upwards for negative ones too."""
    return F.floor(x + 0.5).cast("long")


def field_aqi(v: Column) -> Column:
    """Particle index for fields (F2d): not cut down to steps, so values between two bands go on below the upper one."""
    out = F.when(v < 0, 0.0)
    for lo, hi, i, j in BREAKPOINTS["pm2.5"]:
        out = out.when(v <= hi, F.lit(float(j - i) / (hi - lo)) * (v - lo) + float(i))
    return F.when(v.isNotNull(), out.otherwise(500.0))


def field_aqi_sql(v: str) -> str:
    out = f"CASE WHEN {v} IS NULL THEN NULL WHEN {v} < 0 THEN 0.0::DOUBLE"
    for lo, hi, i, j in BREAKPOINTS["pm2.5"]:
        out += f" WHEN {v} <= {hi}::DOUBLE THEN ({j - i}::DOUBLE / ({hi}::DOUBLE - {lo}::DOUBLE)) * ({v} - {lo}::DOUBLE) + {i}::DOUBLE"
    return out + " ELSE 500.0::DOUBLE END"


def category(v: Column, tops: list) -> Column:
    """How many of the upper bounds a value is above."""
    out = F.when(v.isNull(), F.lit(None).cast("int"))
    for i, top in enumerate(tops):
        out = out.when(v <= top, i)
    return out.otherwise(len(tops)).cast("int")


def category_sql(v: str, tops: list) -> str:
    return f"(CASE WHEN {v} IS NULL THEN NULL " + " ".join(f"WHEN {v} <= {top}::DOUBLE THEN {i}" for i, top in enumerate(tops)) + f" ELSE {len(tops)} END)::INTEGER"


def sentinel_color(v: Column) -> Column:
    """Colour for detecting changes: the two bands from 2 to 9 are one."""
    out = F.when(v.isNull(), F.lit(None).cast("string"))
    for top, color in SENTINEL_BANDS:
        out = out.when(v <= top, color)
    return out.otherwise(PALETTE[11])


def sentinel_sql(v: str) -> str:
    return f"CASE WHEN {v} IS NULL THEN NULL " + " ".join(f"WHEN {v} <= {top}::DOUBLE THEN '{color}'" for top, color in SENTINEL_BANDS) + f" ELSE '{PALETTE[11]}' END"


def ramp(v: Column, stops: list) -> Column:
    """'r,g,b' of a value between two stops, linear; beyond the ends theirs."""
    def channel(k: int) -> Column:
        out = F.when(v <= stops[0][0], stops[0][1][k])
        for (a, x), (b, y) in zip(stops, stops[1:]):
            out = out.when(v <= b, half_up(x[k] + (v - a) / (b - a) * float(y[k] - x[k])))
        return out.otherwise(stops[-1][1][k]).cast("long")

    return F.when(v.isNotNull(), F.concat_ws(",", *(channel(k).cast("string") for k in range(3))))


def ramp_sql(v: str, stops: list) -> str:
    def channel(k: int) -> str:
        out = f"CASE WHEN {v} <= {stops[0][0]}::DOUBLE THEN {stops[0][1][k]}"
        for (a, x), (b, y) in zip(stops, stops[1:]):
            out += f" WHEN {v} <= {b}::DOUBLE THEN floor({x[k]}::DOUBLE + ({v} - {a}::DOUBLE) / ({b}::DOUBLE - {a}::DOUBLE) * {y[k] - x[k]}::DOUBLE + 0.5::DOUBLE)::BIGINT"
        return out + f" ELSE {stops[-1][1][k]} END"

    return f"CASE WHEN {v} IS NOT NULL THEN " + " || ',' || ".join(f"({channel(k)})::VARCHAR" for k in range(3)) + " END"


def channels(color: Column) -> list[Column]:
    """Red, green and blue of '#rrggbb'."""
    return [F.conv(F.substring(color, 2 + 2 * k, 2), 16, 10).cast("double") for k in range(3)]


def hex_of(*rgb: Column) -> Column:
    return F.lower(F.concat(F.lit("#"), *(F.lpad(F.hex(half_up(c)), 2, "0") for c in rgb)))


def is_hex(color: Column) -> Column:
    return F.coalesce(color.rlike("^#[0-9A-Fa-f]{6}$"), F.lit(False))


def mixed(color: Column, target: list[Column], amount: float) -> Column:
    return hex_of(*(c * (1.0 - amount) + t * amount for c, t in zip(channels(color), target)))


def dimmed(color: Column, amount: float = 0.6) -> Column:
    """A colour towards slate gray (F12); anything else than '#rrggbb' becomes that gray."""
    return F.when(is_hex(color), mixed(color, channels(F.lit(GRAY)), amount)).otherwise(GRAY)


def luminance(color: Column) -> Column:
    r, g, b = channels(color)
    return half_up(0.2126 * r + 0.7152 * g + 0.0722 * b).cast("double")


def grayed(color: Column) -> Column:
    y = luminance(color)
    return F.when(is_hex(color), hex_of(y, y, y)).otherwise(GRAY)


def desaturated(color: Column, amount: float = 0.25) -> Column:
    y = luminance(color)
    return F.when(is_hex(color), mixed(color, [y, y, y], amount)).otherwise(GRAY)


def darkened(color: Column, factor: float = 0.75) -> Column:
    return F.when(is_hex(color), hex_of(*(c * factor for c in channels(color)))).otherwise(PALETTE[0])


def rgba(color: Column, alpha: float = 1.0) -> Column:
    text = F.concat(F.lit("rgba("), F.concat_ws(", ", *(c.cast("long").cast("string") for c in channels(color))), F.lit(f", {alpha:g})"))
    return F.when(is_hex(color), text).otherwise(f"rgba(204, 204, 204, {alpha:g})")


def indicator(aqi: Column) -> Column:
    """A mark for the index's category."""
    out = None
    for top, mark in ((50, "🟢"), (100, "🟡"), (150, "🟠"), (200, "🔴"), (300, "🟣")):
        out = F.when(aqi <= top, mark) if out is None else out.when(aqi <= top, mark)
    return F.when(aqi.isNotNull(), out.otherwise("🟤"))


def aqi_percent(aqi: Column) -> Column:
    """Length of a bar: 100 at an index of 300 (F15); unknown is 0."""
    return F.coalesce(F.least(F.greatest(aqi / 300.0 * 100.0, F.lit(0.0)), F.lit(100.0)), F.lit(0.0))


def spark_percent(value: Column, most: Column) -> Column:
    """Height in a sparkline, against the history's greatest value (1 if none is above 0)."""
    top = F.when(most > 0, most).otherwise(1.0)
    return F.coalesce(F.least(F.greatest(value / top * 100.0, F.lit(0.0)), F.lit(100.0)), F.lit(0.0))


def spark_scale(most_aqi: Column, known: Column) -> Column:
    return F.when(known, F.lit(0.25) + 0.75 * F.sqrt(aqi_percent(most_aqi) / 100.0)).otherwise(0.0)


def spark_level(value: Column, least: Column, most: Column) -> Column:
    """Eighth of the range that a value is in, 0 to 7; 4 where all are equal."""
    level = F.least(F.greatest(((value - least) / (most - least) * 7.0).cast("int"), F.lit(0)), F.lit(7))
    return F.when(most > least, level).otherwise(4)


def tag_value(v: Column) -> Column:
    """Whole numbers without decimals, others one below 10 and none above."""
    return F.when(v.isNull(), "").when(v == F.floor(v), v.cast("long").cast("string")).when(v < 10, fixed(v, 1)).otherwise(half_up(v).cast("string"))


def shown_time(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", "—").otherwise(F.regexp_replace(text, "^(.*?) UTC", "$1"))


def collapsed_integer(v: Column) -> Column:
    """Text of a number, without decimals where it is whole."""
    return F.when(v == F.floor(v), v.cast("long").cast("string")).otherwise(v.cast("string"))


def map_view(raw: Column) -> Column:
    """'lat,lon zzoom' of a stored view in JSON; other texts are cut to 30 characters (X11)."""
    at = lambda k: F.coalesce(F.get_json_object(raw, f"$.{k}").try_cast("double"), F.lit(0.0))
    shown = F.concat(F.round(at("lat"), 4).cast("string"), F.lit(","), F.round(at("lon"), 4).cast("string"), F.lit(" z"), F.round(at("zoom"), 1).cast("string"))
    return F.when(F.coalesce(raw, F.lit("")) == "", "—").when(F.get_json_object(raw, "$").isNull(), F.substring(raw, 1, 30)).otherwise(shown)


def vehicle_mark(sensor_id: Column) -> Column:
    """Mark by the id's beginning."""
    s = F.upper(sensor_id)
    return F.when(s.startswith("BUS"), "🚍").when(s.startswith("TRX") | s.startswith("TRAX"), "🚃").otherwise("📍")


def without_vendor(name: Column) -> Column:
    """A community sensor's name without the vendor's words."""
    return F.trim(F.regexp_replace(name, VENDOR_SUFFIX, ""))


def county_fips(name: Column) -> Column:
    """Code of a county by name or code; null if it isn't one."""
    s = F.trim(name)
    known = F.regexp_replace(F.regexp_replace(F.lower(s), r"\s+county$", ""), r"\s+", " ")
    known = F.when(known.isin("slc", "salt lake city"), "salt lake").otherwise(known)
    by_name = F.try_element_at(F.create_map(*(F.lit(x) for kv in COUNTY_FIPS.items() for x in kv)), known)
    code = s.try_cast("int")
    return F.when(s.rlike("^[0-9]+$"), F.when(code.between(49_000, 49_999), code)).otherwise(by_name)


def legend_value(key: Column, aqi: Column) -> Column:
    """The concentration of an index as the legend shows it: ozone in ppb."""
    return aqi_to_value(key, aqi) * F.when(key == "ozone", 1000.0).otherwise(1.0)
