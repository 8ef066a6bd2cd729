"""Times of feeds, and the two local days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/Denver"


def parse_utc(text: Column) -> Column:
    """A UTC time from the feeds' spellings; what has no zone is UTC; what can't be read is null."""
    t = F.regexp_replace(F.trim(text), r"\s*UTC$", "")
    plain = F.coalesce(*(F.try_to_timestamp(t, F.lit(f)).cast("timestamp_ntz") for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm")))
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?$"), t.try_cast("timestamp_ntz"))
    zoned = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})$"), F.convert_timezone(F.current_timezone(), F.lit("UTC"), t.try_cast("timestamp").cast("timestamp_ntz")))
    return F.coalesce(plain, iso, zoned)


def seconds(ts: Column) -> Column:
    """Seconds since 1970 of a UTC time without zone, as a double."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {_name(ts)})") / 1e6


def _name(c: Column) -> str:
    return c._jc.toString()


def millis(ts: Column) -> Column:
    """Whole milliseconds since 1970 of a UTC time without zone."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {_name(ts)})")


def iso_ms(ts: Column) -> Column:
    """'2024-01-01T05:00:00.123Z' of a UTC time."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def utc_ms(text: Column) -> Column:
    """Whole milliseconds since 1970 of a UTC time in text; null if it can't be read."""
    t = F.regexp_replace(F.trim(text), r"(?i)\s*(UTC|Z)$", "")
    good = t.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(\.\d{1,3})?$")
    return millis(F.when(good, F.translate(t, "T", " ").try_cast("timestamp_ntz")))


def local(ts: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(ZONE), ts)


def day_5am(ts: Column) -> Column:
    """The local day that begins at 5 in the morning (T1, as a key)."""
    return F.to_date(local(ts) - F.expr("INTERVAL 5 HOURS"))


def day_midnight(ts: Column) -> Column:
    """The local calendar day."""
    return F.to_date(local(ts))


def slot_15min(ts: Column) -> Column:
    """Start of the quarter of an hour."""
    return F.date_trunc("hour", ts).cast("timestamp_ntz") + F.floor(F.minute(ts) / 15) * F.expr("INTERVAL 15 MINUTES")


def local_sql(ts: str) -> str:
    return f"((({ts})::TIMESTAMP AT TIME ZONE 'UTC') AT TIME ZONE '{ZONE}')"


def day_5am_sql(ts: str) -> str:
    return f"CAST({local_sql(ts)} - INTERVAL 5 HOURS AS DATE)"


def day_midnight_sql(ts: str) -> str:
    return f"CAST({local_sql(ts)} AS DATE)"
