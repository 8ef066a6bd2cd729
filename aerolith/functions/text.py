"""Display and cleaning of strings."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_STRING = 10_000
# What must not be in a stored string; (?i) ignores case.
SUSPICIOUS = [
    r"(?i)<\s*script",
    r"(?i)javascript\s*:",
    r"(?i)on\w+\s*=",
    r"\{\{\s*.*\s*\}\}",
    r"\$\{\s*.*\s*\}",
    r"(?i)<\s*iframe",
    r"(?i)<\s*object",
    r"(?i)<\s*embed",
    r"(?i)ignore\s+.{0,20}(previous|prior|above|all|earlier)\s+.{0,10}instructions?",
    r"(?i)disregard\s+.{0,20}(previous|prior|above|all|earlier)\s+.{0,10}instructions?",
    r"(?i)forget\s+.{0,20}(previous|prior|above|all|earlier)\s+.{0,10}instructions?",
    r"(?i)new\s+instructions?\s*:",
    r"(?i)system\s*:\s*you\s+are",
    r"(?i)<\s*/?\s*system\s*>",
    r"(?i)\[\s*INST\s*\]",
    r"(?i)\[\s*/\s*INST\s*\]",
    r"(?i)<\|im_start\|>",
    r"(?i)<\|im_end\|>",
]


def sanitised(text: Column) -> Column:
    """Cut to MAX_STRING, without control characters, suspicious parts replaced."""
    out = F.regexp_replace(F.substring(text, 1, MAX_STRING), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    for pattern in SUSPICIOUS:
        out = F.regexp_replace(out, pattern, "[REMOVED]")
    return out


def sanitised_sql(text: str) -> str:
    out = rf"regexp_replace(substring({text}, 1, {MAX_STRING}), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')"
    for pattern in SUSPICIOUS:
        out = f"regexp_replace({out}, '{pattern}', '[REMOVED]', 'g')"
    return out


def fixed(v: Column, digits: int) -> Column:
    """The number with so many digits after the point, the nearest to what the double is exactly, halves to the even one as
    printf has it. (format_string rounds the shortest text of the double, so that 40.4125, which is a little less, goes up.)
    Null is null."""
    scale, x = 10**digits, F.abs(v)
    high = x * float(scale)
    # what the product leaves out, exactly: the upper 26 bits of x times the scale need no rounding
    upper = x * 134_217_729.0 - (x * 134_217_729.0 - x)
    rest = (upper * float(scale) - high) + (x - upper) * float(scale)
    near = F.rint(high)
    whole = near + F.when((high - near == 0.5) & (rest > 0), 1.0).when((high - near == -0.5) & (rest < 0), -1.0).otherwise(0.0)
    text = (whole.cast("decimal(18,0)") * F.lit(Decimal(1).scaleb(-digits))).cast(f"decimal(20,{digits})").cast("string")
    text = F.when(x < 1e12, F.concat(F.when(v < 0, "-").otherwise(""), text)).otherwise(F.format_string(f"%.{digits}f", v))
    return F.when(v.isNotNull(), text)


def display_value(v: Column, width: int = 5) -> Column:
    """Fewer digits the larger the value, right-aligned (X2); halves go up; null is blank."""
    shown = F.when(v >= 100, F.format_string("%.0f", v)).when(v >= 10, F.format_string("%.1f", v)).otherwise(F.format_string("%.2f", v))
    return F.when(v.isNull(), " " * width).otherwise(F.when(F.length(shown) < width, F.lpad(shown, width, " ")).otherwise(shown))


def short_name(name: Column, most: int = 25) -> Column:
    """Cut with an ellipsis."""
    return F.when(F.length(name) > most, F.concat(F.substring(name, 1, most - 1), F.lit("…"))).otherwise(name)


def key_of(kind: Column, name: Column) -> Column:
    return F.concat(kind, F.lit(":"), name)


def kind_of(key: Column) -> Column:
    """The part before the colon; keys without one are mobile sensors."""
    return F.when(F.instr(key, ":") > 0, F.substring_index(key, ":", 1)).otherwise("mobile")


def name_of(key: Column) -> Column:
    return F.regexp_replace(key, "^[^:]*:", "")


def safe_date(text: Column) -> Column:
    """Letters, digits and dashes only, 20 at most."""
    return F.substring(F.regexp_replace(text, "[^A-Za-z0-9-]", ""), 1, 20)


def visitor_hash(address: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt), address), 256)
