"""Readings of locations, dates and numbers: columns for data, Python functions for query values."""

from __future__ import annotations

import json
import math
import re
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"

#: The date spellings that are understood; the first that fits wins.
DATE_PATTERNS = (
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss'Z'",
    "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'",
    "yyyy-MM-dd HH:mm:ssX",
    "yyyy-MM-dd HH:mm:ss",
    "yyyyMMddHHmmss",
    "yyyy-MM-dd HH:mm:ss.SSX",
    "yyyy-MM-dd",
    "dd/MM-yyyy",
    "dd/MM/yyyy",
    "yyyy-MM",
    "yyyy",
    "HH:mm:ss",
)

#: The same spellings for Python's parser, each with a pattern that fixes the number of digits.
_PYTHON_DATES = (
    (r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d", "%Y-%m-%dT%H:%M:%S"),
    (r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", "%Y-%m-%dT%H:%M:%SZ"),
    (r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z", "%Y-%m-%dT%H:%M:%S.%fZ"),
    (r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(?:Z|[+-]\d\d(?::?\d\d)?)", "%Y-%m-%d %H:%M:%S%z"),
    (r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d", "%Y-%m-%d %H:%M:%S"),
    (r"\d{14}", "%Y%m%d%H%M%S"),
    (r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\.\d\d(?:Z|[+-]\d\d(?::?\d\d)?)", "%Y-%m-%d %H:%M:%S.%f%z"),
    (r"\d{4}-\d\d-\d\d", "%Y-%m-%d"),
    (r"\d\d/\d\d-\d{4}", "%d/%m-%Y"),
    (r"\d\d/\d\d/\d{4}", "%d/%m/%Y"),
    (r"\d{4}-\d\d", "%Y-%m"),
    (r"\d{4}", "%Y"),
    (r"\d\d:\d\d:\d\d", "%H:%M:%S"),
)


def point_of(text: Column) -> Column:
    """STRUCT<x, y> of a location: a WKT point (any case and blanks, SRID prefix allowed), `x, y`, `[x, y]` or `["x", "y"]`.

    Null where the text is none of these or a coordinate lies outside [-180, 180] or [-90, 90].
    """
    spellings = (
        rf"(?i)^\s*(?:SRID\s*=\s*[0-9]+\s*;\s*)?POINT\s*\(\s*({NUMBER})\s+({NUMBER})\s*\)\s*$",
        rf"^\s*({NUMBER})\s*,\s*({NUMBER})\s*$",
        rf"^\s*\[\s*({NUMBER})\s*,\s*({NUMBER})\s*\]\s*$",
        rf'^\s*\[\s*"\s*({NUMBER})\s*"\s*,\s*"\s*({NUMBER})\s*"\s*\]\s*$',
    )

    def part(i: int) -> Column:
        found = [F.regexp_extract(text, s, i) for s in spellings]
        return F.coalesce(*(F.when(f != "", f) for f in found)).try_cast("double")

    x, y = part(1), part(2)
    return F.when(x.between(-180, 180) & y.between(-90, 90), F.struct((x + 0.0).alias("x"), (y + 0.0).alias("y")))


def epoch_of(text: Column) -> Column:
    """Epoch seconds (UTC, milliseconds in the fraction) of a date in any spelling of DATE_PATTERNS, else null."""
    stamp = F.coalesce(*(F.try_to_timestamp(text, F.lit(p)) for p in DATE_PATTERNS))
    return F.unix_micros(stamp) / F.lit(1e6)


def epoch_of_timestamp(stamp: Column) -> Column:
    return F.unix_micros(stamp.cast("timestamp")) / F.lit(1e6)


def parse_date(text: str) -> float | None:
    """Epoch seconds of a query value, or None."""
    for shape, pattern in _PYTHON_DATES:
        if re.fullmatch(shape, text.strip()):
            # An offset of hours only gets its minutes.
            full = re.sub(r"([+-]\d\d)$", r"\g<1>00", text.strip()) if pattern.endswith("%z") else text.strip()
            try:
                when = datetime.strptime(full, pattern)
            except ValueError:
                continue
            if pattern == "%H:%M:%S":
                when = when.replace(year=1970)
            return (when if when.tzinfo else when.replace(tzinfo=timezone.utc)).timestamp()
    return None


def parse_point(value: Any) -> tuple[float, float] | None:
    """Query location: WKT (a stray closing bracket is forgiven), `x, y`, [x, y] or ["x", "y"]."""
    if isinstance(value, (list, tuple)) and len(value) == 2:
        parts = [str(v) for v in value]
    elif isinstance(value, str):
        text = value.strip()
        if m := re.fullmatch(rf"(?i)(?:SRID\s*=\s*\d+\s*;\s*)?POINT\s*\(\s*({NUMBER})\s+({NUMBER})\s*\)+", text):
            parts = [m[1], m[2]]
        else:
            parts = [p.strip().strip('"').strip() for p in text.removeprefix("[").removesuffix("]").split(",")]
    else:
        return None
    if len(parts) != 2 or not all(re.fullmatch(NUMBER, p.strip()) for p in parts):
        return None
    return float(parts[0]), float(parts[1])


def parse_number(value: Any) -> float | None:
    if isinstance(value, bool):
        return None
    if isinstance(value, (int, float)):
        return float(value) if math.isfinite(value) else None
    if isinstance(value, str) and re.fullmatch(NUMBER, value.strip()):
        return float(value)
    return None


def parse_value(value: Any) -> tuple[str, Any]:
    """(type, value) of a query value whose attribute has no declared type.

    Types are null, vector, keywords, number, point and date, tried in this order of evidence: lists first, then
    numbers, points, dates; any other text is a comma-separated keyword list whose outer brackets are dropped.
    """
    if value is None or value == "":
        return "null", None
    if isinstance(value, (list, tuple)):
        numbers = [parse_number(v) if not isinstance(v, str) else None for v in value]
        if value and all(n is not None for n in numbers):
            return "vector", numbers
        return "keywords", list(dict.fromkeys(str(v).strip() for v in value if v is not None and str(v).strip()))
    if (number := parse_number(value)) is not None:
        return "number", number
    text = str(value).strip()
    if re.match(r"(?i)(SRID\s*=\s*\d+\s*;\s*)?POINT\s*\(", text) and (point := parse_point(text)):
        return "point", point
    if (when := parse_date(text)) is not None:
        return "date", when
    if text.startswith("[") and text.endswith("]"):
        text = text[1:-1]
    words = [re.sub(r"\s+", " ", w).strip().strip('"') for w in text.split(",")]
    return "keywords", list(dict.fromkeys(w for w in words if w))


def is_json(text: str) -> bool:
    try:
        json.loads(text)
    except (TypeError, ValueError):
        return False
    return True


def shown(value: Column, kind: str) -> Column:
    """Text of a result value: whole numbers without a fraction, dates as UTC instants, sets and vectors in brackets."""
    if kind in ("keywords", "vector"):
        return F.concat(F.lit("["), F.array_join(value.cast("array<string>"), ","), F.lit("]"))
    if kind == "number":
        whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
        return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))
    if kind == "date":
        return F.date_format(F.timestamp_micros((value * 1e6).cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    if kind == "point":
        return F.format_string("POINT (%s %s)", value["x"].cast("string"), value["y"].cast("string"))
    return value.cast("string")
