"""XML Schema lexical rules: reading text as a type, and which types a text fits."""

from __future__ import annotations

import datetime as dt
import math
import re
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

INT = re.compile(r"[+-]?[0-9]+\Z")
FLOAT = re.compile(r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\Z")
ZONE = r"(Z|[+-][0-9]{2}:[0-9]{2})?"
DATE = re.compile(rf"(-?[0-9]{{4,9}})-([0-9]{{2}})-([0-9]{{2}}){ZONE}\Z")
TIME = re.compile(rf"([0-9]{{2}}):([0-9]{{2}}):([0-9]{{2}})(?:\.([0-9]+))?{ZONE}\Z")
DATETIME = re.compile(rf"(-?[0-9]{{4,9}})-([0-9]{{2}})-([0-9]{{2}})T([0-9]{{2}}):([0-9]{{2}}):([0-9]{{2}})(?:\.([0-9]+))?{ZONE}\Z")
NUMBER_CHARS = re.compile(r"[0-9+.eE-]+\Z")
RANGES = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}

#: Bits of a type set.
BOOL, INTEGER, DOUBLE, DATE_, TIMESTAMP, TIME_, STRING = (1 << i for i in range(7))
NAMES = {BOOL: "boolean", INTEGER: "bigint", DOUBLE: "double", DATE_: "date", TIMESTAMP: "timestamp", TIME_: "time", STRING: "string"}
ALL = 127


class Misfit(ValueError):
    """A text that its column's type can't hold."""


def zone_minutes(text: str | None) -> int | None:
    """Offset in minutes; None without a zone."""
    if not text:
        return None
    if text == "Z":
        return 0
    h, m = int(text[1:3]), int(text[4:6])
    if h > 14 or m > 59:
        raise Misfit(text)
    return (h * 60 + m) * (-1 if text[0] == "-" else 1)


def read_date(text: str) -> dt.date:
    """A date whose zone is dropped without shifting the day."""
    m = DATE.match(text)
    if not m:
        raise Misfit(text)
    zone_minutes(m[4])
    try:
        return dt.date(int(m[1]), int(m[2]), int(m[3]))
    except (ValueError, OverflowError):
        raise Misfit(text) from None


def micros(fraction: str | None) -> int:
    if not fraction:
        return 0
    if fraction[6:].strip("0"):
        raise Misfit(fraction)  # finer than a microsecond
    return int(fraction[:6].ljust(6, "0"))


def read_time(text: str) -> dt.time:
    m = TIME.match(text)
    if not m:
        raise Misfit(text)
    zone_minutes(m[5])
    return clock(m[1], m[2], m[3], m[4])


def clock(h: str, m: str, s: str, fraction: str | None) -> dt.time:
    second = 59 if s == "60" else int(s)
    try:
        return dt.time(int(h), int(m), second, micros(fraction))
    except ValueError:
        raise Misfit(f"{h}:{m}:{s}") from None


def read_timestamp(text: str, with_zone: bool) -> dt.datetime:
    """With a zone: an aware UTC time, and the text must name one; without, it must not."""
    m = DATETIME.match(text)
    if not m or bool(m[8]) != with_zone:
        raise Misfit(text)
    try:
        day = dt.date(int(m[1]), int(m[2]), int(m[3]))
        at = dt.datetime.combine(day, clock(m[4], m[5], m[6], m[7]))
        if not with_zone:
            return at
        return (at - dt.timedelta(minutes=zone_minutes(m[8]))).replace(tzinfo=dt.timezone.utc)
    except (ValueError, OverflowError):
        raise Misfit(text) from None


def read_scalar(kind: str, text: str) -> Any:
    """`text`, already trimmed, as a Spark type name; raises Misfit."""
    if kind == "string":
        return text
    if kind == "boolean":
        if text in ("true", "1"):
            return True
        if text in ("false", "0"):
            return False
        raise Misfit(text)
    if kind in RANGES:
        if not INT.match(text):
            raise Misfit(text)
        value, bits = int(text), RANGES[kind]
        if not -(1 << bits - 1) <= value < 1 << bits - 1:
            raise Misfit(text)
        return value
    if kind in ("float", "double"):
        if text in ("INF", "-INF", "NaN"):
            return float(text.replace("INF", "inf"))
        if not FLOAT.match(text):
            raise Misfit(text)
        return float(text)
    if kind == "date":
        return read_date(text)
    if kind == "timestamp_ntz":
        return read_timestamp(text, False)
    if kind == "timestamp":
        return read_timestamp(text, True)
    if kind == "time":
        return read_time(text)
    raise ValueError(f"unknown type {kind}")


def leading_zero(text: str) -> bool:
    digits = text.lstrip("+-")
    return len(digits) > 1 and digits[0] == "0" and digits[1].isdigit()


def exact_float(text: str) -> bool:
    """Whether the shortest decimal of the double is the number written."""
    if len(text) <= 15 + ("." in text) and "e" not in text and "E" not in text:
        return True  # 15 digits always come back
    try:
        return Decimal(text).normalize() == Decimal(repr(float(text))).normalize() and math.isfinite(float(text))
    except ArithmeticError:
        return False


def classify(text: str) -> tuple[int, int]:
    """(exact, lossy) type sets of one non-blank value; string is in both.

    Exact: the value can be had back from the typed one. Numbers with leading
    zeros are text, INF and NaN too. A zone other than what the type keeps
    and spellings 1, 0, True of a boolean are lossy.
    """
    exact, lossy = STRING, STRING
    first = text[0]
    if first not in "+-.0123456789" and first not in "tTfF":
        return exact, lossy
    if text in ("true", "false"):
        exact |= BOOL
        lossy |= BOOL
    elif text in ("1", "0") or text.lower() in ("true", "false"):
        lossy |= BOOL
    if not leading_zero(text) and NUMBER_CHARS.match(text):
        if INT.match(text):
            if -(1 << 63) <= int(text) < 1 << 63:
                lossy |= INTEGER
                exact |= 0 if text[0] == "+" or text == "-0" else INTEGER
        if FLOAT.match(text):
            lossy |= DOUBLE
            exact |= DOUBLE if exact_float(text) and text[0] != "+" else 0
    if len(text) < 8 or text[2] != ":" and "-" not in text[4:10]:
        return exact, lossy
    for pattern, bit, read in ((DATE, DATE_, read_date), (TIME, TIME_, read_time), (DATETIME, TIMESTAMP, None)):
        if (m := pattern.match(text)) and ":60" not in text[:19] and not (bit != TIME_ and len(m[1].lstrip("-")) > 4 and m[1].lstrip("-")[0] == "0"):
            try:
                read(text) if read else read_timestamp(text, bool(m[8]))
            except Misfit:
                continue
            exact |= bit
            lossy |= bit
    return exact, lossy


def zone_of(text: str) -> int | None:
    if len(text) < 9 or text[-1] != "Z" and text[-3] != ":":
        return None
    m = DATE.match(text) or TIME.match(text) or DATETIME.match(text)
    return zone_minutes(m[m.lastindex if m.re is not DATETIME else 8]) if m and m.group(m.re.groups) else None


def digits_of(text: str) -> int:
    """Significant digits of a decimal number as written: without sign, point, exponent and zeros before the first."""
    m = FLOAT.match(text)
    return max(1, len(re.split("[eE]", text.lstrip("+-"))[0].replace(".", "").lstrip("0"))) if m else 0


def scale_of(text: str) -> int:
    """Fractional digits as written."""
    if "." not in text:
        return 0
    m = re.match(r"[+-]?[0-9]*\.([0-9]*)", text)
    return len(m[1]) if m else 0


def as_type(column: Column, kind: str) -> Column:
    """The given-schema rules as a Column expression; null where a text doesn't fit."""
    x = F.trim(column)
    if kind == "boolean":
        return F.when(x.isin("true", "1"), True).when(x.isin("false", "0"), False)
    if kind in RANGES:
        return F.when(x.rlike(r"^[+-]?[0-9]+$"), x.try_cast(kind))
    if kind in ("float", "double"):
        number = F.when(x.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"), x.try_cast(kind))
        return F.when(x == "INF", F.lit(math.inf)).when(x == "-INF", F.lit(-math.inf)).when(x == "NaN", F.lit(math.nan)).otherwise(number).cast(kind)
    if kind == "date":
        return F.regexp_extract(x, r"^(-?[0-9]{4,9}-[0-9]{2}-[0-9]{2})(?:Z|[+-][0-9]{2}:[0-9]{2})?$", 1).try_cast("date")
    if kind == "timestamp_ntz":
        return F.when(x.rlike(r"^-?[0-9]{4,9}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?$"), x.try_cast("timestamp_ntz"))
    if kind == "timestamp":
        return F.when(x.rlike(r"T.*(Z|[+-][0-9]{2}:[0-9]{2})$"), x.try_cast("timestamp"))
    if kind == "string":
        return x
    raise ValueError(f"unknown type {kind}")
