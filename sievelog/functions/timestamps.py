"""Times in log lines as column expressions; the result is microseconds since 1970 in UTC and whether a zone was given."""

from __future__ import annotations

import math
import re
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = r"^(\d{4})-(\d{2})-(\d{2})[T ](\d{2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(Z|[+-]\d{2}(?::?\d{2})?)?$"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
FULL_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
# Directive -> pattern of what it reads.
DIRECTIVES = {
    "Y": r"\d{4}", "y": r"\d{2}", "m": r"\d{1,2}", "d": r"\d{1,2}", "e": r" ?\d{1,2}", "H": r"\d{1,2}", "M": r"\d{1,2}", "S": r"\d{1,2}",
    "f": r"\d{1,9}", "z": r"Z|[+-]\d{2}(?::?\d{2})?", "b": "(?i:" + "|".join(MONTHS) + ")", "B": "(?i:" + "|".join(FULL_MONTHS) + ")", "j": r"\d{1,3}",
}
SECOND = 1_000_000


def _number(text: Column) -> Column:
    return F.when(text != "", text.cast("int"))


def _zone_seconds(zone: Column) -> Column:
    digits = F.regexp_replace(F.substring(zone, 2, 6), ":", "")
    hours, minutes = _number(F.substring(digits, 1, 2)), F.coalesce(_number(F.substring(digits, 3, 2)), F.lit(0))
    value = (hours * 3600 + minutes * 60) * F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1)
    return F.when((zone == "") | (zone == "Z"), F.lit(0)).when((hours <= 23) & (minutes <= 59), value)


def _micros(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column, fraction: Column, zone: Column) -> Column:
    """Null unless every field is in range."""
    good = (hour <= 23) & (minute <= 59) & (second <= 59) & (month >= 1) & (month <= 12) & (day >= 1)
    date = F.when(good, F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd"))
    days = F.date_diff(date, F.lit("1970-01-01").cast("date")).cast("long")
    seconds = days * 86400 + hour * 3600 + minute * 60 + second - _zone_seconds(zone)
    micros = F.rpad(F.substring(fraction, 1, 6), 6, "0").cast("long")
    return seconds * SECOND + micros


def parse_iso(text: Column) -> tuple[Column, Column]:
    """(micros, zone given) of an ISO-8601 time; micros is null for anything else."""
    text = F.trim(text)
    part = lambda i: F.regexp_extract(text, ISO, i)
    second = F.coalesce(_number(part(6)), F.lit(0))
    micros = F.when(text.rlike(ISO), _micros(*(_number(part(i)) for i in range(1, 6)), second, part(7), part(8)))
    return micros, part(8) != ""


def compile_format(ts_format: str) -> tuple[str, list[str]]:
    """Pattern with a group per directive, and the directives."""
    out, fields, i = [], [], 0
    text = ts_format.replace("%T", "%H:%M:%S")
    while i < len(text):
        if text[i] == "%" and i + 1 < len(text):
            kind = text[i + 1]
            i += 2
            if kind == "%":
                out.append("%")
            elif kind in DIRECTIVES:
                out.append(f"({DIRECTIVES[kind]})")
                fields.append(kind)
            else:
                raise ValueError(f"the time directive %{kind} is not supported")
        else:
            out.append(" +" if text[i] == " " else re.escape(text[i]))
            i += 1
    return "^" + "".join(out) + "$", fields


def parse_format(text: Column, ts_format: str) -> tuple[Column, Column]:
    """(micros, zone given) of a time in a strptime-like format; falls back to ISO-8601."""
    pattern, fields = compile_format(ts_format)
    text = F.trim(text)
    part = {kind: F.regexp_extract(text, pattern, i + 1) for i, kind in enumerate(fields)}
    number = lambda kind, other: _number(F.trim(part[kind])) if kind in part else F.lit(other)
    year = number("Y", 1970)
    if "y" in part:
        short = _number(part["y"])
        year = F.when(short < 69, short + 2000).otherwise(short + 1900)
    month, day = number("m", 1), number("e" if "e" in part else "d", 1)
    for kind, names in (("b", MONTHS), ("B", FULL_MONTHS)):
        if kind in part:
            month = F.array_position(F.array(*map(F.lit, names)), F.lower(part[kind])).cast("int")
    zone, fraction = part.get("z", F.lit("")), part.get("f", F.lit(""))
    micros = _micros(year, month, day, number("H", 0), number("M", 0), number("S", 0), fraction, zone)
    if "j" in part:
        within = _number(part["j"])
        micros = F.when((within >= 1) & (within <= 366), _micros(year, F.lit(1), F.lit(1), number("H", 0), number("M", 0), number("S", 0), fraction, zone) + (within - 1).cast("long") * 86400 * SECOND)
    own = F.when(text.rlike(pattern), micros)
    iso, iso_zone = parse_iso(text)
    return F.coalesce(own, iso), F.when(own.isNotNull(), zone != "").otherwise(iso_zone)


def epoch_micros(value: Column) -> Column:
    """Microseconds of a whole epoch number: seconds, milli-, micro- or nanoseconds by size."""
    size = F.abs(value)
    return (
        F.when(size < 10**11, value * SECOND)
        .when(size < 10**14, value * 1000)
        .when(size < 10**17, value)
        .otherwise(F.floor((value - F.pmod(value, F.lit(1000))) / F.lit(1000)))
    ).cast("long")


def epoch_float_micros(value: Column) -> Column:
    """The same for a floating-point epoch."""
    size = F.abs(value)
    scale = F.when(size < 1e11, 1e6).when(size < 1e14, 1e3).when(size < 1e17, 1.0).otherwise(1e-3)
    return F.floor(value * scale + 0.5).cast("long")


def json_time(text: Column, ts_format: str | None = None) -> tuple[Column, Column]:
    """(micros, zone given) of a time as ``get_json_object`` renders it, a string or a number.

    A string of up to 18 digits counts as a whole epoch number, as a number does.
    """
    whole, number = text.rlike(r"^-?\d{1,18}$"), text.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$")
    other, zone = parse_format(text, ts_format) if ts_format else parse_iso(text)
    micros = F.when(whole, epoch_micros(text.try_cast("long"))).when(number, epoch_float_micros(text.try_cast("double"))).otherwise(other)
    return micros, F.when(whole | number, F.lit(True)).otherwise(zone)


# The same for Python values, for records that are parsed one by one.


def _python_micros(year: int, month: int, day: int, hour: int, minute: int, second: int, fraction: str, zone: str) -> int | None:
    if hour > 23 or minute > 59 or second > 59:
        return None
    try:
        days = date(year, month, day).toordinal() - date(1970, 1, 1).toordinal()
    except ValueError:
        return None
    shift = 0
    if zone not in ("", "Z"):
        digits = zone[1:].replace(":", "")
        hours, minutes = int(digits[:2]), int(digits[2:4] or 0)
        if hours > 23 or minutes > 59:
            return None
        shift = (hours * 3600 + minutes * 60) * (-1 if zone[0] == "-" else 1)
    return (days * 86400 + hour * 3600 + minute * 60 + second - shift) * SECOND + int(fraction[:6].ljust(6, "0"))


def micros_of(text: str, ts_format: str | None = None) -> int | None:
    """``parse_format`` or ``parse_iso`` of a Python string."""
    text = text.strip(" ")
    if ts_format:
        pattern, fields = compile_format(ts_format)
        if m := re.search(pattern, text, re.ASCII):
            part = dict(zip(fields, m.groups(default=""), strict=True))
            number = lambda kind, other: int(part[kind].strip()) if part.get(kind, "").strip() else other
            year = number("Y", 1970)
            if "y" in part:
                year = number("y", 0) + (2000 if number("y", 0) < 69 else 1900)
            month = number("m", 1)
            for kind, names in (("b", MONTHS), ("B", FULL_MONTHS)):
                if kind in part:
                    month = names.index(part[kind].lower()) + 1
            clock = (number("H", 0), number("M", 0), number("S", 0), part.get("f", ""), part.get("z", ""))
            if "j" in part:
                first = _python_micros(year, 1, 1, *clock)
                own = None if first is None or not 1 <= number("j", 1) <= 366 else first + (number("j", 1) - 1) * 86400 * SECOND
            else:
                own = _python_micros(year, month, number("e" if "e" in part else "d", 1), *clock)
            if own is not None:
                return own
    m = re.search(ISO, text, re.ASCII)
    return _python_micros(*(int(x or 0) for x in m.groups()[:6]), m[7] or "", m[8] or "") if m else None


def epoch_of(value: float) -> int:
    """``epoch_micros`` of an int, ``epoch_float_micros`` of a float."""
    size = abs(value)
    if isinstance(value, int):
        return value * SECOND if size < 10**11 else value * 1000 if size < 10**14 else value if size < 10**17 else value // 1000
    scale = 1e6 if size < 1e11 else 1e3 if size < 1e14 else 1.0 if size < 1e17 else 1e-3
    return math.floor(value * scale + 0.5)
