"""Dates of climate calendars as numbers."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import total_ordering

import numpy as np

GREGORIAN_LIKE = {"standard", "gregorian", "proleptic_gregorian", "noleap", "365_day", "all_leap", "366_day"}
DEFAULT_UNITS = "microseconds since 1970-01-01T00:00:00"
MICROS = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}
MONTHS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)


@total_ordering
@dataclass(frozen=True)
class CalDate:
    """A moment of a climate calendar."""

    year: int
    month: int = 1
    day: int = 1
    hour: int = 0
    minute: int = 0
    second: int = 0
    microsecond: int = 0
    calendar: str = "standard"

    def __lt__(self, other: CalDate) -> bool:
        return micros(self) < micros(other)


def is_gregorian_like(calendar: str) -> bool:
    return calendar in GREGORIAN_LIKE


def is_caldate(values) -> bool:
    values = np.asarray(values)
    return values.dtype == object and values.size > 0 and isinstance(values.ravel()[0], CalDate)


def day_number(year: int, month: int, day: int, calendar: str) -> int:
    """Days since 1970-01-01 of the same calendar."""
    if calendar == "360_day":
        return 360 * (year - 1970) + 30 * (month - 1) + day - 1
    if calendar in ("noleap", "365_day"):
        return 365 * (year - 1970) + sum(MONTHS[: month - 1]) + day - 1
    if calendar in ("all_leap", "366_day"):
        return 366 * (year - 1970) + sum(MONTHS[: month - 1]) + (month > 2) + day - 1
    # days of March-based years since year 0, then the leap rule of the calendar
    y, m = (year, month - 3) if month > 2 else (year - 1, month + 9)
    days = 365 * y + y // 4 + (153 * m + 2) // 5 + day - 1
    if calendar == "julian":
        return days - 719483  # its own 1970-01-01
    if calendar in ("standard", "gregorian") and (year, month, day) < (1582, 10, 15):
        return days - 719470  # Julian dates before the reform, on the Gregorian count
    return days - y // 100 + y // 400 - 719468


def micros(d: CalDate) -> int:
    days = day_number(d.year, d.month, d.day, d.calendar)
    return ((days * 24 + d.hour) * 60 + d.minute) * 60_000_000 + d.second * 1_000_000 + d.microsecond


def parse(text: str, calendar: str) -> CalDate:
    found = re.fullmatch(r"(-?\d{1,5})-(\d{1,2})-(\d{1,2})(?:[T ](\d{1,2}):(\d{2})(?::(\d{2}))?)?", text.strip())
    if not found:
        raise ValueError(f"not a date: {text!r}")
    return CalDate(*(int(x) if x else 0 for x in found.groups()), calendar=calendar)


def date2num(d: CalDate, units: str = DEFAULT_UNITS) -> int:
    """Elapsed units since the epoch of units, counted in the date's own calendar, cut towards zero."""
    unit, _, epoch = units.partition(" since ")
    step = MICROS[unit.strip().rstrip("s")]
    elapsed = micros(d) - micros(parse(epoch, d.calendar))
    return int(abs(elapsed) // step) * (1 if elapsed >= 0 else -1)


def to_microseconds(values) -> np.ndarray:
    """Elapsed microseconds since 1970, each date in its own calendar."""
    return np.array([micros(v) for v in np.asarray(values).ravel()], np.int64)


def to_offsets(values, units: str) -> np.ndarray:
    return np.array([date2num(v, units) for v in np.asarray(values).ravel()], np.int64)


def calendar_of(values) -> str | None:
    return np.asarray(values).ravel()[0].calendar if is_caldate(values) else None


def fold_cftime(query: str, units: str, calendar: str) -> str:
    """cftime('DATE') as the number it stands for, so that it can prune; string literals and comments stay."""
    found = re.compile(r"\bcftime\(\s*'([^']*)'\s*\)|'(?:[^']|'')*'|--[^\n]*|/\*.*?\*/", re.I | re.S)
    return found.sub(lambda m: m[0] if m[1] is None else f"{date2num(parse(m[1], calendar), units)}L", query)
