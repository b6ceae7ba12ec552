"""Dates that spreadsheets keep as serial numbers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of column names that tell a date.
DATE_WORDS = ("date", "time", "datetime", "timestamp", "日期", "时间", "生日", "日付", "fecha", "data", "datum", "dob", "birth", "created", "updated", "modified", "begin", "start", "end", "deadline")

EPOCH = dt.datetime(1899, 12, 30)


def is_date_name(name: str) -> bool:
    return any(word in name.lower() for word in DATE_WORDS)


def from_serial(serial: float) -> str | None:
    """ISO date, date and time, or (below 1) time of day; null outside 0 to 100,000. Serials before 60 come before the leap day that never was."""
    if not 0 <= serial <= 100_000:
        return None
    if serial < 1:
        seconds = round(serial * 86400)
        h, m, s = seconds // 3600, seconds % 3600 // 60, seconds % 60
        return f"{h:02}:{m:02}" + (f":{s:02}" if s else "")
    moment = EPOCH + dt.timedelta(milliseconds=round((serial + (serial < 60)) * 86_400_000))
    return moment.strftime("%Y-%m-%d" if serial % 1 < 0.001 else "%Y-%m-%d %H:%M:%S")


def serial_date(serial: Column) -> Column:
    """The date of a whole serial number, as a column."""
    return F.date_add(F.lit("1899-12-30").cast("date"), (serial + (serial < 60).cast("int")).cast("int"))


def as_number(cell: str) -> float | None:
    try:
        return float(cell) if cell and cell == cell.strip() and "_" not in cell else None
    except ValueError:
        return None


def date_columns(headers: list[str], rows: list[list[str]], known: set[int] = frozenset()) -> set[int]:
    """Columns that hold dates: those known by their format, and those with a date's name where at least two numbers, and most of them, are whole serials."""
    found = set(known)
    for k, header in enumerate(headers):
        if k in found or not is_date_name(header):
            continue
        numbers = [x for r in rows if k < len(r) and (x := as_number(r[k])) is not None]
        serials = sum(1 <= x <= 100_000 and x % 1 < 0.001 for x in numbers)
        if serials >= 2 and serials * 2 > len(numbers):
            found.add(k)
    return found


def with_dates(headers: list[str], rows: list[list[str]], known: set[int] = frozenset()) -> list[list[str]]:
    at = date_columns(headers, rows, known)
    if not at:
        return rows
    read = lambda c: (from_serial(x) if (x := as_number(c)) is not None else None) or c
    return [[read(c) if k in at else c for k, c in enumerate(r)] for r in rows]
