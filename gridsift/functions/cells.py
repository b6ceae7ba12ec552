"""Cells as text and as numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a number in a comparison: no spaces, no type suffixes.
NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$|^[+-]?(?i:inf|infinity|nan)$"


def text_of(cell: Column) -> Column:
    """A cell of any type as text; null is the empty string."""
    return F.coalesce(cell.cast("string"), F.lit(""))


def number_of(text: Column) -> Column:
    """A text as double, null where it is no number."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def like(text: Column, pattern: str, any_case: bool) -> Column:
    """SQL LIKE of the whole text, % and _ being all its special signs. any_case: of ASCII letters."""
    body = "".join(".*" if c == "%" else "." if c == "_" else f"\\x{{{ord(c):x}}}" if not c.isalnum() else c for c in pattern)
    return text.rlike(("(?is)" if any_case else "(?s)") + f"\\A{body}\\z")
