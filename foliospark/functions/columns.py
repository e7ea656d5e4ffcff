"""Column helpers for values that come from MySQL habits: blanks, flags, text years, lists in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank(name: str) -> Column:
    """Null or empty."""
    return F.coalesce(F.col(name), F.lit("")) == ""


def unset(name: str) -> Column:
    """A 0/1 flag that is 0 or null."""
    return F.coalesce(F.col(name), F.lit(0)) == 0


def leading_int(text: Column) -> Column:
    """The number at the beginning of a text, 0 if there is none, null for null: as a lenient cast to integer gives."""
    digits = F.regexp_extract(text, r"^\s*([+-]?\d+)", 1)
    return F.when(text.isNotNull(), F.coalesce(F.nullif(digits, F.lit("")), F.lit("0")).cast("bigint"))


def share(part: Column, whole: Column, digits: int = 2) -> Column:
    """Percentage; null where there is no whole."""
    return F.round(F.try_divide(part.cast("double") * 100.0, whole.cast("double")), digits)


def joined(name: str, separator: str, distinct: bool = True) -> Column:
    """The group's texts in order, in one text."""
    gathered = F.collect_set(name) if distinct else F.collect_list(name)
    return F.array_join(F.array_sort(gathered), separator)


def joined_descending(name: str, separator: str) -> Column:
    return F.array_join(F.reverse(F.array_sort(F.collect_set(name))), separator)
