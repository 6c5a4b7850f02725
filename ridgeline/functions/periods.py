"""Fiscal periods and rounding as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fiscal_start_year(day: Column, fye: Column) -> Column:
    """Calendar year in which the fiscal year of a day begins (fye: its last month; 12 is the calendar year)."""
    return F.year(day) - ((F.month(day) <= fye) & (fye != 12)).cast("int")


def fiscal_index(day: Column, fye: Column) -> Column:
    """1 to 12: the month's place in its fiscal year."""
    return F.pmod(F.month(day) - 1 - fye % 12, F.lit(12)) + 1


def fiscal_label(start_year: Column, fye: Column) -> Column:
    """'2024', or 'FY2024-25' where the fiscal year spans two calendar years."""
    year = start_year.cast("string")
    return F.when(fye == 12, year).otherwise(F.concat(F.lit("FY"), year, F.lit("-"), F.substring((start_year + 1).cast("string"), 3, 2)))


def percent_change(now: Column, before: Column) -> Column:
    """Change against the prior value in per cent to one decimal, halves up; null where there is nothing to compare."""
    return F.when(before != 0, F.floor((now - before) / F.abs(before) * 1000 + 0.5) / 10)


def close(a: Column, b: Column, rel: float = 0.02, absolute: float = 0.0) -> Column:
    return F.abs(a - b) <= F.greatest(rel * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))
