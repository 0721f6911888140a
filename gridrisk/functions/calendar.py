"""Months as integers: k = 12 * year + month - 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_index(year: Column, month: Column) -> Column:
    return (year * 12 + month - 1).cast("int")


def year_of(k: Column) -> Column:
    return F.floor(k / 12).cast("int")


def month_of(k: Column) -> Column:
    return (F.pmod(k, F.lit(12)) + 1).cast("int")


def month_text(k: Column) -> Column:
    """YYYY-MM."""
    return F.format_string("%04d-%02d", year_of(k), month_of(k))


def _checked(year: Column, month: Column, ok: Column) -> Column:
    y, m = year.try_cast("int"), month.try_cast("int")
    return F.when(ok & m.between(1, 12), month_index(y, m))


def parse_month(text: Column) -> Column:
    """k of YYYY-MM; null for anything else."""
    return _checked(F.substring(text, 1, 4), F.substring(text, 6, 2), text.rlike("^[0-9]{4}-[0-9]{2}$"))


def parse_date_month(text: Column) -> Column:
    """k of DD/MM/YYYY; the day is not looked at, as source files hold impossible ones. Null for anything else."""
    return _checked(F.substring(text, 7, 4), F.substring(text, 4, 2), text.rlike("^.{2}/[0-9]{2}/[0-9]{4}$"))


def parse_month_py(text: str) -> int:
    """k of YYYY-MM for parameters; raises ValueError otherwise."""
    year, dash, month = text.partition("-")
    if not (dash and len(year) == 4 and len(month) == 2 and (year + month).isdigit() and 1 <= int(month) <= 12):
        raise ValueError(f"not a month (YYYY-MM): {text!r}")
    return int(year) * 12 + int(month) - 1


def month_text_py(k: int) -> str:
    return f"{k // 12:04d}-{k % 12 + 1:02d}"
