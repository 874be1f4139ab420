"""Codes of periods, sessions and windows of time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip


def period_code(value: Column, default: str = "07") -> Column:
    """One or two digits with a leading zero; other texts as they are."""
    given = strip(F.coalesce(F.nullif(value, F.lit("")), F.lit(default)))
    return F.when(given.rlike("^[0-9]{1,2}$"), F.lpad(given, 2, "0")).otherwise(given)


def session_code(period: Column, session: Column) -> Column:
    text = session.cast("string")
    return F.concat(period, F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text))


def window_number(at: Column, seconds: int) -> Column:
    """Number of the fixed window of so many seconds, from 1970 on."""
    return F.floor(F.unix_seconds(at) / seconds).cast("long")


def western_year(roc_year: Column) -> Column:
    return roc_year.cast("int") + 1911
