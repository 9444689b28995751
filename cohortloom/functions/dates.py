"""Column functions over dates and tolerant casts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_or_null(text: Column) -> Column:
    """Dates written year-month-day, a time of day may follow; anything else is null."""
    text = F.trim(text.cast("string"))
    return F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), F.coalesce(text.try_cast("date"), F.regexp_extract(text, r"^(\d{4}-\d{1,2}-\d{1,2})", 1).try_cast("date")))


def long_or_null(text: Column) -> Column:
    return F.coalesce(text.cast("string").try_cast("long"), F.round(text.cast("string").try_cast("double")).try_cast("long"))


def int_or_null(text: Column) -> Column:
    """Rounds decimals, as '3.7' days are 4."""
    return F.round(text.cast("string").try_cast("double")).try_cast("int")


def double_or_null(text: Column) -> Column:
    return text.cast("string").try_cast("double")


def imputed_end(start: Column, end: Column, days_supply: Column, default_days: int = 30) -> Column:
    return F.coalesce(end, F.date_add(start, F.coalesce(days_supply, F.lit(default_days))))


def window_name(day: Column, t0: Column, windows: dict[str, tuple[int, int]]) -> Column:
    """Name of the first window (low and high day after t0, ends included) that ``day`` lies in; else null."""
    out = F.lit(None).cast("string")
    for name, (low, high) in reversed(windows.items()):
        out = F.when(F.datediff(day, t0).between(low, high), F.lit(name)).otherwise(out)
    return out


def minute_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:'00'")


def minute_before(t0: Column) -> Column:
    """The whole minute before the day begins: nothing of the day itself can leak into it."""
    return F.date_trunc("minute", t0.cast("timestamp_ntz") - F.expr("interval 1 minute")).cast("timestamp_ntz")
