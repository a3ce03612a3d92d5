"""Date expressions. A period (day, month, quarter) has an integer index, so that gaps, folds, seasons
and horizons are integer arithmetic instead of sorts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratocast.spec import season_length

# English month abbreviations.
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")


def _unit(freq: str) -> str:
    season_length(freq)
    return {"D": "D", "ME": "M", "M": "M"}.get(freq, "Q")


def period_index(ds: Column, freq: str) -> Column:
    """Consecutive integer per day / month / quarter."""
    unit = _unit(freq)
    if unit == "D":
        return F.unix_date(ds)
    if unit == "M":
        return F.year(ds) * 12 + F.month(ds) - 1
    return F.year(ds) * 4 + F.quarter(ds) - 1


def period_end(idx: Column, freq: str) -> Column:
    """Last date of a period; inverse of period_index for period ends."""
    unit = _unit(freq)
    if unit == "D":
        return F.date_from_unix_date(idx)
    if unit == "M":
        return F.last_day(F.make_date(F.floor(idx / 12).cast("int"), idx % 12 + 1, F.lit(1)))
    return F.last_day(F.make_date(F.floor(idx / 4).cast("int"), (idx % 4) * 3 + 3, F.lit(1)))


def month_end(ds: Column) -> Column:
    return F.last_day(ds)


def parse_date(text: Column, fmt: str = "yyyy-MM-dd", strict: bool = False) -> Column:
    """Text to date. Text that does not match gives null, or an error when strict."""
    if strict:
        return F.to_date(text, fmt)
    return F.try_to_timestamp(text, F.lit(fmt)).cast("date")


def year_month_to_date(year: Column, month: Column) -> Column:
    return F.last_day(F.make_date(year.cast("int"), month.cast("int"), F.lit(1)))


def month_name_to_date(year_text: Column, month_text: Column) -> Column:
    """Four digits anywhere in the year text and a month abbreviation to the month's last day; null if either fails."""
    names = F.create_map(*[x for i, m in enumerate(MONTHS) for x in (F.lit(m), F.lit(i + 1))])
    year = F.regexp_extract(year_text, r"(\d{4})", 1)
    month = F.try_element_at(names, F.upper(F.substring(F.trim(month_text), 1, 3)))
    return F.when(year != "", year_month_to_date(F.nullif(year, F.lit("")), month))


def shift_months_end(ds: Column, months: int) -> Column:
    return F.last_day(F.add_months(ds, months))


def shift_days(ds: Column, days: int) -> Column:
    return F.date_add(ds, days)


def day_index_to_date(start: str, pos: Column) -> Column:
    return F.date_add(F.lit(start).cast("date"), pos)
