"""Calendar column expressions (all JVM built-ins, inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def year(d) -> Column:
    return F.year(_c(d))


def month(d) -> Column:
    return F.month(_c(d))


def day(d) -> Column:
    return F.dayofmonth(_c(d))


def day_of_year(d) -> Column:
    return F.dayofyear(_c(d))


def quarter(d) -> Column:
    return F.quarter(_c(d))


def iso_weekday(d) -> Column:
    """1 = Monday .. 7 = Sunday."""
    return F.extract(F.lit("DAYOFWEEK_ISO"), _c(d)).cast("int")


def is_month_start(d) -> Column:
    return (F.dayofmonth(_c(d)) == 1).cast("int")


def is_month_end(d) -> Column:
    return (_c(d) == F.last_day(_c(d))).cast("int")


def is_quarter_start(d) -> Column:
    return (_c(d) == F.trunc(_c(d), "quarter")).cast("int")


def is_quarter_end(d) -> Column:
    return (_c(d) == F.date_sub(F.add_months(F.trunc(_c(d), "quarter"), 3), 1)).cast("int")


def week_number(d) -> Column:
    """ceil(day_of_year / 7): weeks counted from 1 January."""
    return F.ceil(F.dayofyear(_c(d)) / F.lit(7.0)).cast("int")


def iso_week(d) -> Column:
    return F.weekofyear(_c(d))


def two_digit_year(d) -> Column:
    return F.date_format(_c(d), "yy").cast("int")


def two_digit_month(d) -> Column:
    return F.date_format(_c(d), "MM").cast("int")


def split_iso_text(text, part: int) -> Column:
    """Year/month/day from 'yyyy-MM-dd' text by splitting on '-' (part 0..2)."""
    return F.split(_c(text), "-").getItem(part).cast("int")


def parse_date(text, fmt: str | None = None) -> Column:
    """Text to date; malformed input becomes NULL instead of failing the job."""
    if fmt is None:
        return F.try_to_timestamp(_c(text)).cast("date")
    return F.try_to_timestamp(_c(text), F.lit(fmt)).cast("date")


def parse_timestamp(text, fmt: str) -> Column:
    return F.try_to_timestamp(_c(text), F.lit(fmt))


def months_since(year_col, month_col, since_year, since_month) -> Column:
    """(year - since_year) * 12 - (since_month - month)."""
    return (_c(year_col) - _c(since_year)) * 12 - (_c(since_month) - _c(month_col))


def parity(c) -> Column:
    return _c(c) % 2


def calendar_columns(d="Date") -> list[Column]:
    """The calendar block of the feature table, in one projection."""
    return [year(d).alias("year"), month(d).alias("month"), day(d).alias("day"),
            day_of_year(d).alias("day_of_year"), quarter(d).alias("quarter"),
            is_month_start(d).alias("is_month_start"), is_month_end(d).alias("is_month_end"),
            is_quarter_start(d).alias("is_quarter_start"), is_quarter_end(d).alias("is_quarter_end"),
            week_number(d).alias("weeknum")]
