"""Partial dates as closed intervals, and other date rules, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_YEAR, _MONTH, _DAY = r"^\d{4}$", r"^\d{4}-\d{2}$", r"^\d{4}-\d{2}-\d{2}"


def _interval(text: Column, day: Column) -> Column:
    month = F.try_to_date(F.concat(text, F.lit("-01")), "yyyy-MM-dd")
    year = F.try_to_date(F.concat(text, F.lit("-01-01")), "yyyy-MM-dd")
    return (
        F.when(text.rlike(_YEAR) & year.isNotNull(), F.struct(year.alias("lo"), F.try_to_date(F.concat(text, F.lit("-12-31")), "yyyy-MM-dd").alias("hi"), F.lit("year").alias("precision")))
        .when(text.rlike(_MONTH) & month.isNotNull(), F.struct(month.alias("lo"), F.last_day(month).alias("hi"), F.lit("month").alias("precision")))
        .when(day.isNotNull(), F.struct(day.alias("lo"), day.alias("hi"), F.lit("day").alias("precision")))
    )


def partial_date(text: Column) -> Column:
    """struct(lo, hi, precision): a year, a month or a day; what follows a day is ignored; else null."""
    return _interval(text, F.when(text.rlike(_DAY), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")))


def strict_partial_date(text: Column) -> Column:
    """As partial_date(), but nothing may follow the day."""
    return _interval(text, F.when(text.rlike(_DAY + "$"), F.try_to_date(text, "yyyy-MM-dd")))


def valid_partial_date(text: Column) -> Column:
    """The text itself where it is a calendar date of any precision, else null."""
    return F.when(strict_partial_date(text).isNotNull(), text)


def boundary_date(text: Column) -> Column:
    """The first day that the first ten characters stand for; words for a missing date are null."""
    head = F.substring(text, 1, 10)
    return F.when(head.isin("unknown", "nan", "None", ""), F.lit(None).cast("date")).otherwise(F.coalesce(F.try_to_date(head, "yyyy-MM-dd"), F.try_to_date(F.concat(head, F.lit("-01")), "yyyy-MM-dd"), F.try_to_date(F.concat(head, F.lit("-01-01")), "yyyy-MM-dd")))


def years_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier) / F.lit(365.25)


def leading_year(text: Column) -> Column:
    """The first four characters as a number, or null."""
    return F.substring(F.trim(text), 1, 4).try_cast("int")


def search_window(year: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """The window of a search: explicit dates, else from three years before to the end of the year."""
    return F.coalesce(start, F.make_date(year - 3, F.lit(1), F.lit(1))), F.coalesce(end, F.make_date(year, F.lit(12), F.lit(31)))
