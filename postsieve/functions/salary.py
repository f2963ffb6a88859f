"""Salary texts. A zero is as good as missing; amounts are cut to whole numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import as_column


def _amount(c: Column | str) -> Column:
    return F.concat(F.lit("$"), F.format_number(as_column(c).try_cast("bigint"), 0))


def _given(c: Column | str) -> Column:
    value = as_column(c)
    return F.coalesce(value, F.lit(0)) != 0


def _salary(low: Column | str, high: Column | str, range_unit: Column, open_unit: Column) -> Column:
    span = F.concat(_amount(low), F.lit("–"), _amount(high), range_unit)
    return F.coalesce(
        F.when(_given(low) & _given(high), span).when(_given(low), F.concat(_amount(low), F.lit("+"), open_unit)),
        F.lit(""),
    )


def salary_with_unit(low: Column | str, high: Column | str, unit: str = " USD/year") -> Column:
    """P4a. ``$min–$max USD/year`` or ``$min+ USD/year``."""
    return _salary(low, high, F.lit(unit), F.lit(unit))


def salary_plain(low: Column | str, high: Column | str) -> Column:
    """P4b. ``$min–$max`` or ``$min+``."""
    return _salary(low, high, F.lit(""), F.lit(""))


def salary_with_currency(
    low: Column | str, high: Column | str, currency: Column | str, period: Column | str
) -> Column:
    """P4c. ``$min–$max CUR/PERIOD``, or ``$min+ CUR`` without the period."""
    code = F.coalesce(as_column(currency), F.lit("USD"))
    every = F.coalesce(as_column(period), F.lit("year"))
    return _salary(low, high, F.concat(F.lit(" "), code, F.lit("/"), every), F.concat(F.lit(" "), code))
