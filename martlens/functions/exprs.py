"""Rounding, ratio, date and bucket expressions.

Money is decimal until the last step, so sums do not depend on the order in
which partitions are merged. Ratios divide doubles of exact sums and are then
rounded as decimals, so a tie such as 0.125 rounds the same way everywhere.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

_RATIO_TYPE = "decimal(28,10)"


def half_up(value: Column, digits: int) -> Column:
    """SQL ``ROUND``: ties away from zero, returned as double."""
    return F.round(value.cast(_RATIO_TYPE), digits).cast("double")


def half_even(value: Column, digits: int) -> Column:
    """Banker's rounding, as data-frame libraries do, returned as double."""
    return F.bround(value.cast(_RATIO_TYPE), digits).cast("double")


def ratio(numerator: Column, denominator: Column, scale: float | None = None) -> Column:
    """Double division that yields null on a zero denominator."""
    top = numerator.cast("double")
    if scale is not None:
        top = F.lit(float(scale)) * top
    return F.try_divide(top, denominator.cast("double"))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return half_up(ratio(part, whole, 100.0), digits)


def money(total: Column) -> Column:
    """An exact decimal sum as a double."""
    return total.cast("double")


def mean_money(total: Column, count: Column, digits: int = 2) -> Column:
    return half_up(ratio(total, count), digits)


def date_lit(day: date | str) -> Column:
    return F.lit(str(day)).cast("date")


def days_before(as_of: date | str, day: Column) -> Column:
    """Whole days from ``day`` to ``as_of`` (integer, null-preserving)."""
    return F.datediff(date_lit(as_of), day)


def month_start(day: Column) -> Column:
    """Grouping key of a month: integer work per row, formatted per group."""
    return F.trunc(day, "month")


def year_start(day: Column) -> Column:
    return F.trunc(day, "year")


def year_month(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def year_text(day: Column) -> Column:
    return F.date_format(day, "yyyy")


def score_low_is_good(value: Column, cuts: Sequence[float]) -> Column:
    """Highest score for ``value <= cuts[0]``, one less per further cut, else 1."""
    return first_match([value <= F.lit(cut) for cut in cuts], _descending(cuts))


def score_high_is_good(value: Column, cuts: Sequence[float]) -> Column:
    """Highest score for ``value >= cuts[0]``, one less per further cut, else 1."""
    return first_match([value >= F.lit(cut) for cut in cuts], _descending(cuts))


def _descending(cuts: Sequence[float]) -> range:
    return range(len(cuts) + 1, 0, -1)


def first_match(conditions: Sequence[Column], results: Sequence) -> Column:
    """The result of the first condition that holds, else the last result."""
    *matched, last = results
    first, *others = zip(conditions, matched, strict=True)
    chain = F.when(first[0], F.lit(first[1]))
    for condition, result in others:
        chain = chain.when(condition, F.lit(result))
    return chain.otherwise(F.lit(last))


def line_total(price: Column, quantity: Column, discount: Column) -> Column:
    """Price times quantity less the discount fraction, rounded to cents."""
    return F.round(price * quantity * (F.lit(1) - discount), 2).cast("decimal(18,2)")


def sum_if(condition: Column, value: Column) -> Column:
    return F.sum(F.when(condition, value))


def count_where(condition: Column) -> Column:
    """Rows where the condition holds; 0 for none and for null conditions."""
    return F.count(F.when(condition, F.lit(1)))
