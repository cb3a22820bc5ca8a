"""Ratios and labels with the null behaviour the metrics need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent_change(now: Column, then: Column) -> Column:
    """``(now - then) / then * 100``; NULL when ``then`` is NULL or zero."""
    return F.try_divide((now - then).cast("double"), then.cast("double")) * 100


def ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def steady_sum(amount: Column) -> Column:
    """Sum of doubles that does not depend on their order; NULL without a value.

    They are added as decimals of 18 places, the finest unit of a token; what is finer is
    rounded. Where one does not fit (not finite, 1e20 or more), or the sum does not, this
    is the plain sum.
    """
    exact = amount.try_cast("decimal(38,18)")
    total = F.when(F.count(exact) == F.count(amount), F.try_sum(exact)).cast("double")
    return F.coalesce(total, F.sum(amount))


def change_label(now: Column, then: Column) -> Column:
    """``"12 (3)"``: the value and its signed change; NULL when either is missing."""
    return F.concat(now.cast("string"), F.lit(" ("), (now - then).cast("string"), F.lit(")"))


def amount_text(amount: Column) -> Column:
    """An amount without exponent and trailing zeros, to twelve decimals."""
    return F.regexp_replace(amount.cast("decimal(38,12)").cast("string"), r"\.?0+$", "")


def amount_change_label(now: Column, then: Column) -> Column:
    """:func:`change_label` for amounts."""
    return F.concat(amount_text(now), F.lit(" ("), amount_text(now - then), F.lit(")"))
