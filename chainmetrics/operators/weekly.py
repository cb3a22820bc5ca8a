"""Operators on weekly aggregates.

Their input has one row per week (and a few labels), so it is bounded by the
calendar; that is why an unpartitioned window is acceptable here and only here.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(value: str, order: str, *labels: str) -> Column:
    return F.sum(value).over(Window.partitionBy(*labels).orderBy(order))


def moving_average(value: str, rows: int, order: str, *labels: str) -> Column:
    window = Window.partitionBy(*labels).orderBy(order).rowsBetween(1 - rows, 0)
    return F.avg(value).over(window)


def calendar_lag(value: str, order: str = "week") -> Column:
    """Value of the calendar week before; NULL when that week has no row."""
    window = Window.orderBy(order)
    adjacent = F.lag(order).over(window) == F.date_add(order, -7)
    return F.when(adjacent, F.lag(value).over(window))


def newest_per_group(df: DataFrame, n: int, label: str, order: str = "week") -> DataFrame:
    window = Window.partitionBy(label).orderBy(F.col(order).desc())
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= n).drop("_rank")


def latest_two(df: DataFrame, cutoff: date, previous_cutoff: date, order: str = "week") -> DataFrame:
    """One row of structs ``now`` and ``then``: the newest rows before two cutoffs.

    A single aggregate instead of two sorts with a limit and a cross join. The
    result is empty when either row is missing.
    """
    row = F.struct(*df.columns)
    newest = F.max_by(row, F.when(F.col(order) < F.lit(cutoff), F.col(order)))
    earlier = F.max_by(row, F.when(F.col(order) < F.lit(previous_cutoff), F.col(order)))
    return df.agg(newest.alias("now"), earlier.alias("then")).filter(
        F.col("now").isNotNull() & F.col("then").isNotNull()
    )


def latest_and_previous(df: DataFrame, order: str = "week") -> DataFrame:
    """One row of structs ``now`` and ``then``: the two newest rows present.

    With a single row, both are that row.
    """
    newest = df.select(F.col(order).alias("_order"), F.struct(*df.columns).alias("_row"))
    newest = newest.orderBy(F.col("_order").desc()).limit(2)
    return newest.agg(
        F.max_by("_row", "_order").alias("now"), F.min_by("_row", "_order").alias("then")
    ).filter(F.col("now").isNotNull())


def share_out(df: DataFrame, group: str, label: str, count: str, unknown: str, out: str) -> DataFrame:
    """Give each known class its proportional part of the unknown class.

    The result is NULL for groups without an unknown row; the unknown row itself
    is dropped.
    """
    window = Window.partitionBy(group)
    is_unknown = F.col(label) == F.lit(unknown)
    known_total = F.sum(F.when(~is_unknown, F.col(count))).over(window)
    unknown_total = F.sum(F.when(is_unknown, F.col(count))).over(window)
    share = F.try_divide(F.col(count).cast("double"), known_total.cast("double"))
    return df.withColumn(out, F.col(count) + unknown_total * share).filter(~is_unknown)
