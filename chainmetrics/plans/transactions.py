"""Transaction counts per week and outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainmetrics.functions.numbers import change_label, percent_change
from chainmetrics.functions.timeops import AsOf, before, week_of
from chainmetrics.operators.entities import union_all, union_sources, weekly_active
from chainmetrics.operators.weekly import (
    calendar_lag,
    latest_and_previous,
    newest_per_group,
    running_total,
)
from chainmetrics.sources.tables import Sources


def last_data_week(src: Sources, as_of: AsOf) -> DataFrame:
    """``(last_week)``: newest complete week in either runtime."""
    stamps = union_all(
        [
            before(df, "block_timestamp", as_of.this_week).select("block_timestamp")
            for df in (src.core_transactions, src.evm_transactions)
        ]
    )
    return stamps.agg(week_of(F.max("block_timestamp")).alias("last_week"))


def tx_outcome_weekly(src: Sources, as_of: AsOf) -> DataFrame:
    """``(week, type, total_transactions)``; an id present in both runtimes counts once."""
    succeeded = F.when(F.col("tx_succeeded"), F.lit("Succeeded")).otherwise(F.lit("Failed"))
    legs = [
        before(df, "block_timestamp", as_of.this_week).select(
            F.col(key).alias("tx_id"), week_of("block_timestamp").alias("week"), succeeded.alias("type")
        )
        for df, key in ((src.core_transactions, "tx_id"), (src.evm_transactions, "tx_hash"))
    ]
    return (
        union_all(legs)
        .groupBy("week", "type")
        .agg(F.count_distinct("tx_id").alias("total_transactions"))
    )


def tx_numbers(src: Sources, as_of: AsOf, outcomes: DataFrame | None = None) -> DataFrame:
    """Newest two weeks per outcome, with the running total over the full history.

    ``outcomes`` is :func:`tx_outcome_weekly` where it has been worked out already.
    """
    weekly = (tx_outcome_weekly(src, as_of) if outcomes is None else outcomes).withColumn(
        "cum_transactions", running_total("total_transactions", "week", "type")
    )
    return newest_per_group(weekly, 2, "type")


def tx_weekly(src: Sources, as_of: AsOf) -> DataFrame:
    """Weekly counts added over both runtimes, with change on the calendar week before."""
    rows = union_sources(
        {
            name: before(df, "block_timestamp", as_of.this_week).select(
                F.col(key).alias("entity"), F.col("block_timestamp").alias("ts")
            )
            for name, df, key in (
                ("core", src.core_transactions, "tx_id"),
                ("evm", src.evm_transactions, "tx_hash"),
            )
        }
    )
    weekly = weekly_active(rows, "total_transactions").withColumn(
        "_previous", calendar_lag("total_transactions")
    )
    now, then = F.col("total_transactions"), F.col("_previous")
    return weekly.select(
        "week",
        "total_transactions",
        change_label(now, then).alias("transactions_diff"),
        percent_change(now, then).alias("pcg_diff"),
        running_total("total_transactions", "week").alias("cum_transactions"),
    )


def kpi_transactions(src: Sources, as_of: AsOf) -> DataFrame:
    """Newest weekly count, its change on the previous row present, and the weekly %."""
    delta = F.col("now.total_transactions") - F.col("then.total_transactions")
    return latest_and_previous(tx_weekly(src, as_of)).select(
        F.col("now.week").alias("week"),
        F.col("now.total_transactions").alias("total_transactions"),
        delta.alias("delta"),
        F.format_string("%+d", delta).alias("delta_label"),
        F.col("now.pcg_diff").alias("pcg_diff"),
    )
