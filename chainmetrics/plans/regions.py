"""Accounts by region, inferred from the hours in which they act."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainmetrics.functions.timeops import hour_of, week_of
from chainmetrics.operators.regions import (
    UNKNOWN,
    hour_profile,
    hourly_counts,
    infer_region,
    rolled_up,
    top_hours,
    top_hours_ascending,
)
from chainmetrics.operators.weekly import share_out
from chainmetrics.sources.tables import Sources


def _account_rows(src: Sources) -> DataFrame:
    return src.core_transactions.select(
        F.get("authorizers", F.lit(0)).alias("user"), "tx_id", F.col("block_timestamp").alias("ts")
    )


def user_hour_profile(src: Sources) -> DataFrame:
    """All 24 hours of each user with transaction count and rank."""
    counts = hour_profile(_account_rows(src)).select(
        "user", hour_of("first_ts").alias("debut"), hourly_counts().alias("counts")
    )
    cells = counts.select("user", "debut", "counts", F.posexplode("counts").alias("hour_of_day", "transactions"))
    busier = F.filter("counts", lambda n: n > F.col("transactions"))
    return cells.select(
        "user", "debut", "hour_of_day", "transactions", (F.size(busier) + 1).alias("hourly_rank")
    )


def user_top_hours(src: Sources) -> DataFrame:
    """The six busiest hours of each user as ordered comma lists."""

    def listed(hours: Column) -> Column:
        return F.array_join(hours.cast("array<string>"), ",")

    return hour_profile(_account_rows(src)).select(
        "user",
        hour_of("first_ts").alias("debut"),
        listed(top_hours()).alias("most_active_hours"),
        listed(top_hours_ascending()).alias("least_active_hours"),
    )


def user_region(src: Sources, profile: str = "reference") -> DataFrame:
    """``(user, debut, region)``, one row per first authorizer."""
    inferred = infer_region(hour_profile(_account_rows(src)), profile)
    return inferred.select("user", hour_of("first_ts").alias("debut"), "region")


def region_active_weekly(src: Sources, regions: DataFrame | None = None) -> DataFrame:
    """``(week, region, active_accounts)``, the week in progress included.

    User-weeks are made distinct before the join, so a user meets the region
    table once per week and not once per transaction.
    """
    regions = user_region(src) if regions is None else regions
    active = (
        src.core_transactions.select(
            F.get("authorizers", F.lit(0)).alias("user"), week_of("block_timestamp").alias("week")
        )
        .filter(F.col("user").isNotNull())
        .distinct()
    )
    return (
        active.join(regions.select("user", rolled_up(F.col("region")).alias("region")), "user")
        .groupBy("week", "region")
        .agg(F.count("user").alias("active_accounts"))
    )


def region_new_weekly(src: Sources, regions: DataFrame | None = None) -> DataFrame:
    """``(week, region, accounts_created)``; accounts of unknown region are shared out."""
    regions = user_region(src) if regions is None else regions
    counts = regions.groupBy(
        week_of("debut").alias("week"), rolled_up(F.col("region")).alias("region")
    ).agg(F.count("user").alias("accounts"))
    shared = share_out(counts, "week", "region", "accounts", UNKNOWN, "accounts_created")
    return shared.select("week", "region", "accounts_created")
