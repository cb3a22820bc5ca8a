"""Stake and unstake flows, stakers, and net positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainmetrics.functions.numbers import percent_change
from chainmetrics.functions.timeops import AsOf, before, week_of
from chainmetrics.operators.median import exact_median
from chainmetrics.operators.weekly import moving_average, running_total
from chainmetrics.sources.tables import Sources

# Fixed values
STAKE_ACTIONS = ["DelegatorTokensCommitted", "TokensCommitted"]
UNSTAKE_ACTIONS = ["UnstakedTokensWithdrawn", "DelegatorUnstakedTokensWithdrawn"]
INITIAL_STAKE = 2.4e8
MOVING_AVERAGE_ROWS = 7

STAKE, UNSTAKE = "staking", "unstaking"


def _side() -> Column:
    return F.when(F.col("action").isin(STAKE_ACTIONS), F.lit(STAKE)).otherwise(F.lit(UNSTAKE))


def _moves(actions: DataFrame) -> DataFrame:
    """Stake and unstake rows in one scan, labelled by side."""
    return actions.filter(F.col("action").isin(STAKE_ACTIONS + UNSTAKE_ACTIONS)).select(
        week_of("block_timestamp").alias("week"), _side().alias("side"), "tx_id", "delegator", "amount"
    )


def _weekly_sides(moves: DataFrame, *more: Column) -> DataFrame:
    """One row per week and side with running totals per side."""
    weekly = moves.groupBy("week", "side").agg(
        F.count_distinct("tx_id").alias("transactions"),
        F.count_distinct("delegator").alias("delegators"),
        F.sum("amount").alias("volume"),
        *more,
    )
    totals = {f"cum_{name}": running_total(name, "week", "side") for name in ("transactions", "delegators", "volume")}
    return weekly.withColumns(totals)


def staking_side_weekly(src: Sources) -> DataFrame:
    """Each side on its own, with mean, median and a seven-row moving average."""
    moves = _moves(src.staking_actions)
    weekly = _weekly_sides(moves, F.avg("amount").alias("avg_volume")).withColumn(
        "avg_7d_ma_volume", moving_average("volume", MOVING_AVERAGE_ROWS, "week", "side")
    )
    medians = exact_median(moves, ["week", "side"], "amount", "median_volume").select(
        F.col("week").alias("_week"), F.col("side").alias("_side"), "median_volume"
    )
    same = weekly["week"].eqNullSafe(F.col("_week")) & (weekly["side"] == F.col("_side"))
    return weekly.join(medians, same, "left").drop("_week", "_side")


def staking_weekly(src: Sources, as_of: AsOf) -> DataFrame:
    """Stake against unstake per week; only weeks in which both happen.

    Running totals are taken per side over all weeks before that restriction.
    """
    sides = _weekly_sides(_moves(before(src.staking_actions, "block_timestamp", as_of.this_week)))

    def of(side: str, name: str, alias: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(name))).alias(alias)

    wide = (
        sides.groupBy(F.col("week").alias("date"))
        .agg(
            F.count("*").alias("_sides"),
            *[
                column
                for name in ("transactions", "delegators")
                for column in (
                    of(STAKE, name, f"staking_{name}"),
                    of(UNSTAKE, name, f"unstaking_{name}"),
                    of(STAKE, f"cum_{name}", f"total_staking_{name}"),
                    of(UNSTAKE, f"cum_{name}", f"total_unstaking_{name}"),
                )
            ],
            of(STAKE, "volume", "staked_volume"),
            of(UNSTAKE, "volume", "_out"),
            of(STAKE, "cum_volume", "total_staked_volume"),
            of(UNSTAKE, "cum_volume", "_total_out"),
        )
        .filter(F.col("_sides") == 2)
    )
    flows = wide.withColumns(
        {"unstaked_volume": -F.col("_out"), "total_unstaked_volume": -F.col("_total_out")}
    )
    counts = []
    for name in ("transactions", "delegators"):
        staked, unstaked = f"total_staking_{name}", f"total_unstaking_{name}"
        counts += [
            f"staking_{name}",
            f"unstaking_{name}",
            staked,
            unstaked,
            (F.col(staked) - F.col(unstaked)).alias(f"net_staking_{name}"),
        ]
    return flows.select(
        "date",
        *counts,
        "staked_volume",
        "unstaked_volume",
        (F.col("staked_volume") + F.col("unstaked_volume")).alias("net_staked_volume"),
        "total_staked_volume",
        "total_unstaked_volume",
        (F.col("total_staked_volume") + F.col("total_unstaked_volume") + F.lit(INITIAL_STAKE)).alias(
            "total_net_staked_volume"
        ),
    )


def stakers_summary(src: Sources, as_of: AsOf) -> DataFrame:
    """Unique stakers now and seven days ago.

    A staker belongs to the past if the first stake does, so one minimum per
    staker answers both counts.
    """
    first = (
        src.staking_actions.filter(F.col("action").isin(STAKE_ACTIONS) & F.col("delegator").isNotNull())
        .groupBy("delegator")
        .agg(F.min("block_timestamp").alias("first_stake"))
    )
    cutoff = F.lit(as_of.midnight_ago(7))
    counts = first.agg(
        F.count("*").alias("unique_stakers"),
        F.count_if(F.col("first_stake") < cutoff).alias("unique_stakers_past_week"),
    )
    now, then = F.col("unique_stakers"), F.col("unique_stakers_past_week")
    return counts.select(
        "unique_stakers",
        "unique_stakers_past_week",
        (now - then).alias("users_diff"),
        F.format_string("%d (+%d)", now, now - then).alias("unique_stakers_diff"),
        percent_change(now, then).alias("pcg_diff"),
    )


def staker_net_positions(src: Sources) -> DataFrame:
    """Staked, unstaked and net volume of everyone who ever staked."""
    moves = _moves(src.staking_actions)
    staked = F.sum(F.when(F.col("side") == STAKE, F.col("amount")))
    unstaked = F.sum(
        F.when((F.col("side") == UNSTAKE) & F.col("delegator").isNotNull(), F.col("amount"))
    )
    per_staker = (
        moves.groupBy("delegator")
        .agg(
            F.count_if(F.col("side") == STAKE).alias("_stakes"),
            F.coalesce(staked, F.lit(0.0)).alias("total_staked_volume"),
            F.coalesce(-unstaked, F.lit(0.0)).alias("total_unstaked_volume"),
        )
        .filter(F.col("_stakes") > 0)
    )
    return per_staker.select(
        "delegator",
        "total_staked_volume",
        "total_unstaked_volume",
        (F.col("total_staked_volume") + F.col("total_unstaked_volume")).alias("total_net_staked_volume"),
    )
