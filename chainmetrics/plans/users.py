"""Active and new users of both runtimes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainmetrics.functions.numbers import change_label, percent_change
from chainmetrics.functions.timeops import AsOf, before
from chainmetrics.operators.entities import debuts, union_sources, weekly_active_and_new
from chainmetrics.operators.weekly import latest_two, running_total
from chainmetrics.sources.tables import Sources


def user_rows(actors: DataFrame, evm: DataFrame) -> DataFrame:
    """``(source, entity, ts)``: one row per actor of a core tx and per EVM sender."""
    return union_sources(
        {
            "core": actors.select(
                F.explode("actors").alias("entity"), F.col("block_timestamp").alias("ts")
            ),
            "evm": evm.select(
                F.col("from_address").alias("entity"), F.col("block_timestamp").alias("ts")
            ),
        }
    )


def user_debut(src: Sources) -> DataFrame:
    """``(source, users, debut)``: first week of each user per runtime."""
    rows = user_rows(src.transaction_actors, src.evm_transactions)
    return debuts(rows, "source", "entity").withColumnRenamed("entity", "users")


def _weekly(src: Sources, as_of: AsOf) -> DataFrame:
    cutoff = as_of.this_week
    return weekly_active_and_new(
        user_rows(
            before(src.transaction_actors, "block_timestamp", cutoff),
            before(src.evm_transactions, "block_timestamp", cutoff),
        )
    )


def users_weekly(src: Sources, as_of: AsOf) -> DataFrame:
    """``(week, active_users, new_users)`` for complete weeks."""
    return _weekly(src, as_of)


def users_weekly_long(src: Sources, as_of: AsOf) -> DataFrame:
    """The two measures as ``(week, metric, value)`` rows."""
    return _weekly(src, as_of).unpivot(["week"], ["active_users", "new_users"], "metric", "value")


def users_numbers(src: Sources, as_of: AsOf, weekly: DataFrame | None = None) -> DataFrame:
    """Newest complete week against the week before it; ``weekly`` is :func:`users_weekly` where it is known."""
    weekly = (_weekly(src, as_of) if weekly is None else weekly).withColumn("unique_users", running_total("new_users", "week"))
    pair = latest_two(weekly, as_of.this_week, as_of.last_week)
    return pair.select(
        "now.*",
        change_label(F.col("now.unique_users"), F.col("then.unique_users")).alias("new_accounts"),
        percent_change(F.col("now.active_users"), F.col("then.active_users")).alias("pcg_diff"),
    )
