"""Daily transaction statistics per runtime and weekly mean fees."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainmetrics.functions.numbers import ratio, steady_sum
from chainmetrics.functions.payload import payload_field
from chainmetrics.functions.timeops import AsOf, before, day_of, minute_boundaries, week_of
from chainmetrics.operators.weekly import latest_and_previous
from chainmetrics.plans.prices import weekly_native_price
from chainmetrics.sources.tables import Sources

# Fixed values
FEE_CONTRACT = "A.f919ee77447b7497.FlowFees"
FEE_EVENT = "FeesDeducted"


def evm_daily_stats(src: Sources, until: date | None = None) -> DataFrame:
    tx = src.evm_transactions
    if until is not None:
        tx = before(tx, "block_timestamp", until)
    daily = tx.groupBy(day_of("block_timestamp").alias("date")).agg(
        F.count("tx_hash").alias("total_transactions"),
        F.count_if("tx_succeeded").alias("successful_transactions"),
        F.sum("tx_fee").alias("fees"),
        F.avg("tx_fee").alias("avg_tx_fee"),
        F.count_distinct("from_address").alias("unique_users"),
        F.avg(minute_boundaries("inserted_timestamp", "block_timestamp")).alias("latency_minutes"),
    )
    return _with_success_rate(daily)


def _fees_per_tx(src: Sources) -> DataFrame:
    """``(tx_id, events, amounts, amount)``: the fee events of each transaction."""
    is_fee = (F.col("event_contract") == FEE_CONTRACT) & (F.col("event_type") == FEE_EVENT)
    amount = payload_field(src.core_events, "event_data", "amount", "double")
    return (
        src.core_events.filter(is_fee)
        .select("tx_id", amount.alias("amount"))
        .groupBy("tx_id")
        .agg(
            F.count("*").alias("events"),
            F.count("amount").alias("amounts"),
            steady_sum(F.col("amount")).alias("amount"),
        )
    )


# A core measure is taken over (transaction, fee event) pairs. Both sides are
# reduced per transaction before they meet, and a measure of the pairs is the
# product of the two sides' counts; so an id repeated on both sides costs one row
# per side, not a row per pair.
_FEE_COUNT = "sum(rows * amounts)"


def _fee_sum() -> Column:
    return steady_sum(F.col("rows") * F.col("amount"))


def _core_transactions(src: Sources, until: date) -> DataFrame:
    return (
        before(src.core_transactions, "block_timestamp", until)
        .filter(F.col("tx_id").isNotNull())
        .withColumn("date", day_of("block_timestamp"))
    )


def core_daily_fees(src: Sources, until: date) -> DataFrame:
    """``(date, fees, avg_tx_fee)`` of the core runtime."""
    tx = _core_transactions(src, until).groupBy("tx_id", "date").agg(F.count("*").alias("rows"))
    return (
        tx.join(_fees_per_tx(src), "tx_id")
        .groupBy("date")
        .agg(
            _fee_sum().alias("fees"),
            ratio(_fee_sum(), F.expr(_FEE_COUNT)).alias("avg_tx_fee"),
        )
    )


def core_daily_stats(src: Sources, until: date) -> DataFrame:
    """The measures of :func:`evm_daily_stats` over the pairs of the core runtime."""
    latency = minute_boundaries("inserted_timestamp", "block_timestamp")
    tx = (
        _core_transactions(src, until)
        .groupBy("tx_id", "date", "payer")
        .agg(
            F.count("*").alias("rows"),
            F.count_if("tx_succeeded").alias("succeeded"),
            F.count(latency).alias("latencies"),
            F.sum(latency).alias("latency"),
        )
    )
    daily = (
        tx.join(_fees_per_tx(src), "tx_id")
        .groupBy("date")
        .agg(
            F.count_distinct("tx_id").alias("total_transactions"),
            F.expr("sum(succeeded * events)").alias("successful_transactions"),
            _fee_sum().alias("fees"),
            ratio(_fee_sum(), F.expr(_FEE_COUNT)).alias("avg_tx_fee"),
            F.count_distinct("payer").alias("unique_users"),
            ratio(F.expr("sum(latency * events)"), F.expr("sum(latencies * events)")).alias("latency_minutes"),
        )
    )
    return _with_success_rate(daily)


def _with_success_rate(daily: DataFrame) -> DataFrame:
    return daily.select(
        "date",
        "total_transactions",
        "successful_transactions",
        ratio(F.col("successful_transactions"), F.col("total_transactions")).alias("success_rate"),
        "fees",
        "avg_tx_fee",
        "unique_users",
        "latency_minutes",
    )


def daily_tx_stats(src: Sources, as_of: AsOf) -> DataFrame:
    """Eight measures per day and runtime, of the rows that exist at ``as_of``."""
    src = src.until(as_of)
    evm = evm_daily_stats(src).withColumn("source", F.lit("evm"))
    core = core_daily_stats(src, as_of.today).withColumn("source", F.lit("core"))
    return evm.unionByName(core)


def fee_weekly(src: Sources, as_of: AsOf) -> DataFrame:
    """Mean of the daily mean fees, in the native token and in USD.

    Every day of a week meets every hourly price of that week, and the mean over
    such a full product is the product of the two means; so prices are reduced to
    one row per week first.
    """
    cutoff = as_of.this_week
    days = (
        evm_daily_stats(src, cutoff)
        .select("date", "fees", "avg_tx_fee")
        .unionByName(core_daily_fees(src, cutoff))
        .distinct()
    )
    weekly = days.groupBy(week_of("date").alias("week")).agg(
        ratio(steady_sum(F.col("avg_tx_fee")), F.count("avg_tx_fee")).alias("avg_tx_fee_flow")
    )
    return weekly.join(weekly_native_price(src, cutoff), "week").select(
        "week", "avg_tx_fee_flow", (F.col("avg_tx_fee_flow") * F.col("price")).alias("avg_tx_fee_usd")
    )


def kpi_fees(src: Sources, as_of: AsOf) -> DataFrame:
    """The newest week's mean fees."""
    return latest_and_previous(fee_weekly(src, as_of)).select("now.*")
