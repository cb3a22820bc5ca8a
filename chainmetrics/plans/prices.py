"""Token prices: the native token by hour, weekly means, weekly movers."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainmetrics.functions.numbers import percent_change, ratio
from chainmetrics.functions.timeops import AsOf, before, hour_of, moment_literal, since, week_of
from chainmetrics.sources.tables import Sources

# Fixed values
NATIVE_SYMBOL = "FLOW"
NATIVE_SYMBOL_PART = "flow"
NATIVE_PRICE_CEILING = 0.5
DISPLAY_ROWS = 50


def price_hourly_week(src: Sources, as_of: AsOf) -> DataFrame:
    """Hourly native-token price of the last seven days with change and volatility.

    The window runs over one row per hour of a week, not over prices.
    """
    recent = since(src.prices_hourly, "hour", as_of.midnight_ago(7)).filter(
        F.lower("symbol").contains(NATIVE_SYMBOL_PART) & (F.col("price") < NATIVE_PRICE_CEILING)
    )
    hourly = recent.groupBy("hour").agg(
        F.avg("price").alias("mean"), F.max("price").alias("high"), F.stddev_pop("price").alias("spread")
    )
    opening = F.lag("mean").over(Window.orderBy("hour"))
    return hourly.select(
        F.col("hour").alias("recorded_hour"),
        F.col("mean").alias("flow_price"),
        percent_change(F.col("high"), opening).alias("flow_price_change_percentage"),
        F.col("spread").alias("flow_price_volatility"),
    )


def token_movers(src: Sources, as_of: AsOf) -> DataFrame:
    """Mean close over seven days and the relative gap to the last day's mean."""
    now = moment_literal(as_of.moment)
    window = src.prices_ohlc.filter(
        F.col("asset_id").isNotNull() & F.col("hour").between(moment_literal(as_of.ago(7)), now)
    )
    last_day = F.col("hour").between(moment_literal(as_of.ago(1)), now)
    per_token = window.groupBy(F.col("asset_id").alias("token")).agg(
        F.avg("close").alias("avg_price"), F.avg(F.when(last_day, F.col("close"))).alias("_last_day")
    )
    return per_token.select(
        "token",
        "avg_price",
        ratio(F.col("avg_price") - F.col("_last_day"), F.col("avg_price")).alias("avg_deviation_weekly_pct"),
    )


def token_movers_top50(src: Sources, as_of: AsOf) -> DataFrame:
    """The rows a report shows: largest deviation first, undefined before all."""
    return (
        token_movers(src, as_of)
        .orderBy(F.col("avg_deviation_weekly_pct").desc_nulls_first(), "token")
        .limit(DISPLAY_ROWS)
    )


def weekly_token_price(src: Sources, until: date | None = None) -> DataFrame:
    """``(week, token_contract, price_usd)``: mean of the hourly prices."""
    prices = src.prices_hourly if until is None else before(src.prices_hourly, "hour", until)
    return prices.groupBy(
        week_of("hour").alias("week"), F.col("token_address").alias("token_contract")
    ).agg(F.avg("price").alias("price_usd"))


def weekly_native_price(src: Sources, until: date) -> DataFrame:
    """``(week, price)``: mean over the week's hours of the mean price in the hour."""
    hourly = (
        before(src.prices_hourly, "hour", until)
        .filter(F.col("symbol") == NATIVE_SYMBOL)
        .groupBy(hour_of("hour").alias("hour"))
        .agg(F.avg("price").alias("price"))
    )
    return hourly.groupBy(week_of("hour").alias("week")).agg(F.avg("price").alias("price"))
