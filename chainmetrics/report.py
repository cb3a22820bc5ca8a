"""All metric tables under one roof: build, order, show and export them by name."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import date, datetime
from functools import cache
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainmetrics.functions.timeops import AsOf
from chainmetrics.plans import contracts, fees, nft, prices, regions, staking, transactions, users
from chainmetrics.session import shared, written
from chainmetrics.sources.sinks import write_csv
from chainmetrics.sources.tables import Sources


@dataclass(frozen=True)
class Metric:
    """How one result table is built, how its rows are ordered, where it is exported.

    In ``order`` a leading minus means descending. NULL counts as the largest
    value: first when descending, last when ascending.
    """

    build: Callable[[Sources, AsOf], DataFrame]
    order: tuple[str, ...] = ()
    file: str | None = None
    #: Order of the rows in the files, where it is not that of the table, and one more file.
    file_order: tuple[str, ...] | None = None
    also: str | None = None

    def table(self, src: Sources, as_of: AsOf) -> DataFrame:
        """The metric of the tables as they stood at ``as_of``."""
        return self.sorted(self.build(src.until(as_of), as_of), self.order)

    def filed(self, df: DataFrame) -> DataFrame:
        return self.sorted(df, self.order if self.file_order is None else self.file_order)

    @staticmethod
    def sorted(df: DataFrame, order: tuple[str, ...]) -> DataFrame:
        if not order:
            return df
        return df.orderBy(
            *[
                F.col(name[1:]).desc_nulls_first() if name.startswith("-") else F.col(name).asc_nulls_last()
                for name in order
            ]
        )


# File names and orders are fixed values.
METRICS: dict[str, Metric] = {
    "last_data_week": Metric(transactions.last_data_week),
    "tx_numbers": Metric(transactions.tx_numbers, ("week", "type"), "tx_numbers_last2.csv"),
    "tx_weekly": Metric(
        transactions.tx_weekly, ("-week",), "tx_over_time.csv", ("week",), "transactions_weekly.csv"
    ),
    "tx_outcome_weekly": Metric(transactions.tx_outcome_weekly, ("week",), "tx_success_failed.csv"),
    "fee_weekly": Metric(fees.fee_weekly, ("week",), "avg_tx_fee_weekly.csv"),
    "staking_weekly": Metric(staking.staking_weekly, ("date",), "staking_over_time.csv"),
    "stakers_summary": Metric(staking.stakers_summary, (), "staking_summary.csv"),
    "price_hourly_week": Metric(
        prices.price_hourly_week, ("-recorded_hour",), "flow_price_week.csv", ("recorded_hour",)
    ),
    "token_movers": Metric(prices.token_movers, ("-avg_deviation_weekly_pct",), "tokens_weekly_movers.csv"),
    "region_active_weekly": Metric(
        lambda src, as_of: regions.region_active_weekly(src),
        ("week", "-active_accounts"),
        "users_by_region.csv",
    ),
    "region_new_weekly": Metric(
        lambda src, as_of: regions.region_new_weekly(src),
        ("week", "-accounts_created"),
        "users_by_region_time.csv",
    ),
    "users_numbers": Metric(users.users_numbers, (), "users_numbers.csv"),
    "users_weekly": Metric(users.users_weekly, ("-week",), "users_over_time.csv"),
    "nft_sales_numbers": Metric(nft.nft_sales_numbers, (), "nft_sales_numbers.csv"),
    "nft_sales_weekly": Metric(nft.nft_sales_weekly, ("-week",), "nft_sales_over_time.csv"),
    "contracts_numbers": Metric(contracts.contracts_numbers, (), "contracts_numbers.csv"),
    "contracts_active_weekly": Metric(
        contracts.contracts_active_weekly, ("-date",), "contracts_active_over_time.csv"
    ),
    "contracts_new_weekly": Metric(contracts.contracts_new_weekly, ("date",), "contracts_new_over_time.csv"),
}
NAMES = list(METRICS)


def table(name: str, src: Sources, as_of: AsOf | datetime | date | str) -> DataFrame:
    """One metric, in its report order."""
    return METRICS[name].table(src, AsOf.of(as_of))


@dataclass(frozen=True)
class Stage:
    """A table that several metrics read, and how each of them is built from it."""

    build: Callable[[Sources, AsOf], Any]
    readers: dict[str, Callable[[Sources, AsOf, Any], DataFrame]]


STAGES = [
    Stage(
        lambda src, as_of: shared(regions.user_region(src)),
        {
            "region_active_weekly": lambda src, as_of, found: regions.region_active_weekly(src, found),
            "region_new_weekly": lambda src, as_of, found: regions.region_new_weekly(src, found),
        },
    ),
    Stage(
        lambda src, as_of: written(transactions.tx_outcome_weekly(src, as_of)),
        {"tx_numbers": transactions.tx_numbers, "tx_outcome_weekly": lambda src, as_of, weekly: weekly},
    ),
    Stage(
        lambda src, as_of: written(users.users_weekly(src, as_of)),
        {"users_numbers": users.users_numbers, "users_weekly": lambda src, as_of, weekly: weekly},
    ),
    Stage(
        lambda src, as_of: contracts.ContractWeeks.of(src),
        {
            "contracts_numbers": contracts.contracts_numbers,
            "contracts_active_weekly": contracts.contracts_active_weekly,
            "contracts_new_weekly": contracts.contracts_new_weekly,
        },
    ),
]


def with_stages(src: Sources, as_of: AsOf, chosen: Iterable[str]) -> dict[str, Callable[[], DataFrame]]:
    """How to build those of the ``chosen`` metrics that share a stage with another; each stage is made when first needed."""
    chosen, found = set(chosen), {}
    for stage in STAGES:
        readers = {name: build for name, build in stage.readers.items() if name in chosen}
        if len(readers) > 1:
            table = cache(lambda stage=stage: stage.build(src, as_of))
            found |= {name: (lambda build=build, table=table: build(src, as_of, table())) for name, build in readers.items()}
    return found


def export(
    src: Sources,
    as_of: AsOf | datetime | date | str,
    folder: str,
    only: Iterable[str] = NAMES,
) -> dict[str, str]:
    """Write metrics as CSV below ``folder``; returns the path of each.

    What several of them need (:data:`STAGES`) is worked out once, as a table of its own. A metric that
    is offered under a second file name is listed under that name too.
    """
    chosen, as_of = list(only), AsOf.of(as_of)
    src = src.until(as_of)
    staged = with_stages(src, as_of, chosen)
    paths = {}
    for name in chosen:
        metric = METRICS[name]
        df = staged[name]() if name in staged else metric.build(src, as_of)
        for label, file in ((name, metric.file or f"{name}.csv"), (metric.also, metric.also)):
            if label:
                paths[label] = f"{folder}/{file}"
                write_csv(metric.filed(df), paths[label])
    return paths
