"""What the physical plans must and must not contain."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as registry
from chainmetrics import AsOf, Sources, report
from chainmetrics.operators.entities import weekly_active_and_new
from chainmetrics.plans import contracts, fees, nft, users
from chainmetrics.session import tune
from chainmetrics.sources import fixtures

SF_DIR = "/root/testdata/sf0.001"

# Metrics bounded by the week in progress: the bare time column must reach the scan.
BOUNDED = [
    "last_data_week",
    "tx_numbers",
    "tx_weekly",
    "tx_outcome_weekly",
    "fee_weekly",
    "staking_weekly",
    "price_hourly_week",
    "token_movers",
    "users_numbers",
    "users_weekly",
    "contracts_active_weekly",
    "contracts_new_weekly",
    "nft_sales_numbers",
    "nft_sales_weekly",
]


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(registry.library_queries()))
def test_no_row_pairing_and_no_python(spark, name):
    plan = physical(registry.queries()[name](spark, SF_DIR))
    assert not re.search(r"Python|Pandas|MapInArrow", plan)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", BOUNDED)
def test_time_bound_reaches_the_scan(spark, stored, name):
    plan = physical(report.table(name, Sources.from_parquet(spark, stored), "2024-01-31"))
    pushed = re.findall(r"PushedFilters: \[([^\]]*)\]", plan)
    assert any(re.search(r"(LessThan|GreaterThan)\w*\((block_timestamp|hour)", p) for p in pushed), pushed


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("tx_weekly", {"event_id", "ts", "user_id"}),
        ("token_movers", {"event_id", "ts", "user_id", "value"}),
        ("last_data_week", {"ts"}),
    ],
)
def test_scans_read_only_what_is_needed(spark, name, columns):
    plan = physical(registry.queries()[name](spark, SF_DIR))
    read = {c.split(":")[0] for s in re.findall(r"ReadSchema: struct<([^>]*)>", plan) for c in s.split(",")}
    assert read == columns


BLOOM = "spark.sql.optimizer.runtime.bloomFilter."


@pytest.mark.parametrize(
    ("build", "pruned"),
    [
        (lambda src, until: nft.storefront_sales(src, until), True),
        (lambda src, until: nft.log_pair_sales(src, until), True),
        (lambda src, until: contracts.evm_creations(src, ["contract"], until), True),
        (lambda src, until: fees.core_daily_fees(src, until), False),
    ],
    ids=["storefront", "log_pair", "creations", "fees"],
)
def test_selective_side_prunes_the_wide_scan(spark, stored, build, pruned):
    """With tables too large to broadcast, a Bloom filter reaches the wide scan."""
    small = {f"{BLOOM}applicationSideScanSizeThreshold": "1", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {key: spark.conf.get(key) for key in small}
    try:
        for key, value in small.items():
            spark.conf.set(key, value)
        src = Sources.from_parquet(tune(spark), stored)
        df = build(src, AsOf.of("2024-01-31").this_week)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert ("might_contain" in plan) == pruned


def test_users_scan_each_table_once(spark):
    src = fixtures.load(spark, SF_DIR)
    rows = users.user_rows(src.transaction_actors, src.evm_transactions)
    assert physical(weekly_active_and_new(rows)).count("FileScan") == 2


def test_single_partition_only_after_aggregation(spark):
    """An unpartitioned window must sit above an aggregate by week."""
    plan = physical(users.users_numbers(fixtures.load(spark, SF_DIR), AsOf.of("2024-01-31")))
    below = plan.split("Exchange SinglePartition")[-1]
    assert "HashAggregate(keys=[week" in below
