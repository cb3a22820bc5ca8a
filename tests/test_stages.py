"""What the export shares between metrics: the same rows, and fact tables read by the stages alone."""

from __future__ import annotations

from datetime import datetime

import pytest

from chainmetrics import report
from chainmetrics.functions.timeops import AsOf
from chainmetrics.sources import fixtures
from chainmetrics.sources.tables import Sources

AS_OF = AsOf.of("2024-01-31")
SHARED = [name for stage in report.STAGES for name in stage.readers]


def bag(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def given(spark):
    src = fixtures.load(spark, "/root/testdata/sf0.001").until(AS_OF)
    return src, report.with_stages(src, AS_OF, report.NAMES)


@pytest.mark.parametrize("name", SHARED)
def test_staged_metric_equals_the_plain_one(given, name):
    src, staged = given
    plain = report.METRICS[name].build(src, AS_OF)
    assert staged[name]().dtypes == plain.dtypes
    assert bag(staged[name]()) == bag(plain)


def test_rows_that_lack_something(make):
    weeks = [datetime(2024, 1, d, 23, 59) for d in (7, 8, 14, 21, 28, 29)]
    events = [
        {"tx_id": str(i), "event_contract": c, "block_timestamp": ts, "tx_succeeded": ok}
        for i, ts in enumerate([*weeks, None])
        for c in ("a", f"b{i}", None)
        for ok in (True, False, None)
        if not (c == "a" and ok and i < 2)
    ]
    logs = [{"tx_hash": f"h{i}", "contract_address": c, "block_timestamp": ts} for i, ts in enumerate([*weeks, None]) for c in ("x", "x", f"y{i}", None)]
    src = make(core_events=events, evm_event_logs=logs).until(AS_OF)
    staged = report.with_stages(src, AS_OF, report.NAMES)
    for name in ("contracts_numbers", "contracts_active_weekly", "contracts_new_weekly"):
        plain = bag(report.METRICS[name].build(src, AS_OF))
        assert plain and bag(staged[name]()) == plain


def test_fact_tables_are_read_by_the_stage_alone(spark, stored):
    opened = []

    def open_table(name):
        opened.append(name)
        return spark.read.parquet(f"{stored}/{name}")

    src = Sources(open_table).until(AS_OF)
    staged = report.with_stages(src, AS_OF, report.NAMES)

    def scans(name: str, table: str) -> int:
        return staged[name]()._jdf.queryExecution().executedPlan().toString().count(f"/{table}]")

    for name in ("tx_numbers", "tx_outcome_weekly"):
        assert scans(name, "core_transactions") == scans(name, "evm_transactions") == 0
    for name in ("users_numbers", "users_weekly"):
        assert scans(name, "transaction_actors") == scans(name, "evm_transactions") == 0
    for name in ("contracts_numbers", "contracts_active_weekly", "contracts_new_weekly"):
        assert scans(name, "core_events") == 0
    assert scans("contracts_active_weekly", "evm_event_logs") == 0
    # The plain forms are found by the same count.
    plain = report.METRICS["contracts_active_weekly"].build(src, AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert plain.count("/core_events]") == plain.count("/evm_event_logs]") == 1


def test_one_reader_alone_makes_no_stage(given):
    src, _ = given
    assert report.with_stages(src, AS_OF, ["tx_numbers", "fee_weekly"]) == {}
    assert set(report.with_stages(src, AS_OF, ["tx_numbers", "tx_outcome_weekly"])) == {"tx_numbers", "tx_outcome_weekly"}
