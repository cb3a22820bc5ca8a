"""Loading, normalising, layouts and sinks."""

from __future__ import annotations

import csv
import re
from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from chainmetrics import AsOf, Sources, report
from chainmetrics.plans import contracts, fees, regions, transactions
from chainmetrics.session import shared
from chainmetrics.sources import fixtures
from chainmetrics.sources.schemas import SCHEMAS
from chainmetrics.sources.sinks import write_by_week, write_csv
from chainmetrics.sources.tables import normalise
from tests.conftest import rows_of

SF_DIR = "/root/testdata/sf0.001"
AS_OF = AsOf.of("2024-01-31")


def bag(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", ["tx_weekly", "region_active_weekly", "nft_sales_weekly"])
def test_parquet_round_trip_gives_equal_metrics(spark, stored, name):
    direct = report.table(name, fixtures.load(spark, SF_DIR), AS_OF)
    assert bag(report.table(name, Sources.from_parquet(spark, stored), AS_OF)) == bag(direct)


def test_catalog_tables_and_views(spark, stored):
    spark.read.parquet(f"{stored}/core_transactions").createOrReplaceTempView("some_core_tx")
    src = Sources.from_catalog(spark, {"core_transactions": "some_core_tx"})
    assert src.core_transactions.columns[0] == "tx_id"
    with pytest.raises(KeyError):
        src.prices_ohlc
    Sources.from_parquet(spark, stored).register_views()
    assert spark.sql("SELECT count(*) FROM staking_actions").first()[0] > 0


def test_text_booleans_and_case_of_columns(spark):
    df = spark.sql(
        "SELECT 'a' AS TX_ID, timestamp_ntz'2024-01-01' AS BLOCK_TIMESTAMP, 'TRUE' AS tx_succeeded, "
        "'c' AS event_contract, 'e' AS event_type, parse_json('{\"amount\": 1.5}') AS event_data, 1 AS extra"
    )
    out = normalise("core_events", df)
    assert out.columns == [
        "tx_id",
        "block_timestamp",
        "tx_succeeded",
        "event_contract",
        "event_type",
        "event_data",
    ]
    assert out.first()["tx_succeeded"] is True


def test_missing_column_is_reported(spark):
    with pytest.raises(ValueError, match="close"):
        normalise("prices_ohlc", spark.sql("SELECT current_timestamp() AS hour, 'a' AS asset_id"))


def test_actors_may_be_variant(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01' AS block_timestamp, parse_json('[\"a\", \"b\"]') AS actors")
    assert normalise("transaction_actors", df).first()["actors"] == ["a", "b"]


def test_variant_and_text_payloads_agree(spark):
    text = fixtures.load(spark, SF_DIR)
    frames = {name: getattr(text, name) for name in SCHEMAS}
    frames["core_events"] = text.core_events.withColumn("event_data", F.parse_json("event_data"))
    variant = Sources.of(**frames)
    assert bag(fees.core_daily_stats(variant, date(2024, 1, 31))) == bag(
        fees.core_daily_stats(text, date(2024, 1, 31))
    )
    assert bag(report.table("nft_sales_numbers", variant, AS_OF)) == bag(
        report.table("nft_sales_numbers", text, AS_OF)
    )


def test_week_layout_prunes_directories(spark, tmp_path):
    src = fixtures.load(spark, SF_DIR)
    frames = {name: getattr(src, name) for name in SCHEMAS}
    for name in ("core_transactions", "evm_transactions", "core_events", "evm_event_logs"):
        write_by_week(frames[name], f"{tmp_path}/{name}")
        frames[name] = spark.read.parquet(f"{tmp_path}/{name}")
    laid_out = Sources(lambda name: frames[name])
    for build in (transactions.tx_weekly, contracts.contracts_numbers):
        assert bag(build(laid_out, AS_OF)) == bag(build(src, AS_OF))
    plan = transactions.tx_weekly(laid_out, AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*block_week", plan)


def read_csv_folder(path: str) -> list[dict]:
    rows = []
    for part in sorted(Path(path).glob("part-*.csv")):
        with part.open(encoding="utf-8") as handle:
            rows += list(csv.DictReader(handle))
    return rows


def test_csv_has_header_and_no_index(spark, tmp_path):
    df = spark.createDataFrame([(1, "é,x"), (2, None)], "n int, s string").coalesce(1)
    write_csv(df, f"{tmp_path}/out.csv")
    assert read_csv_folder(f"{tmp_path}/out.csv") == [{"n": "1", "s": "é,x"}, {"n": "2", "s": ""}]


def test_export_writes_every_metric(spark, tmp_path):
    src = fixtures.load(spark, SF_DIR)
    paths = report.export(src, AS_OF, str(tmp_path))
    assert [n for n in paths if n in report.NAMES] == report.NAMES and len(set(paths.values())) == 19
    weekly = read_csv_folder(paths["tx_weekly"])
    assert [r["week"] for r in weekly] == ["2024-01-01", "2024-01-08", "2024-01-15", "2024-01-22"]
    assert read_csv_folder(paths["transactions_weekly.csv"]) == weekly
    for name, metric in report.METRICS.items():
        order = metric.order if metric.file_order is None else metric.file_order
        shown = [tuple(r[c.lstrip("-")] for c in order) for r in read_csv_folder(paths[name])]
        table = metric.sorted(metric.build(src.until(AsOf.of(AS_OF)), AsOf.of(AS_OF)), order)
        text = table.select(*[table[c.lstrip("-")].cast("string") for c in order]).collect()
        plain = [tuple(v.replace("T00:", " 00:").replace(".000Z", "").replace("T", " ", v[10:11] == "T") for v in r) for r in shown]
        assert plain == [tuple(v or "" for v in r) for r in text]
    by_region = read_csv_folder(paths["region_active_weekly"])
    assert len(by_region) == regions.region_active_weekly(src).count()


def test_shared_frame_is_cut_and_equal(spark):
    df = regions.user_region(fixtures.load(spark, SF_DIR))
    cut = shared(df)
    assert "Aggregate" in df._jdf.queryExecution().logical().toString()
    assert "Aggregate" not in cut._jdf.queryExecution().logical().toString()
    assert bag(cut) == bag(df)


def test_report_order(make):
    weeks = [datetime(2024, 1, d) for d in (1, 8, 15)]
    src = make(
        core_transactions=[
            {"tx_id": str(i), "block_timestamp": ts, "tx_succeeded": True} for i, ts in enumerate(weeks)
        ]
    )
    assert [r["week"].day for r in rows_of(report.table("tx_weekly", src, "2024-01-31"))] == [15, 8, 1]
    assert [r["week"].day for r in rows_of(report.table("tx_outcome_weekly", src, "2024-01-31"))] == [1, 8, 15]
