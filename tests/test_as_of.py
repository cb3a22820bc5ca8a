"""Nothing later than the report's moment counts; ties to it: labels, medians, orders."""

from __future__ import annotations

import math
import re
import statistics
from collections import defaultdict
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from chainmetrics import AsOf, Sources, report
from chainmetrics.functions.numbers import amount_change_label
from chainmetrics.operators.median import exact_median
from chainmetrics.plans import nft
from chainmetrics.sources.schemas import SCHEMAS, TIMES
from parity.check import as_bag
from tests.test_random_tables import random_tables

DAYS = {
    "staking_weekly": ("1996-01-08T09:30:00",),
    "stakers_summary": ("1996-01-08T09:30:00",),
}
OTHERS = ("2024-01-17T13:15:00",)


@pytest.fixture(scope="module")
def tables(spark):
    frames = {}
    for name, rows in random_tables(7).items():
        ddl = SCHEMAS[name].replace(" timestamp", " timestamp_ntz")
        columns = [part.split()[0] for part in ddl.split(",")]
        frames[name] = spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], ddl)
    return frames


def bag(df):
    """Rows with floats to ten digits: sums depend on the order of rows in their last ones."""
    rows = [[float(f"{v:.10g}") if isinstance(v, float) else v for v in r] for r in df.collect()]
    return as_bag(df.columns, rows)


@pytest.mark.parametrize("name", report.NAMES)
def test_later_rows_do_not_count(tables, name):
    for day in DAYS.get(name, OTHERS):
        as_of = AsOf.of(day)
        cut = {t: df.where(F.col(TIMES[t]) <= F.lit(as_of.moment.isoformat(" "))) for t, df in tables.items()}
        whole = report.table(name, Sources.of(**tables), as_of)
        past = report.table(name, Sources.of(**cut), as_of)
        assert bag(whole) == bag(past)


def test_rows_without_a_time_stay(make):
    src = make(core_transactions=[{"tx_id": "a"}, {"tx_id": "b", "block_timestamp": datetime(2024, 2, 1)}])
    assert [r.tx_id for r in src.until(AsOf.of("2024-01-31")).core_transactions.collect()] == ["a"]


def test_amounts_keep_their_digits(spark, make):
    sales = [
        {"block_timestamp": datetime(2024, 1, d), "tx_id": f"t{d}", "price": p, "tx_succeeded": True, "currency": "c"}
        for d, p in ((16, 0.001), (23, 0.004))
    ]
    row = report.table("nft_sales_numbers", make(nft_sales=sales), "2024-01-31").collect()[0]
    assert (row.volume, row.vol_diff) == (0.004, "0.004 (0.003)")
    big = spark.createDataFrame([(123456789.0, 100.0)], "a double, b double")
    label = big.select(amount_change_label(F.col("a"), F.col("b")).alias("x")).collect()[0].x
    assert label == "123456789 (123456689)"


INF, NAN = float("inf"), float("nan")


def test_median_of_odd_values(spark):
    groups = {
        "inf": [INF] * 3,
        "mixed": [-INF, -INF, 2.0, 5.0, INF],
        "nan": [1.0, NAN, NAN, NAN],
        "equal": [7.0] * 50,
        "two": [1.0, 4.0],
        "one": [3.0],
        "both": [-INF, -INF, INF],
        "long": [float(i % 977) for i in range(5000)],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("none", None), (None, 2.0)]
    df = spark.createDataFrame(rows, "key string, value double").repartition(4)
    got = {r.key: r.m for r in exact_median(df, ["key"], "value", "m").collect()}
    assert math.isnan(got.pop("nan"))
    assert got.pop(None) == 2.0
    assert got == {k: statistics.median(v) for k, v in groups.items() if k != "nan"}


def test_median_shuffles_no_value_outside_its_bounds(spark):
    df = spark.range(20_000).select((F.col("id") % 3).alias("key"), F.col("id").cast("double").alias("value"))
    plan = exact_median(df, ["key"], "value", "m")._jdf.queryExecution().executedPlan().toString()
    moved = [below for _, below in re.findall(r"Exchange hashpartitioning(.*)\n(.*)", plan)]
    ranked = [below for below in moved if "percentile_approx" not in below]
    assert len(moved) == len(ranked) + 1 and ranked
    assert all("HashAggregate(keys=[key" in below and "_side" in below for below in ranked)


@pytest.mark.parametrize("largest", [0, 1, 3])
def test_median_of_groups_without_bounds(spark, largest):
    """Groups beyond the largest are ranked as they are."""
    df = spark.range(3_000).select((F.col("id") % 7 * F.col("id") % 5).alias("key"), (F.col("id") * 7919 % 1009).cast("double").alias("value"))
    want = defaultdict(list)
    for r in df.collect():
        want[r.key].append(r.value)
    got = {r.key: r.m for r in exact_median(df, ["key"], "value", "m", largest).collect()}
    assert got == {k: statistics.median(v) for k, v in want.items()}


def test_building_a_median_starts_no_job(spark, make):
    context = spark.sparkContext
    context.setJobGroup("median", "built only")
    try:
        report.table("staking_weekly", make(), "2024-01-31")
        exact_median(spark.range(9).selectExpr("id % 2 AS key", "id AS value"), ["key"], "value", "m")
        assert not context.statusTracker().getJobIdsForGroup("median")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_topic_reaches_the_scan(spark, stored):
    src = Sources.from_parquet(spark, stored)
    plan = nft.log_pair_sales(src, AsOf.of("2024-01-31").this_week)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(topic_0,", plan)
