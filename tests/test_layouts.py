"""Layouts that spare work: payload fields in columns, tables in buckets, keys of patterns."""

from __future__ import annotations

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from chainmetrics import AsOf, report
from chainmetrics.plans import fees, nft
from chainmetrics.sources.schemas import JOIN_KEYS, SCHEMAS
from chainmetrics.sources.sinks import save_bucketed, shredded, write_parquet
from chainmetrics.sources.tables import Sources

AS_OF = AsOf.of("2024-01-31")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def summed(rows) -> list[tuple]:
    """Rows with sums of doubles to twelve digits, as the order of adding differs between layouts."""
    return [tuple(float(f"{x:.12e}") if isinstance(x, float) else x for x in row) for row in rows]


@pytest.fixture(scope="module")
def stored_fields(spark, stored, tmp_path_factory):
    """The stored tables, the payload fields of events in columns."""
    root = str(tmp_path_factory.mktemp("fields"))
    write_parquet(shredded("core_events", spark.read.parquet(f"{stored}/core_events")), f"{root}/core_events")
    return Sources(lambda name: spark.read.parquet(f"{root if name == 'core_events' else stored}/{name}"))


@pytest.mark.parametrize("name", ["nft_sales_numbers", "nft_sales_weekly", "fee_weekly"])
def test_fields_beside_the_payload_give_equal_metrics(spark, stored, stored_fields, name):
    plain = report.table(name, Sources.from_parquet(spark, stored), AS_OF).collect()
    assert plain and report.table(name, stored_fields, AS_OF).collect() == plain


def test_filter_on_a_field_reaches_the_scan(stored_fields):
    plan = plan_of(nft.storefront_sales(stored_fields, AS_OF.this_week))
    assert "EqualTo(event_data__purchased,true)" in plan
    assert "json" not in plan
    assert "event_data#" not in plan


def test_missing_and_unfit_fields_are_null(spark):
    payloads = ['{"salePrice": "1.5"}', '{"salePrice": "x", "purchased": true}', "no json", "", None]
    df = spark.createDataFrame([(p,) for p in payloads], "event_data string")
    got = shredded("core_events", shredded("core_events", df)).select("event_data__salePrice", "event_data__purchased").collect()
    assert [tuple(r) for r in got] == [(1.5, None), (None, "true"), (None, None), (None, None), (None, None)]


def test_fields_of_a_variant(spark):
    df = spark.sql("""select parse_json('{"salePrice": 2.5, "nftType": "n"}') as event_data""")
    row = shredded("core_events", df).first()
    assert (row["event_data__salePrice"], row["event_data__nftType"], row["event_data__amount"]) == (2.5, "n", None)


def test_a_column_of_another_type_is_not_taken(spark, make):
    src = make(core_events=[{"tx_id": "t", "event_contract": fees.FEE_CONTRACT, "event_type": fees.FEE_EVENT, "event_data": '{"amount": 3}'}])
    odd = Sources.of(core_events=src.core_events.withColumn("event_data__amount", F.lit("7")))
    assert fees._fees_per_tx(odd).first()["amount"] == 3.0


@pytest.fixture(scope="module")
def bucketed(spark, stored):
    names = {name: f"bucketed_{name}" for name in JOIN_KEYS}
    for name, table in names.items():
        save_bucketed(name, spark.read.parquet(f"{stored}/{name}"), table, 4)
    yield Sources(lambda name: spark.table(names[name]) if name in names else spark.read.parquet(f"{stored}/{name}"))
    for table in names.values():
        spark.sql(f"drop table {table}")


@pytest.mark.parametrize("name", ["fee_weekly", "tx_numbers", "contracts_numbers", "contracts_new_weekly", "region_active_weekly"])
def test_buckets_give_equal_metrics(spark, stored, bucketed, name):
    plain = report.table(name, Sources.from_parquet(spark, stored), AS_OF).collect()
    assert plain and summed(report.table(name, bucketed, AS_OF).collect()) == summed(plain)


def test_fee_join_on_buckets_shuffles_no_rows(spark, stored, bucketed):
    """Only the aggregate by day behind the join is shuffled, not the tables on their way into it."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(fees.core_daily_fees(bucketed, AS_OF.this_week))
        plain = plan_of(fees.core_daily_fees(Sources.from_parquet(spark, stored), AS_OF.this_week))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(date" in plan
    assert plain.count("Exchange hashpartitioning") > 1


def test_every_key_table_is_known():
    assert all(f"{key} string" in SCHEMAS[name] for name, key in JOIN_KEYS.items())


def _fitting(spark, currencies, patterns):
    """The metrics of :func:`nft._with_prices` by comparing all with all, for a few rows."""
    c = spark.createDataFrame(currencies, "week date, currency string, rows long, price double")
    p = spark.createDataFrame(patterns, "week date, token_contract string, price_usd double")
    got = {(r.week, r.currency): (r.tokens, r.usd_rows, r.usd) for r in nft._with_prices(c, p).collect()}
    fits = (F.col("c.week") == F.col("p.week")) & F.expr("c.currency ilike p.token_contract")
    want = (
        c.alias("c")
        .join(p.alias("p"), fits, "left")
        .groupBy("c.week", "c.currency")
        .agg(F.count("token_contract").alias("t"), F.count("price_usd").alias("u"), F.coalesce(F.sum("price_usd"), F.lit(0.0)).alias("s"))
    )
    assert got == {(r.week, r.currency): (r.t, r.u, r.s) for r in want.collect()}
    return got


def test_patterns_by_their_literal_parts(spark):
    rnd, weeks = random.Random(5), [date(2024, 1, 1), date(2024, 1, 8), None]
    pieces = ["%", "_", "\\%", "\\_", "\\\\", "a", "B", "ab.", "A.1654653399040a61.", "Flow", "Token", "É", "-", ""]
    names = {"".join(rnd.choice([p.replace("\\", "", 1) for p in pieces]) for _ in range(rnd.randint(0, 5))) for _ in range(60)}
    currencies = [(w, n, 1, 1.0) for w in weeks for n in [*sorted(names), None]]
    tokens = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 5))) for _ in range(150)]
    patterns = [(rnd.choice(weeks), t, rnd.choice([1.0, 2.0, None])) for t in [*tokens, "%", "%%", "_", "", None, "a%", "A%"]]
    got = _fitting(spark, currencies, patterns)
    assert any(tokens for tokens, _, _ in got.values())


def test_patterns_join_on_a_key(spark):
    c = spark.createDataFrame([], "week date, currency string, rows long, price double")
    p = spark.createDataFrame([], "week date, token_contract string, price_usd double")
    plan = nft._with_prices(c, p)._jdf.queryExecution().optimizedPlan().toString()
    assert "key#" in plan and "NestedLoop" not in plan_of(nft._with_prices(c, p))
    assert nft._with_prices(c, p).collect() == []
