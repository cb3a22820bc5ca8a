"""Hand-made rows with known answers; E numbers are those of FIXTURES.md."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chainmetrics import AsOf, report
from chainmetrics.functions.hexwords import hex_word, token_amount
from chainmetrics.functions.numbers import steady_sum
from chainmetrics.functions.timeops import minute_boundaries
from chainmetrics.operators.regions import infer_region
from chainmetrics.plans import contracts, fees, nft, prices, regions, staking, transactions, users
from tests.conftest import one, rows_of

AS_OF = AsOf.of("2024-01-31")
WEEKS = [datetime(2024, 1, day, 12) for day in (1, 8, 15, 22, 29)]


def core_tx(tx_id, ts, ok=True, authorizers=("u",), payer="p", inserted=None):
    return {
        "tx_id": tx_id,
        "block_timestamp": ts,
        "inserted_timestamp": inserted or ts,
        "tx_succeeded": ok,
        "payer": payer,
        "authorizers": None if authorizers is None else list(authorizers),
    }


def evm_tx(tx_hash, ts, **more):
    return {"tx_hash": tx_hash, "block_timestamp": ts, "inserted_timestamp": ts, "tx_succeeded": True, **more}


def by(rows, key):
    return {row[key]: row for row in rows}


def test_e1_gap_week(make):
    src = make(
        core_transactions=[core_tx(f"a{i}", WEEKS[0]) for i in range(10)]
        + [core_tx(f"b{i}", WEEKS[2]) for i in range(4)]
    )
    weekly = by(rows_of(transactions.tx_weekly(src, AS_OF)), "week")
    assert [weekly[w]["cum_transactions"] for w in sorted(weekly)] == [10, 14]
    assert all(r["pcg_diff"] is None and r["transactions_diff"] is None for r in weekly.values())
    kpi = one(transactions.kpi_transactions(src, AS_OF))
    assert (kpi["delta"], kpi["delta_label"], kpi["pcg_diff"]) == (-6, "-6", None)


def test_adjacent_weeks_compare(make):
    src = make(core_transactions=[core_tx("a", WEEKS[0]), core_tx("b", WEEKS[1]), core_tx("c", WEEKS[1])])
    weekly = by(rows_of(transactions.tx_weekly(src, AS_OF)), "week")
    assert weekly[date(2024, 1, 8)]["transactions_diff"] == "2 (1)"
    assert weekly[date(2024, 1, 8)]["pcg_diff"] == 100.0


def test_single_week_kpi_has_no_change(make):
    kpi = one(transactions.kpi_transactions(make(core_transactions=[core_tx("a", WEEKS[0])]), AS_OF))
    assert (kpi["total_transactions"], kpi["delta_label"]) == (1, "+0")


def test_e2_id_in_both_runtimes(make):
    src = make(core_transactions=[core_tx("a", WEEKS[0])], evm_transactions=[evm_tx("a", WEEKS[0])])
    assert one(transactions.tx_numbers(src, AS_OF))["total_transactions"] == 1
    assert one(transactions.tx_outcome_weekly(src, AS_OF))["total_transactions"] == 1
    assert one(transactions.tx_weekly(src, AS_OF))["total_transactions"] == 2


def test_e3_null_outcome_is_failed(make):
    src = make(core_transactions=[core_tx("a", WEEKS[0], ok=None)])
    assert one(transactions.tx_outcome_weekly(src, AS_OF))["type"] == "Failed"


def test_tx_numbers_keeps_two_present_weeks_with_full_totals(make):
    src = make(core_transactions=[core_tx(f"t{i}", ts) for i, ts in enumerate(WEEKS[:3])])
    rows = by(rows_of(transactions.tx_numbers(src, AS_OF)), "week")
    assert {w: r["cum_transactions"] for w, r in rows.items()} == {date(2024, 1, 8): 2, date(2024, 1, 15): 3}


def test_last_data_week_skips_week_in_progress(make):
    src = make(core_transactions=[core_tx("a", WEEKS[1])], evm_transactions=[evm_tx("b", WEEKS[4])])
    assert one(transactions.last_data_week(src, AS_OF))["last_week"] == date(2024, 1, 8)


def test_e4_actors(make):
    src = make(
        transaction_actors=[{"block_timestamp": WEEKS[0], "actors": a} for a in ([], None, ["x", None])]
    )
    assert one(users.users_weekly(src, AS_OF))["active_users"] == 1


def test_users_new_is_null_without_debut_and_per_source(make):
    src = make(
        transaction_actors=[{"block_timestamp": ts, "actors": ["x"]} for ts in WEEKS[:2]],
        evm_transactions=[evm_tx("a", WEEKS[0], from_address="x")],
    )
    weekly = by(rows_of(users.users_weekly(src, AS_OF)), "week")
    first, second = weekly[date(2024, 1, 1)], weekly[date(2024, 1, 8)]
    assert (first["active_users"], first["new_users"]) == (2, 2)
    assert (second["active_users"], second["new_users"]) == (1, None)
    long = rows_of(users.users_weekly_long(src, AS_OF))
    assert {(r["week"], r["metric"], r["value"]) for r in long} == {
        (date(2024, 1, 1), "active_users", 2),
        (date(2024, 1, 1), "new_users", 2),
        (date(2024, 1, 8), "active_users", 1),
        (date(2024, 1, 8), "new_users", None),
    }


def test_users_numbers_labels(make):
    src = make(
        transaction_actors=[
            {"block_timestamp": WEEKS[2], "actors": ["a", "b"]},
            {"block_timestamp": WEEKS[3], "actors": ["a", "b", "c"]},
        ]
    )
    row = one(users.users_numbers(src, AS_OF))
    assert (row["week"], row["unique_users"], row["new_accounts"]) == (date(2024, 1, 22), 3, "3 (1)")
    assert row["pcg_diff"] == 50.0


def test_e20_previous_week_on_every_weekday(make):
    src = make(
        transaction_actors=[
            {"block_timestamp": ts, "actors": [f"u{i}" for i in range(n)]}
            for ts, n in zip(WEEKS[:4], (1, 2, 3, 6), strict=True)
        ],
        nft_sales=[
            {"block_timestamp": ts, "tx_id": f"t{i}", "price": float(p), "tx_succeeded": True}
            for i, (ts, p) in enumerate(zip(WEEKS[:4], (1, 2, 4, 5), strict=True))
        ],
    )
    for weekday in range(7):
        as_of = AsOf.of(date(2024, 1, 29) + timedelta(days=weekday))
        assert as_of.week_before_last == date(2024, 1, 15)
        assert one(users.users_numbers(src, as_of))["pcg_diff"] == 100.0
        assert one(nft.nft_sales_numbers(src, as_of))["pcg_diff_vol"] == 25.0


def test_users_numbers_empty_without_previous_week(make):
    src = make(transaction_actors=[{"block_timestamp": WEEKS[3], "actors": ["a"]}])
    assert rows_of(users.users_numbers(src, AS_OF)) == []


def test_e5_empty_authorizers(make):
    src = make(
        core_transactions=[
            core_tx("a", WEEKS[0], authorizers=[]),
            core_tx("b", WEEKS[0], authorizers=None),
            core_tx("c", WEEKS[0], authorizers=["x"]),
        ]
    )
    assert sum(r["active_accounts"] for r in rows_of(regions.region_active_weekly(src))) == 1
    assert {r["user"] for r in rows_of(regions.user_region(src))} == {None, "x"}


def test_accounts_without_authorizer_still_mark_a_week_as_having_unknowns(make):
    src = make(
        core_transactions=[core_tx("a", WEEKS[0], authorizers=[])]
        + [core_tx(f"x{h}", datetime(2024, 1, 1, h), authorizers=["x"]) for h in range(10, 16)]
    )
    assert rows_of(regions.region_new_weekly(src)) == [
        {"week": date(2024, 1, 1), "region": "Oceania", "accounts_created": 1.0}
    ]


@pytest.mark.parametrize(
    "word", ["0x", "0x0", "0x" + "0" * 64, "0xzz", hex(10**38), None, "0x" + "f" * 64, "0x1 ", "0x-1"]
)
def test_e6_words_without_value(spark, word):
    df = spark.createDataFrame([(word,)], "d string")
    assert df.select(hex_word(F.col("d"))).first()[0] is None


def test_e7_amounts(spark):
    df = spark.createDataFrame([("0xde0b6b3a7640000",), ("0x56bc75e2d63100000",)], "d string")
    assert [r[0] for r in df.select(token_amount(F.col("d"), 18)).collect()] == [1.0, 100.0]


def test_e8_identical_sales_count_once(make):
    sale = {
        "block_timestamp": WEEKS[0],
        "tx_id": "t",
        "buyer": "b",
        "currency": "c",
        "price": 5.0,
        "nft_collection": "n",
        "tx_succeeded": True,
    }
    price = {"hour": WEEKS[0], "price": 2.0, "symbol": "C", "token_address": "C"}
    src = make(nft_sales=[sale, sale, {**sale, "tx_succeeded": None}], prices_hourly=[price])
    row = one(nft.nft_sales_weekly(src, AS_OF))
    assert (row["sales"], row["volume"], row["active_collections"]) == (1, 10.0, 1)


def hour_rows(user, hours, week=1):
    return [
        core_tx(f"{user}-{hour}-{n}", datetime(2024, 1, week, hour), authorizers=[user])
        for hour, times in hours.items()
        for n in range(times)
    ]


def test_e9_unknown_accounts_are_shared_out(make):
    known = [("a", range(10, 16)), ("b", range(10, 16)), ("c", range(10, 16)), ("d", [11, 12, 13, 19, 20, 21])]
    rows = []
    for user, hours in known:
        rows += hour_rows(user, {h: 1 for h in hours})
    labels = {r["user"]: r["region"] for r in rows_of(regions.user_region(make(core_transactions=rows)))}
    assert labels["a"] == "Oceania" and labels["d"] != "Unknown Region"
    for i in range(4):
        rows += hour_rows(f"z{i}", {h: 1 for h in range(6)})
    result = by(rows_of(regions.region_new_weekly(make(core_transactions=rows))), "region")
    assert result["Oceania"]["accounts_created"] == 6.0
    assert sum(r["accounts_created"] for r in result.values()) == 8.0
    without = rows_of(regions.region_new_weekly(make(core_transactions=rows[: 4 * 6])))
    assert len(without) == 2 and all(r["accounts_created"] is None for r in without)


@pytest.mark.parametrize(
    ("hours", "reference", "padded"),
    [
        ([10, 11, 12, 13, 14, 15], "Oceania", None),  # E10
        ([10, 14, 15, 16, 17, 18], "Unknown Region", None),  # E11
        ([8, 9, 10, 16, 17, 18], "Europe Central", "Europe Central"),  # E12
        ([0, 1, 2, 3, 4, 5], "Unknown Region", "Africa"),  # E13
    ],
)
def test_e10_to_e13_labels(make, hours, reference, padded):
    src = make(core_transactions=hour_rows("u", {h: 1 for h in hours}))
    assert one(regions.user_region(src))["region"] == reference
    if padded:
        assert one(regions.user_region(src, "padded"))["region"] == padded


def test_unknown_profile_is_refused(make):
    with pytest.raises(ValueError):
        regions.user_region(make(), "other")


def test_e14_few_active_hours(make):
    src = make(core_transactions=hour_rows("u", {20: 3, 5: 2}))
    row = one(regions.user_top_hours(src))
    assert row["most_active_hours"] == "20,5,0,1,2,3"
    assert row["least_active_hours"] == "0,1,2,3,5,20"
    ranks = {r["hour_of_day"]: (r["transactions"], r["hourly_rank"]) for r in rows_of(regions.user_hour_profile(src))}
    assert (ranks[20], ranks[5], ranks[0], len(ranks)) == ((3, 1), (2, 2), (0, 3), 24)


def test_hours_count_distinct_transactions(make):
    src = make(core_transactions=[core_tx("t", datetime(2024, 1, d, 7), authorizers=["u"]) for d in (1, 2, 3)])
    counts = {r["hour_of_day"]: r["transactions"] for r in rows_of(regions.user_hour_profile(src))}
    assert counts[7] == 1


def test_e15_minute_boundaries(spark):
    df = spark.createDataFrame(
        [
            (datetime(2024, 1, 1, 0, 0, 59), datetime(2024, 1, 1, 0, 1, 0)),
            (datetime(2024, 1, 1, 0, 5, 10), datetime(2024, 1, 1, 0, 0, 50)),
        ],
        "a timestamp_ntz, b timestamp_ntz",
    )
    assert [r[0] for r in df.select(minute_boundaries("a", "b")).collect()] == [1, -5]


def move(ts, action, amount, delegator="d", tx_id="t"):
    return {"block_timestamp": ts, "tx_id": tx_id, "delegator": delegator, "amount": amount, "action": action}


def test_e16_week_with_stakes_only(make):
    src = make(
        staking_actions=[
            move(WEEKS[0], "TokensCommitted", 10.0),
            move(WEEKS[1], "DelegatorTokensCommitted", 5.0),
            move(WEEKS[1], "UnstakedTokensWithdrawn", 2.0),
            move(WEEKS[1], "SomethingElse", 99.0),
        ]
    )
    row = one(staking.staking_weekly(src, AS_OF))
    assert row["date"] == date(2024, 1, 8)
    assert (row["staked_volume"], row["total_staked_volume"], row["net_staked_volume"]) == (5.0, 15.0, 3.0)
    assert row["total_net_staked_volume"] == 15.0 - 2.0 + 2.4e8
    assert len(row) == 17


def test_stakers_summary_counts(make):
    src = make(
        staking_actions=[
            move(datetime(2024, 1, 10), "TokensCommitted", 1.0, "a"),
            move(datetime(2024, 1, 30), "TokensCommitted", 1.0, "a"),
            move(datetime(2024, 1, 24), "TokensCommitted", 1.0, "b"),
            move(datetime(2024, 1, 10), "UnstakedTokensWithdrawn", 1.0, "c"),
            move(datetime(2024, 1, 10), "TokensCommitted", 1.0, None),
        ]
    )
    row = one(staking.stakers_summary(src, AS_OF))
    assert (row["unique_stakers"], row["unique_stakers_past_week"], row["users_diff"]) == (2, 1, 1)
    assert (row["unique_stakers_diff"], row["pcg_diff"]) == ("2 (+1)", 100.0)


def test_stakers_summary_without_past(make):
    src = make(staking_actions=[move(datetime(2024, 1, 30), "TokensCommitted", 1.0)])
    row = one(staking.stakers_summary(src, AS_OF))
    assert (row["unique_stakers"], row["pcg_diff"]) == (1, None)


def test_net_positions_ignore_unstakers_and_null_matches(make):
    src = make(
        staking_actions=[
            move(WEEKS[0], "TokensCommitted", 10.0, "a"),
            move(WEEKS[0], "UnstakedTokensWithdrawn", 4.0, "a"),
            move(WEEKS[0], "UnstakedTokensWithdrawn", 4.0, "b"),
            move(WEEKS[0], "TokensCommitted", 3.0, None),
            move(WEEKS[0], "UnstakedTokensWithdrawn", 1.0, None),
        ]
    )
    net = {r["delegator"]: r["total_net_staked_volume"] for r in rows_of(staking.staker_net_positions(src))}
    assert net == {"a": 6.0, None: 3.0}


def test_e17_hourly_price(make):
    hour0, hour1 = datetime(2024, 1, 30, 5), datetime(2024, 1, 30, 9)
    rows = [(hour0, 0.2), (hour1, 0.1), (hour1, 0.3), (hour1, 0.7)]
    src = make(prices_hourly=[{"hour": h, "price": p, "symbol": "stFlow", "token_address": "x"} for h, p in rows])
    result = by(rows_of(prices.price_hourly_week(src, AS_OF)), "recorded_hour")
    assert (result[hour0]["flow_price_change_percentage"], result[hour0]["flow_price_volatility"]) == (None, 0.0)
    assert result[hour1]["flow_price_change_percentage"] == pytest.approx(50.0)
    assert result[hour1]["flow_price_volatility"] == pytest.approx(0.1)


def test_e18_token_without_last_day(make):
    src = make(
        prices_ohlc=[
            {"hour": datetime(2024, 1, 25), "asset_id": "old", "close": 5.0},
            {"hour": datetime(2024, 1, 25), "asset_id": "b", "close": 4.0},
            {"hour": datetime(2024, 1, 30, 12), "asset_id": "b", "close": 2.0},
            {"hour": datetime(2024, 1, 30, 12), "asset_id": None, "close": 2.0},
            {"hour": datetime(2024, 1, 31, 1), "asset_id": "late", "close": 2.0},
        ]
    )
    rows = rows_of(prices.token_movers_top50(src, AS_OF))
    assert [(r["token"], r["avg_deviation_weekly_pct"]) for r in rows] == [("old", None), ("b", pytest.approx(1 / 3))]
    ordered = rows_of(report.table("token_movers", src, AS_OF))
    assert [r["token"] for r in ordered] == ["old", "b"]


def test_e19_fee_times_price(make):
    src = make(
        evm_transactions=[
            evm_tx("a", datetime(2024, 1, 1, 3), tx_fee=1.0),
            evm_tx("b", datetime(2024, 1, 2, 3), tx_fee=3.0),
            evm_tx("c", datetime(2024, 1, 9, 3), tx_fee=9.0),
        ],
        prices_hourly=[
            {"hour": datetime(2024, 1, 3, h), "price": p, "symbol": "FLOW", "token_address": "x"}
            for h, p in ((1, 2.0), (2, 4.0))
        ],
    )
    assert one(fees.fee_weekly(src, AS_OF)) == {
        "week": date(2024, 1, 1),
        "avg_tx_fee_flow": 2.0,
        "avg_tx_fee_usd": 6.0,
    }
    assert one(fees.kpi_fees(src, AS_OF))["avg_tx_fee_usd"] == 6.0


def test_core_daily_stats_fan_out(make):
    day = datetime(2024, 1, 1, 3)
    event = {
        "tx_id": "t",
        "block_timestamp": day,
        "event_contract": "A.f919ee77447b7497.FlowFees",
        "event_type": "FeesDeducted",
    }
    src = make(
        core_transactions=[
            core_tx("t", day, payer="p", inserted=day + timedelta(minutes=2)),
            core_tx("t", day, ok=False, payer="q", inserted=day),
            core_tx("no event", day),
        ],
        core_events=[
            {**event, "event_data": '{"amount": 1.0}'},
            {**event, "event_data": '{"amount": 2.0}'},
            {**event, "event_data": '{"amount": "x"}'},
        ],
    )
    row = one(fees.core_daily_stats(src, date(2024, 1, 31)))
    assert (row["total_transactions"], row["successful_transactions"], row["unique_users"]) == (1, 3, 2)
    assert (row["fees"], row["avg_tx_fee"], row["latency_minutes"]) == (6.0, 1.5, -1.0)


def log(tx_hash, ts, contract="0xc", topics=("0xother",), **more):
    return {
        "tx_hash": tx_hash,
        "block_timestamp": ts,
        "tx_succeeded": True,
        "contract_address": contract,
        "topics": list(topics),
        **more,
    }


OWNED = (contracts.OWNERSHIP_TOPIC.upper().replace("0X", "0x"),)


def test_e21_contract_numbers(make):
    logs = [log("t", WEEKS[3], f"0x{i}") for i in range(6)] + [log("t", WEEKS[2], f"0x{i}") for i in range(4)]
    row = one(contracts.contracts_numbers(make(evm_event_logs=logs), AS_OF))
    assert (row["active_contracts"], row["previous_week_active_contracts"], row["pct_diff"]) == (6, 4, 50.0)
    assert rows_of(contracts.contracts_numbers(make(evm_event_logs=logs[6:]), AS_OF)) == []
    assert one(contracts.contracts_numbers(make(evm_event_logs=logs[:6]), AS_OF))["pct_diff"] == 0.0


def test_contract_numbers_floor(make):
    logs = [log("t", datetime(2023, 12, 20), "0x1")]
    assert rows_of(contracts.contracts_numbers(make(evm_event_logs=logs), AsOf.of("2023-12-27"))) == []


def test_contract_numbers_count_ids_once_over_sources(make):
    src = make(
        core_events=[
            {"tx_id": "t", "block_timestamp": ts, "tx_succeeded": True, "event_contract": name}
            for ts, name in ((WEEKS[3], "same"), (WEEKS[2], "old"), (WEEKS[3], "old"))
        ],
        evm_transactions=[evm_tx("x", WEEKS[3], from_address="c")],
        evm_event_logs=[log("x", WEEKS[3], "same", OWNED)],
    )
    row = one(contracts.contracts_numbers(src, AS_OF))
    assert (row["total_contracts"], row["new_contracts"], row["previous_week_new_contracts"]) == (2, 1, 1)
    assert row["active_contracts"] == 3


def test_e22_creation_with_ownership_log(make):
    src = make(
        evm_transactions=[
            evm_tx("x", WEEKS[0], from_address="c", origin_function_signature="0x60806040"),
            evm_tx("y", WEEKS[0], from_address="c", origin_function_signature="0x60c06040"),
            evm_tx(None, WEEKS[0], from_address="c", origin_function_signature="0x60c06040"),
            evm_tx("z", WEEKS[0], from_address="c", origin_function_signature="0xother"),
        ],
        evm_event_logs=[log("x", WEEKS[0], "0xnew", OWNED)],
    )
    assert {r["contract"] for r in rows_of(contracts.contract_debuts(src))} == {"0xnew", "y"}


def test_e23_currency_match_and_null_currency(make):
    sale = {"block_timestamp": WEEKS[0], "tx_succeeded": True, "price": 3.0}
    src = make(
        nft_sales=[{**sale, "tx_id": "a", "currency": "A.X"}, {**sale, "tx_id": "b", "currency": None}],
        prices_hourly=[{"hour": WEEKS[0], "price": 2.0, "symbol": "X", "token_address": "a.x"}],
    )
    row = one(nft.nft_sales_weekly(src, AS_OF))
    assert (row["sales"], row["volume"]) == (2, 12.0)


def test_currency_fits_several_patterns(make):
    sale = {"block_timestamp": WEEKS[0], "tx_succeeded": True, "price": 3.0, "tx_id": "a", "currency": "A.XY"}
    tokens = [("a.xy", 2.0), ("A.X_", 4.0), ("%y", 9.0), ("a.%z", 50.0)]
    src = make(
        nft_sales=[sale],
        prices_hourly=[{"hour": WEEKS[0], "price": p, "symbol": "X", "token_address": t} for t, p in tokens],
    )
    assert one(nft.nft_sales_weekly(src, AS_OF))["volume"] == 3 * 3.0 * 5.0


def test_week_without_matching_price(make):
    sale = {"block_timestamp": WEEKS[0], "tx_succeeded": True, "price": 3.0, "tx_id": "a", "currency": "A"}
    row = one(nft.nft_sales_weekly(make(nft_sales=[sale]), AS_OF))
    assert (row["sales"], row["volume"], row["total_volume"]) == (1, None, None)


def test_e24_origin_classes(make):
    creators = ["0x0000000000000000000000020000000000000000abc", None, "0xabc"]
    src = make(
        evm_transactions=[
            evm_tx(f"t{i}", WEEKS[0], from_address=c, origin_function_signature="0x60806040")
            for i, c in enumerate(creators)
        ]
    )
    result = by(rows_of(contracts.contracts_new_weekly(src, AS_OF)), "source")
    assert result["COA EVM Contract"]["new_contracts"] == 1
    assert result["Non-COA EVM Contract"]["new_contracts"] == 2


def test_e25_two_creators(make):
    src = make(
        evm_transactions=[evm_tx("x", WEEKS[0], from_address="c"), evm_tx("y", WEEKS[1], from_address="d")],
        evm_event_logs=[log("x", WEEKS[0], "0xnew", OWNED), log("y", WEEKS[1], "0xnew", OWNED)],
    )
    rows = rows_of(contracts.contracts_new_weekly(src, AS_OF))
    assert sorted((r["date"], r["new_contracts"], r["unique_contracts"]) for r in rows) == [
        (date(2024, 1, 1), 1, 1),
        (date(2024, 1, 8), 1, 2),
    ]


def test_floors_bind_evm_activity_only(make):
    old = datetime(2019, 12, 31, 5)
    src = make(
        core_events=[{"tx_id": "t", "block_timestamp": old, "tx_succeeded": True, "event_contract": "c"}],
        evm_event_logs=[log("t", old), log("t", datetime(2020, 1, 2)), log("t", datetime(2020, 1, 6))],
    )
    weekly = {r["date"]: r["active_contracts"] for r in rows_of(contracts.contracts_active_weekly(src, AS_OF))}
    assert weekly == {date(2019, 12, 30): 1, date(2020, 1, 6): 1}


def test_seaport_price_falls_back_to_every_logged_transfer(make):
    call = {"to_address": nft.SEAPORT_ADDRESS, "from_address": "b"}
    transfer = dict(contract=nft.WRAPPED_TOKEN_CONTRACT, topics=(nft.TRANSFER_TOPIC,))
    src = make(
        evm_transactions=[
            evm_tx("paid", WEEKS[0], value=7.0, **call),
            evm_tx("zero", WEEKS[0], value=0.0, **call),
            evm_tx("none", WEEKS[0], value=None, **call),
            evm_tx("lost", WEEKS[0], value=0.0, **call),
        ],
        evm_event_logs=[
            log("paid", WEEKS[0], data=hex(10**18), **transfer),
            log("zero", WEEKS[0], data=hex(2 * 10**18), **transfer),
            log("zero", WEEKS[0], data=hex(3 * 10**18), **transfer),
            log("none", WEEKS[0], data="0x0", **transfer),
            log("none", WEEKS[0], data=hex(10**18), **transfer),
        ],
    )
    got = sorted((r["tx_id"], r["price"]) for r in rows_of(nft.seaport_sales(src, AS_OF.this_week)))
    assert got == [("none", 1.0), ("paid", 7.0), ("zero", 2.0), ("zero", 3.0)]


def test_log_pair_price_comes_from_approvals(make):
    sale = dict(
        contract=nft.LOG_SALE_CONTRACT,
        data="0x",
        event_index=12,
        origin_from_address="seller",
        origin_function_signature="0x09c56431",
    )
    src = make(
        evm_event_logs=[
            log("a", WEEKS[0], topics=("0xother", None, "buyer"), **sale),
            log("a", WEEKS[0], topics=(nft.APPROVAL_TOPIC,), data=hex(25 * 10**5)),
            log("a", WEEKS[0], topics=(nft.APPROVAL_TOPIC,), data="0x"),
            log("b", WEEKS[0], topics=("0xother", None, "buyer"), **sale),
        ]
    )
    rows = rows_of(nft.log_pair_sales(src, AS_OF.this_week))
    assert sorted((r["tx_id"], r["buyer"], r["price"] or 0.0, r["nft_collection"]) for r in rows) == [
        ("a", "buyer", 0.0, "seller"),
        ("a", "buyer", 2.5, "seller"),
    ]


def test_infer_region_keeps_one_row_per_user(spark):
    profile = spark.createDataFrame([("u", datetime(2024, 1, 1))], "user string, first_ts timestamp_ntz").withColumns(
        {f"h{h}": F.lit(1 if 10 <= h < 16 else 0).cast("bigint") for h in range(24)}
    )
    row = one(infer_region(profile))
    assert row["top_hours"] == [10, 11, 12, 13, 14, 15] and row["region"] == "Oceania"


def test_sum_of_doubles_without_regard_to_order(spark):
    rows = [("a", x) for x in (0.1, 0.2, 0.3, 1e16, -1e16, None)] + [("b", None), ("c", float("inf")), ("c", 1.0), ("d", 1e30), ("d", 2.0)]
    for mixed in (rows, rows[::-1], sorted(rows, key=str)):
        df = spark.createDataFrame(mixed, "k string, x double").coalesce(1)
        got = dict(df.groupBy("k").agg(steady_sum(F.col("x"))).collect())
        assert got == {"a": 0.6, "b": None, "c": float("inf"), "d": 1e30}
    df = spark.createDataFrame([("e", float("nan")), ("e", 1.0)], "k string, x double")
    assert df.groupBy("k").agg(F.isnan(steady_sum(F.col("x")))).first()[1]
