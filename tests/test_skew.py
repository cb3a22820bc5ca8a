"""One key holding a third of all rows: same answers as literal joins, no blow-up."""

from __future__ import annotations

import json
import random
from collections import defaultdict
from datetime import date, datetime, timedelta

import pytest

from chainmetrics import AsOf
from chainmetrics.plans import contracts, fees, nft, regions, users
from tests.conftest import rows_of

AS_OF = AsOf.of("2024-01-31")
N = 1500


def hot(rng, i, prefix="t"):
    return "hot" if i % 3 == 0 else f"{prefix}{rng.randint(0, 300)}"


def at(rng):
    return datetime(2024, 1, 1) + timedelta(minutes=rng.randint(0, 27 * 24 * 60))


@pytest.fixture(scope="module")
def data():
    rng = random.Random(11)
    tx = [
        {
            "tx_id": hot(rng, i),
            "block_timestamp": at(rng),
            "inserted_timestamp": at(rng),
            "tx_succeeded": rng.random() < 0.8,
            "payer": f"p{rng.randint(0, 9)}",
            "authorizers": [f"a{rng.randint(0, 5)}"],
        }
        for i in range(N)
    ]
    events = []
    for i in range(N):
        fee = rng.random() < 0.5
        events.append(
            {
                "tx_id": hot(rng, i),
                "block_timestamp": at(rng),
                "tx_succeeded": True,
                "event_contract": fees.FEE_CONTRACT if fee else nft.STOREFRONT_CONTRACT,
                "event_type": fees.FEE_EVENT if fee else nft.STOREFRONT_EVENT,
                "event_data": json.dumps(
                    {
                        "amount": rng.randint(1, 9),
                        "salePrice": rng.randint(1, 3),
                        "nftType": f"n{rng.randint(0, 2)}",
                        "salePaymentVaultType": "c",
                        "purchased": rng.random() < 0.7,
                    }
                ),
            }
        )
    evm = [
        {
            "tx_hash": hot(rng, i, "x"),
            "block_timestamp": at(rng),
            "from_address": hot(rng, i, "c"),
            "origin_function_signature": rng.choice(["0x60806040", "0xother"]),
        }
        for i in range(N)
    ]
    logs = [
        {
            "tx_hash": hot(rng, i, "x"),
            "block_timestamp": at(rng),
            "contract_address": f"k{rng.randint(0, 50)}",
            "topics": [contracts.OWNERSHIP_TOPIC if rng.random() < 0.1 else "0xother"],
        }
        for i in range(N)
    ]
    actors = [{"block_timestamp": at(rng), "actors": [hot(rng, i, "u"), "also hot"]} for i in range(N)]
    return {
        "core_transactions": tx,
        "core_events": events,
        "evm_transactions": evm,
        "evm_event_logs": logs,
        "transaction_actors": actors,
    }


def monday(ts):
    return (ts - timedelta(days=ts.weekday())).date()


def test_fee_pairs(make, data):
    days = defaultdict(lambda: {"n": 0, "sum": 0.0, "ok": 0, "tx": set(), "payers": set()})
    by_tx = defaultdict(list)
    for e in data["core_events"]:
        if e["event_type"] == fees.FEE_EVENT:
            by_tx[e["tx_id"]].append(json.loads(e["event_data"])["amount"])
    for t in data["core_transactions"]:
        for amount in by_tx[t["tx_id"]]:
            day = days[t["block_timestamp"].date()]
            day["n"] += 1
            day["sum"] += amount
            day["ok"] += t["tx_succeeded"]
            day["tx"].add(t["tx_id"])
            day["payers"].add(t["payer"])
    got = rows_of(fees.core_daily_stats(make(**data), date(2024, 1, 31)))
    assert len(got) == len(days)
    for row in got:
        want = days[row["date"]]
        assert row["fees"] == want["sum"]
        assert row["avg_tx_fee"] == pytest.approx(want["sum"] / want["n"])
        assert row["successful_transactions"] == want["ok"]
        assert (row["total_transactions"], row["unique_users"]) == (len(want["tx"]), len(want["payers"]))


def test_storefront_pairs(make, data):
    buyers = defaultdict(set)
    for t in data["core_transactions"]:
        buyers[t["tx_id"]].add(t["authorizers"][0])
    want = set()
    for e in data["core_events"]:
        body = json.loads(e["event_data"])
        if e["event_type"] == nft.STOREFRONT_EVENT and body["purchased"]:
            for buyer in buyers[e["tx_id"]]:
                week = monday(e["block_timestamp"])
                want.add((week, e["tx_id"], buyer, "c", float(body["salePrice"]), body["nftType"]))
    got = nft.storefront_sales(make(**data), AS_OF.this_week).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_creations(make, data):
    owned = defaultdict(set)
    for entry in data["evm_event_logs"]:
        if entry["topics"][0] == contracts.OWNERSHIP_TOPIC:
            owned[entry["tx_hash"]].add(entry["contract_address"])
    want = {}
    for t in data["evm_transactions"]:
        names = owned.get(t["tx_hash"])
        if names is None and t["origin_function_signature"] == "0x60806040":
            names = {t["tx_hash"]}
        for name in names or ():
            key = (name, t["from_address"])
            want[key] = min(want.get(key, date.max), monday(t["block_timestamp"]))
    got = rows_of(contracts.contract_debuts(make(**{**data, "core_events": []})))
    assert {(r["contract"], r["creator"]): r["debut"] for r in got} == want


def test_hot_user(make, data):
    active, first = defaultdict(set), {}
    for a in data["transaction_actors"]:
        for user in a["actors"]:
            week = monday(a["block_timestamp"])
            active[week].add(("core", user))
            first[("core", user)] = min(first.get(("core", user), date.max), week)
    for t in data["evm_transactions"]:
        key, week = ("evm", t["from_address"]), monday(t["block_timestamp"])
        active[week].add(key)
        first[key] = min(first.get(key, date.max), week)
    got = rows_of(users.users_weekly(make(**data), AS_OF))
    assert {r["week"]: r["active_users"] for r in got} == {w: len(s) for w, s in active.items()}
    assert {r["week"]: r["new_users"] or 0 for r in got} == {
        w: sum(f == w for f in first.values()) for w in active
    }


def test_active_accounts_meet_regions_once_per_week(make, data):
    src = make(**data)
    labels = {r["user"]: r["region"] for r in rows_of(regions.user_region(src))}
    seen = {(monday(t["block_timestamp"]), t["authorizers"][0]) for t in data["core_transactions"]}
    got = rows_of(regions.region_active_weekly(src))
    assert sum(r["active_accounts"] for r in got) == len(seen)
    assert set(labels) == {user for _, user in seen}


def test_new_contracts_by_class_equal_the_pairs(make, data):
    src = make(**data)
    pairs = contracts.contract_debuts(src, AS_OF.this_week).collect()
    want = defaultdict(set)
    for r in pairs:
        if r.debut >= date(2020, 1, 6):
            want[r.debut, r.source].add(r.contract)
    got = {(r.date, r.source): r.new_contracts for r in contracts.contracts_new_weekly(src, AS_OF).collect()}
    assert got == {key: len(found - {None}) for key, found in want.items()}
    assert len({source for _, source in got}) > 1
