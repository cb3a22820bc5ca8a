"""All queries on random canonical tables with missing values in most columns.

The tables replace the mapped ones, so every metric meets NULL ids, names,
prices and outcomes, and the SQL bodies run on the same rows.
"""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import duckdb
import pytest

import __spark_entry__ as registry
from chainmetrics.plans import contracts, fees, nft, staking
from chainmetrics.sources.schemas import SCHEMAS
from chainmetrics.sources.tables import Sources
from parity.check import as_bag
from parity.oracles import ORACLES

ROWS = 400


def random_tables(seed: int) -> dict[str, list[dict]]:
    rng = random.Random(seed)

    def some(values, gap=0.08):
        return None if rng.random() < gap else rng.choice(values)

    def ts(start=datetime(2023, 12, 18), days=44):
        return start + timedelta(seconds=rng.randint(0, days * 86400))

    ids = [f"t{i}" for i in range(80)]
    users = [f"u{i}" for i in range(12)] + [contracts.COA_PREFIX + "a", contracts.COA_PREFIX + "b"]
    names = [f"k{i}" for i in range(9)]
    cents = [i / 100 for i in range(0, 5000, 7)]
    flags = [True, True, False]
    words = ["0x", "0x0", "0xzz", "0x00de0b6b3a7640000", "0xF4240", "0x" + "f" * 40, "0x1" + "0" * 20]
    currencies = ["A.X", "a.x", "B.Y", nft.NATIVE_TOKEN, nft.FIAT_TOKEN]
    topics = ["0xother", contracts.OWNERSHIP_TOPIC, nft.APPROVAL_TOPIC, nft.TRANSFER_TOPIC]

    def payload():
        parts = [f'"nftType":"{rng.choice(names)}"', f'"salePaymentVaultType":"{rng.choice(currencies)}"']
        parts += rng.choice([[], [f'"amount":{rng.choice(cents)}']])
        parts += rng.choice([[], [f'"salePrice":{rng.choice(cents)}']])
        parts += rng.choice([[], ['"purchased":true'], ['"purchased":"true"'], ['"purchased":false']])
        return "{" + ",".join(parts) + "}"

    def row(table):
        if table == "core_transactions":
            at = ts()
            return {
                "tx_id": some(ids),
                "block_timestamp": at,
                "inserted_timestamp": some([at + timedelta(seconds=s) for s in (0, 59, 3600)]),
                "tx_succeeded": some(flags),
                "payer": some(users),
                "authorizers": some([[], [rng.choice(users)], [None], [rng.choice(users), "z"]]),
            }
        if table == "evm_transactions":
            at = ts()
            return {
                "tx_hash": rng.choice(ids),
                "block_timestamp": at,
                "inserted_timestamp": some([at + timedelta(seconds=s) for s in (0, 59, 3600)]),
                "tx_succeeded": some(flags),
                "tx_fee": some(cents),
                "value": some([0.0, *cents[:20]], 0.3),
                "from_address": some(users),
                "to_address": some([nft.SEAPORT_ADDRESS, nft.ROUTER_ADDRESS.upper().replace("0X", "0x"), "0xo"]),
                "origin_function_signature": some(["0x60806040", "0x60c06040", "0xe7acab24", "0xother"]),
            }
        if table == "core_events":
            kind = rng.choice([(fees.FEE_CONTRACT, fees.FEE_EVENT), (nft.STOREFRONT_CONTRACT, nft.STOREFRONT_EVENT)])
            return {
                "tx_id": some(ids),
                "block_timestamp": ts(),
                "tx_succeeded": some(flags),
                "event_contract": some([kind[0], kind[0], rng.choice(names)]),
                "event_type": some([kind[1], kind[1], "other"]),
                "event_data": payload(),
            }
        if table == "evm_event_logs":
            return {
                "tx_hash": rng.choice(ids),
                "block_timestamp": ts(),
                "tx_succeeded": some(flags),
                "contract_address": some([nft.LOG_SALE_CONTRACT, nft.WRAPPED_TOKEN_CONTRACT, *names[:3]]),
                "data": some(["0x"] * 5 + words),
                "event_index": some([12, 12, 3]),
                "topics": some([[], [rng.choice(topics)], [rng.choice(topics), None, rng.choice(users)]]),
                "origin_from_address": some(users),
                "origin_to_address": some([nft.ROUTER_ADDRESS, "0xo"]),
                "origin_function_signature": some(["0x052eb226", "0x09c56431", "0xe7acab24", "0x87201b41"]),
            }
        if table == "transaction_actors":
            return {"block_timestamp": ts(), "actors": some([[], [rng.choice(users)], [None, rng.choice(users)]])}
        if table == "staking_actions":
            return {
                "block_timestamp": ts(datetime(1995, 9, 1), 150),
                "tx_id": some(ids),
                "delegator": some(users),
                "amount": some(cents),
                "action": some([*staking.STAKE_ACTIONS, *staking.UNSTAKE_ACTIONS, "other"]),
            }
        if table == "nft_sales":
            return {
                "block_timestamp": ts(),
                "tx_id": some(ids),
                "buyer": some(users),
                "currency": some(currencies),
                "price": some(cents[:9]),
                "nft_collection": some(names),
                "tx_succeeded": some(flags),
            }
        hour = ts(datetime(2023, 12, 18), 46).replace(minute=0, second=0)
        if table == "prices_hourly":
            return {
                "hour": hour,
                "price": some([c / 137 for c in cents]),
                "symbol": some(["FLOW", "stFlow", "USDC"]),
                "token_address": some(["a.X", "B.y", "a.%", "_.Y", nft.NATIVE_TOKEN, nft.FIAT_TOKEN.upper()]),
            }
        return {"hour": hour, "asset_id": some(names), "close": some(cents[1:])}

    return {table: [row(table) for _ in range(ROWS)] for table in SCHEMAS}


@pytest.fixture(scope="module", params=[1, 2])
def world(request, spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp(f"random{request.param}"))
    con = duckdb.connect()
    for name, rows in random_tables(request.param).items():
        ddl = SCHEMAS[name].replace(" timestamp", " timestamp_ntz")
        columns = [part.split()[0] for part in ddl.split(",")]
        spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], ddl).write.parquet(f"{root}/{name}")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{root}/{name}/*.parquet'")
    return Sources.from_parquet(spark, root), con


@pytest.mark.parametrize("name", list(ORACLES))
def test_random_tables(spark, world, monkeypatch, name):
    src, con = world
    monkeypatch.setattr(registry.fixtures, "load", lambda session, sf_dir: src)
    df = registry.queries()[name](spark, "")
    ours = as_bag(df.columns, df.collect())
    result = con.execute(ORACLES[name].body)
    theirs = as_bag([d[0] for d in result.description], result.fetchall())
    assert (ours - theirs, theirs - ours) == ({}, {})
