"""Canonical tables derived from the generated star-schema test tables.

Every derived row comes from exactly one row of a whole source table; nothing is
filtered out. Expressions are kept as SQL text so that the independent check can
build the same tables in another engine; fragments in braces are the few places
where the dialects differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chainmetrics.sources.tables import Sources

EVENTS_AS_OF = "2024-01-31"
ORDERS_AS_OF = "2001-08-01"
STAKERS_AS_OF = "1996-01-03"

# An odd user takes a new identity every eight days.
_USER = (
    "case when user_id%2=0 then concat('u',user_id) "
    "else concat('u',user_id,'_',cast(floor(day(ts)/8) as bigint)) end"
)
_BLOCK = "cast(floor(event_id/4) as bigint)"
# Two fifths of the users share their transaction ids between the two runtimes.
_HASH = f"concat(case when user_id%5<2 then 't' else 'x' end,{_BLOCK})"

_DIALECTS = {
    "spark": {
        "EMPTY": "cast(array() as array<string>)",
        "ONE": f"array({_USER})",
        "TWO": f"array({_USER}, concat('u',(user_id+1)%200))",
        "KEY": "get_json_object(props,'$.k')",
        "HEX": "hex(cast(floor(value*100) as bigint)*100000000000)",
        "TOPICS": "array({0}, cast(null as string), {1})",
    },
    "duckdb": {
        "EMPTY": "cast([] as varchar[])",
        "ONE": f"[{_USER}]",
        "TWO": f"[{_USER}, concat('u',(user_id+1)%200)]",
        "KEY": "json_extract_string(props,'$.k')",
        "HEX": "to_hex(cast(floor(value*100) as bigint)*100000000000)",
        "TOPICS": "[{0}, cast(null as varchar), {1}]",
    },
}

_TOPIC_0 = (
    "case when event_id%4=0 then '0x8c5be1e5ebec7d5bd14f71427d1e84f3dd0314c0f7b2291e5b200ac8c7c3b925' "
    "when event_id%4=1 then '0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef' "
    "when event_id%20=2 then '0x8BE0079c531659141344cd1fd0a4f28419497f9722a3daafe3b4186f6b6457e0' "
    "else '0xother' end"
)

# view -> (source table, {column: expression})
VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "core_transactions": (
        "events",
        {
            "tx_id": f"concat('t',{_BLOCK})",
            "block_timestamp": "ts",
            "inserted_timestamp": "ts + (event_id%300)*interval '1' second",
            "tx_succeeded": "case when event_id%97=0 then null else event_type<>'error' end",
            "payer": _USER,
            "authorizers": "case when event_id%50=0 then {EMPTY} else {ONE} end",
        },
    ),
    "evm_transactions": (
        "events",
        {
            "tx_hash": _HASH,
            "block_timestamp": "ts",
            "inserted_timestamp": "ts + (event_id%300)*interval '1' second",
            "tx_succeeded": "event_type<>'error'",
            "tx_fee": "value/1000",
            "value": "case when event_id%3=0 then 0.0 else value end",
            "from_address": "case when user_id%3=0 then "
            f"concat('0x0000000000000000000000020000000000000000u',user_id) else {_USER} end",
            "to_address": "case event_type "
            "when 'purchase' then '0x0000000000000068f116a894984e2db1123eb395' "
            "when 'click' then '0x00000003CF2C206E1FDA7FD032B2F9BDE12EC6CC' else '0xother' end",
            "origin_function_signature": "case event_type when 'signup' then '0x60806040' "
            "when 'view' then '0x60c06040' when 'click' then '0xe7acab24' else '0x052eb226' end",
        },
    ),
    "core_events": (
        "events",
        {
            "tx_id": f"concat('t',{_BLOCK})",
            "block_timestamp": "ts",
            "tx_succeeded": "event_type<>'error'",
            "event_contract": "case event_type when 'view' then 'A.f919ee77447b7497.FlowFees' "
            "when 'purchase' then 'A.4eb8a10cb9f87357.NFTStorefrontV2' "
            "else concat('A.c',{KEY},'_',user_id%20) end",
            "event_type": "case event_type when 'view' then 'FeesDeducted' "
            "when 'purchase' then 'ListingCompleted' else event_type end",
            "event_data": """concat('{{"amount":',value,',"salePrice":',value,',"nftType":"n',user_id%7,"""
            """'","salePaymentVaultType":"A.1654653399040a61.FlowToken","purchased":',"""
            """case when event_id%5=0 then 'false' else 'true' end,'}}')""",
        },
    ),
    "evm_event_logs": (
        "events",
        {
            "tx_hash": _HASH,
            "block_timestamp": "ts",
            "tx_succeeded": "event_type<>'error'",
            "contract_address": "case event_type "
            "when 'error' then '0xd112634f06902a977db1d596c77715d72f8da8a9' "
            "when 'signup' then '0xd112634f06902a977db1d596c77715d72f8da8a9' "
            "when 'purchase' then '0xd3bf53dac106a0290b0483ecbc89d40fcc961f3e' "
            "else concat('0xc',{KEY},'_',user_id%20) end",
            "data": "case when event_id%3=0 then '0x' when event_id%101=0 then '0xzz' "
            "else concat('0x',lpad(concat(lower({HEX}),"
            "case when event_id%7=0 then '0000000' else '' end),64,'0')) end",
            "event_index": "12",
            "topics": f"{{TOPICS:{_TOPIC_0}|concat('u',user_id)}}",
            "origin_from_address": "concat('u',user_id)",
            "origin_to_address": "case event_type "
            "when 'click' then '0x00000003cf2c206e1fda7fd032b2f9bde12ec6cc' else '0xother' end",
            "origin_function_signature": "case event_type "
            "when 'click' then '0xe7acab24' else '0x052eb226' end",
        },
    ),
    "transaction_actors": (
        "events",
        {
            "block_timestamp": "ts",
            "actors": "case when event_id%50=0 then {EMPTY} else {TWO} end",
        },
    ),
    "staking_actions": (
        "orders",
        {
            "block_timestamp": "o_orderdate",
            "tx_id": "concat('o',cast(floor(o_orderkey/2) as bigint))",
            "delegator": "concat('d',o_custkey)",
            "amount": "o_totalprice",
            "action": "case o_orderstatus when 'F' then 'TokensCommitted' "
            "when 'O' then 'DelegatorTokensCommitted' else case when o_orderkey%2=0 "
            "then 'UnstakedTokensWithdrawn' else 'DelegatorUnstakedTokensWithdrawn' end end",
        },
    ),
    "nft_sales": (
        "events",
        {
            "block_timestamp": "ts",
            "tx_id": f"concat('t',{_BLOCK})",
            "buyer": "concat('u',user_id%3)",
            "currency": "case when event_id%2=0 then 'A.1654653399040a61.FlowToken' "
            "else 'a.b19436aae4d94622.fiattoken' end",
            "price": "cast(floor(value/100)*100 as double)",
            "nft_collection": "concat('n',user_id%2)",
            "tx_succeeded": "event_type<>'error'",
        },
    ),
    "prices_hourly": (
        "events",
        {
            "hour": "date_trunc('hour',ts)",
            "price": "value/1000",
            "symbol": "case event_type when 'click' then 'FLOW' when 'view' then 'stFlow' else 'USDC' end",
            "token_address": "case event_type when 'click' then 'A.1654653399040a61.FlowToken' "
            "when 'view' then 'A.d6f80565193ad727.stFlowToken' else 'A.b19436aae4d94622.FiatToken' end",
        },
    ),
    "prices_ohlc": (
        "events",
        {
            "hour": "date_trunc('hour',ts)",
            "asset_id": "case when event_id%40=0 then null else concat('tok',user_id) end",
            "close": "value",
        },
    ),
}


def expression(text: str, dialect: str) -> str:
    """Fill in the dialect fragments of one column expression."""
    parts = dict(_DIALECTS[dialect])
    topics = parts.pop("TOPICS")
    if text.startswith("{TOPICS:"):
        return topics.format(*text[len("{TOPICS:") : -1].split("|"))
    for name, fragment in parts.items():
        text = text.replace("{" + name + "}", fragment)
    return text.replace("{{", "{").replace("}}", "}")


def view_sql(view: str, dialect: str) -> str:
    """The view as one SELECT over its source table."""
    table, columns = VIEWS[view]
    chosen = ", ".join(f"{expression(text, dialect)} AS {name}" for name, text in columns.items())
    return f"SELECT {chosen} FROM {table}"


# Types of the columns read here, so that opening a file needs no job.
_RAW = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz",
}


def load(spark: SparkSession, sf_dir: str) -> Sources:
    def open_table(view: str) -> DataFrame:
        table, columns = VIEWS[view]
        raw = spark.read.schema(_RAW[table]).parquet(f"{sf_dir}/{table}.parquet")
        return raw.selectExpr(*[f"{expression(text, 'spark')} AS {name}" for name, text in columns.items()])

    return Sources(open_table)
