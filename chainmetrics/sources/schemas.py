"""Columns and types of the nine canonical input tables."""

from __future__ import annotations

#: Columns that a table may hold, and how they follow from the others where it does not.
#: A stored column can be pruned by Parquet statistics, an array element cannot.
DERIVED: dict[str, dict[str, str]] = {"evm_event_logs": {"topic_0": "get(topics, 0)"}}

#: Payload fields that the metrics read. A table may hold them in typed columns of their own.
SHREDDED: dict[str, dict[str, dict[str, str]]] = {
    "core_events": {
        "event_data": {
            "purchased": "string",
            "salePaymentVaultType": "string",
            "salePrice": "double",
            "nftType": "string",
            "amount": "double",
        }
    }
}

#: The transaction id of each table that is joined by it.
JOIN_KEYS: dict[str, str] = {
    "core_transactions": "tx_id",
    "core_events": "tx_id",
    "evm_transactions": "tx_hash",
    "evm_event_logs": "tx_hash",
}

SCHEMAS: dict[str, str] = {
    "core_transactions": """
        tx_id string, block_timestamp timestamp, inserted_timestamp timestamp,
        tx_succeeded boolean, payer string, authorizers array<string>""",
    "evm_transactions": """
        tx_hash string, block_timestamp timestamp, inserted_timestamp timestamp,
        tx_succeeded boolean, tx_fee double, value double, from_address string,
        to_address string, origin_function_signature string""",
    "core_events": """
        tx_id string, block_timestamp timestamp, tx_succeeded boolean,
        event_contract string, event_type string, event_data string""",
    "evm_event_logs": """
        tx_hash string, block_timestamp timestamp, tx_succeeded boolean,
        contract_address string, data string, event_index int, topics array<string>,
        origin_from_address string, origin_to_address string,
        origin_function_signature string""",
    "transaction_actors": "block_timestamp timestamp, actors array<string>",
    "staking_actions": """
        block_timestamp timestamp, tx_id string, delegator string, amount double,
        action string""",
    "nft_sales": """
        block_timestamp timestamp, tx_id string, buyer string, currency string,
        price double, nft_collection string, tx_succeeded boolean""",
    "prices_hourly": "hour timestamp, price double, symbol string, token_address string",
    "prices_ohlc": "hour timestamp, asset_id string, close double",
}

#: The time column of each table.
TIMES: dict[str, str] = {
    name: "hour" if name.startswith("prices_") else "block_timestamp" for name in SCHEMAS
}
