"""Token-collectible sales of five venues."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainmetrics.functions.hexwords import hex_word, token_amount
from chainmetrics.functions.numbers import amount_change_label, change_label, percent_change
from chainmetrics.functions.payload import payload_field, with_payload
from chainmetrics.functions.timeops import AsOf, before, week_of
from chainmetrics.operators.entities import union_all
from chainmetrics.operators.weekly import latest_two, running_total
from chainmetrics.plans.contracts import topic
from chainmetrics.plans.prices import weekly_token_price
from chainmetrics.plans.sales import (
    APPROVED,
    BOUGHT,
    CALLED,
    FIELDS,
    LISTED,
    MARKET,
    PAID,
    ROUTED,
    SOLD,
    SOUGHT,
    TRANSFERRED,
    distinct_parts,
    part,
    sale_rows,
    tagged,
)
from chainmetrics.plans.sales import weekly as sales_by_week
from chainmetrics.session import written
from chainmetrics.sources.tables import Sources

# Fixed values
STOREFRONT_CONTRACT = "A.4eb8a10cb9f87357.NFTStorefrontV2"
STOREFRONT_EVENT = "ListingCompleted"
FIAT_TOKEN = "a.b19436aae4d94622.fiattoken"
NATIVE_TOKEN = "A.1654653399040a61.FlowToken"
LOG_SALE_SIGNATURES = ["0x052eb226", "0x09c56431"]
LOG_SALE_CONTRACT = "0xd112634f06902a977db1d596c77715d72f8da8a9"
LOG_SALE_INDEX = 12
APPROVAL_TOPIC = "0x8c5be1e5ebec7d5bd14f71427d1e84f3dd0314c0f7b2291e5b200ac8c7c3b925"
ROUTER_SIGNATURES = ["0xe7acab24", "0x87201b41"]
ROUTER_ADDRESS = "0x00000003cf2c206e1fda7fd032b2f9bde12ec6cc"
SEAPORT_ADDRESS = "0x0000000000000068f116a894984e2db1123eb395"
TRANSFER_TOPIC = "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
WRAPPED_TOKEN_CONTRACT = "0xd3bf53dac106a0290b0483ecbc89d40fcc961f3e"
EMPTY_DATA = "0x"
FIAT_DECIMALS = 6
NATIVE_DECIMALS = 18

SALE_COLUMNS = ["week", "tx_id", "buyer", "currency", "price", "nft_collection"]

# Which rows of a wide table belong to a venue.


def _log_sale() -> Column:
    return (
        F.col("origin_function_signature").isin(LOG_SALE_SIGNATURES)
        & (F.col("contract_address") == LOG_SALE_CONTRACT)
        & F.col("tx_succeeded")
        & (F.col("data") == EMPTY_DATA)
        & (F.col("event_index") == LOG_SALE_INDEX)
    )


def _approval() -> Column:
    return F.col("topic_0") == APPROVAL_TOPIC


def _router_signature() -> Column:
    return F.col("origin_function_signature").isin(ROUTER_SIGNATURES) & F.col("tx_succeeded")


def _router_call() -> Column:
    return _router_signature() & (F.lower("to_address") == ROUTER_ADDRESS)


def _empty_router_log() -> Column:
    return _router_signature() & (F.col("data") == EMPTY_DATA)


def _router_log() -> Column:
    return _empty_router_log() & (F.lower("origin_to_address") == ROUTER_ADDRESS)


def _seaport_call() -> Column:
    return (F.col("to_address") == SEAPORT_ADDRESS) & F.col("tx_succeeded")


def _transfer() -> Column:
    return (F.col("topic_0") == TRANSFER_TOPIC) & (F.col("contract_address") == WRAPPED_TOKEN_CONTRACT)


# In every venue both sides of the join are made distinct on the columns that
# reach the result. A sale row is kept once in the end anyway, so nothing is lost,
# and a repeated transaction id no longer multiplies rows inside the join. A side
# without a filter of its own is first cut down to the ids the other side holds.


def marketplace_sales(src: Sources, until: date) -> DataFrame:
    sales = before(src.nft_sales, "block_timestamp", until).filter(F.col("tx_succeeded"))
    return sales.withColumn("week", week_of("block_timestamp")).select(*SALE_COLUMNS)


def _listings(src: Sources, until: date) -> tuple[DataFrame, DataFrame]:
    """Completed listings, and the buyers of their transactions."""
    events = src.core_events
    listing = (F.col("event_contract") == STOREFRONT_CONTRACT) & (F.col("event_type") == STOREFRONT_EVENT)

    # A plain expression, as a generator would keep the ids from becoming a Bloom filter.
    purchased = payload_field(events, "event_data", "purchased", "string") == "true"
    listed = before(events, "block_timestamp", until).filter(listing).filter(purchased)
    fields = {"salePaymentVaultType": "string", "salePrice": "double", "nftType": "string"}
    completed = with_payload(listed, "event_data", fields).select(
        week_of("block_timestamp").alias("week"),
        "tx_id",
        F.col("salePaymentVaultType").alias("currency"),
        F.col("salePrice").alias("price"),
        F.col("nftType").alias("nft_collection"),
    )
    buyers = src.core_transactions.select("tx_id", F.get("authorizers", F.lit(0)).alias("buyer")).join(
        listed.select("tx_id"), "tx_id", "left_semi"
    )
    return completed, buyers


def storefront_sales(src: Sources, until: date) -> DataFrame:
    completed, buyers = _listings(src, until)
    return completed.distinct().join(buyers.distinct(), "tx_id").select(*SALE_COLUMNS)


def log_pair_sales(src: Sources, until: date) -> DataFrame:
    """A sale log and the approval logs of the same transaction, which hold the price."""
    logs = src.evm_event_logs
    sale_logs = before(logs, "block_timestamp", until).filter(_log_sale())
    sold = sale_logs.select(
        week_of("block_timestamp").alias("week"),
        F.col("tx_hash").alias("tx_id"),
        topic(2).alias("buyer"),
        F.col("origin_from_address").alias("nft_collection"),
    ).distinct()
    approved = (
        logs.filter(_approval())
        .select(F.col("tx_hash").alias("tx_id"), "data")
        .join(sale_logs.select(F.col("tx_hash").alias("tx_id")), "tx_id", "left_semi")
        .select("tx_id", token_amount(F.col("data"), FIAT_DECIMALS).alias("price"))
        .distinct()
    )
    return sold.join(approved, "tx_id").withColumn("currency", F.lit(FIAT_TOKEN)).select(*SALE_COLUMNS)


def router_sales(src: Sources, until: date) -> DataFrame:
    """Calls of the router contract and the empty logs of the same transaction."""
    calls = (
        before(src.evm_transactions, "block_timestamp", until)
        .filter(_router_call())
        .select(
            week_of("block_timestamp").alias("week"),
            F.col("tx_hash").alias("tx_id"),
            F.col("value").alias("price"),
        )
        .distinct()
    )
    logs = (
        src.evm_event_logs.filter(_router_log())
        .select(
            F.col("tx_hash").alias("tx_id"),
            F.col("origin_from_address").alias("buyer"),
            F.col("contract_address").alias("nft_collection"),
        )
        .distinct()
    )
    return calls.join(logs, "tx_id").withColumn("currency", F.lit(NATIVE_TOKEN)).select(*SALE_COLUMNS)


def seaport_sales(src: Sources, until: date) -> DataFrame:
    """Direct calls; a missing or zero value falls back to the logged transfers."""
    calls = (
        before(src.evm_transactions, "block_timestamp", until)
        .filter(_seaport_call())
        .select(
            week_of("block_timestamp").alias("week"),
            F.col("tx_hash").alias("tx_id"),
            F.col("from_address").alias("buyer"),
            F.nullif("value", F.lit(0.0)).alias("paid"),
        )
        .distinct()
    )
    transfers = (
        src.evm_event_logs.filter(_transfer())
        .select(
            F.col("tx_hash").alias("log_tx_id"),
            token_amount(F.col("data"), NATIVE_DECIMALS).alias("transferred"),
        )
        .distinct()
    )
    needs_log = F.col("paid").isNull() & (F.col("tx_id") == F.col("log_tx_id"))
    return (
        calls.join(transfers, needs_log, "left")
        .withColumns(
            {
                "price": F.coalesce("paid", "transferred"),
                "currency": F.lit(NATIVE_TOKEN),
                "nft_collection": F.lit(None).cast("string"),
            }
        )
        .filter(F.col("price").isNotNull())
        .select(*SALE_COLUMNS)
    )


VENUES = {
    "marketplace": marketplace_sales,
    "storefront": storefront_sales,
    "log_pair": log_pair_sales,
    "router": router_sales,
    "seaport": seaport_sales,
}
CORE_VENUES = ["marketplace", "storefront"]


def sale_parts(src: Sources, until: date) -> DataFrame:
    """The sides of all venues' sales (see :mod:`chainmetrics.plans.sales`), one scan of each EVM table.

    As the approval and transfer logs come from the same scan as the sales that choose among them,
    they are all shuffled, three narrow columns each.
    """

    def given(*names: str) -> dict[str, Column]:
        return {name: F.col(name) for name in names}

    started, week = F.col("block_timestamp") < F.lit(until), week_of("block_timestamp")
    tx, native, fiat = F.col("tx_hash"), F.lit(NATIVE_TOKEN), F.lit(FIAT_TOKEN)
    completed, buyers = _listings(src, until)
    paid, called = F.nullif("value", F.lit(0.0)), before(src.evm_transactions, "block_timestamp", until)
    caller = dict(tx_id=tx, week=week, currency=native, buyer=F.col("from_address"))
    feeds = [
        marketplace_sales(src, until).select(part(MARKET, **given(*FIELDS)).alias("made")).select("made.*"),
        completed.select(part(LISTED, **given("tx_id", "week", "currency", "price", "nft_collection")).alias("made")).select("made.*"),
        buyers.select(part(BOUGHT, **given("tx_id", "buyer")).alias("made")).select("made.*"),
        tagged(
            called,
            [
                (_router_call(), part(CALLED, tx_id=tx, week=week, currency=native, price=F.col("value"))),
                (_seaport_call() & paid.isNotNull(), part(PAID, **caller, price=paid)),
                (_seaport_call() & paid.isNull(), part(SOUGHT, **caller)),
            ],
            reach=_router_signature() | _seaport_call(),
        ),
        tagged(
            src.evm_event_logs,
            [
                (
                    _log_sale() & started,
                    part(SOLD, tx_id=tx, week=week, currency=fiat, buyer=topic(2), nft_collection=F.col("origin_from_address")),
                ),
                (_approval(), part(APPROVED, tx_id=tx, price=token_amount(F.col("data"), FIAT_DECIMALS))),
                (
                    _router_log(),
                    part(ROUTED, tx_id=tx, buyer=F.col("origin_from_address"), nft_collection=F.col("contract_address")),
                ),
                (_transfer(), part(TRANSFERRED, tx_id=tx, price=token_amount(F.col("data"), NATIVE_DECIMALS))),
            ],
            reach=_log_sale() & started | _approval() | _empty_router_log() | _transfer(),
        ).filter((F.col("part") != TRANSFERRED) | F.col("price").isNotNull()),
    ]
    return distinct_parts(feeds)


def nft_sales_by_venue(src: Sources, as_of: AsOf) -> DataFrame:
    """Sale rows of all venues before they are aggregated."""
    return sale_rows(sale_parts(src, as_of.this_week)).select(*SALE_COLUMNS, "venue")


def _sales(src: Sources, as_of: AsOf, venues: list[str]) -> DataFrame:
    """Distinct sale rows; equal rows of two venues count once."""
    return union_all([VENUES[name](src, as_of.this_week) for name in venues]).distinct()


def nft_sales_numbers(src: Sources, as_of: AsOf) -> DataFrame:
    """Newest complete week of the core venues against the week before it."""
    weekly = (
        _sales(src, as_of, CORE_VENUES)
        .groupBy("week")
        .agg(
            F.count_distinct("tx_id").alias("sales"),
            F.count_distinct("buyer").alias("nft_buyers"),
            F.sum("price").alias("volume"),
            F.count_distinct("nft_collection").alias("active_collections"),
        )
        .select(
            "week",
            "sales",
            "nft_buyers",
            "volume",
            running_total("volume", "week").alias("total_volume"),
            "active_collections",
        )
    )
    now, then = "now.{}".format, "then.{}".format
    sales = F.col(now("sales")), F.col(then("sales"))
    volume = F.col(now("volume")), F.col(then("volume"))
    return latest_two(weekly, as_of.this_week, as_of.last_week).select(
        "now.*",
        change_label(*sales).alias("sales_diff"),
        percent_change(*sales).alias("pcg_diff_sales"),
        amount_change_label(*volume).alias("vol_diff"),
        percent_change(*volume).alias("pcg_diff_vol"),
    )


# Lengths of the literal parts by which patterns and currencies find each other.
_KEY_LENGTHS = (8, 4, 2, 1)


def _pattern_key(pattern: Column) -> Column:
    """The middle of the longest literal part of a folded pattern, in one of the key lengths.

    Whatever the pattern fits holds the key. A pattern without a literal part has the empty key, and
    so has one that is malformed, which then fails in comparison as it would without a key.
    """
    well_formed = pattern.rlike(r"^(?:[^\\]|\\[%_\\])*$")
    parts = F.transform(
        F.regexp_extract_all(pattern, F.lit(r"((?:[^%_\\]|\\[%_\\])+)"), F.lit(1)),
        lambda part: F.regexp_replace(part, r"\\([%_\\])", "$1"),
    )
    longest = F.coalesce(F.array_max(F.transform(parts, lambda p: F.struct(F.length(p).alias("n"), p.alias("part"))))["part"], F.lit(""))
    key = F.lit("")
    for size in reversed(_KEY_LENGTHS):
        middle = F.substring(longest, F.floor((F.length(longest) - size) / 2).cast("int") + 1, F.lit(size))
        key = F.when(F.length(longest) >= size, middle).otherwise(key)
    return F.when(well_formed, key).otherwise(F.lit(""))


def _text_keys(text: Column) -> Column:
    """Every key that a pattern fitting the folded text can have, each once."""

    def cut(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
        return F.transform(starts, lambda at: F.substring(text, at, F.lit(size)))

    # Shorter texts give themselves, which does no harm: the comparison decides.
    return F.array_distinct(F.concat(F.array(F.lit("")), *[cut(size) for size in _KEY_LENGTHS]))


def _with_prices(per_currency: DataFrame, prices: DataFrame) -> DataFrame:
    """Add ``tokens``, ``usd_rows`` and ``usd``: the price rows a currency meets.

    A price row applies if its token, read as a case-insensitive pattern, fits
    the currency. A token without wildcards is plain equality, so it joins on the whole
    name; one with wildcards joins on a literal part of it, and is then compared.
    """
    by_token = prices.groupBy("week", F.lower("token_contract").alias("token")).agg(
        F.count("token_contract").alias("tokens"), F.count("price_usd").alias("usd_rows"), F.sum("price_usd").alias("usd")
    )
    wildcard, folded = F.col("token").rlike(r"[%_\\]"), F.lower("currency")
    patterns = by_token.filter(wildcard).withColumn("key", _pattern_key(F.col("token")))
    named = per_currency.select("week", "currency", folded.alias("folded"))
    by_key = named.filter(F.col("currency").isNotNull()).withColumn("key", F.explode(_text_keys(F.col("folded"))))
    fitting = by_key.join(patterns, ["week", "key"]).filter("folded like token")
    equal = named.join(by_token.filter(~wildcard).withColumnRenamed("token", "folded"), ["week", "folded"])
    figures = ["tokens", "usd_rows", "usd"]
    met = (
        union_all([df.select("week", "currency", *figures) for df in (fitting, equal)])
        .groupBy("week", "currency")
        .agg(*[F.sum(name).alias(name) for name in figures])
    )
    return per_currency.join(met, ["week", "currency"], "left").withColumns(
        {name: F.coalesce(name, F.lit(0)) for name in figures}
    )


def nft_sales_weekly(src: Sources, as_of: AsOf) -> DataFrame:
    """Sales of all venues per week, valued at one blended weekly price.

    Counts and sums come from the sides of the sales, which are not paired where they are many. Volume is the summed price times the mean USD price over all (sale, price)
    pairs. Both factors follow from per-currency counts, so prices join a table
    of one row per week and currency and never the sales.
    """
    parts = written(sale_parts(src, as_of.this_week))
    counts, per_currency = sales_by_week(parts)
    valued = (
        _with_prices(per_currency, weekly_token_price(src, as_of.this_week))
        .groupBy("week")
        .agg(
            F.sum(F.col("price") * F.greatest("tokens", F.lit(1))).alias("price"),
            F.sum(F.col("rows") * F.col("usd")).alias("usd"),
            F.sum(F.col("rows") * F.col("usd_rows")).alias("usd_rows"),
        )
    )
    volume = F.col("price") * F.try_divide(F.col("usd"), F.col("usd_rows"))
    weekly = counts.join(valued, "week").select(
        "week", "sales", "nft_buyers", volume.alias("volume"), "active_collections"
    )
    return weekly.select(
        "week",
        "sales",
        running_total("sales", "week").alias("total_sales"),
        "nft_buyers",
        "volume",
        running_total("volume", "week").alias("total_volume"),
        "active_collections",
    )


def log_amounts(src: Sources) -> DataFrame:
    """Every log's data word as whole units and as amounts of both token kinds."""
    data = F.col("data")
    return src.evm_event_logs.select(
        "tx_hash",
        "data",
        hex_word(data).cast("string").alias("units"),
        token_amount(data, NATIVE_DECIMALS).alias("native_amount"),
        token_amount(data, FIAT_DECIMALS).alias("fiat_amount"),
    )
