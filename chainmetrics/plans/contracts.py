"""Contract creation and activity in both runtimes."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainmetrics.functions.timeops import AsOf, before, first_week_after, since, week_of
from chainmetrics.operators.entities import debuts, union_all, union_sources, weekly_active
from chainmetrics.operators.weekly import running_total
from chainmetrics.session import written
from chainmetrics.sources.tables import Sources

# Fixed values
OWNERSHIP_TOPIC = "0x8be0079c531659141344cd1fd0a4f28419497f9722a3daafe3b4186f6b6457e0"
CREATION_SIGNATURES = ["0x60c06040", "0x60806040"]
COA_PREFIX = "0x0000000000000000000000020000000000000000"
WEEKLY_FLOOR = date(2020, 1, 1)
NUMBERS_FLOOR = date(2024, 1, 1)

CADENCE, COA, NON_COA = "Cadence", "COA EVM Contract", "Non-COA EVM Contract"


def topic(index: int) -> Column:
    return F.get("topics", F.lit(index))


def evm_creations(src: Sources, keys: list[str], until: date | None = None) -> DataFrame:
    """EVM contracts with the time ``ts`` of their creation.

    ``keys`` is ``["contract"]`` or ``["contract", "creator"]``; without the
    creator a transaction is reduced to its earliest time alone.

    A transaction with an ownership log creates the logging contracts. One with
    a creation signature and no such log stands for a contract itself, under its
    own hash.

    The wide transaction table is first cut down to the few rows that have an
    ownership log; only what is left is reduced per transaction and joined for
    the contract, so a repeated hash does not multiply.
    """
    owned = src.evm_event_logs.filter(F.lower("topic_0").contains(OWNERSHIP_TOPIC)).select(
        "tx_hash", F.col("contract_address").alias("contract")
    )
    tx = src.evm_transactions
    if until is not None:
        tx = before(tx, "block_timestamp", until)
    tx = tx.select("tx_hash", F.col("from_address").alias("creator"), "block_timestamp", "origin_function_signature")
    logged = (
        tx.join(owned, "tx_hash", "left_semi")
        .groupBy("tx_hash", *[key for key in keys if key != "contract"])
        .agg(F.min("block_timestamp").alias("ts"))
        .join(owned.distinct(), "tx_hash")
    )
    unlogged = tx.filter(
        F.col("tx_hash").isNotNull() & F.col("origin_function_signature").isin(CREATION_SIGNATURES)
    ).join(owned, "tx_hash", "left_anti")
    unlogged = unlogged.withColumns({"contract": F.col("tx_hash"), "ts": F.col("block_timestamp")})
    return logged.select(*keys, "ts").unionByName(unlogged.select(*keys, "ts"))


@dataclass(frozen=True)
class ContractWeeks:
    """The weeks in which each contract acts, in the columns of the two tables they come from.

    A few rows a contract and week stand for all of its events and logs; ``block_timestamp`` is the
    first day of the week, so whatever asks for weeks alone, cutoffs at weeks included, is the same on them.
    """

    core_events: DataFrame
    evm_event_logs: DataFrame

    @classmethod
    def of(cls, src: Sources) -> ContractWeeks:
        week = week_of("block_timestamp").alias("block_timestamp")
        core = src.core_events.groupBy("event_contract", week).agg(F.max("tx_succeeded").alias("tx_succeeded"))
        return cls(written(core), written(src.evm_event_logs.select("contract_address", week).distinct()))


def _core_contracts(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_contract").alias("contract"), F.col("block_timestamp").alias("ts"))


def contract_debuts(src: Sources, until: date | None = None) -> DataFrame:
    """``(contract, creator, source, debut)``: first week per contract and creator."""
    events = src.core_events if until is None else before(src.core_events, "block_timestamp", until)
    core = debuts(_core_contracts(events), "contract").select(
        "contract", F.lit(None).cast("string").alias("creator"), F.lit(CADENCE).alias("source"), "debut"
    )
    keys = ["contract", "creator"]
    evm = debuts(evm_creations(src, keys, until), *keys).select(
        "contract", "creator", _origin().alias("source"), "debut"
    )
    return core.unionByName(evm)


def _origin() -> Column:
    return F.when(F.col("creator").startswith(COA_PREFIX), F.lit(COA)).otherwise(F.lit(NON_COA))


def _evm_class_debuts(src: Sources, until: date) -> DataFrame:
    """``(contract, source, debut)``: the distinct classes and weeks of :func:`contract_debuts`.

    A contract of one transaction takes over what that transaction's creators reduce
    to, a few classes and weeks, whatever their number. Only a contract that occurs
    under several transactions has to be paired with creators, as the debut of each
    is the earliest of them. One aggregate tells the two apart and names the transaction
    of the first, so neither has to be joined with the other.
    """
    hashed = F.col("tx_hash").isNotNull()
    owned = src.evm_event_logs.filter(F.lower("topic_0").contains(OWNERSHIP_TOPIC) & hashed).select(
        "tx_hash", F.col("contract_address").alias("contract")
    )
    tx = before(src.evm_transactions, "block_timestamp", until).filter(hashed)
    signed = F.col("origin_function_signature").isin(CREATION_SIGNATURES)
    tx = tx.select("tx_hash", F.col("from_address").alias("creator"), "block_timestamp", signed.alias("signed"))

    # The wide table is pruned by the few rows that either join leaves, then reduced.
    logged = tx.join(owned, "tx_hash", "left_semi").withColumn("named", F.lit(True))
    unlogged = tx.filter("signed").join(owned, "tx_hash", "left_anti").withColumn("named", F.lit(False))
    creators = (
        logged.unionByName(unlogged)
        .groupBy("tx_hash", "creator")
        .agg(F.min("block_timestamp").alias("ts"), F.max("named").alias("named"))
        # Always true, but both columns are then needed by every reader, so all share one shuffle.
        .filter(F.col("ts").isNotNull() & F.col("named").isNotNull())
    )
    itself = creators.filter(~F.col("named")).select("tx_hash", F.col("tx_hash").alias("contract"))
    places = owned.unionByName(itself).distinct()
    by_contract = places.groupBy("contract").agg(F.count("*").alias("n"), F.min("tx_hash").alias("tx_hash"))
    per_tx = creators.select("tx_hash", _origin().alias("source"), week_of("ts").alias("debut")).distinct()
    of_one = by_contract.filter("n = 1").join(per_tx, "tx_hash")
    several = by_contract.filter("n > 1").select(F.col("contract").alias("_several"))
    paired = places.join(several, F.col("contract").eqNullSafe(F.col("_several")), "left_semi").join(creators, "tx_hash")
    columns = ["contract", "source", "debut"]
    of_several = debuts(paired, "contract", "creator").withColumn("source", _origin())
    return of_one.select(*columns).unionByName(of_several.select(*columns))


def contracts_new_weekly(src: Sources, as_of: AsOf, weeks: ContractWeeks | None = None) -> DataFrame:
    """``(date, source, new_contracts, unique_contracts)`` by origin class."""
    until, weeks = as_of.this_week, weeks or src
    core = debuts(_core_contracts(before(weeks.core_events, "block_timestamp", until)), "contract")
    weekly = (
        core.withColumn("source", F.lit(CADENCE))
        .unionByName(_evm_class_debuts(src, until))
        .filter(F.col("debut") >= F.lit(first_week_after(WEEKLY_FLOOR)))
        .groupBy(F.col("debut").alias("date"), "source")
        .agg(F.count_distinct("contract").alias("new_contracts"))
    )
    return weekly.withColumn("unique_contracts", running_total("new_contracts", "date", "source"))


def _active_rows(events: DataFrame, logs: DataFrame) -> DataFrame:
    """Core contracts count in successful transactions only, EVM ones in all."""
    return union_sources(
        {
            "core": _core_contracts(events.filter(F.col("tx_succeeded"))),
            "evm": logs.select(
                F.col("contract_address").alias("contract"), F.col("block_timestamp").alias("ts")
            ),
        }
    ).withColumnRenamed("contract", "entity")


def contracts_active_weekly(src: Sources, as_of: AsOf, weeks: ContractWeeks | None = None) -> DataFrame:
    """``(date, active_contracts)``: both runtimes added; the floor binds EVM only."""
    weeks = weeks or src
    logs = since(weeks.evm_event_logs, "block_timestamp", first_week_after(WEEKLY_FLOOR))
    rows = _active_rows(
        before(weeks.core_events, "block_timestamp", as_of.this_week),
        before(logs, "block_timestamp", as_of.this_week),
    )
    return weekly_active(rows, "active_contracts").withColumnRenamed("week", "date")


def contracts_numbers(src: Sources, as_of: AsOf, weeks: ContractWeeks | None = None) -> DataFrame:
    """Newest complete week against the one before; no row without activity in it.

    Activity reads two weeks only. New and total contracts need one flag pair per
    contract, so no distinct count is taken over the debuts.
    """
    last, earlier, weeks = as_of.last_week, as_of.week_before_last, weeks or src

    def two_weeks(df: DataFrame) -> DataFrame:
        return before(since(df, "block_timestamp", earlier), "block_timestamp", as_of.this_week)

    weekly = weekly_active(_active_rows(two_weeks(weeks.core_events), two_weeks(weeks.evm_event_logs)), "n")
    active = weekly.agg(
        F.max(F.when(F.col("week") == F.lit(last), F.col("n"))).alias("now"),
        F.max(F.when(F.col("week") == F.lit(earlier), F.col("n"))).alias("then"),
    )
    core = debuts(_core_contracts(weeks.core_events), "contract")
    evm = debuts(evm_creations(src, ["contract"]), "contract")
    per_contract = (
        union_all([core, evm])
        .groupBy("contract")
        .agg(
            F.max(F.col("debut") == F.lit(last)).alias("new_now"),
            F.max(F.col("debut") == F.lit(earlier)).alias("new_then"),
        )
        .filter(F.col("contract").isNotNull())
    )
    totals = per_contract.agg(
        F.count("*").alias("total_contracts"),
        F.count_if("new_now").alias("new_contracts"),
        F.count_if("new_then").alias("previous_week_new_contracts"),
    )
    now, then = F.col("now"), F.col("then")
    change = F.try_divide((now - then).cast("double"), then.cast("double")) * 100
    figures = active.unionByName(totals, allowMissingColumns=True)
    report = figures.agg(*[F.max(name).alias(name) for name in figures.columns]).filter(now.isNotNull())
    if last < NUMBERS_FLOOR:
        report = report.filter(F.lit(False))
    return report.select(
        F.lit(last).alias("current_week"),
        now.alias("active_contracts"),
        F.coalesce(then, F.lit(0)).alias("previous_week_active_contracts"),
        "new_contracts",
        "total_contracts",
        "previous_week_new_contracts",
        F.coalesce(change, F.lit(0.0)).alias("pct_diff"),
    )
