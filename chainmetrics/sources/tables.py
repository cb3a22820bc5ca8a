"""The nine input tables as lazily built, normalised DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    StringType,
    StructType,
    TimestampNTZType,
    TimestampType,
    VariantType,
)

from chainmetrics.functions.payload import field_column
from chainmetrics.functions.timeops import PARTITION_WEEK, AsOf, up_to
from chainmetrics.sources.schemas import DERIVED, SCHEMAS, SHREDDED, TIMES


class _Table:
    """A table opened and normalised when first used, then kept."""

    def __set_name__(self, owner: type, name: str) -> None:
        self.name = name

    def __get__(self, sources: Sources | None, owner: type) -> DataFrame | _Table:
        if sources is None:
            return self
        df = normalise(self.name, sources.open_table(self.name))
        sources.__dict__[self.name] = df
        return df


class Sources:
    """Canonical tables; every metric takes one of these.

    A metric opens only the tables it reads.
    """

    core_transactions = _Table()
    evm_transactions = _Table()
    core_events = _Table()
    evm_event_logs = _Table()
    transaction_actors = _Table()
    staking_actions = _Table()
    nft_sales = _Table()
    prices_hourly = _Table()
    prices_ohlc = _Table()

    def __init__(self, open_table: Callable[[str], DataFrame]) -> None:
        self.open_table = open_table

    @classmethod
    def of(cls, **frames: DataFrame) -> Sources:
        """Tables that are DataFrames already."""
        return cls(frames.__getitem__)

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str) -> Sources:
        """One Parquet table per canonical name below ``root``."""
        return cls(lambda name: spark.read.parquet(f"{root}/{name}"))

    @classmethod
    def from_catalog(cls, spark: SparkSession, names: dict[str, str]) -> Sources:
        """Catalog tables; ``names`` maps each canonical name to a full table name."""
        return cls(lambda name: spark.table(names[name]))

    def until(self, as_of: AsOf) -> Sources:
        """The tables as they stood at ``as_of``: no later row is seen by any metric."""

        def open_table(name: str) -> DataFrame:
            return up_to(getattr(self, name), TIMES[name], as_of.moment)

        return Sources(open_table)

    def register_views(self) -> None:
        """Expose all tables to ``spark.sql`` under their canonical names."""
        for name in SCHEMAS:
            getattr(self, name).createOrReplaceTempView(name)


def normalise(name: str, df: DataFrame) -> DataFrame:
    """Select the canonical columns of a table in canonical types.

    Columns already of a fitting type pass untouched, so filters on them still
    reach the scan. The week directory column and typed columns of payload fields are kept where
    the table has them.
    """
    wanted = StructType.fromDDL(SCHEMAS[name])
    have = {field.name.lower(): field for field in df.schema}
    missing = [field.name for field in wanted if field.name not in have]
    if missing:
        raise ValueError(f"table {name} lacks columns {missing}")
    columns = [
        _as_type(F.col(have[field.name].name), have[field.name].dataType, field.dataType).alias(field.name)
        for field in wanted
    ]
    for extra, text in DERIVED.get(name, {}).items():
        columns.append((F.col(have[extra].name) if extra in have else F.expr(text)).alias(extra))
    for payload, fields in SHREDDED.get(name, {}).items():
        for field, kind in fields.items():
            stored = have.get(field_column(payload, field).lower())
            if stored is not None and stored.dataType.simpleString() == kind:
                columns.append(F.col(stored.name).alias(field_column(payload, field)))
    if PARTITION_WEEK in have:
        columns.append(F.col(PARTITION_WEEK))
    return df.select(*columns)


def _as_type(column: Column, have: DataType, want: DataType) -> Column:
    if have == want or _fits(have, want):
        return column
    if isinstance(want, BooleanType) and isinstance(have, StringType):
        return F.lower(column) == F.lit("true")
    if isinstance(want, ArrayType) and isinstance(have, VariantType):
        return F.try_variant_get(column, "$", want.simpleString())
    return column.cast(want)


def _fits(have: DataType, want: DataType) -> bool:
    if isinstance(want, TimestampType):
        return isinstance(have, TimestampNTZType)
    # Payloads may arrive as VARIANT or as JSON text; both are understood.
    if isinstance(want, StringType):
        return isinstance(have, VariantType)
    # Nullability of array elements does not matter here.
    return have.simpleString() == want.simpleString()
