"""Field access into semi-structured event payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import VariantType


def field_column(column: str, field: str) -> str:
    """Name of the column that holds a field beside its payload."""
    return f"{column}__{field}"


def _stored(df: DataFrame, column: str, field: str, type_name: str) -> Column | None:
    """The field's own column, where the table has one of that type."""
    return F.col(field_column(column, field)) if (field_column(column, field), type_name) in df.dtypes else None


def payload_field(df: DataFrame, column: str, field: str, type_name: str) -> Column:
    """A typed top-level field; NULL where it is absent or does not convert.

    Works on a VARIANT column and on JSON text. A column written beside the payload
    (:func:`chainmetrics.sources.sinks.shredded`) is taken as it is.
    """
    stored = _stored(df, column, field, type_name)
    if stored is not None:
        return stored
    path = f"$.{field}"
    if isinstance(df.schema[column].dataType, VariantType):
        return F.try_variant_get(F.col(column), path, type_name)
    return F.get_json_object(F.col(column), path).try_cast(type_name)


def with_payload(df: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """``df`` with one column for each top-level field, as :func:`payload_field` has it.

    JSON text is parsed once for all fields.
    """
    beside = {name: _stored(df, column, name, kind) for name, kind in fields.items()}
    if all(found is not None for found in beside.values()):
        return df.withColumns(beside)
    if isinstance(df.schema[column].dataType, VariantType):
        return df.withColumns({name: payload_field(df, column, name, kind) for name, kind in fields.items()})
    parsed = df.select("*", F.json_tuple(column, *fields).alias(*fields))
    return parsed.withColumns({name: F.col(name).try_cast(kind) for name, kind in fields.items() if kind != "string"})
