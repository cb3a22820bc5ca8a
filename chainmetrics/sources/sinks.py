"""Where results and prepared tables go."""

from __future__ import annotations

from pyspark.sql import DataFrame

from chainmetrics.functions.payload import field_column, with_payload
from chainmetrics.functions.timeops import PARTITION_WEEK, week_of
from chainmetrics.sources.schemas import JOIN_KEYS, SHREDDED


def write_csv(df: DataFrame, path: str) -> None:
    """UTF-8 CSV with a header and no index column, written by the executors."""
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_by_week(df: DataFrame, path: str, ts: str = "block_timestamp") -> None:
    """A fact table laid out in week directories, which as-of cutoffs then prune.

    Rows are spread evenly first, within a week too, so that a hot week is
    written by many tasks instead of one.
    """
    dated = df.withColumn(PARTITION_WEEK, week_of(ts))
    dated.hint("rebalance", PARTITION_WEEK).write.mode("overwrite").partitionBy(PARTITION_WEEK).parquet(path)


def shredded(name: str, df: DataFrame) -> DataFrame:
    """A table with the payload fields that metrics read in typed columns of their own.

    Parquet then prunes by them, and no metric parses a payload. A payload that lacks the
    field, or holds a value that does not convert, has NULL there, as when it is parsed.
    """
    columns = df.columns
    for payload, fields in SHREDDED.get(name, {}).items():
        names = {field: field_column(payload, field) for field in fields}
        taken = [column for column in columns if column in names.values()]
        df = with_payload(df.drop(*taken), payload, fields).withColumnsRenamed(names)
    return df


def save_bucketed(name: str, df: DataFrame, table: str, buckets: int) -> None:
    """A fact table in the catalog, in buckets by its transaction id and sorted by it.

    Tables with the same number of buckets are joined and grouped by transaction without
    a shuffle. The number must fit the largest table: a bucket is one task of a scan.
    """
    key = JOIN_KEYS[name]
    # Dealt out by the buckets' own hash: a bucket is then one file, not one of each task.
    dealt = df.repartition(buckets, key)
    dealt.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
