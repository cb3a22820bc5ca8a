"""Distinct-entity counts and debut cohorts over several sources.

Both work on rows ``(source, entity, ts)``. An entity seen in two sources counts
once per source, so nothing is de-duplicated across sources here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainmetrics.functions.timeops import week_of


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda left, right: left.unionByName(right), frames)


def union_sources(frames: dict[str, DataFrame]) -> DataFrame:
    """Stack equally shaped frames under a literal ``source`` column."""
    return union_all([df.withColumn("source", F.lit(name)) for name, df in frames.items()])


def weekly_active(rows: DataFrame, out: str) -> DataFrame:
    """``(week, out)``: distinct entities per week and source, summed over sources.

    One distinct over (source, entity) equals the sum of the per-source counts.
    Spark spreads it by (week, source, entity) after a map-side combine, so
    neither a hot week nor a hot entity gathers in one task.
    """
    return (
        rows.withColumn("week", week_of("ts"))
        .groupBy("week")
        .agg(F.count_distinct("source", "entity").alias(out))
    )


def debuts(rows: DataFrame, *keys: str) -> DataFrame:
    """First week of each key; the minimum is combined before the shuffle."""
    first = rows.groupBy(*keys).agg(F.min("ts").alias("first_ts"))
    return first.select(*keys, week_of("first_ts").alias("debut"))


def weekly_active_and_new(rows: DataFrame) -> DataFrame:
    """``(week, active_users, new_users)`` in one pass over the rows.

    Rows become distinct entity-weeks first, so an entity brings at most one row
    per week to the window that finds its first week. ``new_users`` is NULL in a
    week without any debut.
    """
    seen = rows.select("source", "entity", week_of("ts").alias("week")).distinct()
    debut = F.min("week").over(Window.partitionBy("source", "entity"))
    is_user = F.col("entity").isNotNull().cast("bigint")
    return (
        seen.withColumn("debut", debut)
        .groupBy("week")
        .agg(
            F.count("entity").alias("active_users"),
            F.sum(F.when(F.col("week") == F.col("debut"), is_user)).alias("new_users"),
        )
    )
