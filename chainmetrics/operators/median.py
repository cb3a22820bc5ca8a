"""Exact median per small-grain group without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SKETCH_ACCURACY = 10_000  # rank error at most n / 10,000 ...
BAND = 0.005  # ... and the band around the middle is 50 times as wide

#: The bounds of the so many largest groups are broadcast. Any other group holds at most that
#: share of all values, and is ranked as it is.
LARGEST_GROUPS = 10_000

BELOW, INSIDE, ABOVE = -1, 0, 1


def _bounds(present: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Two values that enclose the middle, for each of the ``most`` largest groups."""
    bounds = present.groupBy(*keys).agg(
        F.percentile_approx("_value", [0.5 - BAND, 0.5 + BAND], SKETCH_ACCURACY).alias("_band"),
        F.count("*").alias("_rows"),
    )
    return (
        bounds.orderBy(F.desc("_rows"), *keys)
        .limit(most)
        .select(
            *[F.col(key).alias(f"_b_{key}") for key in keys],
            F.get("_band", F.lit(0)).alias("_low"),
            F.get("_band", F.lit(1)).alias("_high"),
        )
    )


def exact_median(df: DataFrame, keys: list[str], value: str, out: str, largest: int = LARGEST_GROUPS) -> DataFrame:
    """``(keys, out)``: the interpolated median of the non-null values.

    1. A mergeable sketch gives two bounds that enclose the middle of the group.
    2. Rows outside the bounds become one lump for each side, where they are read;
       equal values inside are counted. Only this is shuffled: about 1 % of a group
       keeps its value. Groups beyond the ``largest`` have no bounds; their values are counted.
    3. Those are ranked.

    Infinite values and NaN (the largest value) are values like any other. The bounds are a
    part of the plan, at most ``largest`` rows of it: building the frame starts no job.
    """
    present = df.select(*keys, F.col(value).cast("double").alias("_value")).filter(
        F.col("_value").isNotNull()
    )
    bounds = F.broadcast(_bounds(present, keys, largest))
    same_group = [F.col(key).eqNullSafe(F.col(f"_b_{key}")) for key in keys]
    side = (
        F.when(F.col("_value") < F.col("_low"), F.lit(BELOW))
        .when(F.col("_value") > F.col("_high"), F.lit(ABOVE))
        .otherwise(F.lit(INSIDE))
    )
    counted = (
        present.join(bounds, same_group, "left")
        .select(*keys, side.alias("_side"), F.when(side == INSIDE, F.col("_value")).alias("_point"))
        .groupBy(*keys, "_side", "_point")
        .agg(F.count("*").alias("_n"))
    )
    group = Window.partitionBy(*keys)
    ranked = counted.withColumns(
        {"_upto": F.sum("_n").over(group.orderBy("_side", "_point")), "_total": F.sum("_n").over(group)}
    )

    def at_rank(rank):
        holds = (F.col("_upto") >= rank) & (F.col("_upto") - F.col("_n") < rank)
        return F.max(F.when(holds, F.col("_point")))

    lower = at_rank(F.floor((F.col("_total") + 1) / 2))
    upper = at_rank(F.floor(F.col("_total") / 2) + 1)
    # Halved by weights, so that two infinities of one sign stay what they are.
    return ranked.groupBy(*keys).agg((lower / 2 + upper / 2).alias(out))
