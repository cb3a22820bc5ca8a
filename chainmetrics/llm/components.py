"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainmetrics.llm.common import staged


def _sum_of(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for each node of ``links(a, b)``, both long.

    ``component`` is the least node that can be reached. Each round joins edges with
    the least neighbour of a node and stores the result, so that a round lost with an
    executor starts from the one before; a hub's edges can be split, as the other
    side of the join has one row for each node and is written, hence a plain shuffle. Null ends are ignored.
    """
    edges = staged(
        links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    )
    state = _sum_of(edges)
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = staged(both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
        parent = staged(large.groupBy("hi").agg(F.min("lo").alias("m")))
        small = (
            large.join(parent, "hi")
            .select(F.inline(F.array(F.struct(F.col("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))))
            .where("hi <> lo")
            .distinct()
        )
        edges = staged(small)
        if (now := _sum_of(edges)) == state:
            break
        state = now
    roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)
