"""Mixing sources to target weights by capped water-filling.

Every source should give its share of all words by weight, but none is repeated more
than some number of epochs. Sources that would be are clamped there, and what they
cannot give is shared out again by weight among the others, until no further source is
clamped. All that a round needs of the earlier ones is the water level, two whole
numbers, so a round is one aggregation over the table of sources.

A target of 2.3 times a source's size is two whole repetitions and a sample: the first
documents in a seeded order whose words fill up the rest. The place where that
order is cut is found digit by digit, from sums over 4,096 ranges of the order, so no
source is sorted or gathered, whatever its share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainmetrics.llm.common import numbered, staged

EPOCHS = 3
SEED = 11
#: Bits of a place in the seeded order, and of each of the two digits it is searched by.
BITS, DIGIT = 60, 12

_WORD = r"[^\x20\x09-\x0D]+"
_WHOLE = "decimal(38,0)"


def cycled_weights(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), source: str = "source") -> DataFrame:
    """``(source, weight)``: the weights in turn, repeating, for the sources by code point, null last."""
    sources = staged(docs.select(F.col(source).cast("string").alias("source")).distinct())
    placed = numbered(sources.withColumn("absent", F.col("source").isNull()), [], ["absent", "source"])
    cycle = F.array(*map(F.lit, weights))
    return placed.select("source", F.get(cycle, (F.col("pos") % len(weights)).cast("int")).cast("long").alias("weight"))


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def _place(key: Column, size: Column, seed: int) -> Column:
    """Where a document stands in the seeded order."""
    name = F.concat_ws(":", F.lit(seed), F.coalesce(key.cast("string"), F.lit("-")), size)
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def water_level(sources: DataFrame, epochs: int) -> tuple[int, int]:
    """``(words, weight)``: a source that is not clamped gets ``words / weight`` for each unit of its weight.

    ``sources(source_size, weight)`` is read once a round. A weight of 0 means that all are clamped.
    """
    cap = F.col("source_size").cast("decimal(20,0)") * epochs

    def sums(clamped: Column) -> tuple[int, int, int]:
        row = sources.agg(
            F.sum(F.col("source_size").cast(_WHOLE)),
            F.sum(F.when(clamped, cap).otherwise(0)),
            F.sum(F.when(~clamped, F.col("weight")).otherwise(0)),
        ).first()
        return tuple(int(x or 0) for x in row)

    total, _, free = sums(F.lit(False))
    words = total
    while free:
        _, given, left = sums(_clamped(epochs, words, free))
        if (total - given, left) == (words, free):
            break
        words, free = total - given, left
    return words, free


def _clamped(epochs: int, words: int, free: int) -> Column:
    """Whether a source's share at this level reaches its cap, in whole numbers."""
    cap = F.col("source_size").cast("decimal(19,0)") * F.lit(epochs * free).cast("decimal(18,0)")
    return cap <= _product(words)


def _product(words: int) -> Column:
    return F.col("weight").cast("decimal(18,0)") * F.lit(words).cast("decimal(19,0)")


def _same(source: str) -> Column:
    return F.col("source").eqNullSafe(F.col(source))


def plan(rows: DataFrame, weights: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """``(of, source_size, target, whole, cut)`` for each source ``of``.

    ``rows(source, size, place)`` is a written table of all documents. A document of the
    source is taken ``whole`` times, and once more where its ``place`` is at most ``cut``.
    """
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    given = weights.select(F.col("source").alias("of"), "weight")
    sources = staged(
        by_source.join(given, _same("of"), "left").select(
            F.col("source").alias("of"), "source_size", F.coalesce("weight", F.lit(0)).cast("long").alias("weight")
        )
    )
    words, free = water_level(sources, epochs)
    share = _product(words).cast("double") / F.lit(max(free, 1)).cast("double")
    target = F.when(_clamped(epochs, words, free), (F.col("source_size") * epochs).cast("double")).otherwise(share)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = staged(
        sources.withColumn("target", target)
        .withColumn("whole", whole.cast("int"))
        .withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    )

    # The range of the order in which the words needed are reached, by its first digit, then by two.
    first, second = F.shiftright("place", BITS - DIGIT), F.shiftright("place", BITS - 2 * DIGIT)
    open_ = targets.where("need > 0").select("of", "need")
    ranges = rows.groupBy("source", first.alias("digit")).agg(F.sum("size").alias("words"))
    one = _reached(ranges.join(open_, _same("of")).withColumn("base", F.lit(0).cast("long")))
    inside = rows.join(one, _same("of") & (first == F.col("reached")))
    two = _reached(inside.groupBy("of", "need", F.col("before").alias("base"), second.alias("digit")).agg(F.sum("size").alias("words")))
    inside = rows.join(two, _same("of") & (second == F.col("reached")))

    # Within it document by document: one is taken if that leaves the sum nearer to the need.
    last = inside.groupBy("of", "need", "before", "reached", "place").agg(F.sum("size").alias("words"))
    upto = F.col("before") + F.sum("words").over(Window.partitionBy("of").orderBy("place"))
    cuts = (
        last.withColumn("upto", upto)
        .groupBy("of")
        .agg(
            F.max(F.when(2 * F.col("upto") - F.col("words") <= 2 * F.col("need"), F.col("place"))).alias("taken"),
            (F.shiftleft(F.max("reached"), BITS - 2 * DIGIT) - 1).alias("none"),
        )
        .select(F.col("of").alias("source"), F.coalesce("taken", "none").alias("cut"))
    )
    return staged(
        targets.join(cuts, _same("of"), "left").select(
            "of", "source_size", "target", "whole", F.coalesce("cut", F.lit(-1)).cast("long").alias("cut")
        )
    )


def _reached(ranges: DataFrame) -> DataFrame:
    """``(of, need, before, reached)``: for each source the range that holds the last of the words needed.

    At most 4,096 rows ``(of, need, base, digit, words)`` for each source, ``base`` words before them.
    """
    upto = F.col("base") + F.sum("words").over(Window.partitionBy("of").orderBy("digit"))
    inside = (F.col("upto") - F.col("words") < F.col("need")) & (F.col("upto") >= F.col("need"))
    found = ranges.withColumn("upto", upto).where(inside)
    return staged(found.select("of", "need", (F.col("upto") - F.col("words")).alias("before"), F.col("digit").alias("reached")))


def _sized(docs: DataFrame, kept: list[Column], key: str, source: str, text: str, seed: int) -> DataFrame:
    sized = docs.select(*kept, F.col(source).cast("string").alias("source"), F.col(key).alias("key"), _size(F.col(text)).alias("size"))
    return sized.withColumn("place", _place(F.col("key"), F.col("size"), seed))


def _decided(rows: DataFrame, shares: DataFrame) -> DataFrame:
    joined = rows.join(shares, _same("of"))
    return joined.withColumn("repeats", F.col("whole") + (F.col("place") <= F.col("cut")).cast("int"))


def shares(
    docs: DataFrame,
    weights: DataFrame,
    epochs: int = EPOCHS,
    seed: int = SEED,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """``(key, size, source_size, target, repeats, taken)`` for each document.

    ``size`` counts the words ``[^\\x20\\x09-\\x0D]+`` of the whole text, none where it is null or
    empty; ``taken`` is ``size`` times ``repeats``. ``weights(source, weight)`` are whole numbers;
    a source that is not listed weighs nothing and is not taken, and null is a source like others.
    Documents that share key, source and size are taken alike, ties in the seeded order
    included; so are repeated rows. A null key is a key. An empty table gives none. Only the named columns are read.
    """
    rows = staged(_sized(docs, [], key, source, text, seed))
    decided = _decided(rows, plan(rows, weights, epochs))
    taken = (F.col("size") * F.col("repeats")).alias("taken")
    return decided.select(F.col("key").alias(key), "size", "source_size", "target", "repeats", taken)


def mixed(
    docs: DataFrame,
    weights: DataFrame,
    epochs: int = EPOCHS,
    seed: int = SEED,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns, each as often as :func:`shares` says."""
    rows = staged(_sized(docs, [], key, source, text, seed).select("source", "size", "place"))
    whole_rows = _sized(docs, [F.struct("*").alias("doc")], key, source, text, seed)
    decided = _decided(whole_rows, plan(rows, weights, epochs))
    return decided.select("doc", F.explode(F.array_repeat(F.lit(0), F.col("repeats")))).select("doc.*")
