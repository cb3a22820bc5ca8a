"""Sales kept as the two sides they are made of, and exact figures without pairing them.

Most venues pair two kinds of rows of one transaction: listings with buyers, sale logs with
prices. The sales of a transaction are then a product, and its number of rows and
sum of prices follow from those of its sides. An equal sale that several venues report counts once.
As sets of such products overlap in products again, that is settled by inclusion and
exclusion over the sides, and no sale row is built.

A part is ``(kind, tx_id, week, currency, buyer, price, nft_collection)`` with only the columns
that its kind holds. The side with the week and the currency is called dated.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainmetrics.operators.entities import union_all
from chainmetrics.session import written

FIELDS = {
    "tx_id": "string",
    "week": "date",
    "currency": "string",
    "buyer": "string",
    "price": "double",
    "nft_collection": "string",
}

# Kinds of parts. Whole sales stand for themselves.
MARKET, PAID = "market", "paid"
LISTED, BOUGHT = "listed", "bought"  # dated prices and collections; buyers
SOLD, APPROVED = "sold", "approved"  # dated buyers and collections; prices
CALLED, ROUTED = "called", "routed"  # dated prices; buyers and collections
SOUGHT, TRANSFERRED = "sought", "transferred"  # dated buyers; prices

WHOLE = {MARKET: "marketplace", PAID: "seaport"}
SIDES = {
    "storefront": (LISTED, BOUGHT),
    "log_pair": (SOLD, APPROVED),
    "router": (CALLED, ROUTED),
    "seaport": (SOUGHT, TRANSFERRED),
}
DATED = {dated: venue for venue, (dated, _) in SIDES.items()}
OTHER = {other: venue for venue, (_, other) in SIDES.items()}
#: A transaction whose sides make more pairs than this in a venue is not paired. Either way the figures are exact.
PAIRS = 1 << 16
#: Dated kinds that hold the price.
PRICED = (LISTED, CALLED)


def part(kind: str, **columns: Column) -> Column:
    """One part as a struct; columns that are not given are null."""
    fields = [columns.get(name, F.lit(None)).cast(type_).alias(name) for name, type_ in FIELDS.items()]
    return F.struct(F.lit(kind).alias("part"), *fields)


def tagged(df: DataFrame, roles: list[tuple[Column, Column]], reach: Column) -> DataFrame:
    """The parts that rows of one table give, by ``(condition, part)``, in one scan of it.

    ``reach`` holds wherever a condition does, in plain comparisons only: a scan takes a disjunction
    whole or not at all. The conditions themselves decide in the array, where they are not merged with it.
    """
    parts = F.array_compact(F.array(*[F.when(condition, made) for condition, made in roles]))
    return df.filter(reach).select(F.inline(parts))


def distinct_parts(feeds: list[DataFrame]) -> DataFrame:
    """Each part once.

    ``kind`` is an aggregate, so a filter on it stays above the shuffle; users of several kinds
    then share one, and the scans below it.
    """
    return union_all(feeds).groupBy("part", *FIELDS).agg(F.max("part").alias("kind")).select("kind", *FIELDS)


def _venue(names: dict[str, str], kind: str = "kind") -> Column:
    return reduce(lambda case, item: case.when(F.col(kind) == item[0], item[1]), names.items(), F)


def _of(parts: DataFrame, kinds: dict[str, str]) -> DataFrame:
    return parts.filter(F.col("kind").isin(*kinds)).withColumn("venue", _venue(kinds))


def sale_rows(parts: DataFrame) -> DataFrame:
    """``(venue, *FIELDS)``: the sales themselves, each once for each venue.

    Sides without a transaction have no venue here and meet nothing. A null-safe join adds
    no filter below the parts' shuffle, so both of its sides read one.
    """
    placed = parts.withColumn("venue", F.when(F.col("tx_id").isNotNull(), _venue({**DATED, **OTHER})))
    other = placed.filter(F.col("kind").isin(*OTHER)).select(
        *[F.col(name).alias(f"_{name}") for name in ("tx_id", "venue", "buyer", "price", "nft_collection")]
    )
    dated = placed.filter(F.col("kind").isin(*DATED, *WHOLE))
    pairs = dated.join(other, F.col("tx_id").eqNullSafe(F.col("_tx_id")) & (F.col("venue") == F.col("_venue")), "left")
    whole = _venue(WHOLE)
    both = {name: F.coalesce(name, f"_{name}").alias(name) for name in ("buyer", "price", "nft_collection")}
    columns = [F.coalesce(whole, "_venue").alias("venue"), *[both.get(name, F.col(name)) for name in FIELDS]]
    return pairs.filter(whole.isNotNull() | F.col("_venue").isNotNull()).select(*columns).distinct()


def venue_products(parts: DataFrame) -> DataFrame:
    """``(tx_id, source, week, currency, rows, price)``: sales of each venue, pairs and whole ones apart."""
    sides = parts.groupBy("tx_id", "kind", "week", "currency").agg(F.count("*").alias("n"), F.sum("price").alias("sum"))
    other = _of(sides, OTHER).select(
        F.col("tx_id").alias("_tx_id"), F.col("venue").alias("_venue"), F.col("n").alias("_n"), F.col("sum").alias("_sum")
    )
    pairs = _of(sides, DATED).join(other, (F.col("tx_id") == F.col("_tx_id")) & (F.col("venue") == F.col("_venue")))
    price = F.when(F.col("kind").isin(*PRICED), F.col("sum") * F.col("_n")).otherwise(F.col("n") * F.col("_sum"))
    columns = ["tx_id", F.col("kind").alias("source"), "week", "currency"]
    paired = pairs.select(*columns, (F.col("n") * F.col("_n")).alias("rows"), price.alias("price"))
    whole = sides.filter(F.col("kind").isin(*WHOLE)).select(*columns, F.col("n").alias("rows"), F.col("sum").alias("price"))
    return paired.unionByName(whole)


def weekly(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts by week as :func:`weekly_counts` and sums as :func:`weekly_sums` has them.

    Sales of ordinary transactions are paired and made distinct, which is little work. Only
    crowded ones, if there are any, are left as sides. ``parts`` should be a written table.
    """
    crowded = written(_crowded(parts))
    if crowded.isEmpty():
        sales = written(_paired(parts))
        return _counted(sales), _summed(_priced(sales))
    same = F.col("tx_id") == F.col("_tx_id")
    sales = written(_paired(parts.join(crowded, same, "left_anti")))
    sides = written(parts.join(crowded, same, "left_semi"))
    products = written(venue_products(sides))
    named = _names(sides, products).unionByName(sales.select("week", "tx_id", "buyer", "nft_collection"))
    return _counted(named), _summed(_unpaired_sums(sides, products).unionByName(_priced(sales)))


def _crowded(parts: DataFrame) -> DataFrame:
    """Transactions with a long side, or with two whose pairs are many."""
    sides = {kind: F.count_if(F.col("kind") == kind).cast("double") + 1.0 for kind in (*DATED, *OTHER)}
    many = [sides[dated] * sides[other] > PAIRS for dated, other in SIDES.values()]
    counted = parts.groupBy(F.col("tx_id").alias("_tx_id")).agg(reduce(or_, many).alias("_many"))
    return counted.filter("_many").filter(F.col("_tx_id").isNotNull()).select("_tx_id")


def _paired(parts: DataFrame) -> DataFrame:
    """The sales themselves, one of several venues once."""
    other = _of(parts, OTHER).select(
        *[F.col(name).alias(f"_{name}") for name in ("tx_id", "venue", "buyer", "price", "nft_collection")]
    )
    pairs = _of(parts, DATED).join(other, (F.col("tx_id") == F.col("_tx_id")) & (F.col("venue") == F.col("_venue")))
    both = {name: F.coalesce(name, f"_{name}").alias(name) for name in ("buyer", "price", "nft_collection")}
    whole = parts.filter(F.col("kind").isin(*WHOLE)).select(*FIELDS)
    return pairs.select(*[both.get(name, F.col(name)) for name in FIELDS]).unionByName(whole).distinct()


def _priced(sales: DataFrame) -> DataFrame:
    return sales.groupBy("week", "currency").agg(F.count("*").alias("rows"), F.sum("price").alias("price"))


def _summed(figures: DataFrame) -> DataFrame:
    sums = figures.groupBy("week", "currency").agg(F.sum("rows").alias("rows"), F.sum("price").alias("price"))
    return sums.filter("rows > 0")


def _counted(named: DataFrame) -> DataFrame:
    return named.groupBy("week").agg(
        F.count_distinct("tx_id").alias("sales"),
        F.count_distinct("buyer").alias("nft_buyers"),
        F.count_distinct("nft_collection").alias("active_collections"),
    )


def weekly_sums(parts: DataFrame, products: DataFrame) -> DataFrame:
    """``(week, currency, rows, price)`` over the sales, each counted once whatever its venues.

    ``parts`` and their ``products`` should be written tables, as they are read many times. Only
    transactions that occur in several venues under one currency can hold a sale twice; where
    there are none, all that is left of the plan is one aggregation.
    """
    return _summed(_unpaired_sums(parts, products))


def _unpaired_sums(parts: DataFrame, products: DataFrame) -> DataFrame:
    shared = written(
        products.groupBy("tx_id", "currency")
        .agg(F.min("source").alias("_first"), F.max("source").alias("_last"))
        .filter(F.col("_first") != F.col("_last"))
        .select(F.col("tx_id").alias("_tx_id"))
    )
    columns = ["week", "currency", "rows", "price"]
    figures = products.select(*columns)
    if not shared.isEmpty():
        held = written(parts.join(shared, F.col("tx_id").eqNullSafe(F.col("_tx_id")), "left_semi"))
        figures = figures.unionByName(_repeats(held).select("week", "currency", "rows", F.nullif("price", F.lit(0.0)).alias("price")))
    return figures


def _looked_up(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of ``table``, one row for each of ``keys``, null where it has none.

    The table is dealt out by all its columns first: the join then shuffles both sides,
    and a key that many rows hold can be split.
    """
    renamed = table.repartition(*table.columns).withColumnsRenamed({key: f"_{key}" for key in keys})
    same = reduce(and_, [F.col(key).eqNullSafe(F.col(f"_{key}")) for key in keys])
    return rows.join(renamed, same, "left").drop(*[f"_{key}" for key in keys])


def _any(condition: Column) -> Column:
    return F.coalesce(F.bool_or(condition), F.lit(False))


def _dates(kind: str) -> Column:
    return F.collect_set(F.when(F.col("kind") == kind, F.struct("week", "currency")))


def _dated(dates: str) -> Column:
    return F.array_contains(dates, F.struct("week", "currency"))


def _sums(**conditions: Column) -> list[Column]:
    """The number and the prices of the rows under each condition."""
    columns = []
    for name, condition in conditions.items():
        columns += [F.count_if(condition).alias(f"n_{name}"), F.sum(F.when(condition, F.col("price"))).alias(f"sum_{name}")]
    return columns


def _counts(**conditions: Column) -> list[Column]:
    return [F.count_if(condition).alias(f"of_{name}") for name, condition in conditions.items()]


def _times(name: str, sign: int) -> list[Column]:
    """What an overlap, the product of its two sides, adds to rows and prices."""
    return [sign * F.col(f"n_{name}") * F.col(f"of_{name}"), F.coalesce(sign * F.col(f"sum_{name}") * F.col(f"of_{name}"), F.lit(0.0))]


def _met(prices: DataFrame, buyers: DataFrame, keys: list[str]) -> DataFrame:
    renamed = buyers.withColumnsRenamed({key: f"_{key}" for key in keys})
    return prices.join(renamed, reduce(and_, [F.col(key).eqNullSafe(F.col(f"_{key}")) for key in keys]))


def _repeats(parts: DataFrame) -> DataFrame:
    """``(week, currency, rows, price)`` to be added to the sums over venues, mostly negative.

    Listings may report what any other venue does, routed calls and transfers each
    other's; the two currencies of the others differ. A transaction's prices and buyers
    are looked up, never paired.
    """

    def of(*kinds: str) -> DataFrame:
        return parts.filter(F.col("kind").isin(*kinds))

    kind, unnamed = F.col("kind"), F.col("nft_collection").isNull()
    prices = (
        of(APPROVED, TRANSFERRED, CALLED)
        .groupBy("tx_id", "price")
        .agg(_any(kind == APPROVED).alias("approved"), _any(kind == TRANSFERRED).alias("transferred"), _dates(CALLED).alias("calls"))
    )
    buyers = (
        of(BOUGHT, ROUTED)
        .groupBy("tx_id", "buyer")
        .agg(_any(kind == BOUGHT).alias("bought"), _any((kind == ROUTED) & unnamed).alias("routed"))
    )
    priced = _looked_up(of(LISTED, CALLED, *WHOLE), prices, ["tx_id", "price"]).withColumn("called", _dated("calls"))
    handed = _looked_up(of(SOLD, ROUTED, SOUGHT), buyers, ["tx_id", "buyer"])

    # Sales without a collection: routed and transferred, listed and transferred, all three.
    day = ["tx_id", "week", "currency"]
    listed = (kind == LISTED) & unnamed & F.col("transferred")
    both = priced.groupBy(*day).agg(*_sums(a=(kind == CALLED) & F.col("transferred"), b=listed, c=listed & F.col("called")))
    sought = handed.filter(kind == SOUGHT).groupBy(*day).agg(*_counts(a=F.col("routed"), b=F.col("bought"), c=F.col("routed") & F.col("bought")))
    met = _met(both, sought, day)
    terms = [sum(x) for x in zip(_times("a", -1), _times("b", -1), _times("c", 1), strict=True)]
    found = [met.select("week", "currency", terms[0].alias("rows"), terms[1].alias("price"))]

    # Sales with any: listed and approved, listed and routed.
    item = [*day, "nft_collection"]
    by_item = priced.filter(kind == LISTED).groupBy(*item).agg(*_sums(d=F.col("approved"), e=F.col("called")))
    sold = handed.filter(kind == SOLD).groupBy(*item).agg(*_counts(d=F.col("bought")))
    routed = handed.filter(kind == ROUTED).groupBy("tx_id", "nft_collection").agg(*_counts(e=F.col("bought")))
    for name, side, keys in (("d", sold, item), ("e", routed, ["tx_id", "nft_collection"])):
        rows, price = _times(name, -1)
        found.append(_met(by_item, side, keys).select("week", "currency", rows.alias("rows"), price.alias("price")))

    # Whole sales: one stays unless it is in a product too.
    elements = (
        of(SOLD, ROUTED, SOUGHT)
        .groupBy("tx_id", "buyer", "nft_collection")
        .agg(_dates(SOLD).alias("sold"), _any(kind == ROUTED).alias("named"), _dates(SOUGHT).alias("sought"))
    )
    listings = of(LISTED).select(*item, "price", F.lit(True).alias("listed"))
    whole = _looked_up(priced.filter(kind.isin(*WHOLE)), buyers, ["tx_id", "buyer"])
    whole = _looked_up(whole, elements, ["tx_id", "buyer", "nft_collection"])
    whole = _looked_up(whole, listings, [*item, "price"])
    again = [
        F.col("approved") & _dated("sold"),
        F.col("called") & F.col("named"),
        unnamed & F.col("transferred") & _dated("sought"),
        F.col("listed") & F.col("bought"),
    ]
    again = reduce(or_, [F.coalesce(x, F.lit(False)) for x in again])
    counted = whole.groupBy(*FIELDS).agg((F.lit(1) - F.count("*") - F.max(again.cast("int"))).alias("rows"))
    found.append(counted.select("week", "currency", "rows", (F.col("rows") * F.col("price")).alias("price")))
    return union_all(found)


def weekly_counts(parts: DataFrame, products: DataFrame) -> DataFrame:
    """``(week, sales, nft_buyers, active_collections)``: distinct transactions, buyers and collections.

    Names of the side without a week take on the weeks of the other side, a few for each
    transaction, and are not paired with its rows.
    """
    return _counted(_names(parts, products))


def _names(parts: DataFrame, products: DataFrame) -> DataFrame:
    """``(week, tx_id, buyer, nft_collection)``: the names that the sales of a week hold, not side by side."""
    complete = (
        products.filter(F.col("source").isin(*DATED))
        .select(F.col("tx_id").alias("_tx_id"), _venue(DATED, "source").alias("_venue"), F.col("week").alias("_week"))
        .distinct()
    )
    # Dealt out by more than the join's columns: both of its sides are shuffled then.
    complete = complete.repartition("_tx_id", "_venue", "_week")
    same = (F.col("tx_id") == F.col("_tx_id")) & (F.col("venue") == F.col("_venue"))
    names = ["tx_id", "buyer", "nft_collection"]
    dated = _of(parts, DATED).join(complete, same & F.col("week").eqNullSafe(F.col("_week")), "left_semi")
    other = _of(parts, OTHER).select("venue", *names).distinct().join(complete, same)
    named = [
        dated.select("week", *names),
        other.select(F.col("_week").alias("week"), *names),
        parts.filter(F.col("kind").isin(*WHOLE)).select("week", *names),
    ]
    return union_all(named)
