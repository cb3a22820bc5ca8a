"""Near-duplicate vectors by tiles compared along principal axes.

Unit vectors are turned onto the principal axes of the whole table. Two tiles are
compared along the leading axes first. What the other axes can still add is at most
the product of the two suffix norms (Cauchy-Schwarz), so a pair is dropped as soon as
its sum and that bound stay below the threshold; the few that remain are settled by
the cosine itself, in double precision. A pair of tiles returns the number of links of
each vector and a spanning forest, never its pairs.

Tiles are cells of the leading axes, halved at medians, so a pair of tiles whose boxes are
farther apart than the threshold allows is skipped whole. Every other pair is compared, so
the work stays quadratic where vectors fill many dimensions; tiles are rows of a
table, dealt out by pair. Equal vectors are one vector with a weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainmetrics.llm.common import numbered, staged
from chainmetrics.llm.components import components
from chainmetrics.llm.simhash import _forest

THRESHOLD = 0.95
#: Vectors in a tile, and rows of it compared at once.
TILE, ROWS = 4096, 512
#: Leading axes by which tiles are cut, and tiles that one other tile is sent to at once.
LEAD, ROW = 8, 8
#: Share of the axes in each step, leading axes first.
STEPS = (0.25, 0.5)
#: What rounding may take from a sum or a norm.
SLACK = 1e-9


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def principal_axes(vectors: DataFrame, size: int) -> np.ndarray:
    """Axes by falling variance (columns), from the second moments of all unit vectors."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            x = _unit(_matrix(batch.column(0), size))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(size)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "xs"]
        )

    sums = (
        vectors.select("vector")
        .mapInArrow(moments, "i long, xs array<double>")
        .select("i", F.posexplode("xs").alias("j", "x"))
        .groupBy("i", "j")
        .agg(F.sum("x").alias("x"))
    )
    matrix = np.zeros((size, size))
    for i, j, x in sums.toLocalIterator():
        matrix[i, j] = x
    return np.linalg.eigh(matrix)[1][:, ::-1]


class TilePair:
    """Links between the vectors of two tiles."""

    def __init__(self, axes: np.ndarray, threshold: float) -> None:
        self.axes, self.threshold = axes, threshold
        size = len(axes)
        self.stops = sorted({max(1, min(size, round(size * s))) for s in STEPS})

    def near(self, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs with cosine >= threshold, some rows of ``x`` at a time."""
        rx, ry, floor, lead = x @ self.axes, y @ self.axes, self.threshold - SLACK, self.stops[0]
        rest = [(np.sqrt((rx[:, s:] ** 2).sum(1)), np.sqrt((ry[:, s:] ** 2).sum(1))) for s in self.stops]
        head = np.ascontiguousarray(ry[:, :lead].T)
        for at in range(0, len(x), ROWS):
            part = rx[at : at + ROWS, :lead] @ head
            bound = np.multiply.outer(rest[0][0][at : at + ROWS], rest[0][1])
            bound += part
            flat = np.flatnonzero(bound >= floor)
            i, j = np.divmod(flat, len(y))
            total = part.ravel()[flat]
            i += at
            for (a, b), (nx, ny) in zip(zip(self.stops, self.stops[1:], strict=False), rest[1:], strict=True):
                total = total + np.einsum("ij,ij->i", rx[i, a:b], ry[j, a:b])
                left = total + nx[i] * ny[j] >= floor
                i, j, total = i[left], j[left], total[left]
            for cut in range(0, len(i), 1 << 16):
                p, q = i[cut : cut + (1 << 16)], j[cut : cut + (1 << 16)]
                exact = np.einsum("ij,ij->i", x[p], y[q]) >= self.threshold
                yield p[exact], q[exact]


_FOUND = "node long, links long, other long"


def _compare(axes: np.ndarray, threshold: float):
    """Links of the tile ``low`` with each other tile of its row, and with itself where it is one of them."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        pair, size, low = TilePair(axes, threshold), len(axes), key[0].as_py()
        table = table.combine_chunks()
        at = {t: i for i, t in enumerate(table.column("tile").to_pylist())}

        def opened(tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            row = table.slice(at[tile], 1)
            nodes, weights = (row.column(n).combine_chunks().flatten().to_numpy(zero_copy_only=False) for n in ("nodes", "weights"))
            return nodes, weights, _unit(_matrix(row.column("vectors").combine_chunks().flatten(), size))

        nodes, weights, x = opened(low)
        own = np.zeros(len(x), np.int64)
        a, b, counted = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        others = table.filter(table.column("asked")).column("tile").to_pylist()
        for tile in sorted(others):
            alone = tile == low
            other_nodes, other_weights, y = (nodes, weights, x) if alone else opened(tile)
            theirs = np.zeros(len(y), np.int64)
            for i, j in pair.near(x, y):
                if alone:
                    i, j = i[i < j], j[i < j]
                np.add.at(own, i, other_weights[j])
                np.add.at(own if alone else theirs, j, weights[i])
                a, b = _forest(np.concatenate((a, nodes[i])), np.concatenate((b, other_nodes[j])))
            counted += zip(other_nodes[theirs > 0].tolist(), theirs[theirs > 0].tolist(), strict=True)
        counted += zip(nodes[own > 0].tolist(), own[own > 0].tolist(), strict=True)
        rows = [(n, c, None) for n, c in counted] + [(n, None, m) for n, m in zip(a.tolist(), b.tolist(), strict=True)]
        columns = zip(*rows, strict=True) if rows else [[]] * 3
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["node", "links", "other"])

    return run


def _placed(axes: np.ndarray, lead: int):
    """Each vector's coordinates on the leading axes, and the norm of what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(_matrix(batch.column("vector"), len(axes))) @ axes
            at = np.column_stack((x[:, :lead], np.linalg.norm(x[:, lead:], axis=1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(at), pa.list_(pa.float64()))], names=[*batch.schema.names, "at"])

    return run


def tiled(classes: DataFrame, axes: np.ndarray, tile: int) -> DataFrame:
    """``classes`` with ``at`` and ``tile``: cells halved at the medians of one leading axis after another.

    A cell that medians cannot part, as its vectors agree on the leading axes, is dealt out by
    hash, so no tile is much larger than ``tile``.
    """
    lead = min(LEAD, len(axes))
    kinds = {n: classes.schema[n].dataType.simpleString() for n in ("node", "weight", "vector")}
    schema = ", ".join(f"{n} {k}" for n, k in kinds.items())
    rows = classes.select("node", "weight", "vector").mapInArrow(_placed(axes, lead), f"{schema}, at array<double>")
    rows = staged(rows.withColumn("cell", F.lit(0).cast("long")))
    places = rows.select("node", "at", "cell")
    halvings = max(0, int(np.ceil(np.log2(max(1, rows.count()) / tile))))
    for k in range(halvings):
        value = F.get("at", F.lit(k % lead))
        middle = staged(places.groupBy("cell").agg(F.percentile_approx(value, 0.5).alias("_middle")).withColumnRenamed("cell", "_cell"))
        places = places.join(middle, F.col("cell") == F.col("_cell"))
        places = places.withColumn("cell", F.col("cell") * 2 + (value > F.col("_middle")).cast("long")).drop("_cell", "_middle")
        places = staged(places)
    pieces = staged(places.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("long").alias("pieces")).withColumnRenamed("cell", "_cell"))
    tiles = numbered(staged(pieces.select("_cell", F.explode(F.expr("sequence(0, pieces - 1)")).alias("_piece"))), [], ["_cell", "_piece"])
    places = places.join(pieces, F.col("cell") == F.col("_cell")).drop("_cell")
    places = places.withColumn("piece", F.pmod(F.xxhash64("node"), "pieces"))
    named = places.join(tiles, (F.col("cell") == F.col("_cell")) & (F.col("piece") == F.col("_piece")))
    named = named.select(F.col("node").alias("_node"), F.col("pos").cast("int").alias("tile"))
    return rows.join(named, F.col("node") == F.col("_node")).select("node", "weight", "vector", "at", "tile")


def tile_pairs(tiles: DataFrame, threshold: float) -> DataFrame:
    """``(low, high)``: the pairs of ``tiles(tile, box)`` that may hold a link.

    Two unit vectors are at least as far apart as the boxes of their tiles, in the coordinates of
    the leading axes and the suffix norm, and their cosine is 1 - distance^2 / 2.
    """
    number = tiles.count()
    ahead = F.explode(F.sequence("tile", F.lit(number - 1)))
    asked = tiles.select(F.col("tile").alias("low"), F.col("box").alias("one"), ahead.alias("high"))
    both = asked.join(tiles.select(F.col("tile").alias("high"), F.col("box").alias("two")), "high")

    def gap(a: Column, b: Column) -> Column:
        return F.greatest(a.least - b.most, b.least - a.most, F.lit(0.0))

    squares = F.aggregate(F.zip_with("one", "two", lambda a, b: F.pow(gap(a, b), 2.0)), F.lit(0.0), lambda x, y: x + y)
    return both.where(1 - squares / 2 >= threshold - SLACK).select("low", "high")


def _boxes(rows: DataFrame, lead: int) -> DataFrame:
    axes = [F.get("at", F.lit(i)) for i in range(lead + 1)]
    return rows.groupBy("tile").agg(F.array(*(F.struct(F.min(x).alias("least"), F.max(x).alias("most")) for x in axes)).alias("box"))


def _found(classes: DataFrame, size: int, threshold: float, tile: int) -> DataFrame:
    own = classes.where(F.size("vector") == size)
    axes = principal_axes(own, size)
    rows = staged(tiled(own, axes, tile))
    packed = rows.groupBy("tile").agg(F.collect_list(F.struct("node", "weight", "vector")).alias("xs"))
    packed = staged(
        packed.select("tile", F.col("xs.node").alias("nodes"), F.col("xs.weight").alias("weights"), F.col("xs.vector").alias("vectors"))
    )
    # A tile is sent once with each row of ``ROW`` others that it may have links with.
    pairs = tile_pairs(staged(_boxes(rows, min(LEAD, size))), threshold)
    wanted = pairs.select("low", F.expr(f"high div {ROW}").alias("row"), F.explode(F.array("low", "high")).alias("t"), "high")
    wanted = staged(wanted.groupBy("low", "row", "t").agg(F.max(F.col("t") == F.col("high")).alias("asked")))
    dealt = wanted.join(packed, F.col("t") == F.col("tile")).drop("t")
    return dealt.groupBy("low", "row").applyInArrow(_compare(axes, threshold), _FOUND)


def near_duplicates(
    embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, tile: int = TILE
) -> DataFrame:
    """``(key, n_links, component_id, kept)`` for each row.

    Two rows are linked if their vectors have one length and a cosine of at least
    ``threshold``. Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing, nor with themselves. ``component_id`` is the least key that links
    reach, the row's own included; null keys are ignored for it unless alone. Repeated
    rows are rows of their own. Other columns are ignored.
    """
    if threshold <= 0:
        raise ValueError("threshold must be above zero")
    rows = embeddings.select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    valid = rows.where(usable)
    grouped = valid.groupBy("vector").agg(F.count("*").alias("weight"), F.min("key").alias("least"))
    classes = staged(grouped.withColumn("node", F.monotonically_increasing_id()))
    sizes = [r[0] for r in classes.select(F.size("vector")).distinct().collect()]
    found = classes.sparkSession.createDataFrame([], _FOUND)
    for size in sizes:
        found = found.unionByName(staged(_found(classes, size, threshold, tile)))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    labelled = classes.join(groups, "node", "left").withColumn("label", F.coalesce("component", "node"))
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    named = labelled.join(least, "label").join(links, "node", "left")
    named = named.select("vector", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    joined = valid.join(named, "vector").select("key", "n_links", F.coalesce("component_id", "key").alias("component_id"))
    rest = rows.where(~usable).select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    both = joined.unionByName(rest)
    return both.select(F.col("key").alias(key), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))
