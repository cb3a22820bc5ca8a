"""Hard negatives by cover trees over norm-augmented candidates.

A component more, ``sqrt(M^2 - |x|^2)``, gives all candidates of a tree one norm M, so that an
inner product with an anchor is a distance: ``|q|^2 + M^2 - 2 q.x``. A node of a cover tree
has a centre and the radius that covers its points; the radius bounds the inner
product of all of them from both sides. An anchor goes down its trees level by level and skips
nodes that lie outside of its windows or below the least of the rows it has already found;
the leaves that remain are taken best bound first, and their rows are verified exactly.

Candidates are dealt to trees of some thousand rows by the nearest of a few centres that a
bounded sample gives; a centre with more rows has more trees, so no centre, label or vector
gathers in one task. Anchors come in blocks of a bounded number, each a stated query
set that meets all trees; a task keeps only the best rows of each anchor, whatever the number of
its trees.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainmetrics.llm.common import numbered, shared_folder, staged

POSITIVES, NEGATIVES = 5, 10
#: A negative's score in hundredths of the positive's.
LOW, HIGH = 30, 90
SCALE = 256
#: Rows of a tree, points of a leaf, and how much a child's radius shrinks.
TREE, LEAF, BASE = 4096, 32, 1.5
#: Rows that the centres are chosen from, and their number.
SAMPLE, CENTRES = 4096, 64
#: Anchors of a block, and points verified before bounds are looked at again, twice as many each time.
BLOCK, WAVE = 4096, 128
#: What rounding may take from a bound, relative to its scale.
SLACK = 1e-9

_EXACT = 2.0**53
_LONG = 2**63 - 1


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers; those beyond 64 bits become the limit."""
    if not q.size or not x.size or np.abs(q).max() * np.abs(x).max() * q.shape[1] < _EXACT:
        return (q @ x.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    products = whole(q).dot(whole(x).T)
    return np.clip(products, -_LONG, _LONG).astype(np.int64)


def _augmented(x: np.ndarray) -> np.ndarray:
    norms = np.einsum("ij,ij->i", x, x)
    return np.column_stack((x, np.sqrt(np.maximum(norms.max(initial=0.0) - norms, 0.0))))


def _distances(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    d = x - centre
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def spread(x: np.ndarray, most: int, radius: float = 0.0) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Centres, farthest first from row 0, until all rows are within ``radius`` of one.

    Returns the rows that are centres (``most`` at most), and the nearest of each row with its distance.
    """
    centres, nearest, d = [0], np.zeros(len(x), np.int64), _distances(x, x[0])
    while len(centres) < most and d.max() > radius:
        far = int(d.argmax())
        new = _distances(x, x[far])
        closer = new < d
        nearest[closer], d[closer] = len(centres), new[closer]
        centres.append(far)
    return centres, nearest, d


@dataclass
class CoverTree:
    """Points in the order of the leaves; nodes level by level, the root first.

    Node ``i`` holds points ``start[i]:end[i]``, all within ``radius[i]`` of point ``centre[i]``.
    """

    points: np.ndarray
    order: np.ndarray
    start: np.ndarray
    end: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    parent: np.ndarray
    level: np.ndarray
    leaf: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> CoverTree:
        lifted = _augmented(x)
        order, nodes, level = np.arange(len(x)), [], [(0, len(x), 0, -1)]
        depth = 0
        while level:
            below = []
            for start, end, centre, parent in level:
                rows = order[start:end]
                middle, radius = int(rows[centre]), float(_distances(lifted[rows], lifted[rows[centre]]).max())
                leaf = end - start <= LEAF or radius == 0
                if not leaf:
                    # The centre comes first, so that it is the first child's centre too.
                    rows = np.concatenate((rows[centre : centre + 1], np.delete(rows, centre)))
                    most = (end - start) // 2
                    centres, nearest, near = spread(lifted[rows], most, radius / BASE)
                    # Where half of the points would be centres, the next level tells nothing apart.
                    leaf = len(centres) == most and near.max() > radius / BASE
                if not leaf:
                    by_child = np.argsort(nearest, kind="stable")
                    order[start:end] = rows[by_child]
                    place = np.argsort(by_child)
                    ends = np.searchsorted(nearest[by_child], np.arange(len(centres)), "right").tolist()
                    for first, last, row in zip([0, *ends], ends, centres, strict=False):
                        below.append((start + first, start + last, int(place[row]) - first, len(nodes)))
                nodes.append((start, end, middle, radius, parent, depth, leaf))
            level, depth = below, depth + 1
        start, end, centre, radius, parent, levels, leaf = zip(*nodes, strict=True)
        return cls(x[order], order, *map(np.array, (start, end)), np.argsort(order)[list(centre)], *map(np.array, (radius, parent, levels, leaf)))


class Best:
    """The best rows found for each window of each anchor: higher scores first, then smaller ids."""

    def __init__(self, windows: int, most: int) -> None:
        self.most = most
        self.window, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = np.full(windows, -_LONG - 1, np.int64)

    def add(self, window: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """A row that is found twice, by id and score, counts once."""
        w, s, i = (np.concatenate(pair) for pair in ((self.window, window), (self.score, score), (self.id, ids)))
        order = np.lexsort((i, ~s, w))
        w, s, i = w[order], s[order], i[order]
        new = np.ones(len(w), bool)
        new[1:] = (w[1:] != w[:-1]) | (s[1:] != s[:-1]) | (i[1:] != i[:-1])
        w, s, i = w[new], s[new], i[new]
        first = np.searchsorted(w, w, "left")
        rank = np.arange(len(w)) - first
        self.window, self.score, self.id = (a[rank < self.most] for a in (w, s, i))
        full = rank == self.most - 1
        self.least[w[full]] = s[full]


@dataclass
class Queries:
    """Anchors of one vector length with the windows that their rows' scores must lie in."""

    number: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same_label: bool
    best: Best

    def search(self, tree: CoverTree, ids: np.ndarray, labels: np.ndarray) -> None:
        q = self.vectors
        most = float(np.einsum("ij,ij->i", tree.points, tree.points).max())
        scale = np.einsum("ij,ij->i", q, q)[:, None] + most
        slack = SLACK * (scale + 1)
        alive = np.zeros((len(q), len(tree.start)), bool)
        upper = np.zeros(alive.shape)
        lower = np.zeros(alive.shape)
        for level in range(int(tree.level[-1]) + 1):
            at = np.flatnonzero(tree.level == level)
            if level:
                at = at[alive[:, tree.parent[at]].any(axis=0)]
            if not len(at):
                break
            d = np.sqrt(np.maximum(scale - 2 * (q @ tree.points[tree.centre[at]].T), 0.0))
            upper[:, at] = (scale - np.maximum(d - tree.radius[at], 0.0) ** 2) / 2 + slack
            lower[:, at] = (scale - (d + tree.radius[at]) ** 2) / 2 - slack
            alive[:, at] = self._useful(upper[:, at], lower[:, at])
            if level:
                alive[:, at] &= alive[:, tree.parent[at]]
        leaves = np.flatnonzero(tree.leaf & alive.any(axis=0))
        bound = np.where(alive[:, leaves], upper[:, leaves], -np.inf).max(axis=0)
        leaves = leaves[np.argsort(-bound, kind="stable")]
        sizes = np.cumsum(tree.end[leaves] - tree.start[leaves])
        waves = np.floor(np.log2(sizes / WAVE + 1))
        for wave in np.split(leaves, np.flatnonzero(np.diff(waves)) + 1):
            left = alive[:, wave] & self._useful(upper[:, wave], lower[:, wave])
            who, wave = np.flatnonzero(left.any(axis=1)), wave[left.any(axis=0)]
            if len(who):
                points = np.concatenate([np.arange(tree.start[n], tree.end[n]) for n in wave])
                self._verify(who, tree.points[points], ids[points], labels[points])

    def _useful(self, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Whether a node may hold a row that one of the anchor's windows still wants."""
        found = np.zeros(upper.shape, bool)
        least = self.best.least.reshape(self.low.shape)
        for w in range(self.low.shape[1]):
            floor = np.maximum(self.low[:, w], least[:, w])[:, None]
            found |= (upper >= floor) & (lower <= self.high[:, w][:, None])
        return found

    def _verify(self, who: np.ndarray, points: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        scores = _scores(self.vectors[who], points)
        fits = self.labels[who][:, None] == labels
        fits = fits & (self.ids[who][:, None] != ids) if self.same_label else ~fits
        windows = self.low.shape[1]
        least = self.best.least.reshape(self.low.shape)
        found = []
        for w in range(windows):
            floor = np.maximum(self.low[who, w], least[who, w])[:, None]
            i, j = np.nonzero(fits & (scores >= floor) & (scores <= self.high[who, w][:, None]))
            found.append((who[i] * windows + w, scores[i, j], ids[j]))
        window, score, id_ = (np.concatenate(parts) for parts in zip(*found, strict=True))
        if len(window):
            self.best.add(window, score, id_)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def whole_numbers(x: np.ndarray) -> np.ndarray:
    return np.floor(x.astype(np.float64) * SCALE)


def centres_of(rows: DataFrame, size: int, sample: int = SAMPLE) -> np.ndarray:
    """Centres of the augmented vectors of a sample, the rows least by hash."""
    chosen = rows.where(F.size("vector") == size).orderBy(F.xxhash64("id", "vector")).limit(sample).select("vector").toArrow()
    x = whole_numbers(_matrix(chosen.column(0).combine_chunks(), size))
    return x[spread(_augmented(x), CENTRES)[0]]


def _dealt(centres: dict[int, np.ndarray]):
    """Each row's nearest centre, as vectors of one norm would have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            near = np.zeros(len(sizes), np.int32)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                x = whole_numbers(_matrix(batch.column("vector").take(pa.array(at)), size))
                c = centres[int(size)]
                norms = np.concatenate([np.einsum("ij,ij->i", v, v) for v in (x, c)])
                extra = np.sqrt(np.maximum(norms.max() - norms, 0.0))
                near[at] = (x @ c.T + np.multiply.outer(extra[: len(x)], extra[len(x) :])).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32())], names=[*batch.schema.names, "centre"])

    return run


_NODES = ("start", "end", "centre", "radius", "parent", "level", "leaf")
_TREE = (
    "size int, ids array<long>, labels array<int>, points array<double>, start array<int>, end array<int>, "
    "centre array<int>, radius array<double>, parent array<int>, level array<int>, leaf array<boolean>"
)
_TREE_ARROW = pa.schema(
    [
        ("size", pa.int32()),
        ("ids", pa.list_(pa.int64())),
        ("labels", pa.list_(pa.int32())),
        ("points", pa.list_(pa.float64())),
        *[(n, pa.list_(pa.int32())) for n in ("start", "end", "centre")],
        ("radius", pa.list_(pa.float64())),
        *[(n, pa.list_(pa.int32())) for n in ("parent", "level")],
        ("leaf", pa.list_(pa.bool_())),
    ]
)


def _planted(table: pa.Table) -> pa.Table:
    table = table.combine_chunks()
    size = table.column("size")[0].as_py()
    tree = CoverTree.of(whole_numbers(_matrix(table.column("vector").combine_chunks(), size)))
    ids, labels = (table.column(n).to_numpy()[tree.order] for n in ("id", "label"))
    row = dict(size=size, ids=ids, labels=labels, points=tree.points.ravel())
    row |= {n: getattr(tree, n) for n in _NODES}
    arrays = [pa.array([row[f.name]], f.type) for f in _TREE_ARROW]
    return pa.Table.from_arrays(arrays, schema=_TREE_ARROW)


def planted(rows: DataFrame, tree: int = TREE) -> DataFrame:
    """Cover trees over all of ``rows(id, label, vector)``, one a row, of about ``tree`` points at most."""
    rows = rows.withColumn("size", F.size("vector"))
    sizes = [r[0] for r in rows.select("size").distinct().collect()]
    centres = {size: centres_of(rows, size) for size in sizes}
    dealt = staged(rows.mapInArrow(_dealt(centres), "id long, label int, vector array<double>, size int, centre int"))
    pieces = staged(
        dealt.groupBy(F.col("size").alias("_size"), F.col("centre").alias("_centre")).agg(
            F.ceil(F.count("*") / tree).cast("int").alias("_pieces")
        )
    )
    piece = F.pmod("_number", "_pieces").alias("piece")
    own = (F.col("size") == F.col("_size")) & (F.col("centre") == F.col("_centre"))
    counted = dealt.withColumn("_number", F.monotonically_increasing_id())
    groups = counted.join(pieces, own).select("id", "label", "vector", "size", "centre", piece)
    return staged(groups.groupBy("size", "centre", "piece").applyInArrow(_planted, _TREE))


_FOUND = "anchor long, window int, score long, id long"


def _searched(queries: dict[int, tuple]):
    """The best rows that a task's trees have for each window of each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = {size: Queries(*given, Best(given[4].size, most)) for size, (*given, most) in queries.items()}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                size = row["size"].as_py()
                if size in opened:
                    held = {n: row[n].values.to_numpy(zero_copy_only=False) for n in batch.schema.names if n != "size"}
                    points = held["points"].reshape(-1, size)
                    tree = CoverTree(points, np.arange(len(points)), *(held[n] for n in _NODES))
                    opened[size].search(tree, held["ids"], held["labels"])
        for q in opened.values():
            anchor, window = np.divmod(q.best.window, q.low.shape[1])
            columns = [pa.array(c) for c in (q.number[anchor], window.astype(np.int32), q.best.score, q.best.id)]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "window", "score", "id"])

    return run


def _best(trees: DataFrame, queries: dict[int, tuple], most: int) -> DataFrame:
    """``(anchor, window, score, id, rank)``: the best rows over all trees."""
    given = {size: (*q, most) for size, q in queries.items()}
    found = trees.mapInArrow(_searched(given), _FOUND).distinct()
    order = Window.partitionBy("anchor", "window").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _block(rows: pa.Table, fewest: int) -> dict[int, tuple]:
    """The anchors of a block by vector length, with the open windows of their positives."""
    by_size = {}
    sizes = rows.column("size").to_numpy()
    for size in np.unique(sizes):
        own = rows.filter(pa.array(sizes == size)).combine_chunks()
        number, ids, labels = (own.column(n).to_numpy() for n in ("pos", "id", "label"))
        vectors = whole_numbers(_matrix(own.column("vector").combine_chunks(), int(size)))
        bounds = [np.full((len(ids), fewest), side, np.int64) for side in (-_LONG - 1, _LONG)]
        by_size[int(size)] = (number, ids, labels, vectors, *bounds, True)
    return by_size


def _windows(queries: dict[int, tuple], scores: dict[tuple[int, int], int], positives: int) -> dict[int, tuple]:
    """The same anchors with the windows of their positives' scores; those without one are empty."""
    given = {}
    for size, (number, ids, labels, vectors, *_) in queries.items():
        low, high = np.full((len(ids), positives), _LONG, np.int64), np.full((len(ids), positives), -_LONG - 1, np.int64)
        for i, n in enumerate(number.tolist()):
            for w in range(positives):
                if (score := scores.get((n, w))) is not None:
                    low[i, w], high[i, w] = -(-LOW * score // 100), HIGH * score // 100
        given[size] = (number, ids, labels, vectors, low, high, False)
    return given


def mine(
    rows: DataFrame,
    anchors: Column,
    key: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    tree: int = TREE,
    block: int = BLOCK,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Components become ``floor(256 * x)``; a score is the whole inner product with the anchor, higher
    ones come first, then smaller keys. ``anchors`` is a condition on the columns of ``rows``. Positives
    of an anchor are its first ``positives`` rows of the same label and another key; for each, the first
    ``negatives`` rows of other labels with 30 to 90 hundredths of its score are returned.

    Rows with a null key, label, vector or component, or with a component that is not finite, take no part;
    an empty vector and vectors of another length than the anchor's are not compared. Rows found
    twice with one key and score count once. An anchor without positives, or a positive without
    negatives, gives no rows; nor does an empty table. Other columns are ignored. Scores beyond 64 bits
    are the greatest or least of them.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col(key).isNotNull() & F.col(label).isNotNull() & F.coalesce(finite & (F.size(vector) > 0), F.lit(False))
    chosen = rows.where(usable).select(
        F.col(key).cast("long").alias("id"),
        F.col(label).cast("int").alias("label"),
        F.col(vector).cast("array<double>").alias("vector"),
        F.coalesce(anchors, F.lit(False)).alias("asks"),
    )
    chosen = staged(chosen)
    spark = rows.sparkSession
    trees = planted(chosen.drop("asks"), tree).coalesce(spark.sparkContext.defaultParallelism)
    asking = chosen.where("asks").select("id", "label", "vector", F.size("vector").alias("size"))
    asking = staged(numbered(staged(asking), [], ["id", "label", "vector"]))
    number = asking.count()
    folder = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    result = spark.createDataFrame([], out)
    for part, start in enumerate(range(0, number, block)):
        own = asking.where((F.col("pos") >= start) & (F.col("pos") < start + block))
        queries = _block(own.toArrow(), 1)
        near = staged(_best(trees, queries, positives))
        held = near.select("anchor", (F.col("rank") - 1).alias("window"), "score", "id").toArrow().to_pylist()
        scores = {(r["anchor"], r["window"]): r["score"] for r in held}
        far = _best(trees, _windows(queries, scores, positives), negatives)
        meant = near.select(
            F.col("anchor").alias("_anchor"),
            (F.col("rank") - 1).alias("_window"),
            F.col("id").alias("positive_id"),
            F.col("score").alias("positive_score"),
        )
        named = own.select(F.col("pos").alias("_pos"), F.col("id").alias("anchor_id"))
        joined = (
            far.join(meant, (F.col("anchor") == F.col("_anchor")) & (F.col("window") == F.col("_window")))
            .join(named, F.col("anchor") == F.col("_pos"))
            .select(
                "anchor_id",
                "positive_id",
                "rank",
                F.col("id").alias("negative_id"),
                "positive_score",
                F.col("score").alias("negative_score"),
            )
        )
        joined.write.parquet(f"{folder}/block={part}")
    return spark.read.schema(result.schema).parquet(folder).select(*result.columns) if number else result
