"""A Merkle manifest of a dataset as a persistent tree, built and updated by path copying.

Leaves are numbered in their order by a sort that is dealt out by range, and cut into aligned
blocks of 8^``depth``. A block is one row: its four levels of nodes are built in one task, its top is a
leaf of the next tree above, and so on until one node is left. Trees of the groups
are in the same way the leaves of the tree that gives the root.

A changed leaf makes a new version of the tree: it owns the nodes from the leaf to the root,
some copied within each block, and shares all others with the tree as it was. Versions go
on above their block over the siblings that the tree above hands down to it, so one version
is folded up without any other block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from chainmetrics.llm.common import numbered, staged

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a node, and levels of a block above its leaves.
FAN, DEPTH = 8, 4

_SIBLINGS = "array<struct<left:string,right:string>>"


def leaf_digest(fields: list[Column]) -> Column:
    """Lowercase hex SHA-256 over each field as ``-`` or as its UTF-8 bytes' number, a colon and its text."""
    parts = []
    for field in fields:
        text = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Block:
    """The nodes over an aligned run of leaves, shared by all versions."""

    def __init__(self, digests: list[str], total: int, depth: int = DEPTH) -> None:
        self.levels = [digests]
        # A tree that fits into one block ends with one node, a block of a larger one after all its levels.
        while len(self.levels[-1]) > 1 if total <= FAN**depth else len(self.levels) <= depth:
            below = self.levels[-1]
            self.levels.append([_hash("".join(below[i : i + FAN])) for i in range(0, len(below), FAN)])

    @property
    def top(self) -> str:
        return self.levels[-1][0]

    def siblings(self, at: int) -> list[tuple[str, str]]:
        """The nodes before and after the path from leaf ``at``, level by level."""
        found = []
        for level in self.levels[:-1]:
            run = at // FAN * FAN
            found.append(("".join(level[run:at]), "".join(level[at + 1 : run + FAN])))
            at //= FAN
        return found


def version(leaf: str, siblings: list[tuple[str, str]]) -> list[str]:
    """The nodes that a version owns when it has ``leaf``: the leaf and a copy of each node above it."""
    own = [leaf]
    for left, right in siblings:
        own.append(_hash(left + own[-1] + right))
    return own


def _blocks(nodes: DataFrame, depth: int, *more: str) -> DataFrame:
    """One row for each block of ``nodes(tree, pos, total, digest)``."""
    held = F.sort_array(F.collect_list(F.struct("pos", "digest", *more))).alias("nodes")
    block = F.expr(f"pos div {FAN**depth}").alias("block")
    return nodes.groupBy("tree", block, "total").agg(held)


def _opened(batch: pa.RecordBatch, depth: int) -> Iterator[tuple[dict, pa.StructArray, Block]]:
    """The plain columns and the nodes of each block."""
    names = batch.schema.names
    for i in range(batch.num_rows):
        row = {name: batch.column(name)[i].as_py() for name in names if name != "nodes"}
        nodes = batch.column("nodes")[i].values
        yield row, nodes, Block(nodes.field("digest").to_pylist(), row["total"], depth)


def _tops(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, block in _opened(batch, depth):
                yield pa.RecordBatch.from_pylist([{**row, "digest": block.top}])

    return run


def _pairs(up: list[dict]) -> list[tuple[str, str]]:
    return [(s["left"], s["right"]) for s in up]


_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _handed_down(blocks: DataFrame, depth: int) -> DataFrame:
    """``(tree, pos, up)``: the siblings from each node of the blocks to its tree's root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, nodes, block in _opened(batch, depth):
                above = _pairs(row["up"])
                paths = [[dict(left=a, right=b) for a, b in [*block.siblings(i), *above]] for i in range(len(nodes))]
                tree = pa.array([row["tree"]] * len(nodes), pa.string())
                yield pa.RecordBatch.from_arrays([tree, nodes.field("pos"), pa.array(paths, _PATH)], names=["tree", "pos", "up"])

    return staged(blocks.mapInArrow(run, f"tree string, pos long, up {_SIBLINGS}"))


def _climbed(blocks: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """``(tree, digest)`` of all trees, and ``blocks`` with ``up``, the siblings from their top to it."""
    span = FAN**depth
    tops = staged(blocks.mapInArrow(_tops(depth), "tree string, block long, total long, digest string"))
    roots = tops.where(F.col("total") <= span).select("tree", "digest")
    higher = tops.where(F.col("total") > span)
    if higher.isEmpty():
        return roots, blocks.withColumn("up", F.array().cast(_SIBLINGS))
    nodes = higher.select("tree", F.col("block").alias("pos"), F.expr(f"(total + {span - 1}) div {span}").alias("total"), "digest")
    more, above = _climbed(staged(_blocks(nodes, depth)), depth)
    paths = _handed_down(above, depth).select(F.col("tree").alias("_tree"), F.col("pos").alias("_block"), "up")
    joined = blocks.join(paths, (F.col("tree") == F.col("_tree")) & (F.col("block") == F.col("_block")), "left")
    up = F.coalesce("up", F.array().cast(_SIBLINGS))
    return roots.unionByName(more), joined.select(*blocks.columns, up.alias("up"))


def _audit(root: str, key_type: pa.DataType, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, nodes, block in _opened(batch, depth):
                found, above = nodes.field("found").to_pylist(), _pairs(row["up"])
                proofs, folded, owned = [], [], []
                for i, leaf in enumerate(block.levels[0]):
                    siblings = [*block.siblings(i), *above]
                    proofs.append(_hash("".join(a + b for a, b in siblings)))
                    own = version(leaf if found[i] is None else found[i], siblings)
                    folded.append(own[-1])
                    owned.append(None if found[i] is None else own)
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        nodes.field("key").cast(key_type),
                        nodes.field("digest"),
                        pa.array([row["subroot"]] * n, pa.string()),
                        pa.array([root] * n, pa.string()),
                        pa.array(proofs, pa.string()),
                        pa.array(folded, pa.string()),
                        pa.array([f == root for f in folded], pa.bool_()),
                        pa.array(owned, pa.list_(pa.string())),
                    ],
                    names=["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "own_nodes"],
                )

    return run


def audited(
    docs: DataFrame,
    found: Column | None = None,
    changed: Column | None = None,
    fields: tuple[str, ...] = FIELDS,
    key: str = "doc_id",
    group: str = "lang",
    text: str = "text",
    depth: int = DEPTH,
) -> DataFrame:
    """``(key, leaf, subroot, root, proof_sha256, folded_root, verified, own_nodes)`` for each row.

    ``leaf`` is the digest of the row's ``fields``. Leaves of one ``group`` ascend by ``key`` (null
    first, ties by digest); 8 consecutive nodes, the last run fewer, become one until one is left,
    the ``subroot``, a lone leaf being its own. Subroots by group, null first, in the same way give ``root``.
    ``proof_sha256`` is the digest of all siblings of the path from leaf to root, one after another.

    ``changed`` names the rows, null meaning no, whose ``text`` is now ``found``. Each makes a version
    of its own: ``own_nodes`` are its leaf and the copied nodes up to its root (null for other
    rows), ``folded_root`` is that root, and ``verified`` tells whether it is the root of all. A changed
    row that reads as before verifies.

    Null in any field, empty and long texts and repeated rows are leaves like any other; copies of a row
    have a place each, hence proofs of their own. No rows give none. Only the fields are read.
    """
    own = [F.col(name) for name in fields]
    now = [found if name == text and found is not None else F.col(name) for name in fields]
    again = F.when(F.coalesce(changed, F.lit(False)), leaf_digest(now)) if changed is not None else F.lit(None).cast("string")
    of = F.col(group).cast("string")
    tree = F.coalesce(F.concat(F.lit("="), of), F.lit("")).alias("tree")
    leaves = staged(docs.select(tree, F.col(key).alias("key"), leaf_digest(own).alias("digest"), again.alias("found")))
    placed = numbered(leaves, ["tree"], ["key", "digest", "found"])
    roots, blocks = _climbed(staged(_blocks(placed, depth, "key", "found")), depth)

    # The trees of the groups are the leaves of one more tree.
    crown = numbered(staged(roots), [], ["tree"])
    crown = crown.select(F.lit("").alias("tree"), "pos", "total", "digest", F.col("tree").alias("group"))
    top, crown_blocks = _climbed(staged(_blocks(crown, depth)), depth)
    first = top.first()
    root = first.digest if first else ""
    handed = _handed_down(crown_blocks, depth)
    groups = crown.select("pos", "digest", "group").join(handed.select("pos", "up"), "pos")
    groups = staged(groups.select(F.col("group").alias("_tree"), F.col("digest").alias("subroot"), F.col("up").alias("_over")))

    whole = blocks.join(groups, F.col("tree") == F.col("_tree"))
    whole = whole.select("nodes", "total", "subroot", F.concat("up", "_over").alias("up"))
    kind = docs.schema[key].dataType
    out = f"key {kind.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, own_nodes array<string>"
    return whole.mapInArrow(_audit(root, to_arrow_type(kind), depth), out).withColumnRenamed("key", key)
