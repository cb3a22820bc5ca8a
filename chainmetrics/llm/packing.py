"""Packing of token sequences into windows, with a fixed number of windows open.

A task reads its documents in order. Whole windows are cut off a long document;
what remains goes to the open window that it fills best. When none has room, the
fullest one is closed: it is topped up with the head of the piece if its gap is
worth a cut, and padded otherwise. So a task holds ``OPEN`` windows, whatever the
input. The windows left at the end are merged in groups of tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainmetrics.llm.bpe import codec
from chainmetrics.llm.common import staged

WINDOW = 2048
#: Windows a task keeps open.
OPEN = 32
#: A gap of at least so many tokens is filled by cutting the next document.
CUT = 16
#: Tasks whose last windows are merged together.
MERGED_TASKS = 16

#: Id that ends each document.
END = 1


class Packer:
    """Windows of one task; finished ones are taken from ``done`` as lists of pieces."""

    def __init__(self, window: int = WINDOW, open_windows: int = OPEN, cut: int = CUT) -> None:
        self.window, self.most, self.cut = window, open_windows, cut
        self.open: list[list] = []  # [free, pieces]
        self.done: list[list[tuple]] = []

    def add(self, size: int, piece: Callable[[int, int], tuple]) -> None:
        """Places a document of ``size`` tokens; ``piece(start, length)`` makes what a window holds."""
        at = 0
        while size - at >= self.window:
            self.done.append([piece(at, self.window)])
            at += self.window
        if at == size:
            return
        need = size - at
        best = min((w for w in self.open if w[0] >= need), key=lambda w: w[0], default=None)
        if best is None and len(self.open) == self.most:
            full = min(self.open, key=lambda w: w[0])
            self.open.remove(full)
            if full[0] >= self.cut:
                full[1].append(piece(at, full[0]))
                at, need = at + full[0], need - full[0]
            self.done.append(full[1])
        if best is None:
            best = [self.window, []]
            self.open.append(best)
        best[1].append(piece(at, need))
        best[0] -= need
        if not best[0]:
            self.open.remove(best)
            self.done.append(best[1])


def merged(windows: list[list[tuple]], window: int = WINDOW, cut: int = CUT) -> list[list[tuple]]:
    """Windows of pieces (.., start, length, ids) moved together: the emptiest fill up the fullest.

    Pieces are cut where a gap is shorter than they are; at most one window, and gaps
    not worth a cut, stay open.
    """
    size = lambda w: sum(p[3] for p in w)
    left = sorted(windows, key=size, reverse=True)
    done = []
    while left:
        target = left.pop(0)
        gap = window - size(target)
        while left and gap >= cut:
            key, total, start, length, ids = left[-1].pop()
            if length > gap:
                left[-1].append((key, total, start + gap, length - gap, ids[4 * gap :]))
                length, ids = gap, ids[: 4 * gap]
            target.append((key, total, start, length, ids))
            gap -= length
            if not left[-1]:
                left.pop()
        done.append(target)
    return done


_NAMES = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "task", "ids"]


def _rows(windows: list[list[tuple]], first_id: int, kind: pa.DataType, task: int | None = None) -> pa.RecordBatch:
    """A row for each piece; with ``task``, as leftovers that carry their ids."""
    out = []
    for nth, pieces in enumerate(windows):
        offset = 0
        for key, total, start, length, ids in pieces:
            out.append((key, start, length, zlib.crc32(ids), total, first_id + nth, offset, task, None if task is None else bytes(ids)))
            offset += length
    kinds = [kind, *[pa.int64()] * 6, pa.int32(), pa.binary()]
    columns = zip(*out, strict=True) if out else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_NAMES)


def _pack(path: str, window: int, open_windows: int, cut: int):
    end = END.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, kind = codec(path).encode, TaskContext.get().partitionId(), pa.null()
        packer, made = Packer(window, open_windows, cut), task << 33
        for batch in batches:
            kind = batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py()) + end
                size = len(ids) // 4
                packer.add(size, lambda at, n, key=key, ids=ids, size=size: (key, size, at, n, ids[4 * at : 4 * (at + n)]))
            if packer.done:
                yield _rows(packer.done, made, kind)
                made, packer.done = made + len(packer.done), []
        if packer.open:
            yield _rows([w[1] for w in packer.open], made, kind, task)

    return run


def _merge(window: int, cut: int):
    """Merges the last windows of a group of tasks."""

    def run(table: pa.Table) -> pa.Table:
        windows: dict[int, list[tuple]] = {}
        rows = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).to_pydict()
        for sequence, key, total, start, length, ids in zip(
            *(rows[c] for c in ("sequence_id", "key", "doc_tokens", "start", "length", "ids")), strict=True
        ):
            windows.setdefault(sequence, []).append((key, total, start, length, ids))
        batch = _rows(merged(list(windows.values()), window, cut), min(windows), table.schema.field("key").type)
        return pa.Table.from_batches([batch.cast(table.schema)])

    return run


def pack(
    docs: DataFrame,
    path: str,
    key: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    open_windows: int = OPEN,
    cut: int = CUT,
) -> DataFrame:
    """One row for each piece of a document, with its place in a sequence.

    Columns: ``key``, ``start`` and ``length`` in the document's ids (those of the tokenizer
    at ``path`` and ``END``), ``ids_crc32``, ``doc_tokens``, ``sequence_id`` and ``offset``. Pieces
    fill a sequence without a gap from 0; a sequence holds at most ``window`` tokens.
    A null or empty text is packed as ``END`` alone. Repeated rows and rows with a null
    key are packed as documents of their own; other columns are ignored, and an empty
    table gives no piece. Sequence ids depend on how the input is split.
    """
    kind = docs.schema[key].dataType.simpleString()
    columns = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, task int, ids binary"
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    pieces = staged(rows.mapInArrow(_pack(path, window, open_windows, cut), f"key {kind}, {columns}"))
    last = pieces.where("task is not null")
    group = F.floor(F.col("task") / MERGED_TASKS)
    last = last.withColumn("task", group.cast("int")).groupBy("task").applyInArrow(_merge(window, cut), last.schema)
    return pieces.where("task is null").unionByName(last).drop("task", "ids").withColumnRenamed("key", key)
