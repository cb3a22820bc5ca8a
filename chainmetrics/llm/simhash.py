"""Near-duplicates by SimHash, linked through Golay codewords.

A 64-bit fingerprint is cut into three segments. If two fingerprints differ in at
most four bits, sort their segments by errors ``a <= b <= c``:

* ``b <= 1``: two segments have at most one error each. Each segment is decoded to
  its nearest word of the perfect binary Golay code (23, 12). If ``w`` and ``w'``
  differ in one bit, the word nearest to ``w'`` lies within 4 of ``w``. So a
  fingerprint is *indexed* by the nearest words of two segments and *probes* with
  all words within 4 of each (one, or six where the nearest is 3 away).
* otherwise the errors are (0, 2, 2) and a whole segment is equal: a key of its own.

Equal keys meet in one task, where bits are compared. A bucket gives a spanning
forest of its links, never all pairs: members already linked are not compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainmetrics.llm.common import staged, words_in_parts
from chainmetrics.llm.components import components

SHINGLE = 4
MAX_BITS = 4
#: XXH64 seed of the shingle hash.
SEED = 42
#: Bits of the three segments, lowest first.
SEGMENTS = (21, 21, 22)
#: Generator polynomial of the binary Golay code.
GOLAY = 0b101011100011

#: Rows compared together; a block always holds whole buckets.
BLOCK_ROWS = 400_000
#: Pairs expanded at once, and the bucket size from which linked members are skipped.
PAIRS, CROWD = 1 << 21, 256


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the shingles of a text in UTF-8; zero without a word."""
    digest, counts, total, tail = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0, []
    for words in words_in_parts(raw.lower()):
        words = tail + words
        if len(words) >= shingle:
            grams = [digest(b" ".join(t), SEED) for t in zip(*(words[i:] for i in range(shingle)), strict=False)]
            bits = np.unpackbits(np.array(grams, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int32)
            total += len(grams)
        tail = words[-(shingle - 1) :] if shingle > 1 else []
    if not total:
        return digest(b" ".join(tail), SEED) if tail else 0
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], names=["key", "print"]
            )

    return run


@cache
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits; by syndrome, up to six error patterns of weight <= 4."""

    def rest(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GOLAY << (bit - 11)
        return word

    single = [rest(1 << b) for b in range(23)]
    low, high = np.zeros(1 << 12, np.int64), np.zeros(1 << 11, np.int64)
    for b in range(23):
        table, at = (low, b) if b < 12 else (high, b - 12)
        table[np.arange(len(table)) >> at & 1 == 1] ^= single[b]
    errors = np.full((1 << 11, 6), -1, np.int64)
    filled = np.zeros(1 << 11, np.int64)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = 0
            for b in bits:
                s ^= single[b]
            errors[s, filled[s]] = sum(1 << b for b in bits)
            filled[s] += 1
    return np.concatenate((low, high)), errors


def codewords(segment: np.ndarray) -> np.ndarray:
    """Indices of the codewords within 4 of each 23-bit word, nearest first; -1 where there are fewer than six."""
    half, errors = _golay()
    syndrome = half[segment & 0xFFF] ^ half[(1 << 12) + (segment >> 12)]
    error = errors[syndrome]
    return np.where(error < 0, -1, (segment[:, None] ^ error) >> 11)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 20_000):
            prints = np.asarray(whole.column(0).slice(at, 20_000)).astype(np.int64)
            bits, parts, low = prints.view(np.uint64), [], 0
            for width in SEGMENTS:
                parts.append((bits >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64))
                low += width
            words = [codewords(p) for p in parts]
            out = []
            for pair, (i, j) in enumerate(combinations(range(3), 2)):
                key = (words[i][:, :, None] << 12 | words[j][:, None, :]).reshape(len(prints), 36)
                used = ((words[i] >= 0)[:, :, None] & (words[j] >= 0)[:, None, :]).reshape(len(prints), 36)
                row, nth = np.nonzero(used)
                out.append((key[row, nth] << 3 | pair, prints[row], nth == 0))
            for i in range(3):
                out.append((parts[i] << 3 | (3 + i), prints, np.ones(len(prints), bool)))
            key, fp, indexed = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp), pa.array(indexed)], names=["key", "print", "indexed"])


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links (a, b) as one link from each node to the least of its component."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        label = label[label]
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(before, label) and np.array_equal(label[x], label[y]):
            break
    linked = label != np.arange(len(nodes))
    return nodes[linked], nodes[label[linked]]


def _crowd(prints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join a large bucket, found by searching outward through what is not reached yet."""
    rest, a, b = np.unique(prints), [], []
    while len(rest):
        root, queue, rest = rest[0], [rest[:1]], rest[1:]
        while queue:
            front = queue.pop()
            for at in range(0, len(front), 64):
                if not len(rest):
                    break
                near = (np.bitwise_count((front[at : at + 64, None] ^ rest[None, :]).view(np.uint64)) <= max_bits).any(axis=0)
                if near.any():
                    queue.append(rest[near])
                    a.append(rest[near])
                    b.append(np.full(int(near.sum()), root))
                    rest = rest[~near]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _links(key: np.ndarray, prints: np.ndarray, indexed: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, prints, indexed = key[order], prints[order], indexed[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(first, append=len(key))
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in np.flatnonzero(size > CROWD):
        a, b = _crowd(prints[first[at] : first[at] + size[at]], max_bits)
        found_a.append(a)
        found_b.append(b)
    bucket = np.repeat(np.arange(len(first)), size)
    left = np.flatnonzero(indexed & (size[bucket] > 1) & (size[bucket] <= CROWD))
    many = size[bucket[left]]
    for part in np.split(left, np.flatnonzero(np.diff(np.cumsum(many) // PAIRS)) + 1):
        many = size[bucket[part]]
        base = np.repeat(first[bucket[part]] - (np.cumsum(many) - many), many)
        a, b = prints[np.repeat(part, many)], prints[base + np.arange(len(base))]
        close = (a != b) & (np.bitwise_count((a ^ b).view(np.uint64)) <= max_bits)
        found_a.append(a[close])
        found_b.append(b[close])
    return _forest(np.concatenate(found_a), np.concatenate(found_b))


def _compare(max_bits: int):
    def solve(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        columns = [np.concatenate([np.asarray(p.column(i).to_numpy(zero_copy_only=False)) for p in parts]) for i in range(3)]
        a, b = _links(*columns, max_bits)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if rows >= BLOCK_ROWS and batch.num_rows:
                # Rows come sorted by key: close the block where its last bucket ends.
                key = np.asarray(batch.column(0))
                end = int(np.searchsorted(key, np.asarray(held[-1].column(0))[-1], side="right"))
                held.append(batch.slice(0, end))
                batch = batch.slice(end)
                if batch.num_rows:
                    yield solve(held)
                    held, rows = [], 0
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
        if held:
            yield solve(held)

    return run


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(key, print)``: the fingerprint of each row's text as a signed long."""
    kind = docs.schema[key].dataType.simpleString()
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw")
    return docs.select(F.col(key).alias("key"), raw).mapInArrow(_fingerprints(shingle), f"key {kind}, print long")


def linked_prints(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints that join every pair within ``max_bits``."""
    if not 0 <= max_bits <= 4:
        raise ValueError("three segments allow at most four differing bits")
    keys = prints.select("print").distinct().mapInArrow(_keys, "key long, print long, indexed boolean")
    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(_compare(max_bits), "a long, b long")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS
) -> DataFrame:
    """``(key, print, component)`` for each row: the least key that links of fingerprints reach.

    A null or empty text, or one without a word, has fingerprint zero and is linked like
    any other; fewer words than a shingle make one shingle. Repeated rows and equal
    fingerprints share a component. A null key is ignored as a least key. Other columns
    are ignored; an empty table gives no row.
    """
    prints = staged(fingerprints(docs, key, text, shingle))
    kinds = prints.groupBy("print").agg(F.min("key").alias("least"))
    groups = components(linked_prints(kinds, max_bits))
    labelled = kinds.join(groups.withColumnRenamed("node", "print"), "print", "left").select(
        "print", "least", F.coalesce("component", "print").alias("label")
    )
    least = labelled.groupBy("label").agg(F.min("least").alias("component"))
    named = labelled.join(least, "label").select("print", "component")
    return prints.join(named, "print").select(F.col("key").alias(key), "print", "component")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each component: that of its least key.

    Rows with a null key cannot be named and stay; of repeated rows one stays.
    """
    found = near_duplicates(docs, key, text, shingle, max_bits)
    chosen = found.where(F.col(key) == F.col("component")).select(key).distinct()
    stay = docs.where(F.col(key).isNotNull()).join(chosen, key, "left_semi").dropDuplicates([key])
    return stay.unionByName(docs.where(F.col(key).isNull()))
