"""Removal of every byte covered by a string of ``length`` bytes that occurs twice.

Strings are suffixes cut at ``length`` bytes. Only suffixes that can have a twin
are sorted, one bucket at a time:

1. *Buckets.* Each suffix is assigned to the smallest hashed ``seed_length``-byte
   substring in its first ``length`` bytes (its seed). Equal suffixes hold equal
   seeds at equal offsets, so twins share a bucket. Neighbouring suffixes with one
   seed form a zone: one row. Buckets with a single zone have no twins and end here.
2. *Equal zones* of different places are twins throughout; one copy stands for all.
3. *Hot buckets.* A shorter passage that many texts hold among other words makes a bucket
   of very many unequal zones. Such zones are texts of their own to a further round with
   a longer seed, and so on up to a seed of ``length`` bytes; seeds that take in the
   words around the passage stand at a single place, and end there.
4. *Sort.* The unequal zones of a bucket are sorted by their first and last
   bytes. What ties there is long, and is resolved without looking at the text
   again: ranks of the difference-cover sample (positions ``p`` with ``p mod v`` in
   the cover) are made for each block by doubling over multiples of ``v``, and any
   two suffixes have an offset below ``v`` at which both meet the sample. Ranks
   tell equality within their block; no suffix array of the corpus is made.

Texts that are whole copies of one another are handled once. Memory is bounded by
a block of buckets, each of at most ``HOT_ZONES`` zones, not by the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainmetrics.llm.common import staged, text_key

LENGTH = 400
SEED_LENGTH = 64
#: A perfect difference set: every residue mod 7 is a difference of two members.
PERIOD, COVER = 7, (0, 1, 3)

#: Bytes of zone text sorted together; a block always holds whole buckets.
BLOCK_BYTES = 2_000_000
#: Buckets of more unequal zones (of less than ``2 * LENGTH`` bytes) are split by a longer seed.
HOT_ZONES = BLOCK_BYTES // (2 * LENGTH)
#: Suffixes hashed at once, so that a very long text needs no more memory.
SPAN = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_ZONE = "tid binary, seed long, zone long, start int, suffixes int, seed_at int, more array<int>"
_SPAN = "tid binary, start int, stop int"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.cumprod(out, out=out)


class _Seeds:
    """The seed of each suffix of a text."""

    def __init__(self, length: int, seed_length: int) -> None:
        if not 8 <= seed_length <= length:
            raise ValueError("8 <= seed_length <= length")
        self.length, self.k, self.width = length, seed_length, length - seed_length + 1
        self._grow(1 << 14)

    def _grow(self, n: int) -> None:
        self.up, self.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)

    def zones(self, text: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Offset of a span, then its zones: start, number of suffixes, seed's place, seed."""
        for at in range(0, len(text) - self.length + 1, SPAN):
            yield at, *self._span(text[at : at + SPAN + self.length - 1])

    def _span(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n, k, width = len(text), self.k, self.width
        if n > len(self.up):
            self._grow(1 << n.bit_length())
        sums = np.zeros(n + 1, _U)
        np.cumsum((np.frombuffer(text, np.uint8).astype(_U) + _U(1)) * self.up[:n], out=sums[1:])
        seed = (sums[k:] - sums[:-k]) * self.down[: n - k + 1]
        seed ^= seed >> _U(29)
        seed *= _U(0xBF58476D1CE4E5B9)
        seed ^= seed >> _U(32)
        m = len(seed)
        # Smallest (high half of the hash, place) among the seeds of each suffix.
        rows = -(-m // width)
        order = np.full(rows * width, ~_U(0))
        np.bitwise_or(seed & _U(0xFFFFFFFF00000000), np.arange(m, dtype=_U), out=order[:m])
        order = order.reshape(rows, width)
        ahead = np.minimum.accumulate(order, axis=1).ravel()
        back = np.minimum.accumulate(order[:, ::-1], axis=1)[:, ::-1].ravel()
        suffixes = m - width + 1
        place = np.minimum(back[:suffixes], ahead[width - 1 : width - 1 + suffixes]) & _U(0xFFFFFFFF)
        start = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
        count = np.diff(start, append=suffixes)
        seed_place = place[start].astype(np.int64)
        return start, count, seed_place, seed[seed_place]


def _text_zones(seeds: _Seeds, text: bytes) -> tuple[np.ndarray, ...] | None:
    """Seed, hash, start, number of suffixes, seed's place and further starts of each kind of zone of a text.

    Equal zones of one text, as periodic text has by the thousand, are one row.
    """
    digest, parts = xxhash.xxh3_64_intdigest, []
    for at, start, count, place, seed in seeds.zones(text):
        view = memoryview(text)[at:]
        ends = start + count + (seeds.length - 1)
        zone = [digest(view[a:b]) for a, b in zip(start.tolist(), ends.tolist(), strict=True)]
        parts.append((seed.view(np.int64), np.array(zone, _U).view(np.int64), start + at, count, place - start))
    if not parts:
        return None
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    kinds, first, back = np.unique(columns[1], return_index=True, return_inverse=True)
    if len(kinds) == len(back):
        return *columns, np.zeros(0, np.int32), np.zeros(len(back), np.int64)
    again = np.ones(len(back), bool)
    again[first] = False
    more = np.flatnonzero(again)
    more = more[np.argsort(back[more], kind="stable")]
    return *(c[first] for c in columns), columns[2][more], np.bincount(back[more], minlength=len(kinds))


def _zone_rows(length: int, seed_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = _Seeds(length, seed_length)
        for batch in batches:
            tids, texts = batch.column(0), batch.column(1)
            owner, found, held = [], [], 0
            for i in range(batch.num_rows):
                if (zones := _text_zones(seeds, texts[i].as_py())) is not None:
                    owner.append(np.full(len(zones[0]), i, np.int32))
                    found.append(zones)
                    held += len(zones[0])
                if found and (held > 50_000 or i == batch.num_rows - 1):
                    seed, zone, *places, more, repeats = (np.concatenate(c) for c in zip(*found, strict=True))
                    ends = np.concatenate(([0], np.cumsum(repeats))).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            tids.take(pa.array(np.concatenate(owner))),
                            pa.array(seed),
                            pa.array(zone),
                            *(pa.array(c.astype(np.int32)) for c in places),
                            pa.ListArray.from_arrays(pa.array(ends), pa.array(more.astype(np.int32))),
                        ],
                        names=["tid", "seed", "zone", "start", "suffixes", "seed_at", "more"],
                    )
                    owner, found, held = [], [], 0

    return run


def _meeting(period: int, cover: tuple[int, ...]) -> np.ndarray:
    """For two residues, the least offset that brings both into the cover."""
    inside = np.isin(np.arange(2 * period) % period, cover)
    meet = np.full((period, period), -1)
    for a in range(period):
        for b in range(period):
            both = np.flatnonzero(inside[a : a + period] & inside[b : b + period])
            if not len(both):
                raise ValueError("not a difference cover")
            meet[a, b] = both[0]
    return meet


class BucketSorter:
    """Finds, in a block of buckets, the suffixes that have a twin."""

    def __init__(self, length: int = LENGTH, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> None:
        self.n, self.v, self.meet = length, period, _meeting(period, cover)
        self.in_cover = np.isin(np.arange(period), cover)
        self.ranked = (length - period + 1) // period * period
        if self.ranked < period or length < 32 or length - self.ranked > 16 or period > 8:
            raise ValueError("unsuitable length and period")

    def sample_ranks(self, words: np.ndarray, residue: np.ndarray, room: np.ndarray) -> np.ndarray:
        """Rank of the first ``ranked`` bytes at each sampled place; -1 elsewhere."""
        v, size = self.v, self.v
        at = np.flatnonzero(self.in_cover[residue] & (room >= size))
        rank = np.full(len(residue), -1, np.int64)
        mask = _U((1 << (8 * v)) - 1) if v < 8 else ~_U(0)
        rank[at] = np.unique(words[at] & mask, return_inverse=True)[1]
        while size < self.ranked:
            step = min(size, self.ranked - size)
            size += step
            at = at[room[at] >= size]
            pair = (rank[at] << 32) | rank[at + step]
            rank = np.full(len(residue), -1, np.int64)
            rank[at] = np.unique(pair, return_inverse=True)[1]
        return rank

    def twins(self, bucket: np.ndarray, texts: list[bytes], start: np.ndarray, suffixes: np.ndarray, seed_at: np.ndarray) -> np.ndarray:
        """For all suffixes, zone by zone: whether an equal one is in the bucket."""
        n, v = self.n, self.v
        size = np.array([len(t) for t in texts], np.int64)
        first = np.cumsum(size) - size
        raw = np.frombuffer(b"".join(texts) + bytes(16), np.uint8)
        total = len(raw) - 16
        words = np.ndarray((total + 8,), "<u8", raw, strides=(1,))
        place = np.arange(total) - np.repeat(first, size)
        room = np.repeat(size, size) - place
        residue = (np.repeat(start, size) + place) % v
        rank = self.sample_ranks(words, residue, room)
        # All suffixes, and the key on which they are sorted.
        zone = np.repeat(np.arange(len(texts)), suffixes)
        nth = np.arange(len(zone)) - np.repeat(np.cumsum(suffixes) - suffixes, suffixes)
        at = first[zone] + nth
        keys = [words[at + n - 8], words[at + n - 16], words[at], seed_at[zone] - nth, bucket[zone]]
        order = np.lexsort(keys)
        fresh = np.ones(len(at), bool)
        fresh[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
        tie = np.cumsum(fresh)
        found = np.zeros(len(at), bool)
        while len(order):
            # The first of each tie against the rest, by rank where both meet the sample.
            head = np.flatnonzero(np.concatenate(([True], tie[1:] != tie[:-1])))
            counts = np.diff(head, append=len(tie))
            pivot = np.repeat(order[head], counts)
            offset = self.meet[residue[at[order]], residue[at[pivot]]]
            same = rank[at[order] + offset] == rank[at[pivot] + offset]
            twin = np.repeat(np.add.reduceat(same, head) > 1, counts) & same
            found[order[twin]] = True
            order, tie = order[~same], tie[~same]
        return found


def _runs(flags: np.ndarray, zone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each stretch of true flags within one zone."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at
    cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(zone[at]) != 0))
    return at[np.concatenate(([0], cut + 1))], at[np.concatenate((cut, [len(at) - 1]))]


def _twin_spans(length: int, period: int, cover: tuple[int, ...]):
    def solve(sorter: BucketSorter, rows: list[tuple]) -> pa.RecordBatch:
        bucket, tid, start, suffixes, seed_at, known, texts = zip(*rows, strict=True)
        start, suffixes = np.array(start, np.int64), np.array(suffixes, np.int64)
        found = sorter.twins(np.array(bucket), list(texts), start, suffixes, np.array(seed_at, np.int64))
        zone = np.repeat(np.arange(len(rows)), suffixes)
        found &= ~np.array(known, bool)[zone]
        a, b = _runs(found, zone)
        base = start - (np.cumsum(suffixes) - suffixes)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([tid[z] for z in zone[a].tolist()], pa.binary()),
                pa.array((base[zone[a]] + a).astype(np.int32)),
                pa.array((base[zone[a]] + b + length).astype(np.int32)),
            ],
            names=["tid", "start", "stop"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sorter, block, held, last = BucketSorter(length, period, cover), [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held > BLOCK_BYTES and row[0] != last:
                    yield solve(sorter, block)
                    block, held = [], 0
                block.append(row)
                held, last = held + len(row[-1]), row[0]
        if block:
            yield solve(sorter, block)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The union of each text's spans, in order."""
    for batch in batches:
        out = []
        for spans in batch.column(1).to_pylist():
            merged: list[list[int]] = []
            for a, b in sorted((s["start"], s["stop"]) for s in spans):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            out.append([{"start": a, "stop": b} for a, b in merged])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["tid", "spans"])


def _seed_lengths(seed_length: int, length: int) -> list[int]:
    """Seeds of the rounds: each halves what is missing to ``length``, which is the last."""
    if not 8 <= seed_length < length:
        raise ValueError("8 <= seed_length < length")
    lengths = [seed_length]
    while length - lengths[-1] > 16:
        lengths.append((lengths[-1] + length + 1) // 2)
    return [*lengths, length]


def _twins(texts: DataFrame, length: int, seed_lengths: list[int], period: int, cover: tuple[int, ...]) -> DataFrame:
    """``(tid, start, stop)``: the spans of suffixes with a twin, for texts ``(tid, raw)`` of ``length`` bytes or more."""
    zones = staged(texts.mapInArrow(_zone_rows(length, seed_lengths[0]), _ZONE))
    place = F.xxhash64("tid", "start")
    # A bucket matters if it has two places; whole copies of a text are one place.
    live = staged(
        zones.groupBy("seed")
        .agg(F.min(place).alias("a"), F.max(place).alias("b"), F.max(F.size("more")).alias("repeats"))
        .where("a <> b or repeats > 0")
        .select("seed")
    )
    zones = staged(zones.join(live, "seed").select("*", place.alias("place")))
    kinds = zones.groupBy("seed", "zone", "suffixes", "seed_at").agg(
        F.min(F.struct("place", "tid", "start")).alias("one"),
        ((F.min("place") != F.max("place")) | (F.max(F.size("more")) > 0)).alias("known"),
    )
    kinds = staged(kinds.select("seed", "zone", "suffixes", "seed_at", "known", "one.tid", "one.start"))
    known = (
        zones.join(kinds.where("known").select("seed", "zone", "suffixes", "seed_at"), ["seed", "zone", "suffixes", "seed_at"])
        .select("tid", "suffixes", F.explode(F.concat(F.array("start"), "more")).alias("start"))
        .select("tid", "start", (F.col("start") + F.col("suffixes") + (length - 1)).alias("stop"))
    )
    mixed = staged(kinds.groupBy("seed").count().where("count > 1").select("seed", (F.col("count") > HOT_ZONES).alias("hot")))
    # Copies of a text are reduced to one in each task before they are shuffled.
    slices = kinds.join(mixed, "seed").join(texts.dropDuplicates(["tid"]), "tid").select(
        "seed",
        "tid",
        "start",
        "suffixes",
        "seed_at",
        "known",
        F.substring(F.col("raw"), F.col("start") + 1, F.col("suffixes") + (length - 1)).alias("part"),
        "hot",
    )
    # With a seed of the whole length, only equal hashes of unequal strings are left together.
    if len(seed_lengths) > 1 and not mixed.where("hot").isEmpty():
        slices = staged(slices)
        at = F.unhex(F.lpad(F.hex("start"), 8, "0"))
        parts = slices.where("hot").select(F.concat("tid", at).alias("tid"), F.col("part").alias("raw"))
        base = F.conv(F.hex(F.substring(F.col("tid"), -4, 4)), 16, 10).cast("int")
        whole = F.substring(F.col("tid"), F.lit(1), F.octet_length("tid") - 4)
        split = _twins(parts, length, seed_lengths[1:], period, cover)
        split = split.select(whole.alias("tid"), (F.col("start") + base).alias("start"), (F.col("stop") + base).alias("stop"))
        known, slices = known.unionByName(split), slices.where("not hot")
    sorted_buckets = slices.drop("hot").repartition("seed").sortWithinPartitions("seed")
    return known.unionByName(sorted_buckets.mapInArrow(_twin_spans(length, period, cover), _SPAN))


def repeated_spans(
    docs: DataFrame,
    text: str = "text",
    length: int = LENGTH,
    seed_length: int = SEED_LENGTH,
    period: int = PERIOD,
    cover: tuple[int, ...] = COVER,
) -> DataFrame:
    """``(tid, spans)``: byte spans of each text to be removed, merged and in order.

    ``tid`` is ``text_key(text)``. Texts that occur several times as a whole are not
    listed for that (see ``remove_repeats``); texts without a repeat have no row.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    long = docs.select(text_key(body).alias("tid"), body.cast("binary").alias("raw")).where(
        F.octet_length("raw") >= length
    )
    found = _twins(long, length, _seed_lengths(seed_length, length), period, cover)
    spans = found.groupBy("tid").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    return spans.mapInArrow(_merged, "tid binary, spans array<struct<start:int,stop:int>>")


_SPANS = "array<struct<start:int,stop:int>>"


def _marked(docs: DataFrame, text: str, length: int, method: dict) -> DataFrame:
    """``docs`` with ``__raw`` (its bytes), ``__n`` (how many) and ``__spans`` (those to be removed)."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.withColumns({"__tid": text_key(F.col(text)), "__raw": raw, "__n": F.octet_length(raw)})
    copied = rows.groupBy("__tid").count().where("count > 1").select("__tid", F.lit(True).alias("__copied"))
    spans = repeated_spans(docs, text, length, **method).withColumnsRenamed({"tid": "__tid", "spans": "__some"})
    whole = F.coalesce(F.col("__copied"), F.lit(False)) & (F.col("__n") >= length)
    all_of_it = F.array(F.struct(F.lit(0).alias("start"), F.col("__n").alias("stop")))
    found = F.when(whole, all_of_it).otherwise(F.coalesce(F.col("__some"), F.array().cast(_SPANS)))
    marks = spans.join(copied, "__tid", "full")
    return rows.join(marks, "__tid", "left").withColumn("__spans", found).drop("__tid", "__copied", "__some")


def _kept(spans: Column) -> Column:
    """The bytes between spans, joined."""
    starts = F.concat(F.transform(spans, lambda s: s.start), F.array(F.col("__n")))
    stops = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s.stop))
    pieces = F.zip_with(stops, starts, lambda a, b: F.substring(F.col("__raw"), a + 1, F.greatest(b - a, F.lit(0))))
    joined = F.aggregate(pieces, F.lit(b""), lambda acc, piece: F.concat(acc, piece))
    return F.when(F.size(spans) == 0, F.col("__raw")).otherwise(joined)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, **method) -> DataFrame:
    """One row per row of ``docs``: what remains of its text.

    Returns ``key``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (binary: the
    remaining bytes joined). A null or empty text has no bytes and stays empty. A text
    shorter than ``length`` loses nothing. Rows with one text (repeated rows, rows with
    a null key) all lose it if it has ``length`` bytes. Other columns are ignored.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("body"))
    return _marked(rows, "body", length, method).select(
        F.col("key").alias(key),
        F.col("__n").cast("long").alias("n_bytes"),
        F.aggregate("__spans", F.lit(0), lambda acc, s: acc + s.stop - s.start).cast("long").alias("n_removed"),
        F.size("__spans").cast("long").alias("n_spans"),
        _kept(F.col("__spans")).alias("kept"),
    )


def kept_rows(docs: DataFrame, text: str = "text", length: int = LENGTH, **method) -> DataFrame:
    """The rows of ``docs``, all columns, with ``text`` cut down to what ``remove_repeats`` keeps.

    A character of which a byte is removed is removed as a whole, so that the text stays
    valid. A null text stays null.
    """

    def inside(at: Column) -> Column:
        """Whether the byte at ``at`` continues a character."""
        return F.hex(F.substring(F.col("__raw"), at + 1, F.lit(1))).between("80", "BF") & (at < F.col("__n"))

    def edge(at: Column, step: int) -> Column:
        for _ in range(3):
            at = F.when(inside(at), at + step).otherwise(at)
        return at

    snapped = F.transform("__spans", lambda s: F.struct(edge(s.start, -1).alias("start"), edge(s.stop, 1).alias("stop")))
    marked = _marked(docs, text, length, method).withColumn("__spans", snapped)
    left = F.when(F.size("__spans") == 0, F.col(text)).otherwise(_kept(F.col("__spans")).cast("string"))
    return marked.withColumn(text, left).select(*(F.col(f"`{c}`") for c in docs.columns))
