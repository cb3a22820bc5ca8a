"""Byte-level BPE: encoding by tree concatenation, and decoding.

A long text is halved again and again, without looking for a good place to cut, and
the parts are encoded in parallel. Neighbours are joined in a tree. Around a join a
window of a few words on either side is split and encoded anew, and grown until

* its first word starts where the left side has a word start that no longer
  depends on the cut, and
* a word start of the window is one of the right side too: from there on both
  see the same text, so they agree to the end.

A word that runs through the join without end (no blank for thousands of letters) is
joined token by token: a window of tokens is encoded anew and grown until both seams
are stable, that is until the two tokens at a seam, put together, are encoded as
themselves. A sequence of which all neighbours are stable is the encoding.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainmetrics.llm.common import text_key

#: Characters from which a text is encoded in parts.
LEAF = 32_768
#: Distinct words remembered by a worker, twice over (a young and an old half).
REMEMBERED = 120_000
#: Words longer than this are not remembered, and are joined token by token.
LONG_WORD = 512

#: How the byte-level pre-tokenizer cuts a text into words (fixed by the tokenizer).
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts in which ``re`` sees letters, digits and blanks alike.
PLAIN_WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: The first again, for the Rust engine, which is quicker with few alternatives.
GROUPED_WORD = r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters on which they may differ.
UNUSUAL = "[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbeɐ-\U0010ffff]"


def _byte_alphabet() -> dict[str, int]:
    """Character -> byte of the printable alphabet that byte-level vocabularies are written in."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Words(dict):
    """Word -> its ids as bytes; filled on demand, bounded."""

    def __init__(self, encode) -> None:
        self.encode, self.old = encode, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.encode(word.encode())
        if len(word) <= LONG_WORD:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


@dataclass
class Part:
    """A stretch of text: its words, and the ids of each as bytes."""

    words: list[str]
    ids: list[bytes]


class Codec:
    """One vocabulary: a tokenizers file of a byte-level BPE without normalizer or truncation."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("not a plain byte-level tokenizer")
        if model["type"] != "BPE" or model["dropout"] or model.get("ignore_merges"):
            raise ValueError("not a plain BPE model")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings")
        alphabet = _byte_alphabet()
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(alphabet[c] for c in t) for t, i in model["vocab"].items()}
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(merged):
            raise ValueError("ids are not in the order of merges")
        self.bytes_of |= {i: t.encode() for t, i in added.items()}
        self._table = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.added = {t: i.to_bytes(4, "little") for t, i in added.items()}
        self._core = tiktoken.Encoding(
            "byte-bpe",
            pat_str=GROUPED_WORD,
            mergeable_ranks={self.bytes_of[i]: i for i in model["vocab"].values()},
            special_tokens={},
        )._core_bpe
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self._plain, self._full, self._unusual = re.compile(PLAIN_WORD), regex.compile(WORD), re.compile(UNUSUAL)
        self._known = _Words(self.encode_word)

    def encode_word(self, raw: bytes) -> bytes:
        return np.array(self._core.encode_single_piece(raw), "<u4").tobytes()

    def words(self, text: str) -> list[str]:
        return (self._full if self._unusual.search(text) else self._plain).findall(text)

    def stretches(self, text: str) -> list[str]:
        """The text cut at added tokens, which stand alone at odd places."""
        return self._cut.split(text) if self._cut else [text]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(self.added[s] if i % 2 else self._encode(s) for i, s in enumerate(self.stretches(text)))

    def _encode(self, text: str) -> bytes:
        """Ids of a text without added tokens: in one call, or word by word where it is long or unusual."""
        if len(text) <= LEAF and not self._unusual.search(text):
            return np.frombuffer(array("I", self._core.encode_ordinary(text)), np.uintc).astype("<u4").tobytes()
        return b"".join(map(self._known.__getitem__, self.words(text)))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self._table.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")

    # -- tree concatenation ---------------------------------------------------

    def part(self, text: str) -> Part:
        words = self.words(text)
        return Part(words, [self._known[w] for w in words])

    def stable(self, a: int, b: int) -> bool:
        """Whether two tokens, put together, are encoded as themselves."""
        return self._core.encode_single_piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def join_word(self, left: bytes, right: bytes) -> bytes:
        """Ids of a word from the ids of its two parts."""
        a, b = np.frombuffer(left, "<u4").tolist(), np.frombuffer(right, "<u4").tolist()
        width = 8
        while True:
            i, j = max(0, len(a) - width), min(len(b), width)
            window = self._core.encode_single_piece(b"".join(self.bytes_of[t] for t in a[i:] + b[:j]))
            if (i == 0 or self.stable(a[i - 1], window[0])) and (j == len(b) or self.stable(window[-1], b[j])):
                return np.array(a[:i] + window + b[j:], "<u4").tobytes()
            width *= 2

    def join(self, left: Part, right: Part) -> Part:
        if not left.words or not right.words:
            return right if not left.words else left
        i = j = 2
        while True:
            i, j = min(i, len(left.words)), min(j, len(right.words))
            head = "".join(left.words[-i:])
            window = self.words(head + "".join(right.words[:j]))
            starts = np.cumsum([len(head)] + [len(w) for w in right.words[:j]])
            ends = np.cumsum([0] + [len(w) for w in window])
            # Word starts of both inside the window; at its end only if the text ends too.
            last = starts[-1] if j < len(right.words) else starts[-1] + 1
            both = np.intersect1d(starts, ends)
            both = both[(both >= len(head)) & (both < last)]
            if len(both):
                k, m = int(np.searchsorted(ends, both[0])), int(np.searchsorted(starts, both[0]))
                ids = [self._joined(w, left, right) for w in window[:k]]
                return Part(left.words[:-i] + window[:k] + right.words[m:], left.ids[:-i] + ids + right.ids[m:])
            j *= 2

    def _joined(self, word: str, left: Part, right: Part) -> bytes:
        """Ids of a word of the window; a long one that runs through the join is not encoded again."""
        if len(word) > LONG_WORD and word == left.words[-1] + right.words[0]:
            return self.join_word(left.ids[-1], right.ids[0])
        return self._known[word]


@cache
def codec(path: str) -> Codec:
    """One per worker process."""
    return Codec(path)


def _encode_short(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(path).encode
        for batch in batches:
            ids = [encode(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["key", "ids"])

    return run


def _leaves(path: str, size: int):
    """Stretches between added tokens, each cut into leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for tid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i, stretch in enumerate(codec(path).stretches(text)):
                    for leaf, at in enumerate(range(0, max(1, len(stretch)), size)):
                        out.append((tid, i, leaf, stretch[at : at + size]))
            kinds = [pa.binary(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 4, kinds, strict=True)],
                names=["tid", "stretch", "leaf", "body"],
            )

    return run


def _encode_leaves(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                words, ids = [], []
                for odd, body in zip(some.column(1).to_pylist(), some.column(3).to_pylist(), strict=True):
                    part = Part([body], [own.added[body]]) if odd % 2 else own.part(body)
                    words.append(part.words)
                    ids.append(part.ids)
                yield pa.RecordBatch.from_arrays(
                    [*some.columns[:3], pa.array(words, pa.list_(pa.string())), pa.array(ids, pa.list_(pa.binary()))],
                    names=["tid", "stretch", "leaf", "words", "ids"],
                )

    return run


def _concatenate(path: str):
    """Joins the leaves of one text pair by pair, level by level."""

    def run(table: pa.Table) -> pa.Table:
        own = codec(path)
        rows = sorted(
            zip(*(table.column(c).to_pylist() for c in ("stretch", "leaf", "words", "ids")), strict=True), key=lambda r: r[:2]
        )
        stretches: dict[int, list[Part]] = {}
        for stretch, _, words, ids in rows:
            stretches.setdefault(stretch, []).append(Part(words, ids))
        out = []
        for parts in stretches.values():
            while len(parts) > 1:
                pairs = [own.join(*parts[i : i + 2]) for i in range(0, len(parts) - 1, 2)]
                parts = pairs + parts[2 * len(pairs) :]
            out += parts[0].ids
        tid = table.column("tid")[0].as_py()
        return pa.table([pa.array([tid], pa.binary()), pa.array([b"".join(out)], pa.binary())], names=["tid", "ids"])

    return run


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", leaf: int = LEAF) -> DataFrame:
    """``(key, ids)`` for each row: the ids of its text, as little-endian unsigned 32-bit integers.

    As the tokenizers library encodes with ``add_special_tokens=False``, without truncation
    and padding; strings of added tokens in a text are those tokens. A null text is empty
    and has no ids. Texts of up to ``leaf`` characters are encoded where they are read;
    longer ones are cut into leaves that are dealt out, equal texts only once. Repeated
    rows and rows with a null key each keep their row; other columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    short = rows.where(F.length("body") <= leaf).mapInArrow(_encode_short(path), f"key {kind}, ids binary")
    long = rows.where(F.length("body") > leaf).select("key", text_key(F.col("body")).alias("tid"), "body")
    leaves = long.select("tid", "body").mapInArrow(
        _leaves(path, leaf), "tid binary, stretch int, leaf int, body string"
    )
    parts = (
        leaves.dropDuplicates(["tid", "stretch", "leaf"])
        .select("tid", "stretch", "leaf", "body")
        .mapInArrow(_encode_leaves(path), "tid binary, stretch int, leaf int, words array<string>, ids array<binary>")
    )
    whole = parts.groupBy("tid").applyInArrow(_concatenate(path), "tid binary, ids binary")
    joined = long.select("key", "tid").join(whole, "tid").select("key", "ids")
    return short.unionByName(joined).withColumnRenamed("key", key)


def decode(tokens: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``(key, text)`` for each row; null ids give an empty text."""
    kind = tokens.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = codec(path).decode
        for batch in batches:
            texts = [back(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    rows = tokens.select(F.col(key).alias("key"), F.coalesce(F.col(ids), F.lit(b"")).alias("ids"))
    return rows.mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)
