"""Quality by a document classifier and the reputation of where a document comes from.

1. Two linear classifiers (quality, toxicity) over hashed words and text counts are
   fitted on a bounded sample of labelled documents and score every document.
2. Sites are estimated by hierarchical empirical Bayes. A path (within a host) is a
   binomial rate with a beta prior around its host's rate, and a host one around the
   rate of all; evidence is the label where there is one, the classifier's probability
   elsewhere. The weight of each prior is estimated by moments, so sparse sites
   shrink to the level above and large ones speak for themselves.
3. A document's odds are Bayes' rule: the classifier's odds over those of the corpus are
   the likelihood ratio of its text, the prior is the posterior mean of its path's rate
   given all other documents. The document's own share of that rate is taken out first.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainmetrics.llm.common import staged
from chainmetrics.llm.quality_rules import SYMBOLS, counts

#: Labelled documents used to fit, at most: those with the least hash of their key.
SAMPLE = 8_000
#: Buckets of hashed words.
BUCKETS = 1 << 20
#: Lengths in bytes of the beginnings of words, and how many words make a family.
PREFIXES, FAMILY = (6, 7, 9), 3
EPOCHS, RATE, RIDGE, BATCH = 20, 0.3, 1e-6, 32
#: A document stays if it is good, and not toxic, with these probabilities.
GOOD_FROM, TOXIC_FROM = 0.5, 0.5
#: Bounds of the weight of a prior, in documents.
WEIGHT = (2.0, 1000.0)

#: A bucket is used if so many labelled documents hold it, and their labels stand so
#: many standard deviations off the base rate.
HELD_BY, DEVIATIONS = 4, 4.0
#: Rates assumed before any label, worth so many labels.
GOOD_BEFORE, TOXIC_BEFORE, WORTH = 0.9, 0.05, 2

_DROPPED = (".,;:!?\"'()[]" + SYMBOLS).encode()
_DENSE = 10


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the distinct words, their beginnings, and beginnings of several words; some shares."""
    words = set(text.lower().encode().translate(None, _DROPPED).split())
    found = [zlib.crc32(w) for w in words]
    for size in PREFIXES:
        starts = Counter(w[:size] for w in words if len(w) > size)
        found += [zlib.crc32(p, size) for p in starts]
        found += [zlib.crc32(p, 256 + size) for p, n in starts.items() if n >= FAMILY]
    at = np.fromiter({h % BUCKETS for h in found}, np.int64)
    n, chars, symbols, dup_lines, repeat, lines, letters, upper, ends, frequent, marked, doubled = counts(text)
    word, line = max(n, 1), max(lines, 1)
    dense = (
        np.log1p(n) / 8, chars / word / 10, min(1, 5 * symbols / max(chars, 1)), dup_lines / line, repeat / word,
        upper / max(letters, 1), min(1, 4 * ends / word), frequent / word, marked / word, doubled / word,
    )
    return at, np.array(dense)


@dataclass(frozen=True)
class Linear:
    """Weights of the buckets and of the shares, and an offset."""

    words: np.ndarray
    dense: np.ndarray
    offset: float

    def score(self, at: np.ndarray, dense: np.ndarray) -> float:
        return float(self.words[at].sum() + self.dense @ dense + self.offset)


def _telling(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> np.ndarray:
    """Buckets whose documents' labels are too far from the base rate for chance."""
    rate, n, ones = labels.mean(), np.zeros(BUCKETS), np.zeros(BUCKETS)
    for (at, _), label in zip(rows, labels, strict=True):  # a document holds a bucket once
        n[at] += 1
        ones[at] += label
    off = np.abs(ones - n * rate) / np.sqrt(np.maximum(n, 1) * rate * (1 - rate))
    return (n >= HELD_BY) & (off >= DEVIATIONS)


def fit_linear(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, before: float) -> Linear:
    """Logistic regression by AdaGrad in a fixed order; the base rate alone without both classes."""
    rate = (labels.sum() + WORTH * before) / (len(labels) + WORTH)
    words, dense, offset = np.zeros(BUCKETS, np.float32), np.zeros(_DENSE), float(np.log(rate / (1 - rate)))
    if not 0 < labels.sum() < len(labels):
        return Linear(words, dense, offset)
    telling = _telling(rows, labels)
    rows = [(at[telling[at]], shares) for at, shares in rows]
    seen_w, seen_d, seen_o = np.full(BUCKETS, 1e-2, np.float32), np.full(_DENSE, 1e-2), 1e-2
    shares, order = np.array([r[1] for r in rows]), np.random.default_rng(1)
    for _ in range(EPOCHS):
        for part in np.array_split(order.permutation(len(rows)), max(1, len(rows) // BATCH)):
            at = np.concatenate([rows[i][0] for i in part])
            ends = np.cumsum([len(rows[i][0]) for i in part])
            sums = np.diff(np.concatenate(([0.0], np.cumsum(words[at], dtype=np.float64)))[np.concatenate(([0], ends))])
            p = 1 / (1 + np.exp(-np.clip(sums + shares[part] @ dense + offset, -30, 30)))
            error = p - labels[part]
            used, back = np.unique(at, return_inverse=True)
            grad = np.bincount(back, np.repeat(error, np.diff(ends, prepend=0)), len(used)) / len(part) + RIDGE * words[used]
            seen_w[used] += grad**2
            words[used] -= (RATE * grad / np.sqrt(seen_w[used])).astype(np.float32)
            grad_d, grad_o = error @ shares[part] / len(part), error.mean()
            seen_d += grad_d**2
            seen_o += grad_o**2
            dense -= RATE * grad_d / np.sqrt(seen_d)
            offset -= RATE * grad_o / np.sqrt(seen_o)
    return Linear(words, dense, float(offset))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t.as_py()) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array([at.astype("<i4").tobytes() for at, _ in rows], pa.binary()),
                pa.array([dense.tobytes() for _, dense in rows], pa.binary()),
            ],
            names=["quality", "toxic", "words", "dense"],
        )


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> tuple[Linear, Linear]:
    """Classifiers of quality and toxicity from at most ``sample`` labelled documents."""
    chosen = (
        labels.select(F.col(key).alias("key"), "quality", "toxic")
        .where("key is not null")
        .groupBy("key")
        .agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("key"), "key")
        .limit(sample)
    )
    rows = (
        docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"))
        .join(F.broadcast(chosen), "key")  # at most ``sample`` rows
        .select(F.col("quality").cast("double"), F.col("toxic").cast("double"), "body")
        .mapInArrow(_feature_rows, "quality double, toxic double, words binary, dense binary")
    )
    # Repeated rows of one key can exceed the sample; the order makes the fit reproducible.
    found = sorted(rows.orderBy(F.xxhash64("words", "dense")).limit(sample).collect(), key=lambda r: (bytes(r.words), bytes(r.dense)))
    models = []
    for name, before in (("quality", GOOD_BEFORE), ("toxic", TOXIC_BEFORE)):
        some = [r for r in found if r[name] is not None]
        pairs = [(np.frombuffer(r.words, "<i4"), np.frombuffer(r.dense)) for r in some]
        models.append(fit_linear(pairs, np.array([float(r[name]) for r in some]), before))
    return models[0], models[1]


def _scores(quality: Linear, toxic: Linear):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(f[0]), quality.score(*f), toxic.score(*f)) for f in (features(t.as_py()) for t in batch.column(3))]
            columns = zip(*rows, strict=True) if rows else [[]] * 3
            kinds = (pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["key", "host", "path", "kinds", "quality", "toxic"],
            )

    return run


def _weight(groups: DataFrame) -> float:
    """Weight of the prior by moments, from groups with n documents, rate r and prior mean m."""
    spread = F.col("n") * (F.col("r") - F.col("m")) ** 2 / (F.col("m") * (1 - F.col("m")))
    row = (
        groups.where("n > 0 and m > 0 and m < 1")
        .agg(F.sum(spread).alias("v"), F.count("*").alias("g"), F.sum("n").alias("n"))
        .first()
    )
    if not row.g or row.n == row.g:
        return WEIGHT[1]
    rho = (row.v - row.g) / (row.n - row.g)
    return min(WEIGHT[1], max(WEIGHT[0], 1 / rho - 1)) if rho > 0 else WEIGHT[1]


def site_rates(evidence: DataFrame) -> tuple[DataFrame, float]:
    """``(host, path, n, total, prior, weight)`` and the rate of all.

    ``evidence(host, path, p)``: a probability for each document. ``prior`` is the rate of
    the host, shrunk to that of all; ``weight`` is what it counts, in documents.
    """
    paths = evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("total"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    if not whole.n:
        return paths.withColumns({"prior": F.lit(0.5), "weight": F.lit(WEIGHT[1])}), 0.5
    rate = min(1 - 1e-6, max(1e-6, whole.total / whole.n))
    hosts = hosts.withColumn("m", F.lit(rate)).withColumn("r", F.col("total") / F.col("n"))
    weight = _weight(hosts)
    hosts = hosts.select(F.col("host").alias("_host"), ((F.col("total") + weight * F.col("m")) / (F.col("n") + weight)).alias("m"))
    joined = paths.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    inner = _weight(joined.withColumn("r", F.col("total") / F.col("n")))
    return joined.withColumnRenamed("m", "prior").withColumn("weight", F.lit(inner)), rate


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(30.0)), F.lit(-30.0))))


def _log_odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def _with_site(rows: DataFrame, score: str, label: str, out: str) -> DataFrame:
    own = F.coalesce(F.col(label).cast("double"), _sigmoid(F.col(score)))
    rows = rows.withColumn("_p", own)
    rates, base = site_rates(rows.select("host", "path", F.col("_p").alias("p")))
    rates = staged(rates).select(
        F.col("host").alias("_host"), F.col("path").alias("_path"), "n", "total", "prior", "weight"
    )
    at_site = F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path"))
    others = (F.col("total") - F.col("_p") + F.col("weight") * F.col("prior")) / (F.col("n") - 1 + F.col("weight"))
    others = F.greatest(F.least(others, F.lit(1 - 1e-6)), F.lit(1e-6))
    moved = F.col(score) - float(np.log(base / (1 - base))) + _log_odds(others)
    joined = rows.join(rates, at_site).withColumns({f"site_{out}": others, out: _sigmoid(moved)})
    return joined.drop("_p", "_host", "_path", "n", "total", "prior", "weight")


def classified(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    host: str = "source",
    path: str = "lang",
    sample: int = SAMPLE,
) -> DataFrame:
    """``key``, ``host``, ``path``, ``p_good``, ``p_toxic``, the rates ``site_p_good`` and ``site_p_toxic``, and ``kept``.

    One row for each row of ``docs``. ``labels`` has ``key``, ``quality`` and ``toxic`` (0, 1 or null);
    several labels of a key count as the worst. A null host or path is a site of its own. A text
    without a word (null, empty) is rejected. Without labels nothing else is. Rows with a
    null key are judged like any other; repeated rows each keep their row.
    """
    kinds = {c: docs.schema[c].dataType.simpleString() for c in (key, host, path)}
    models = fit(docs, labels, key, text, sample)
    rows = docs.select(
        F.col(key).alias("key"), F.col(host).alias("host"), F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("body")
    )
    schema = f"key {kinds[key]}, host {kinds[host]}, path {kinds[path]}, kinds long, quality double, toxic double"
    scored = staged(rows.mapInArrow(_scores(*models), schema))
    known = (
        labels.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("key"))
        .agg(F.min("quality").alias("is_good"), F.max("toxic").alias("is_toxic"))
    )
    rows = scored.join(known, "key", "left")
    rows = _with_site(rows, "quality", "is_good", "p_good")
    rows = _with_site(rows, "toxic", "is_toxic", "p_toxic")
    kept = (F.col("kinds") > 0) & (F.col("p_good") >= GOOD_FROM) & (F.col("p_toxic") < TOXIC_FROM)
    return rows.select(
        F.col("key").alias(key), "host", "path", "p_good", "p_toxic", "site_p_good", "site_p_toxic", kept.alias("kept")
    )
