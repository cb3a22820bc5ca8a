"""Quality by weak supervision: rules vote or abstain, and are weighed by estimated accuracy.

No rule rejects a document by itself. Each votes good (1), bad (-1) or abstains (0). A
latent class model (good or bad; given it, votes are independent) is fitted by
expectation-maximisation, which gives each rule's accuracy on good and on bad documents
without labels. A document is kept if its posterior probability of being good, given
all votes, is high enough. Besides, two plain base checks reject at once.

The model sees the corpus through counts of vote patterns. There are at most 3 to the
number of rules of them (19,683 for nine rules), whatever the corpus, so they may go to
the driver.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainmetrics.llm.common import SPACE, staged, words_in_parts

SYMBOLS = "#*$%&|<>"
#: Words in a window that counts as repeated if it occurs twice.
WINDOW = 5
#: Base checks: fewest words, and most words in repeated windows (percent).
FEWEST_WORDS, MOST_REPEATED = 10, 20
#: A document stays if it is good with at least this probability.
KEPT_FROM = 0.5
#: EM stops when no estimate moves by more, or after so many rounds.
TOLERANCE, ROUNDS = 1e-9, 500
#: Pseudo-votes (right, wrong) of each rule and class; rules are taken to be better than chance.
PRIOR_VOTES = (8.0, 2.0)

#: Frequent words of English, French, German and Spanish.
FREQUENT = frozenset(
    b"the of and to in is that it for as with was on be by "
    b"de la le et les des en un une du est que qui dans pour "
    b"der die und das von zu den mit ist ein nicht im sich "
    b"el los se del las por con su para al".split()
)

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_letters", "n_upper", "n_ends", "n_frequent", "n_marked", "n_doubled",
)


@dataclass(frozen=True)
class Rule:
    """Votes good or bad where a condition on the counts holds, and abstains elsewhere."""

    name: str
    good: Callable[[], Column]
    bad: Callable[[], Column]


def _share(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def _range(a: str, b: str, good: tuple[float, float], bad: tuple[float, float]) -> tuple[Callable, Callable]:
    """Good within ``good``, bad outside ``bad``."""
    share = lambda: _share(a, b)
    return (lambda: share().between(*good)), (lambda: (share() < bad[0]) | (share() > bad[1]))


RULES: tuple[Rule, ...] = (
    Rule("symbols", *_range("n_symbols", "word_chars", (0, 0.005), (0, 0.03))),
    Rule("marked words", *_range("n_marked", "n_words", (0, 0.02), (0, 0.15))),
    Rule("repeated words", *_range("n_repeat_words", "n_words", (0, 0.05), (0, 0.15))),
    Rule("doubled words", *_range("n_doubled", "n_words", (0, 0.04), (0, 0.2))),
    Rule("repeated lines", *_range("n_dup_lines", "n_lines", (0, 0.05), (0, 0.25))),
    Rule("word length", *_range("word_chars", "n_words", (3, 9), (2.2, 13))),
    Rule("capitals", *_range("n_upper", "n_letters", (0, 0.12), (0, 0.35))),
    Rule("frequent words", *_range("n_frequent", "n_words", (0.12, 0.7), (0.04, 0.9))),
    Rule("sentences", *_range("n_ends", "n_words", (0.02, 0.34), (0.004, 0.75))),
)


def _repeated(words: list[bytes], size: int) -> int:
    """Words that lie in a window of ``size`` words that occurs twice or more."""
    if len(words) <= size:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    n, kinds = len(words) - size + 1, len(numbers)
    code, top = ids[:n], kinds
    for k in range(1, size):
        if top * kinds >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
            top = n
        code, top = code * kinds + ids[k : k + n], top * kinds
    ordered = np.sort(code)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    hit = np.flatnonzero(np.isin(code, twice))
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + size, -1)
    return int((np.cumsum(cover) > 0).sum())


_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_NOT_LETTER = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122))
_TRIM = b".,;:!?\"'()"


def counts(text: str) -> tuple[int, ...]:
    """The ``COUNTS`` of a text."""
    raw = text.encode()
    words = [w for part in words_in_parts(raw) for w in part]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    bare = [w.strip(_TRIM).lower() for w in words]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        _repeated(words, WINDOW),
        len(lines),
        len(raw.translate(None, _NOT_LETTER)),
        len(raw.translate(None, _NOT_UPPER)),
        sum(w[-1:] in b".!?" for w in words),
        sum(w in FREQUENT for w in bare),
        sum(w[-2:-1] == w[-1:] and not w[-1:].isalnum() for w in words),
        sum(map(operator.eq, bare[1:], bare)),
    )


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [counts(t.as_py()) for t in batch.column(1)]
        columns = zip(*rows, strict=True) if rows else [[]] * len(COUNTS)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["key", *COUNTS]
        )


def text_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the ``COUNTS`` of each row's text; a null text is empty."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    schema = f"key {kind}, " + ", ".join(f"{c} long" for c in COUNTS)
    return rows.mapInArrow(_count_rows, schema)


@dataclass(frozen=True)
class Model:
    """Share of good documents, and each rule's chance to be right when it votes."""

    good: float
    right_on_good: tuple[float, ...]
    right_on_bad: tuple[float, ...]


def fit(patterns: np.ndarray, weights: np.ndarray) -> Model:
    """EM over vote patterns (rows of -1, 0, 1) and their numbers of documents."""
    m = patterns.shape[1]
    if not len(patterns):
        return Model(0.5, (0.8,) * m, (0.8,) * m)
    plus, minus, w = patterns == 1, patterns == -1, weights.astype(float)
    # Start from the majority of votes; ties lean to good.
    posterior = np.clip(0.55 + 0.4 * np.sign(plus.sum(1) - 2 * minus.sum(1)), 0.05, 0.95)
    before = np.zeros(2 * m + 1)
    for _ in range(ROUNDS):
        g, b = w * posterior, w * (1 - posterior)
        rate = (g.sum() + 1) / (w.sum() + 2)
        a = (g @ plus + PRIOR_VOTES[0]) / (g @ (plus | minus) + sum(PRIOR_VOTES))
        c = (b @ minus + PRIOR_VOTES[0]) / (b @ (plus | minus) + sum(PRIOR_VOTES))
        # A vote must not speak against what it says: right on good at least as often as wrong on bad.
        a = np.maximum(a, 1 - c)
        odds = np.log(rate / (1 - rate)) + plus @ np.log(a / (1 - c)) + minus @ np.log((1 - a) / c)
        posterior = 1 / (1 + np.exp(-odds))
        now = np.concatenate(([rate], a, c))
        if np.abs(now - before).max() < TOLERANCE:
            break
        before = now
    return Model(float(rate), tuple(map(float, a)), tuple(map(float, c)))


def posterior(model: Model, votes: Sequence[Column]) -> Column:
    odds = F.lit(float(np.log(model.good / (1 - model.good))))
    for vote, a, c in zip(votes, model.right_on_good, model.right_on_bad, strict=True):
        odds = odds + F.when(vote == 1, float(np.log(a / (1 - c)))).when(vote == -1, float(np.log((1 - a) / c))).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def judged(
    docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES, kept_from: float = KEPT_FROM
) -> DataFrame:
    """``key``, the ``COUNTS``, ``base_failed``, ``votes``, ``p_good`` and ``kept`` for each row.

    Null and empty texts have zero counts and fail the base checks. Rules are estimated on
    the documents that pass them; without any, all rules count alike. Repeated rows are
    documents of their own, null keys are kept, other columns are ignored.
    """
    rows = staged(text_counts(docs, key, text))
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    vote = [F.when(r.bad(), -1).when(r.good(), 1).otherwise(0).cast("int") for r in rules]
    rows = rows.withColumn("base_failed", failed).withColumn("votes", F.array(*vote))
    found = rows.where("not base_failed").groupBy("votes").count().collect()
    model = fit(np.array([r.votes for r in found]).reshape(-1, len(rules)), np.array([r["count"] for r in found]))
    p = posterior(model, [F.col("votes")[i] for i in range(len(rules))])
    kept = ~F.col("base_failed") & (F.col("p_good") >= kept_from)
    return rows.withColumn("p_good", p).withColumn("kept", kept).withColumnRenamed("key", key)
