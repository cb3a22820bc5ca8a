from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from chainmetrics.llm.quality_rules import RULES, counts, fit, judged


def plain(text: str) -> tuple[int, int, int, int, int]:
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    dup = sum(1 for i, x in enumerate(lines) if x in lines[:i])
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(list("ab é#|\n\t\x0b\x85 \u3000")), max_size=120))
def test_counts(text):
    assert counts(text)[:5] == plain(text)


def test_counts_of_long_repetition():
    rnd = random.Random(1)
    words = [str(rnd.randint(0, 40_000)) for _ in range(60_000)]
    text = " ".join(words + words[100:140] + ["x"])
    assert counts(text)[:5] == plain(text)


def test_estimated_accuracies():
    rnd = np.random.default_rng(0)
    good = rnd.random(40_000) < 0.8
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.7, 0.6])
    votes = np.where(rnd.random((len(good), 6)) < right, 1, -1) * np.where(good, 1, -1)[:, None]
    votes[rnd.random(votes.shape) < 0.3] = 0
    patterns, weights = np.unique(votes, axis=0, return_counts=True)
    model = fit(patterns, weights)
    assert abs(model.good - 0.8) < 0.03
    assert np.abs(np.array(model.right_on_good) - right).max() < 0.04
    assert np.abs(np.array(model.right_on_bad) - right).max() < 0.08
    assert 0 < fit(np.zeros((0, 8)), np.zeros(0)).good < 1


def test_rows(spark):
    prose = "The house of the old man is on the hill. It was built by his father in that year. "
    texts = [None, "", "too short", "word " * 60, prose + "And the rest of it is for him.", "### $$$ " * 30]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, texts[4], 1, "x")], "doc_id long, text string, n_words int, votes string")
    got = {r.doc_id: r for r in judged(docs).collect()}
    for i, text in enumerate(texts):
        n_words, *_, repeat = plain(text or "")
        assert (got[i].n_words, got[i].n_repeat_words) == (n_words, repeat)
        assert got[i].base_failed == (n_words < 10 or 100 * repeat > 20 * n_words)
        assert not (got[i].base_failed and got[i].kept)
    assert got[4].kept and got[None].kept
    assert judged(docs.where("false")).collect() == []


def test_agrees_with_labels(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    rows = judged(docs).join(labels, "doc_id").select("kept", "base_failed", "quality").toPandas()
    rows = rows[~rows.base_failed]
    assert rows.kept[rows.quality == 1].mean() > 0.99
    assert rows.kept[rows.quality == 0].mean() < 0.05
    assert 3 ** len(RULES) < 20_000
