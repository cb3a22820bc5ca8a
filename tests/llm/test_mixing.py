from __future__ import annotations

import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from chainmetrics.llm.mixing import cycled_weights, mixed, shares

SCHEMA = "doc_id long, text string, source string, extra int, `size` string, of int, place string"


def targets(sizes: dict, weights: dict, epochs: int) -> dict:
    """Clamp the sources that are too small and share out the rest anew."""
    total, clamped = sum(sizes.values()), set()
    while True:
        free = [s for s in sizes if s not in clamped]
        left = total - sum(epochs * sizes[s] for s in clamped)
        share = {s: Fraction(left * weights.get(s, 0), sum(weights.get(f, 0) for f in free) or 1) for s in free}
        over = {s for s in free if share[s] > epochs * sizes[s]}
        if not over:
            return {s: share.get(s, Fraction(epochs * sizes[s])) for s in sizes}
        clamped |= over


def size(text) -> int:
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(rows, got, weights, epochs=3):
    sizes = Counter()
    for r in rows:
        sizes[r[2]] += size(r[1])
    want = targets(sizes, weights, epochs)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], size(r[1])) for r in rows)
    taken, longest, of = Counter(), Counter(), defaultdict(set)
    for r in got:
        of[r.source_size, r.target].add(r.doc_id)
        assert r.taken == r.repeats * r.size <= epochs * r.size
    source_of = {r[0]: r[2] for r in rows}
    for r in got:
        s = source_of[r.doc_id]
        assert r.source_size == sizes[s]
        assert r.target == pytest.approx(float(want[s]))
        taken[s] += r.taken
        longest[s] = max(longest[s], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s] / 2, s


@pytest.mark.parametrize("epochs", [1, 2, 3])
def test_equals_clamping_by_rounds(spark, epochs):
    rows, number = [], 0
    for s, n in enumerate([400, 3, 9, 40, 80, 1, 0, 17]):
        for i in range(n):
            rows.append((number, " ".join(["w"] * (1 + (i * 37 + s) % 60)), None if s == 3 else f"s{s}", 1, "x", 2, "y"))
            number += 1
    rows += [(number, None, "s0", 1, "x", 2, "y"), (number + 1, "", "empty", 1, "x", 2, "y"), (number + 2, "  \x1c\t\x0b", "s1", 1, "x", 2, "y")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    weights = {f"s{s}": 1 + s % 3 for s in range(8)} | {None: 5, "empty": 2}
    given = spark.createDataFrame(list(weights.items()), "source string, weight long")
    got = shares(docs, given, epochs).collect()
    check(rows, got, weights, epochs)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, shares(docs.repartition(5), given, epochs).collect()), key=str)


def test_mix_holds_each_row_as_often_as_said(spark):
    rows = [(i, "a b c d"[: 1 + i % 7], f"s{i % 5}" if i % 5 < 3 else "s0", i, "x", 2, "y") for i in range(90)]
    docs = spark.createDataFrame(rows, SCHEMA)
    weights = cycled_weights(docs)
    said = {r.doc_id: r.repeats for r in shares(docs, weights).collect()}
    out = mixed(docs, weights)
    assert out.columns == docs.columns
    assert Counter(tuple(r) for r in out.collect()) == Counter({r: said[r[0]] for r in rows if said[r[0]]})


def test_weights_in_turn_by_code_point(spark):
    docs = spark.createDataFrame([(s,) for s in ["b", "a", None, "\U0001f600", "￮", "B", "a"]], "source string")
    got = {r.source: r.weight for r in cycled_weights(docs).collect()}
    assert got == {"B": 1, "a": 2, "b": 3, "￮": 1, "\U0001f600": 2, None: 3}


def test_unlisted_sources_repeated_rows_and_no_rows(spark):
    rows = [(1, "a b", "x", 0, "", 0, "")] * 4 + [(None, "a b c", "x", 0, "", 0, ""), (2, "q " * 10, "unlisted", 0, "", 0, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    weights = spark.createDataFrame([("x", 1), ("absent", 7)], "source string, weight long")
    got = shares(docs, weights).collect()
    assert len({r.repeats for r in got if r.doc_id == 1}) == 1
    assert [(r.target, r.taken) for r in got if r.doc_id == 2] == [(0.0, 0)]
    assert sum(r.taken for r in got) >= 17
    assert shares(docs.where("false"), weights).collect() == []
    assert cycled_weights(docs.where("false")).collect() == []
    assert {r.taken for r in shares(docs.select("doc_id", "source").selectExpr("*", "'' AS text"), weights).collect()} == {0}


def test_one_source_with_most_rows(spark):
    docs = spark.range(60_000).selectExpr(
        "id AS doc_id", "repeat('w ', cast(1 + id % 50 AS int)) AS text", "if(id % 3 < 2, 'hot', concat('s', id % 40)) AS source"
    )
    got = shares(docs, cycled_weights(docs)).toPandas()
    got["source"] = [-1 if i % 3 < 2 else i % 40 for i in got["doc_id"]]
    taken = got.groupby("source").agg({"taken": "sum", "target": "max"})
    assert (abs(taken["taken"] - taken["target"]) <= 25).all()


def test_long_texts(spark):
    rows = [(1, "w " * 3_000_000, "a"), (2, "w" * 5_000_000, "b"), (3, "x y", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.doc_id: r.size for r in shares(docs, cycled_weights(docs)).collect()} == {1: 3_000_000, 2: 1, 3: 2}
