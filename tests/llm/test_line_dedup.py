from __future__ import annotations

import random
import time
from collections import defaultdict

import pytest

from chainmetrics.llm.line_dedup import remove_later_runs, without_runs


def longest(texts: list[str | None], min_chars: int) -> list[list[int]]:
    """Deleted lines of each document, by the longest match over all earlier positions."""
    lines = [(t or "").split("\n") for t in texts]
    where = [(d, i) for d, ls in enumerate(lines) for i in range(len(ls))]

    def common(p, q):
        pairs = zip(lines[p[0]][p[1] :], lines[q[0]][q[1] :], strict=False)
        return next((n for n, (a, b) in enumerate(pairs) if a != b), min(len(lines[p[0]]) - p[1], len(lines[q[0]]) - q[1]))

    gone, earlier = [set() for _ in texts], defaultdict(list)
    for p in where:
        alike = earlier[lines[p[0]][p[1]]]  # any other position shares no line
        n = max((common(p, q) for q in alike), default=0)
        alike.append(p)
        if sum(len(x) for x in lines[p[0]][p[1] : p[1] + n]) >= min_chars:
            gone[p[0]] |= set(range(p[1], p[1] + n))
    return [sorted(g) for g in gone]


@pytest.mark.parametrize("seed,min_chars", [(1, 0), (2, 9), (3, 25)])
def test_equals_brute_force(spark, seed, min_chars):
    rnd = random.Random(seed)
    pool = ["", "a", "bb", "the same line", "another line of words", *(f"line {i} {'x' * rnd.randint(0, 9)}" for i in range(25))]
    block = [rnd.choice(pool) for _ in range(13)]
    texts: list[str | None] = [None, "", "\n", "a\na\na\na\na\na\na"]
    for _ in range(25):
        own = [rnd.choice(pool) if rnd.random() < 0.7 else f"own {rnd.random()}" for _ in range(rnd.randint(0, 12))]
        at = rnd.randint(0, len(own))
        cut = rnd.randint(0, 6)
        texts.append("\n".join(own[:at] + (block[cut : cut + rnd.randint(1, 9)] if rnd.random() < 0.5 else []) + own[at:]))
    texts.append(texts[7])
    docs = spark.createDataFrame(
        [(i, t, "x", 7, "y", "z", 3, "v") for i, t in enumerate(texts)],
        "doc_id long, text string, key string, line int, _own string, _gone string, did int, spans string",
    )
    out = remove_later_runs(docs.repartition(3), min_chars=min_chars)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    got = {r.doc_id: r for r in out.collect()}
    want = longest(texts, min_chars)
    assert any(want)
    for i, (text, gone) in enumerate(zip(texts, want, strict=True)):
        lines = (text or "").split("\n")
        left = "\n".join(x for j, x in enumerate(lines) if j not in gone)
        assert (got[i].n_lines, got[i].n_removed) == (len(lines), len(gone)), i
        assert got[i].text == (text if not gone else left), i
        assert tuple(got[i])[2:8] == ("x", 7, "y", "z", 3, "v")


def test_null_keys_repeated_rows_and_empty_tables(spark):
    same = "a line that is long enough to be deleted when it comes again, surely"
    docs = spark.createDataFrame(
        [(None, same), (1, same), (1, same), (2, f"{same}\nz"), (None, None)], "doc_id long, text string"
    )
    got = sorted((str(r.doc_id), r.text, r.n_removed) for r in remove_later_runs(docs).collect() if r.text is not None)
    assert got == [("1", "", 1), ("1", "", 1), ("2", "z", 1), ("None", same, 0)]
    alone = remove_later_runs(docs.where("doc_id = 1")).collect()
    assert [(r.text, r.n_removed) for r in alone] == [(same, 0)] * 2
    assert remove_later_runs(docs.where("false")).collect() == []


@pytest.mark.parametrize("seed,min_chars", [(0, 50), (4, 6), (5, 7), (6, 8)])
def test_run_is_the_longest_of_all_earlier_copies(spark, seed, min_chars):
    a, b, c = ("".join(x * 20) for x in "ABC")
    texts = [f"{a}\n{b}\nx", f"{a}\n{b}\n{c}", f"{a}\n{b}\n{c}"]
    if seed:
        rnd = random.Random(seed)
        texts = ["\n".join(rnd.choice(["a", "b", "", "cc"]) for _ in range(rnd.randint(0, 24))) for _ in range(30)]
    want = longest(texts, min_chars)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in remove_later_runs(docs.repartition(3), min_chars=min_chars).collect()}
    for i, (text, gone) in enumerate(zip(texts, want, strict=True)):
        assert got[i].n_removed == len(gone), i
        assert got[i].text == (text if not gone else "\n".join(x for j, x in enumerate(text.split("\n")) if j not in gone)), i


def test_work_grows_with_the_lines(spark):
    """A log of 200,000 lines with a run at every other one, some of them overlapping."""
    n = 200_000
    docs = spark.range(2).selectExpr("id AS doc_id", f"array_join(transform(sequence(0, {n - 1}), i -> concat('l', i)), '\n') AS text")
    runs = docs.selectExpr("doc_id AS key", "xxhash64(text) AS did", f"explode(sequence(0, {n - 1}, 4)) AS line").selectExpr("*", f"least(IF(line % 8 = 0, 2, 5), {n} - line) AS lines")
    gone = {j for i in range(0, n, 4) for j in range(i, i + (2 if i % 8 == 0 else 5)) if j < n}
    start = time.time()
    got = without_runs(docs, runs.where("key = 0")).collect()
    assert time.time() - start < 60
    by_id = {r.doc_id: r for r in got}
    assert by_id[0].text.split("\n") == [f"l{i}" for i in range(n) if i not in gone]
    assert (by_id[0].n_lines, by_id[0].n_removed) == (n, len(gone))
    assert (by_id[1].n_lines, by_id[1].n_removed) == (n, 0)
