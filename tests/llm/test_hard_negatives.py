from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainmetrics.llm import hard_negatives
from chainmetrics.llm.hard_negatives import CoverTree, mine, spread

SCHEMA = "vec_id long, embedding array<float>, label int, id int, vector string, size int"


def whole(v):
    if v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v):
        return None
    return [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v]


def brute(rows, positives=5, negatives=10):
    usable = [(r[0], r[2], w) for r in rows if r[0] is not None and r[2] is not None and (w := whole(r[1])) is not None]
    out = []
    for a_id, a_label, a in usable:
        if a_id % 100:
            continue
        scored = sorted({(-sum(x * y for x, y in zip(a, v, strict=True)), i, label) for i, label, v in usable if len(v) == len(a)})
        own = [(-s, i) for s, i, label in scored if label == a_label and i != a_id][:positives]
        for p_score, p_id in own:
            fits = [(-s, i) for s, i, label in scored if label != a_label and 30 * p_score <= -100 * s <= 90 * p_score]
            out += [(a_id, p_id, n + 1, i, p_score, s) for n, (s, i) in enumerate(fits[:negatives])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def clustered(n: int, dim: int, seed: int, ids=None):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(12, dim))
    rows = []
    for i in range(n):
        c = int(rnd.integers(12))
        rows.append((int(i if ids is None else ids[i]), (centres[c] * rnd.uniform(0.1, 2) + rnd.normal(size=dim) * 0.2).astype(np.float32).tolist(), int(c % 4)))
    return rows


@pytest.mark.parametrize(("tree", "block"), [(4096, 4096), (60, 2)])
def test_equals_brute_force(spark, tree, block):
    rows = clustered(700, 12, 1)
    rows += [(1000 + i, rows[5][1], 1 + i % 2) for i in range(200)]
    rows += [(5000 + 100 * i, v, 1) for i, v in enumerate([None, [], [float("nan")] * 12, [float("inf")] * 12, [None] + [1.0] * 11, [1.0, 2.0], [0.0] * 12])]
    rows += [(6001, [2.0, 1.0], 1), (6002, [0.5, 0.7], 2), (6003, [0.7, 0.5], 2), (None, rows[0][1], 1), (6100, rows[3][1], None), (6200, [-1.0, -1.0], 9), (6201, [1.0, 1.0], 9)]
    got = mine(table(spark, rows), F.col("vec_id") % 100 == 0, tree=tree, block=block)
    want = brute(rows)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 200
    assert dict(got.dtypes)["rank"] == "int" and dict(got.dtypes)["negative_id"] == "bigint"


def test_ties_go_to_smaller_ids(spark):
    rows = [(0, [1.0, 0.0], 0)] + [(i, [1.0, float(i)], 0) for i in (9, 3, 7, 1, 5, 8, 2)] + [(i, [0.5, float(-i)], 1) for i in range(40, 20, -1)]
    got = mine(table(spark, rows), F.col("vec_id") % 100 == 0).collect()
    assert sorted(map(tuple, got)) == brute(rows)
    assert sorted({r.positive_id for r in got}) == [1, 2, 3, 5, 7]
    assert [r.negative_id for r in sorted(got) if r.positive_id == 1] == list(range(21, 31))


def test_repeated_rows_and_nothing_to_find(spark):
    rows = [(0, [1.0], 0), (0, [1.0], 0), (1, [1.0], 0), (1, [1.0], 0), (2, [0.5], 1), (2, [0.5], 1)]
    df = table(spark, rows)
    got = {tuple(r) for r in mine(df, F.col("vec_id") % 100 == 0).collect()}
    assert got == {(0, 1, 1, 2, 65536, 32768)}
    for none in (df.where("false"), df.where("vec_id > 0"), df.where("label = 1"), df.where("label = 0")):
        assert mine(none, F.col("vec_id") % 100 == 0).collect() == []


def test_large_components_are_exact(spark):
    rows = [(0, [1e6, 1.0], 0), (1, [3e6, 1.0], 0), (2, [1e6, 2.0], 1), (3, [1.5e6, 3.0], 1), (4, [3e38, 0.0], 0), (5, [2e38, 0.0], 1)]
    got = sorted(map(tuple, mine(table(spark, rows[:4]), F.col("vec_id") % 100 == 0).collect()))
    assert got == brute(rows[:4]) and got
    assert mine(table(spark, rows), F.col("vec_id") % 100 == 0).count() > 0


def test_radii_cover_and_levels_nest():
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(30, 8))
    x = np.floor(256 * np.concatenate([c + rnd.normal(size=(60, 8)) * s for s, c in zip(np.linspace(0, 0.3, 30), centres, strict=True)]))
    tree = CoverTree.of(x)
    lifted = hard_negatives._augmented(tree.points)
    assert (tree.points == x[tree.order]).all() and sorted(tree.order) == list(range(len(x)))
    assert tree.level.max() >= 2 and (np.diff(tree.level) >= 0).all()
    for n in range(len(tree.start)):
        own = lifted[tree.start[n] : tree.end[n]]
        assert tree.start[n] <= tree.centre[n] < tree.end[n]
        assert np.linalg.norm(own - lifted[tree.centre[n]], axis=1).max() <= tree.radius[n] * (1 + 1e-12)
        if n:
            p = tree.parent[n]
            assert tree.start[p] <= tree.start[n] and tree.end[n] <= tree.end[p] and tree.radius[n] <= tree.radius[p] / hard_negatives.BASE * (1 + 1e-12)
    leaves = sorted((tree.start[n], tree.end[n]) for n in np.flatnonzero(tree.leaf))
    assert leaves[0][0] == 0 and leaves[-1][1] == len(x) and all(a[1] == b[0] for a, b in zip(leaves, leaves[1:], strict=False))


def test_outside_nodes_are_skipped(monkeypatch):
    rnd = np.random.default_rng(2)
    centres = rnd.normal(size=(40, 16)) * 3
    x = np.floor(256 * np.concatenate([c + rnd.normal(size=(50, 16)) * 0.05 for c in centres]))
    tree, seen = CoverTree.of(x), []
    verify = hard_negatives.Queries._verify
    monkeypatch.setattr(hard_negatives.Queries, "_verify", lambda self, who, points, *a: (seen.append(len(points)), verify(self, who, points, *a)))
    low, high = np.full((1, 1), -(2**62)), np.full((1, 1), 2**62)
    q = hard_negatives.Queries(np.zeros(1, np.int64), np.array([-1]), np.zeros(1, np.int64), x[:1], low, high, True, hard_negatives.Best(1, 5))
    q.search(tree, tree.order.astype(np.int64), np.zeros(len(x), np.int64))
    want = sorted(range(len(x)), key=lambda i: (-(x[i] @ x[0]), i))[:5]
    assert q.best.id.tolist() == want and sum(seen) < len(x) / 2


def test_spread_stops_at_the_radius():
    x = np.array([[0.0], [1.0], [10.0], [10.5], [20.0]])
    centres, nearest, d = spread(x, 5, 1.0)
    assert centres == [0, 4, 2] and nearest.tolist() == [0, 0, 2, 2, 1] and d.max() <= 1.0
    assert len(spread(x, 2)[0]) == 2
