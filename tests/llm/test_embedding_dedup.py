from __future__ import annotations

import numpy as np
import pytest

from chainmetrics.llm.embedding_dedup import LEAD, TilePair, _boxes, near_duplicates, principal_axes, tile_pairs, tiled


def brute(vectors: list, threshold: float = 0.95) -> list[tuple[int, int]]:
    def usable(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    x = [np.array(v, float) if usable(v) else None for v in vectors]
    near = [
        [j for j, b in enumerate(x) if a is not None and b is not None and i != j and len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold]
        for i, a in enumerate(x)
    ]
    label = list(range(len(x)))
    for i in range(len(x)):
        queue, seen = [i], {i}
        while queue:
            for j in near[queue.pop()]:
                if j not in seen:
                    seen.add(j)
                    queue.append(j)
        label[i] = min(seen)
    return [(len(n), c) for n, c in zip(near, label, strict=True)]


@pytest.mark.parametrize("tile", [4096, 30])
def test_equals_brute_force(spark, tile):
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(25, 16))
    vectors: list = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    for c in centres:
        vectors += [(c + rnd.normal(size=16) * s).astype(np.float32).tolist() for s in (0, 0.1, 0.25, 0.3, 0.3)]
    vectors += [vectors[20], vectors[20], [3 * x for x in vectors[21]], [-x for x in vectors[22]]]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, node int, vector string")
    got = {r.vec_id: r for r in near_duplicates(df, tile=tile).collect()}
    want = brute(vectors)
    assert [(got[i].n_links, got[i].component_id) for i in range(len(vectors))] == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert near_duplicates(df.where("false")).collect() == []


def test_repeated_rows_and_null_keys(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (5, [1.0, 0.01]), (5, [1.0, 0.01]), (None, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in near_duplicates(df).collect())
    assert got == [("5", 2, "5", True), ("5", 2, "5", True), ("None", 0, "None", True), ("None", 2, "5", False)]


def test_few_products_are_completed():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(600, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[7] = x[3]
    pair = TilePair(np.linalg.eigh(x.T @ x)[1][:, ::-1], 0.95)
    found = {(int(a), int(b)) for i, j in pair.near(x, x) for a, b in zip(i, j, strict=True)}
    assert found == {(i, i) for i in range(600)} | {(3, 7), (7, 3)}


def test_far_tiles_are_skipped(spark):
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(16, 12))
    x = np.concatenate([c + rnd.normal(size=(40, 12)) * 0.05 for c in centres])
    x = np.concatenate((x, x[:1] * np.linspace(1, 2, 100)[:, None]))
    rows = [(i, 1, v.tolist()) for i, v in enumerate(x)]
    classes = spark.createDataFrame(rows, "node long, weight long, vector array<double>")
    placed = tiled(classes, principal_axes(classes, 12), 50).cache()
    found = {r.node: r.tile for r in placed.select("node", "tile").collect()}
    sizes = np.bincount(list(found.values()))
    assert sorted(found) == list(range(len(x))) and sizes.min() > 0 and sizes.max() < 150
    pairs = {(r.low, r.high) for r in tile_pairs(_boxes(placed, LEAD), 0.95).collect()}
    assert all((t, t) in pairs for t in range(len(sizes))) and len(pairs) < len(sizes) * (len(sizes) + 1) / 4
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for i, j in np.argwhere(unit @ unit.T >= 0.95):
        assert tuple(sorted((found[i], found[j]))) in pairs


def test_many_tiles(spark):
    rnd = np.random.default_rng(9)
    centres = rnd.normal(size=(60, 8))
    vectors = [(c + rnd.normal(size=8) * s).tolist() for c in centres for s in (0.05, 0.1, 0.2, 0.3, 0.3)]
    vectors += [vectors[0]] * 3 + [[x * (1 + i / 50) for x in vectors[1]] for i in range(60)]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(df, tile=16).collect()}
    assert [got[i] for i in range(len(vectors))] == brute(vectors)
