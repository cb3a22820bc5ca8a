from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from chainmetrics.llm.components import components
from chainmetrics.llm.simhash import _crowd, codewords, fingerprint, keep_one, linked_prints, near_duplicates


def plain_print(text: str) -> int:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    words = [w for w in lower.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(g.encode(), 42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def groups(prints: list[int], most: int) -> dict[int, int]:
    """Fingerprint -> least fingerprint (signed) of its single-linkage group."""
    left, out = sorted({signed(p) for p in prints}), {}
    while left:
        group, queue = {left[0]}, [left.pop(0)]
        while queue:
            x = queue.pop()
            near = [y for y in left if ((x ^ y) & (1 << 64) - 1).bit_count() <= most]
            left = [y for y in left if y not in near]
            queue += near
            group |= set(near)
        out |= {x: min(group) for x in group}
    return out


@pytest.mark.parametrize("text", ["", " \n\t", "One", "one two three", "A b\x0bc d É f", "x y z w " * 40, "\x1ca b c d e"])
def test_fingerprint(text):
    assert fingerprint(text.encode()) == plain_print(text)


def test_words_one_bit_apart_meet():
    words = np.arange(1 << 23, step=997)
    near = codewords(words)
    for bit in range(23):
        nearest = codewords(words ^ (1 << bit))[:, 0]
        assert (near == nearest[:, None]).any(axis=1).all()


@pytest.mark.parametrize("most", [4, 2])
def test_links_join_what_is_near(spark, most):
    rnd = random.Random(5)
    prints = []
    for _ in range(60):
        x = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 12)):
            prints.append(x)
            for b in rnd.sample(range(64), rnd.randint(0, 6)):
                x ^= 1 << b
    base = rnd.getrandbits(64)
    prints += [base ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 4))) for _ in range(500)]
    df = spark.createDataFrame([(signed(p),) for p in prints], "print long")
    links = linked_prints(df, most)
    found = {r.node: r.component for r in components(links).collect()}
    assert {p: found.get(p, p) for p in map(signed, prints)} == groups(prints, most)
    assert links.count() < 60 * len(prints)


def test_crowd_equals_all_pairs():
    rnd = random.Random(1)
    prints = [0, *(sum(1 << b for b in rnd.sample(range(64), 5)) for _ in range(400))]
    a, b = _crowd(np.array([signed(p) for p in prints]), 4)
    want = groups(prints, 4)
    assert {x: min(want[x], want[y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)} == {
        x: want[x] for x in a.tolist()
    }
    assert len(a) == len(want) - len(set(want.values()))


def test_documents(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(300)]
    texts = [" ".join(base), " ".join(base).upper(), " ".join([*base[:-1], "zz"]), None, "", "one", "One", *(" ".join(word() for _ in range(50)) for _ in range(20))]
    rows = [(i, t, "x", 0) for i, t in enumerate(texts)] + [(9, texts[9], "x", 0), (None, "lone null key", "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component string, print int")
    prints = {i: plain_print(t or "") for i, t in enumerate(texts)}
    roots = groups(list(prints.values()), 4)
    want = {i: min(j for j in prints if roots[signed(prints[j])] == roots[signed(p)]) for i, p in prints.items()}
    got = near_duplicates(docs).collect()
    assert {r.doc_id: r.component for r in got if r.doc_id is not None} == want and len(got) == len(rows)
    assert {r.doc_id: r["print"] for r in got if r.doc_id is not None} == {i: signed(p) for i, p in prints.items()}
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([*set(want.values()), None], key=str)
    assert near_duplicates(docs.where("false")).collect() == []
