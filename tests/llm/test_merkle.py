from __future__ import annotations

import hashlib
import random
import zlib
from string import ascii_lowercase, ascii_uppercase

import pytest
from pyspark.sql import functions as F

from chainmetrics.llm import merkle
from chainmetrics.llm.merkle import audited

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, `key` int, digest string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text) -> str:
    fields = (row[0], row[3], row[2], row[4], text)
    return digest("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def above(nodes: list[str]) -> list[str]:
    return [digest("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]


def path(nodes: list[str], at: int) -> tuple[str, list[tuple[str, str]]]:
    found = []
    while len(nodes) > 1:
        run = at // 8 * 8
        found.append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + 8])))
        nodes, at = above(nodes), at // 8
    return nodes[0], found


def brute(rows) -> list[tuple]:
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
    leaves = {g: [leaf(r, r[1]) for r in groups[g]] for g in order}
    subroots = [path(leaves[g], 0)[0] for g in order]
    out = []
    for n, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            root, over = path(subroots, n)
            siblings = path(leaves[g], i)[1] + over
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            folded = leaf(r, r[1].translate(str.maketrans(ascii_uppercase, ascii_lowercase)) if hit and r[1] is not None else r[1])
            for left, right in siblings:
                folded = digest(left + folded + right)
            proof = digest("".join(a + b for a, b in siblings))
            out.append((r[0], leaves[g][i], subroots[n], root, proof, folded, folded == root))
    return out


def run(docs, **options):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return audited(docs, F.translate("text", ascii_uppercase, ascii_lowercase), tampered, **options)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def corpus(n: int) -> list[tuple]:
    rnd = random.Random(5)
    rows = []
    for i in range(n):
        lang = "en" if i % 3 == 0 else rnd.choice(["de", "fr", None, "é", "\U0001f600", f"l{i % 11}"])
        text = rnd.choice([None, "", "Große Ähre ABC", "lower only", f"T{i}", "x" * i])
        rows.append((i, text, lang, rnd.choice([None, "src", ""]), rnd.choice([None, i, -1]), "t", 1, "d"))
    return rows + rows[:9] + rows[:9] + [(None, "Null A", "en", "s", 1, "t", 1, "d"), (None, "Null B", "en", "s", 1, "t", 1, "d"), (10**6, "lone", "zz", "s", 1, "t", 1, "d")]


@pytest.mark.parametrize(("depth", "n"), [(4, 300), (1, 700)])
def test_equals_brute_force(spark, depth, n):
    """With blocks of one level a tree of 240 leaves climbs through three of them."""
    rows = corpus(n)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = run(docs, depth=depth).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=key) == sorted(brute(rows), key=key)
    assert not all(r.verified for r in got)
    for r in got:
        hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
        assert (r.own_nodes is not None) == hit
        if hit:
            assert r.own_nodes[-1] == r.folded_root and (r.own_nodes[0] == r.leaf) == r.verified


def test_a_version_shares_all_but_its_path():
    block = merkle.Block([digest(str(i)) for i in range(100)], 100)
    changed = merkle.Block([digest("new" if i == 77 else str(i)) for i in range(100)], 100)
    own = merkle.version(digest("new"), block.siblings(77))
    assert own[-1] == changed.top and len(own) == 4
    for depth, level in enumerate(changed.levels):
        differ = [i for i, (a, b) in enumerate(zip(level, block.levels[depth], strict=True)) if a != b]
        assert differ == [77 // 8**depth] and level[differ[0]] == own[depth]


@pytest.mark.parametrize("rows", [[], [(5, "A", "en", None, None, "t", 1, "d")], [(None, None, None, None, None, None, None, None)]])
def test_smallest(spark, rows):
    got = [tuple(r[c] for c in COLUMNS) for r in run(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert got == brute(rows)


def test_long_texts_and_nothing_changed(spark):
    rows = [(i, "Ab" * 2_000_000 if i == 3 else "x", "en", "s", 1, "t", 1, "d") for i in range(10)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r[c] for c in COLUMNS) for r in run(docs).collect())
    assert got == sorted(brute(rows))
    assert all(r.verified and r.own_nodes is None for r in audited(docs).collect())
