from __future__ import annotations

import random
import uuid
from collections import Counter

import pytest

from chainmetrics.llm import suffix_dedup
from chainmetrics.llm.suffix_dedup import kept_rows, remove_repeats


def brute(texts: list[str | None], n: int) -> list[tuple[int, int, int, bytes]]:
    raws = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for r in raws:
        for i in range(len(r) - n + 1):
            seen[r[i : i + n]] = seen.get(r[i : i + n], 0) + 1
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - n + 1):
            if seen[r[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(r), sum(gone), spans, bytes(b for b, g in zip(r, gone, strict=True) if not g)))
    return out


def made(seed: int) -> list[str | None]:
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abé") for _ in range(rnd.randint(1, 4)))
    pool = [" ".join(word() for _ in range(rnd.randint(5, 60))) for _ in range(12)]
    texts: list[str | None] = [None, "", "a" * 31, "a" * 200, "ab " * 90, "Und " * 50 + "x" + "Und " * 40]
    for _ in range(60):
        parts = [rnd.choice(pool)[rnd.randint(0, 9) :] if rnd.random() < 0.6 else word() * 3 for _ in range(rnd.randint(1, 6))]
        texts.append("".join(parts))
    return [*texts, texts[10], texts[10], texts[11], *(t[:40] + "#" + t[40:] for t in texts[12:16])]


@pytest.mark.parametrize("seed,length,seed_length", [(1, 40, 8), (2, 64, 20), (3, 33, 12)])
def test_equals_brute_force(spark, seed, length, seed_length):
    texts = made(seed)
    docs = spark.createDataFrame(
        [(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, tid string, spans int"
    )
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(docs.repartition(3), length=length, seed_length=seed_length).collect()}
    want = brute(texts, length)
    assert [got[i] for i in range(len(texts))] == want
    assert any(0 < w[1] < w[0] for w in want)


def test_null_keys_repeated_rows_and_empty_tables(spark):
    rows = [(None, "q" * 50), (None, "q" * 50), (1, None), (1, None), (2, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.n_bytes, r.n_removed, r.n_spans) for r in remove_repeats(docs, length=40, seed_length=10).collect())
    assert got == [(0, 0, 0), (0, 0, 0), (1, 0, 0), (50, 50, 1), (50, 50, 1)]
    assert remove_repeats(docs.where("false"), length=40, seed_length=10).collect() == []


def test_kept_rows_stay_valid_text(spark):
    texts = ["aaé" + "x" * 40 + "é", "bbè" + "x" * 40 + "è", None, "ü"]
    docs = spark.createDataFrame([(i, t, "y") for i, t in enumerate(texts)], "doc_id long, text string, raw string")
    # The repeat takes in the first byte of the last letter, which both texts share.
    got = {r.doc_id: r for r in kept_rows(docs, length=40, seed_length=10).collect()}
    assert [got[i].text for i in range(4)] == ["aaé", "bbè", None, "ü"]
    assert got[0].raw == "y" and kept_rows(docs, length=40, seed_length=10).columns == docs.columns


@pytest.mark.parametrize("line", [100, 300, 399])
def test_a_passage_under_many_texts_is_not_gathered_whole(spark, tmp_path, monkeypatch, line):
    real = suffix_dedup._twin_spans
    folder = str(tmp_path)

    def counted(*args):
        solve = real(*args)

        def run(batches):
            kept = list(batches)
            seeds = Counter(x for b in kept for x in b.column(0).to_pylist())
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(str(max(seeds.values(), default=0)))
            yield from solve(iter(kept))

        return run

    monkeypatch.setattr(suffix_dedup, "_twin_spans", counted)
    monkeypatch.setattr(suffix_dedup, "HOT_ZONES", 8, raising=False)
    rnd = random.Random(line)
    some = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage, tail = some(line), some(350)
    texts: list[str | None] = [some(rnd.randint(350, 500)) + passage + some(rnd.randint(350, 500)) for _ in range(40)]
    # Real repeats around the passage, in unequal zones.
    texts += [some(500) + passage + tail[: 300 + 10 * i] + some(400) for i in range(6)] + [some(900) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(docs.repartition(3)).collect()}
    want = brute(texts, 400)
    assert [got[i] for i in range(len(texts))] == want
    assert any(w[1] for w in want)
    assert max(int(f.read_text()) for f in tmp_path.iterdir()) <= 8


@pytest.mark.parametrize("size,gone", [(399, 0), (400, 400)])
def test_bytes_not_words_decide_whether_a_passage_goes(spark, size, gone):
    rnd = random.Random(size)
    some = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage = " ".join(some(8).replace(" ", "x")[: rnd.randint(3, 6)] for _ in range(200))[:size]
    assert len(passage.split()) > 50
    texts = [some(300) + edge + passage + edge + some(300) for edge in "#+"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(docs).collect()}
    assert [got[i] for i in range(2)] == brute(texts, 400)
    assert [(g[0], g[1]) for g in got.values()] == [(size + 602, gone)] * 2
