from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chainmetrics.llm.bpe import Part, codec, decode, encode

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def ids(packed: bytes) -> list[int]:
    return np.frombuffer(packed, "<u4").tolist()


def test_every_character_as_the_library(library):
    own, wrong = codec(PATH), []
    # All of them once took 100 s and agreed; the planes with letters in use are kept.
    for start in [*range(0, 0x3400, 256), *range(0xA000, 0x12000, 2048), *range(0x1D000, 0x20000, 1024)]:
        chars = [chr(c) for c in range(start, start + 256) if not 0xD800 <= c < 0xE000]
        for form in ("a{0}1{0} b", " {0}{0}s'{0}"):
            text = "|".join(form.format(c) for c in chars)
            if ids(own.encode(text)) != library(text):
                wrong += [c for c in chars if ids(own.encode(form.format(c))) != library(form.format(c))]
    assert not wrong, (len(wrong), [hex(ord(c)) for c in wrong[:40]])


SOME = st.lists(st.sampled_from([*"aabcels  \n\t'12_.é²中!", "the", " the", "'ll", "   "]), max_size=60).map("".join)


@settings(max_examples=300, deadline=None)
@given(SOME, SOME, SOME)
def test_joins_equal_whole(a, b, c):
    own = codec(PATH)
    left = own.join(own.join(own.part(a), own.part(b)), own.part(c))
    right = own.join(own.part(a), own.join(own.part(b), own.part(c)))
    for part in (left, right):
        assert "".join(part.words) == a + b + c and part.words == own.words(a + b + c)
        assert b"".join(part.ids) == own.encode(a + b + c)


@pytest.mark.parametrize("seed", range(6))
def test_long_words_are_joined_by_tokens(seed):
    rnd, own = random.Random(seed), codec(PATH)
    letters = ["a", "ab", "theing", "étionsé", "aaaaaaab", "qzxj"][seed]
    word = "".join(rnd.choice(letters) for _ in range(6000))
    cut = rnd.randrange(1500, 4500)
    joined = own.join(own.part("x " + word[:cut]), own.part(word[cut:] + " y"))
    assert b"".join(joined.ids) == own.encode("x " + word + " y")
    a, b = own.encode_word(word[:cut].encode()), own.encode_word(word[cut:].encode())
    assert own.join_word(a, b) == own.encode_word(word.encode())
    assert own.join(Part([], []), joined) is joined


def test_rows(spark, library):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdeé ,\n'") for _ in range(7))
    texts = [None, "", " ", "x", "<|endoftext|>", "a" * 3000, " " * 700, "a<|endoftext|> b" * 90, "".join(word() for _ in range(900))]
    rows = [(i, t, "x", b"1") for i, t in enumerate(texts)] + [(8, texts[8], "x", b"1"), (None, texts[5], "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tid string, ids binary").repartition(3)
    tokens = encode(docs, PATH, leaf=100)
    got = sorted(((r.doc_id, r.ids) for r in tokens.collect()), key=str)
    want = sorted(((r[0], np.array(library(r[1] or ""), "<u4").tobytes()) for r in rows), key=str)
    assert [(k, bytes(v)) for k, v in got] == want
    back = sorted(((r.doc_id, r.text) for r in decode(tokens, PATH).collect()), key=str)
    assert back == sorted(((r[0], r[1] or "") for r in rows), key=str)
    assert encode(docs.where("false"), PATH).collect() == []
