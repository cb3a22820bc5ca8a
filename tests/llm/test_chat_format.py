from __future__ import annotations

import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chainmetrics.llm.chat_format import CLOSE, ESCAPED, OPEN, canonical_turns, field_paths, formatted, messages_of_rows, read_loss, read_turns
from chainmetrics.llm.queries import QUERIES

ODD = ["", "\\", "\\o", "<s>", "</s>", "</s>[INST] ok [/INST]", "<</SYS>>\\<s", "\\\\n\n", "é<s></s>\\", "<<s>/s>", "a\nb"]

RECORDS = [
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, "messages", [("user", "a"), ("assistant", "b")]),
    ({"messages": [{"content": "a", "role": None}, {"content": None, "role": "assistant"}]}, "messages", [(None, "a"), ("assistant", None)]),
    ({"messages": []}, "no messages", []),
    ({"system": "s", "messages": [{"role": "user", "content": "a"}]}, "system and messages", [("system", "s"), ("user", "a")]),
    ({"conversations": [{"from": "human", "value": "a"}, {"value": "b", "from": "gpt"}]}, "from and value", [("user", "a"), ("assistant", "b")]),
    ({"response": "b", "prompt": "a"}, "prompt and response", [("user", "a"), ("assistant", "b")]),
    ({"prompt": "a", "completion": "b"}, "prompt and completion", [("user", "a"), ("assistant", "b")]),
    ({"instruction": "a", "output": "b"}, "instruction", [("user", "a"), ("assistant", "b")]),
    ({"instruction": "a", "input": "", "output": "b"}, "instruction and input", [("user", "a"), ("assistant", "b")]),
    ({"instruction": "a", "input": "i", "output": None}, "instruction and input", [("user", "a"), ("user", "i")]),
    ({"system": "s", "instruction": "a", "output": "b"}, "system and instruction", [("system", "s"), ("user", "a"), ("assistant", "b")]),
    ({"unknown": 1}, None, None),
    ({"prompt": "a", "response": "b", "more": {"x": 1}}, None, None),
    ([], None, None),
]


def test_layouts(spark):
    rows = [(i, json.dumps(r[0]), "x", "y") for i, r in enumerate(RECORDS)] + [(98, "{no json", "x", "y"), (99, None, "x", "y")]
    df = spark.createDataFrame(rows, "conv_id long, record string, turns_ string, formatted_ string")
    got = {r.conv_id: r for r in canonical_turns(df).collect()}
    for i, (_, layout, turns) in enumerate(RECORDS):
        assert got[i].layout == layout, i
        assert (None if got[i].turns is None else [tuple(t) for t in got[i].turns]) == turns, i
    assert got[98].turns is None and got[99].turns is None


def round_trip(spark, conversations: list[list[tuple[str | None, str | None]]]) -> None:
    df = spark.createDataFrame(list(enumerate(conversations)), "conv_id long, turns array<struct<role:string,text:string>>")
    done = formatted(df).select(
        "*", read_turns(F.col("formatted")).alias("read"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")
    )
    for r in done.collect():
        want = [(role or "", text or "") for role, text in conversations[r.conv_id]]
        assert [tuple(t) for t in r.read] == want
        assert r.loss == "".join(t for role, t in want if role == "assistant")
        assert r.formatted.count(OPEN) == r.formatted.count(CLOSE) == len(want)
        assert not any(c in r.formatted for c in ESCAPED if c not in (OPEN, CLOSE))
        assert all(r.formatted[s.stop :].startswith(CLOSE) for s in r.loss_spans)


def test_reversible(spark):
    turns = [(role, text) for role in ("user", "assistant", None, *ODD) for text in (None, *ODD)]
    round_trip(spark, [[t] for t in turns] + [turns, []])


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), st.text(st.sampled_from(list("\\oc<s>/[]INSTY \n"))))), min_size=1, max_size=40))
def test_reversible_at_random(spark, conversations):
    round_trip(spark, conversations)


def test_rows(spark):
    rows = [(1, 1, "assistant", "b", 0), (1, 0, "user", None, 0), (None, 0, None, "n", 0), (1, None, "system", "s", 0), (1, 1, "assistant", "b", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, messages int")
    got = {r.conv_id: [tuple(m) for m in r.messages] for r in messages_of_rows(df).collect()}
    assert got == {1: [("system", "s"), ("user", ""), ("assistant", "b"), ("assistant", "b")], None: [("", "n")]}
    assert messages_of_rows(df.where("false")).collect() == []


@pytest.mark.parametrize("text", ["x" * 300_000])
def test_long_text(spark, text):
    round_trip(spark, [[("user", text), ("assistant", "<s>" + text)]])


@pytest.mark.parametrize("millions", [25, 150])
def test_texts_beyond_the_parser(spark, tmp_path, millions):
    """Through the registered query, in a layout of fields and in one of messages."""
    text = "word <s> " * (millions * 1_000_000 // 9 + 1)
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", text)]
    if millions < 100:
        rows += [(2, 0, "user", text), (2, 1, "assistant", "b"), (2, 2, "user", "c")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in QUERIES["op10_chat_format"](spark, str(tmp_path)).collect()}
    for number in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == number]
        learned = "".join(t for _, _, role, t in own if role == "assistant")
        assert (got[number].n_turns, got[number].loss_chars) == (len(own), len(learned))
        assert got[number].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
        assert got[number].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in own).encode()).hexdigest()


def test_a_record_that_the_parser_refuses_is_an_error(spark):
    long = spark.range(1).selectExpr("""concat('{"prompt": "', repeat('x', 20000001), '", "response": "b"}') AS record""")
    with pytest.raises(Exception, match="too long to be parsed"):
        canonical_turns(long).collect()


def test_texts_beside_records_and_clashing_names(spark):
    rows = [
        (1, '{"prompt": "0", "response": "1"}', ["a", "b"], "p", "r", "x"),
        (2, '{"messages": [{"role": "user", "content": "1"}, {"role": "z", "content": "7"}]}', ["a", "b"], "p", "r", "x"),
        (3, "no json", None, "p", "r", "x"),
        (4, None, ["a"], "p", "r", "x"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, record string, own array<string>, _record string, print string, row string")
    out = canonical_turns(df, texts="own")
    assert out.columns == ["conv_id", "_record", "print", "row", "layout", "turns"]
    got = {r.conv_id: (r.layout, r.turns and [tuple(t) for t in r.turns], r.print) for r in out.collect()}
    assert got == {
        1: ("prompt and response", [("user", "a"), ("assistant", "b")], "r"),
        2: ("messages", [("user", "b"), ("z", None)], "r"),
        3: (None, None, "r"),
        4: (None, None, "r"),
    }


NESTED = [
    ({"instruction": {"input": "i", "output": "o"}}, ["instruction", "instruction.input", "instruction.output"]),
    ({"prompt": {"response": "b"}}, ["prompt", "prompt.response"]),
    ({"prompt": [{"response": ["b"]}]}, ["prompt", "prompt[].response"]),
    ({"a": {"b": {"c": 1}, "d": [[{"e": 1}]]}, "f": 1}, ["a", "a.b", "a.b.c", "a.d", "a.d[][].e", "f"]),
]


def test_nested_objects_are_paths_of_their_own(spark):
    df = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _) in enumerate(NESTED)], "conv_id long, record string")
    paths = df.select("conv_id", field_paths(F.parse_json("record")).alias("paths"))
    assert {r.conv_id: r.paths for r in paths.collect()} == {i: p for i, (_, p) in enumerate(NESTED)}
    assert [(r.layout, r.turns) for r in canonical_turns(df).collect()] == [(None, None)] * len(NESTED)
