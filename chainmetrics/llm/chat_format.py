"""Chat formatting of records in several layouts, chosen by a schema fingerprint.

A record is JSON. Its nested field paths, without types and in order, are hashed; the
hash selects a declarative layout, which says where the turns are. Canonical turns
are written between ``<s>`` and ``</s>`` behind their role; control strings inside a role
or a text are escaped, so that the formatted text can be read back exactly and holds
no control string that the template did not write. The loss mask covers the texts of
the assistant's turns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<s>", "</s>"
#: Escape character and, for each control string, the letter that stands for it.
ESCAPE = "\\"
ESCAPED = {OPEN: "o", CLOSE: "c", "[INST]": "i", "[/INST]": "j", "<<SYS>>": "y", "<</SYS>>": "z"}
#: Ends the role inside a turn; escaped in roles.
AFTER_ROLE, ROLE_END = "\n", "n"
#: Roles whose texts are learned.
LEARNED = ("assistant",)


@dataclass(frozen=True)
class Layout:
    """Where the turns of a record are.

    ``paths`` are all field paths, with ``[]`` for list items. ``turns`` are (role, field) of
    turns that stand in fields of their own, in order; a field that is null or empty
    is no turn. ``items`` is (list, role field, text field) of turns in a list, put after them.
    ``roles`` renames roles.
    """

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    items: tuple[str, str, str] | None = None
    roles: tuple[tuple[str, str], ...] = ()


def _fields(*names: str) -> tuple[str, ...]:
    return tuple(sorted(names))


def _list(name: str, role: str, text: str, *more: str) -> tuple[str, ...]:
    return tuple(sorted((name, f"{name}[].{role}", f"{name}[].{text}", *more)))


_SHARED = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"))

LAYOUTS: tuple[Layout, ...] = (
    Layout("messages", _list("messages", "role", "content"), items=("messages", "role", "content")),
    Layout("no messages", ("messages",)),
    Layout(
        "system and messages",
        _list("messages", "role", "content", "system"),
        turns=(("system", "system"),),
        items=("messages", "role", "content"),
    ),
    Layout("from and value", _list("conversations", "from", "value"), items=("conversations", "from", "value"), roles=_SHARED),
    Layout("prompt and response", _fields("prompt", "response"), turns=(("user", "prompt"), ("assistant", "response"))),
    Layout("prompt and completion", _fields("prompt", "completion"), turns=(("user", "prompt"), ("assistant", "completion"))),
    Layout("instruction", _fields("instruction", "output"), turns=(("user", "instruction"), ("assistant", "output"))),
    Layout(
        "instruction and input",
        _fields("instruction", "input", "output"),
        turns=(("user", "instruction"), ("user", "input"), ("assistant", "output")),
    ),
    Layout(
        "system and instruction",
        _fields("system", "instruction", "output"),
        turns=(("system", "system"), ("user", "instruction"), ("assistant", "output")),
    ),
)

#: Characters of a string from which the JSON parser gives up.
PARSER_LIMIT = 20_000_000

_TURNS = "array<struct<role:string,text:string>>"


def field_paths(record: Column) -> Column:
    """The sorted field paths of a variant: ``a``, ``a.b`` below an object, and ``a[].b`` below a list.

    ``schema_of_variant`` writes ``OBJECT<a: ARRAY<OBJECT<b: STRING>>>``, fields in order. Its
    tokens are read from the left; ``open`` are the paths of what encloses a token.
    """
    tokens = F.regexp_extract_all(F.schema_of_variant(record), F.lit(r"[^\s:<>,]+(?=: )|ARRAY<|OBJECT<|>"), F.lit(0))
    texts = F.array().cast("array<string>")
    start = F.struct(texts.alias("open"), F.lit("").alias("path"), texts.alias("paths"))

    def state(opened: Column, path: Column, paths: Column) -> Column:
        return F.struct(opened.alias("open"), path.alias("path"), paths.alias("paths"))

    def step(acc: Column, token: Column) -> Column:
        last = F.try_element_at(acc.open, F.lit(-1))
        deeper = F.concat(acc.open, F.array(acc.path))
        path = F.when(last == "", token).otherwise(F.concat(last, F.lit("."), token))
        return (
            F.when(token == "ARRAY<", state(deeper, F.concat(acc.path, F.lit("[]")), acc.paths))
            .when(token == "OBJECT<", state(deeper, acc.path, acc.paths))
            .when(token == ">", state(F.slice(acc.open, 1, F.greatest(F.size(acc.open) - 1, F.lit(0))), last, acc.paths))
            .otherwise(state(acc.open, path, F.concat(acc.paths, F.array(path))))
        )

    return F.array_sort(F.aggregate(tokens, start, step, lambda acc: acc.paths))


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.array_join(paths, "\n"))


def _layout_turns(record: Column, layout: Layout, read: Callable[[Column], Column]) -> Column:
    single = F.array(
        *(
            F.struct(F.lit(role).alias("role"), read(F.try_variant_get(record, f"$.{field}", "string")).alias("text"))
            for role, field in layout.turns
        )
    ).cast(_TURNS)
    turns = F.filter(single, lambda t: t.text != "") if layout.turns else F.array().cast(_TURNS)
    if not layout.items:
        return turns
    name, role, text = layout.items
    items = F.try_variant_get(record, f"$.{name}", f"array<struct<`{role}` string, `{text}` string>>")
    named = F.create_map(*(F.lit(x) for pair in layout.roles for x in pair)) if layout.roles else None

    def turn(x: Column) -> Column:
        own = x[role]
        return F.struct((F.coalesce(named[own], own) if named is not None else own).alias("role"), read(x[text]).alias("text"))

    return F.concat(turns, F.coalesce(F.transform(items, turn), F.array().cast(_TURNS)))


def canonical_turns(
    records: DataFrame, record: str = "record", layouts: Sequence[Layout] = LAYOUTS, texts: str | None = None
) -> DataFrame:
    """``records`` with ``layout`` and ``turns`` (role, text) in place of the JSON column ``record``.

    A record that is null, no JSON, or of no known layout has a null layout and null turns;
    it is for the caller to count those. Other columns stay, whatever their names, but for
    ``layout`` and ``turns``.

    The JSON parser refuses strings of 20 million characters. A record of that length that it
    does not read is an error, never a null. Texts of any length go beside their record: where
    ``texts`` names an array of strings, the record's texts are indexes into it, as strings,
    and that column is taken away too.
    """
    parsed = F.try_parse_json(F.col(record))
    refused = F.col(record).isNotNull() & parsed.isNull() & (F.length(F.col(record)) >= PARSER_LIMIT)
    others = [F.col(f"`{c}`") for c in records.columns if c not in (record, texts, "layout", "turns")]
    rows = records.select(
        (F.struct(*others) if others else F.struct()).alias("row"),
        F.when(refused, F.raise_error(F.lit("a record is too long to be parsed; give its texts apart"))).otherwise(parsed).alias("record"),
        (F.col(texts) if texts else F.array().cast("array<string>")).alias("texts"),
    ).withColumn("print", fingerprint(field_paths(F.col("record"))))

    def read(value: Column) -> Column:
        return F.get(F.col("texts"), value.try_cast("int")) if texts else value

    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(_TURNS)
    for known in layouts:
        match = F.col("print") == fingerprint(F.array(*map(F.lit, sorted(known.paths))))
        layout = F.when(match, known.name).otherwise(layout)
        turns = F.when(match, _layout_turns(F.col("record"), known, read)).otherwise(turns)
    return rows.select("row.*", layout.alias("layout"), turns.alias("turns"))


def _replace(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escape(text: Column, role: bool = False) -> Column:
    out = _replace(text, ESCAPE, ESCAPE * 2)
    for control, letter in ESCAPED.items():
        out = _replace(out, control, ESCAPE + letter)
    return _replace(out, AFTER_ROLE, ESCAPE + ROLE_END) if role else out


def unescape(text: Column) -> Column:
    """The inverse of ``escape``: pairs of escape characters are taken apart first."""

    def part(x: Column) -> Column:
        for control, letter in ESCAPED.items():
            x = _replace(x, ESCAPE + letter, control)
        return _replace(x, ESCAPE + ROLE_END, AFTER_ROLE)

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), part), ESCAPE)


def formatted(turns: DataFrame, column: str = "turns", learned: Sequence[str] = LEARNED) -> DataFrame:
    """Adds ``formatted`` and ``loss_spans`` (start, stop in characters of it, stop excluded).

    Null turns give a null text; no turns an empty one. Null roles and texts are empty.
    """
    wrapped = F.transform(
        column,
        lambda t: F.struct(
            F.coalesce(t.role, F.lit("")).isin(*learned).alias("learned"),
            F.concat(F.lit(OPEN), escape(F.coalesce(t.role, F.lit("")), role=True), F.lit(AFTER_ROLE)).alias("head"),
            escape(F.coalesce(t.text, F.lit(""))).alias("body"),
        ),
    )
    ends = len(CLOSE)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        a = acc.at + F.length(t.head)
        b = a + F.length(t.body)
        mine = F.array(F.struct(a.alias("start"), b.alias("stop")))
        return F.struct((b + ends).alias("at"), F.when(t.learned, F.concat(acc.spans, mine)).otherwise(acc.spans).alias("spans"))

    return (
        turns.withColumn("_turns", wrapped)
        .withColumn("formatted", F.array_join(F.transform("_turns", lambda t: F.concat(t.head, t.body, F.lit(CLOSE))), ""))
        .withColumn("loss_spans", F.aggregate("_turns", start, step, lambda acc: acc.spans))
        .drop("_turns")
    )


def read_turns(text: Column) -> Column:
    """The turns of a formatted text."""
    pieces = F.split(text, CLOSE, -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    skip = len(OPEN)

    def turn(x: Column) -> Column:
        at = F.instr(x, AFTER_ROLE)
        return F.struct(
            unescape(F.substr(x, F.lit(skip + 1), at - skip - 1)).alias("role"), unescape(F.substr(x, at + 1)).alias("text")
        )

    return F.transform(pieces, turn)


def read_loss(text: Column, spans: Column) -> Column:
    """All learned texts of a formatted text, joined."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(text, s.start + 1, s.stop - s.start))), "")


def messages_of_rows(
    rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``(key, messages)``: an array of (role, content) for each key of a table with a row for each turn.

    Turns go by number; ties, such as repeated rows, by role and text. Null texts and
    roles become empty. Rows with a null key form one conversation.
    """
    message = F.struct(
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("content")
    )
    ordered = F.sort_array(F.collect_list(F.struct(F.col(turn).alias("turn"), message.alias("message"))))
    whole = rows.groupBy(F.col(key).alias("key")).agg(ordered.alias("xs"))
    return whole.select(F.col("key").alias(key), F.transform("xs", lambda x: x.message).alias("messages"))
