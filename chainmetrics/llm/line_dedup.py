"""Deletion of the later copies of repeated runs of lines.

A document is a sequence of line ids. Prefix doubling names the sequences of 1, 2,
4, ... lines at each position by the first position where they stand; a round needs
one grouping of pairs of names, and only positions whose sequence repeats go on.
The longest earlier match of each position is then found from the top down: positions
that share a sequence are parted by the 2^k, 2^(k-1), ..., 1 lines behind it, and a
position's match is as long as the longest sequence of which it is not the first place.

Positions are ordered by key, then by content for rows that share a key, then by line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainmetrics.llm.common import staged

#: Runs of fewer characters (line ends not counted) are left where they are.
MIN_CHARS = 50

_POSITION = ["key", "did", "line"]


def _position(*names: str) -> Column:
    return F.struct(*(F.col(n).alias(p) for n, p in zip(names or _POSITION, _POSITION, strict=True)))


def _groups(rows: DataFrame, by: list[str]) -> DataFrame:
    """Each ``by`` that stands at two positions or more: the first of them as ``name``, their number as ``size``.

    Written, so that a join with it has two plain shuffles and AQE can split a hot ``by``.
    """
    found = rows.groupBy(*by).agg(F.min(_position()).alias("name"), F.max(_position()).alias("_last"), F.count("*").alias("size"))
    return staged(found.where("name <> _last").drop("_last"))


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    line = F.transform(
        F.split("body", "\n", -1),
        lambda x: F.struct(F.substring(F.unhex(F.md5(x)), 1, 12).alias("lid"), F.length(x).alias("chars")),
    )
    rows = docs.select(F.col(key).alias("key"), body.alias("body"))
    return rows.select("key", F.xxhash64("body").alias("did"), F.posexplode(line).alias("line", "x")).select(
        "key", "did", "line", "x.lid", "x.chars"
    )


def _levels(lines: DataFrame) -> list[DataFrame]:
    """For 1, 2, 4, ... lines: each position whose sequence repeats, with the name of the sequence, its ``size``
    and ``chars``, and, as ``longer``, the same of the sequence of twice as many lines if that repeats too."""
    found = _groups(lines, ["lid"])
    # Rows equal in key and text are one document, so one position.
    level = lines.join(found, "lid").drop("lid").repartition("key", "did").dropDuplicates(_POSITION)
    level = level.select(*_POSITION, "name", "size", F.col("chars").cast("long").alias("chars"))
    levels, step = [], 1
    while True:
        ahead = Window.partitionBy("key", "did").orderBy("line").rangeBetween(step, step)
        pairs = level.withColumn("_next", F.max(F.struct("name", "chars")).over(ahead))
        pairs = staged(pairs.withColumns({"head": F.col("name"), "next": F.col("_next.name")}))
        found = _groups(pairs.where("next is not null"), ["head", "next"]).withColumnsRenamed({"name": "name2", "size": "size2"})
        longer = F.struct(F.col("name2").alias("name"), F.col("size2").alias("size"), (F.col("chars") + F.col("_next.chars")).alias("chars"))
        joined = pairs.join(found, ["head", "next"], "left").withColumn("longer", F.when(F.col("name2").isNotNull(), longer))
        levels.append(staged(joined.select(*_POSITION, "name", "size", "chars", "longer")))
        level = levels[-1].where("longer is not null").select(*_POSITION, "longer.*")
        step *= 2
        if level.isEmpty():
            return levels


def _parted(rows: DataFrame, step: int) -> DataFrame:
    """``rows`` after those with a ``longer`` sequence, ``step`` lines longer, have gone on to it.

    The first place of a longer sequence also stays behind for the others that share the
    shorter one, unless all of them go on together.
    """
    own = F.struct("name", "n", "size", "chars")
    on = F.struct(F.col("longer.name"), (F.col("n") + step).alias("n"), F.col("longer.size"), F.col("longer.chars"))
    stays = F.col("longer").isNull() | ((F.col("longer.name") == _position()) & (F.col("longer.size") < F.col("size")))
    both = F.array_compact(F.array(F.when(stays, own), F.when(F.col("longer").isNotNull(), on)))
    return rows.select(*_POSITION, F.inline(both))


def earlier_matches(lines: DataFrame) -> DataFrame:
    """``(key, did, line, lines, chars)``: the longest sequence at each position that stands at an earlier one too."""
    levels = _levels(lines)
    shared = None
    for k in reversed(range(len(levels))):
        # Those that share 2^k lines, but not as a whole the 2^k lines behind them, join those already parted.
        new = levels[k].withColumn("n", F.lit(1 << k))
        goes_on = F.col("longer").isNotNull() & ((F.col("longer.name") != _position()) | (F.col("longer.size") == F.col("size")))
        new = new.where(~goes_on).select(*_POSITION, "name", "n", "size", "chars")
        if shared is not None:
            block = levels[k].select(
                F.col("key").alias("key2"), F.col("did").alias("did2"), F.col("line").alias("line2"), F.col("name").alias("next"), F.col("chars").alias("more")
            )
            behind = F.col("key").eqNullSafe(F.col("key2")) & (F.col("did") == F.col("did2")) & (F.col("line") + F.col("n") == F.col("line2"))
            asked = staged(shared.join(block, behind, "left").drop("key2", "did2", "line2").withColumnRenamed("name", "head"))
            by = ["head", "n", "next"]
            found = _groups(asked.where("next is not null"), by).withColumnsRenamed({"name": "name2", "size": "size2"})
            longer = F.struct(F.col("name2").alias("name"), F.col("size2").alias("size"), (F.col("chars") + F.col("more")).alias("chars"))
            joined = asked.join(found, by, "left").withColumn("longer", F.when(F.col("name2").isNotNull(), longer))
            new = _parted(joined.withColumnRenamed("head", "name"), 1 << k).unionByName(new)
        shared = new
    # A position is a later one of one sequence at most: from there on it is the first.
    return shared.where(F.col("name") != _position()).select(*_POSITION, F.col("n").alias("lines"), "chars")


def later_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, did, line, lines, chars)``: runs that stand at an earlier position too.

    A run starts at ``line`` and is the longest one that stands at any earlier position, which
    may overlap it; runs that are only the rest of another one are left out.
    """
    before = Window.partitionBy("key", "did").orderBy("line").rangeBetween(-1, -1)
    matches = earlier_matches(staged(_lines(docs, key, text))).withColumn("previous", F.max("lines").over(before))
    return matches.where("previous is null or previous <= lines").drop("previous")


def remove_later_runs(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS
) -> DataFrame:
    """The rows of ``docs``, all columns, with the deleted lines taken out of ``text``.

    Adds ``n_lines`` and ``n_removed``, in place of columns of that name. Lines are split at ``\\n``;
    the line ends of deleted lines go with them, so a text may become empty. A run of fewer
    than ``min_chars`` characters stays. A null text stays null and counts as one empty line.
    Rows equal in key and text are one document and lose the same lines; rows with a null key
    come first in order, among them by content.
    """
    return without_runs(docs, later_runs(docs, key, text).where(F.col("chars") >= min_chars), key, text)


def without_runs(docs: DataFrame, runs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the lines of ``runs(key, did, line, lines)``, which may overlap.

    What lies between the runs of a text is a list of spans, and a text is put together
    from slices of its lines: work in proportion to lines and runs. Columns of ``docs`` are
    kept in a struct of their own, so their names are free.
    """
    earlier = Window.partitionBy("key", "did").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("line") + F.col("lines")
    spans = runs.withColumn("start", F.coalesce(F.max(end).over(earlier), F.lit(0)))
    between = F.when(F.col("line") > F.col("start"), F.struct("start", (F.col("line") - F.col("start")).alias("lines")))
    kept = spans.groupBy("key", "did").agg(F.sort_array(F.collect_list(between)).alias("spans"), F.max(end).alias("end"))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col(key).alias("own_key"), F.xxhash64(body).alias("own_did"))
    joined = rows.join(kept, F.col("own_key").eqNullSafe(F.col("key")) & (F.col("own_did") == F.col("did")), "left")
    whole = F.col(f"doc.`{text}`")
    body = F.coalesce(whole, F.lit(""))
    n_lines = F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1
    # The lines are an element here, so that they are split once and not for each span.
    split = F.array(F.struct(F.split(whole, "\n", -1).alias("lines"), F.col("spans"), F.col("end")))

    def rest(x: Column) -> Column:
        inner = F.flatten(F.transform(x.spans, lambda s: F.slice(x.lines, s.start.cast("int") + 1, s.lines.cast("int"))))
        last = F.slice(x.lines, x.end.cast("int") + 1, F.greatest(F.size(x.lines) - x.end.cast("int"), F.lit(0)))
        return F.array_join(F.concat(inner, last), "\n")

    cut = F.col("end").isNotNull()
    left = F.when(cut, F.element_at(F.transform(split, rest), 1)).otherwise(whole)
    n_kept = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.lines.cast("long")) + n_lines - F.col("end")
    columns = [left.alias(c) if c == text else F.col(f"doc.`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")]
    return joined.select(
        *columns, n_lines.cast("long").alias("n_lines"), F.when(cut, n_lines - n_kept).otherwise(0).cast("long").alias("n_removed")
    )
