from __future__ import annotations

import pytest

from chainmetrics.llm import components, line_dedup, suffix_dedup


def join_sides(node) -> list[str]:
    """What stands below the sort on each side of each sort-merge join."""
    below = [node.children().apply(i) for i in range(node.children().size())]
    own = [side.children().apply(0).nodeName() for side in below] if node.nodeName() == "SortMergeJoin" else []
    return own + [x for child in below for x in join_sides(child)]


def line_runs(spark):
    docs = spark.createDataFrame([(i, f"a\nb\nc{i % 2}") for i in range(6)], "doc_id long, text string")
    line_dedup.remove_later_runs(docs, min_chars=1)


def stars(spark):
    components.components(spark.createDataFrame([(1, 2), (2, 3), (5, 4)], "a long, b long"))


def zones(spark):
    docs = spark.createDataFrame([(i, f"{i}" * 30 + "same " * 20) for i in range(6)], "doc_id long, text string")
    suffix_dedup.remove_repeats(docs, length=40, seed_length=10)


@pytest.mark.parametrize("module,run", [(line_dedup, line_runs), (components, stars), (suffix_dedup, zones)])
def test_both_sides_of_a_join_by_a_hot_key_are_shuffles(spark, monkeypatch, module, run):
    """Only such a join is split by AQE where a key is hot."""
    real, sides = module.staged, []

    def seen(df):
        sides.extend(join_sides(df._jdf.queryExecution().executedPlan().initialPlan()) if "SortMergeJoin" in df._jdf.queryExecution().toString() else [])
        return real(df)

    monkeypatch.setattr(module, "staged", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        run(spark)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sides and set(sides) == {"Exchange"}
