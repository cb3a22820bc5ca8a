from __future__ import annotations

import pytest

from __spark_entry__ import library_queries

SF_DIR = "/root/testdata/sf0.001"

#: Its window runs over one row per hour of the last seven days.
BY_HOUR = "price_hourly_week"


def below(node) -> list:
    return [node, *(x for i in range(node.children().size()) for x in below(node.children().apply(i)))]


@pytest.mark.parametrize("name", sorted(library_queries()))
def test_unpartitioned_windows_run_on_small_aggregates(spark, name):
    plan = library_queries()[name](spark, SF_DIR)._jdf.queryExecution().sparkPlan()
    for window in (x for x in below(plan) if x.nodeName() == "Window" and x.partitionSpec().isEmpty()):
        keys = next((x.groupingExpressions().mkString(" ") for x in below(window) if "Aggregate" in x.nodeName()), "")
        assert ("hour" if name == BY_HOUR else "week") in keys, keys
