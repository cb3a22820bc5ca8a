"""Figures from the maintained index against the full computation."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest

from chainmetrics import AsOf
from chainmetrics.plans import users
from chainmetrics.plans.user_index import UserIndex

MONDAY = date(2024, 1, 1)


def facts(rnd, week: int, n: int, names: int) -> tuple[list[dict], list[dict]]:
    def at():
        return datetime(2024, 1, 1) + timedelta(days=7 * week, minutes=rnd.randint(0, 7 * 24 * 60 - 1))

    actors = [{"block_timestamp": at(), "actors": [rnd.choice([f"u{rnd.randint(0, names)}", "hot", None])]} for _ in range(n)]
    evm = [{"block_timestamp": at(), "from_address": f"u{rnd.randint(0, names)}" if i % 3 else "hot"} for i in range(n)]
    return actors, evm


def figures(df) -> dict:
    return {r.week: (r.active_users, r.new_users) for r in df.collect()}


@pytest.fixture
def index(spark, tmp_path):
    return UserIndex(spark, str(tmp_path / "index"))


def test_equal_after_each_appended_week_and_after_late_rows(make, index):
    rnd = random.Random(9)
    actors, evm = [], []
    for week in range(3):
        more = facts(rnd, week, 40, 30 * (week + 1))
        actors += more[0]
        evm += more[1]
        src, as_of = make(transaction_actors=actors, evm_transactions=evm), AsOf.of(MONDAY + timedelta(days=7 * (week + 1)))
        index.refresh(src, as_of, MONDAY + timedelta(days=7 * week) if week else None)
        assert figures(index.weekly()) == figures(users.users_weekly(src, as_of))

    late = facts(rnd, 1, 30, 200)
    src = make(transaction_actors=actors + late[0], evm_transactions=evm + late[1])
    index.refresh(src, as_of, MONDAY + timedelta(days=7))
    assert figures(index.weekly()) == figures(users.users_weekly(src, as_of))
    assert index.ids().count() == index.ids().select("id").distinct().count() == index.ids().select("source", "entity").distinct().count()

    for first, last in ((0, 2), (1, 2), (2, 2), (5, 9)):
        span = [MONDAY + timedelta(days=7 * w) for w in (first, last)]
        inside = {
            (source, name)
            for source, name, ts in [
                *[("core", a, r["block_timestamp"]) for r in actors + late[0] for a in r["actors"]],
                *[("evm", r["from_address"], r["block_timestamp"]) for r in evm + late[1]],
            ]
            if name is not None and span[0] <= ts.date() < span[1] + timedelta(days=7)
        }
        assert index.active_between(*span) == len(inside)


def test_a_refresh_can_be_repeated_and_reads_new_weeks_only(make, index):
    rnd = random.Random(2)
    old, new = facts(rnd, 0, 30, 20), facts(rnd, 1, 30, 40)
    whole = make(transaction_actors=old[0] + new[0], evm_transactions=old[1] + new[1])
    as_of = AsOf.of(MONDAY + timedelta(days=14))
    index.refresh(make(transaction_actors=old[0], evm_transactions=old[1]), AsOf.of(MONDAY + timedelta(days=7)))
    for _ in range(2):
        index.refresh(make(transaction_actors=new[0], evm_transactions=new[1]), as_of, MONDAY + timedelta(days=7))
        assert figures(index.weekly()) == figures(users.users_weekly(whole, as_of))


def test_nothing_yet(make, index):
    assert index.weekly().collect() == [] and index.active_between(MONDAY, MONDAY) == 0
    index.refresh(make(), AsOf.of(MONDAY))
    assert index.weekly().collect() == [] and index.ids().collect() == []
