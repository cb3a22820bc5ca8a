"""Exhaustive and randomised comparisons with plain Python."""

from __future__ import annotations

import itertools
import random
import statistics
from collections import Counter, defaultdict
from datetime import date, datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from chainmetrics import AsOf
from chainmetrics.functions.hexwords import hex_word
from chainmetrics.functions.timeops import first_week_after, week_of
from chainmetrics.operators.median import exact_median
from chainmetrics.operators.regions import (
    BEATS_ALL,
    REGION_HOURS,
    UNKNOWN,
    classify,
    region_hours,
    region_score,
)
from chainmetrics.operators.weekly import calendar_lag, moving_average, running_total, share_out


def expected_region(hours, profile):
    wanted = region_hours(profile)
    scores = {region: len(set(hours) & set(listed)) for region, listed in wanted.items()}
    for region in scores:
        rivals = [r for r in scores if r != region and (region in BEATS_ALL or r not in BEATS_ALL)]
        if all(scores[region] > scores[r] for r in rivals):
            return region
    return UNKNOWN


@pytest.mark.parametrize(("profile", "labels"), [("reference", 8), ("padded", 10)])
def test_every_possible_set_of_top_hours(spark, profile, labels):
    sets = list(itertools.combinations(range(24), 6))
    assert len(sets) == 134_596
    df = spark.createDataFrame(pd.DataFrame({"hours": [list(s) for s in sets]}), "hours array<int>")
    wanted = region_hours(profile)
    scores = {r: region_score("hours", listed) for r, listed in wanted.items()}
    got = df.select("hours", classify(scores).alias("region")).toPandas()
    assert len(set(got["region"])) == labels
    wrong = [
        (hours, region)
        for hours, region in zip(got["hours"], got["region"], strict=True)
        if region != expected_region(hours, profile)
    ]
    assert wrong == []
    if profile == "reference":
        assert (got["region"] == UNKNOWN).sum() == 55_085


def test_region_table_shape():
    assert [len(tokens) for tokens in REGION_HOURS.values()] == [6] * 9
    assert region_hours("reference")["Africa"] == []
    assert region_hours("padded")["Africa"] == [0, 1, 2, 3, 4, 5]


def test_hex_words_against_python(spark):
    rng = random.Random(7)
    values = [0, 1, 2**63, 2**64 - 1, 2**64, 2**64 + 1, 10**38 - 1, 10**38, 10**38 + 1, 2**128 - 1, 2**200]
    values += [rng.getrandbits(rng.randint(1, 256)) for _ in range(500)]
    words = ["0x" + f"{v:x}".zfill(rng.choice([1, 64])) for v in values]
    words = [w.upper().replace("0X", "0x") if i % 3 == 0 else w for i, w in enumerate(words)]
    df = spark.createDataFrame(list(zip(words, map(str, values), strict=True)), "word string, value string")
    for row in df.select("value", hex_word(F.col("word")).alias("got")).collect():
        value = int(row["value"])
        assert (None if row["got"] is None else int(row["got"])) == (value if 0 < value < 10**38 else None)


def median_by_python(rows):
    groups = defaultdict(list)
    for key, value in rows:
        if value is not None:
            groups[key].append(value)
    return {key: statistics.median(values) for key, values in groups.items()}


@pytest.mark.parametrize("seed", range(3))
def test_exact_median(spark, seed):
    rng = random.Random(seed)
    rows = [("hot", rng.choice([round(rng.gauss(0, 1e6), 2), 5.0, 5.0])) for _ in range(40_001 + seed)]
    rows += [("even", float(i)) for i in range(2_000)] + [("same", 3.25)] * 999
    rows += [("outlier", v) for v in (1.0, 2.0, 1e300, -1e300)] + [("null", None), (None, 4.0), (None, 8.0)]
    rows += [(f"small{n}", rng.random()) for n in range(1, 40) for _ in range(n)]
    df = spark.createDataFrame(rows, "key string, value double").repartition(16)
    got = {r["key"]: r["m"] for r in exact_median(df, ["key"], "value", "m").collect()}
    assert got == pytest.approx(median_by_python(rows), rel=1e-12)


def weekly_frame(spark, values):
    monday = date(2024, 1, 1)
    rows = [(monday + timedelta(days=7 * i), v) for i, v in enumerate(values) if v is not None]
    return spark.createDataFrame(rows, "week date, n bigint")


def test_running_total_moving_average_and_lag(spark):
    rng = random.Random(1)
    values = [None if rng.random() < 0.2 else rng.randint(0, 99) for _ in range(60)]
    df = weekly_frame(spark, values).select(
        "week",
        "n",
        running_total("n", "week").alias("total"),
        moving_average("n", 7, "week").alias("mean"),
        calendar_lag("n").alias("previous"),
    )
    present = [v for v in values if v is not None]
    by_week = {date(2024, 1, 1) + timedelta(days=7 * i): v for i, v in enumerate(values) if v is not None}
    for i, row in enumerate(df.orderBy("week").collect()):
        assert row["total"] == sum(present[: i + 1])
        assert row["mean"] == pytest.approx(statistics.mean(present[max(0, i - 6) : i + 1]))
        assert row["previous"] == by_week.get(row["week"] - timedelta(days=7))


def test_shares_add_up(spark):
    rng = random.Random(2)
    rows = [(g, c, rng.randint(1, 50)) for g in range(20) for c in ("A", "B", "C", UNKNOWN)]
    df = spark.createDataFrame(rows, "g int, c string, n bigint")
    shared = share_out(df, "g", "c", "n", UNKNOWN, "out").groupBy("g").agg(F.sum("out").alias("s")).collect()
    total = Counter()
    for g, _, n in rows:
        total[g] += n
    assert {r["g"]: round(r["s"], 9) for r in shared} == dict(total)


def test_mean_of_products_is_product_of_means(spark):
    """The rewrite behind the weekly fee in USD, with missing values."""
    rng = random.Random(3)
    fee = [None if rng.random() < 0.1 else rng.random() for _ in range(14)]
    price = [None if rng.random() < 0.1 else rng.random() for _ in range(168)]
    pairs = [f * p for f in fee for p in price if f is not None and p is not None]
    by_means = statistics.mean(f for f in fee if f is not None) * statistics.mean(p for p in price if p is not None)
    assert by_means == pytest.approx(statistics.mean(pairs), rel=1e-12)


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_weeks_start_on_monday(spark, kind):
    days = [datetime(2023, 12, 25) + timedelta(hours=7 * i) for i in range(60)]
    df = spark.createDataFrame([(d.isoformat(),) for d in days], "t string")
    got = [r[0] for r in df.select(week_of(F.col("t").cast(kind))).collect()]
    assert got == [(d - timedelta(days=d.weekday())).date() for d in days]


def test_clock():
    for offset in range(7):
        clock = AsOf.of(date(2024, 1, 29) + timedelta(days=offset))
        assert clock.this_week == date(2024, 1, 29)
        assert clock.last_week == date(2024, 1, 22)
    assert AsOf.of("2024-01-31 10:00:00").ago(1) == datetime(2024, 1, 30, 10)
    assert AsOf.of(datetime(2024, 1, 31, 10)).today == date(2024, 1, 31)
    assert AsOf.of(clock) is clock
    assert first_week_after(date(2020, 1, 1)) == date(2020, 1, 6)
    assert first_week_after(date(2020, 1, 6)) == date(2020, 1, 13)
