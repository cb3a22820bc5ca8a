"""Region inference from the hours of day in which a user is active."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOURS = 24
TOP = 6
UNKNOWN = "Unknown Region"

# The six hour tokens of each region, in order of precedence.
REGION_HOURS = {
    "Europe Central": ["08", "09", "10", "16", "17", "18"],
    "United States (East Coast)": ["02", "03", "04", "10", "16", "17"],
    "Asia": ["08", "09", "10", "14", "15", "16"],
    "Europe Western": ["23", "00", "01", "07", "08", "09"],
    "United States (Central)": ["17", "18", "19", "01", "02", "03"],
    "United States (West Coast)": ["11", "12", "13", "19", "20", "21"],
    "South America": ["20", "21", "22", "04", "05", "06"],
    "Africa": ["00", "01", "02", "03", "04", "05"],
    "Oceania": ["10", "11", "12", "13", "14", "15"],
}

# These two must beat all others; the rest only beat each other.
BEATS_ALL = ("Africa", "Oceania")

# Labels reported under a wider name.
ROLL_UP = {
    "US": [
        "United States (East Coast)",
        "United States (Central)",
        "United States (West Coast)",
    ],
    "Europe": ["Europe Central", "Europe Western"],
}

PROFILES = ("reference", "padded")


def region_hours(profile: str = "reference") -> dict[str, list[int]]:
    """Hours that count for each region.

    Profile ``reference`` compares tokens with hours written without padding, so
    ``"08"`` matches nothing; profile ``padded`` lets every token match.
    """
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}; choose one of {PROFILES}")
    return {
        region: [int(token) for token in tokens if profile == "padded" or token == str(int(token))]
        for region, tokens in REGION_HOURS.items()
    }


def hour_profile(rows: DataFrame) -> DataFrame:
    """``(user, first_ts, h0 .. h23)`` from rows ``(user, tx_id, ts)``.

    Each ``h`` holds the distinct transactions of the user in that hour of day.
    Transactions are de-duplicated by (user, hour, tx), which spreads a hot user
    over all tasks; the second aggregate then combines at most 24 counters per
    user before its shuffle. All 24 hours exist without a cross join. The NULL
    user keeps a row, but without counts, as it matches no activity.
    """
    per_tx = rows.groupBy("user", F.hour("ts").alias("hour"), "tx_id").agg(
        F.min("ts").alias("first_ts")
    )
    counts = [
        F.expr(f"count_if(hour = {h} AND tx_id IS NOT NULL AND user IS NOT NULL) AS h{h}") for h in range(HOURS)
    ]
    return per_tx.groupBy("user").agg(F.min("first_ts").alias("first_ts"), *counts)


def hourly_counts() -> Column:
    return F.expr(f"array({', '.join(f'h{h}' for h in range(HOURS))})")


def top_hours() -> Column:
    """The six busiest hours, busiest first; ties go to the earlier hour."""
    cells = ", ".join(f"struct(-h{h} AS fewer, {h} AS hour)" for h in range(HOURS))
    return F.expr(f"slice(sort_array(array({cells})), 1, {TOP}).hour")


def top_hours_ascending() -> Column:
    """The same six hours, least busy first."""
    cells = ", ".join(f"struct(-h{h} AS fewer, {h} AS hour)" for h in range(HOURS))
    top = f"slice(sort_array(array({cells})), 1, {TOP})"
    return F.expr(f"sort_array(transform({top}, x -> struct(-x.fewer AS n, x.hour AS hour))).hour")


def region_score(hours: str, wanted: list[int]) -> Column:
    if not wanted:
        return F.lit(0)
    return F.expr(f"size(array_intersect({hours}, array({', '.join(map(str, wanted))})))")


def classify(scores: dict[str, Column]) -> Column:
    """First region whose score strictly beats its rivals, else unknown."""
    ordinary = [region for region in scores if region not in BEATS_ALL]
    label = F.lit(UNKNOWN)
    for region in reversed(list(scores)):
        rivals = scores if region in BEATS_ALL else ordinary
        best_rival = F.greatest(*[scores[other] for other in rivals if other != region])
        label = F.when(scores[region] > best_rival, F.lit(region)).otherwise(label)
    return label


def infer_region(profile_rows: DataFrame, profile: str = "reference") -> DataFrame:
    """``(user, first_ts, top_hours, region)``, one row per user."""
    with_hours = profile_rows.select("user", "first_ts", top_hours().alias("top_hours"))
    wanted = region_hours(profile)
    names = {region: f"score_{i}" for i, region in enumerate(wanted)}
    scored = with_hours.select(
        "*", *[region_score("top_hours", wanted[region]).alias(names[region]) for region in wanted]
    )
    label = classify({region: F.col(name) for region, name in names.items()})
    return scored.select("user", "first_ts", "top_hours", label.alias("region"))


def rolled_up(region: Column) -> Column:
    label = region
    for wide, narrow in ROLL_UP.items():
        label = F.when(region.isin(narrow), F.lit(wide)).otherwise(label)
    return label
