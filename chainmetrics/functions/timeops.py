"""The as-of clock and the calendar arithmetic every metric shares."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Optional directory column of tables written by ``sinks.write_by_week``.
PARTITION_WEEK = "block_week"


@dataclass(frozen=True)
class AsOf:
    """The moment a report is made for; nothing here reads the wall clock."""

    moment: datetime

    @classmethod
    def of(cls, value: AsOf | datetime | date | str) -> AsOf:
        if isinstance(value, AsOf):
            return value
        if isinstance(value, str):
            return cls(datetime.fromisoformat(value))
        if isinstance(value, datetime):
            return cls(value)
        return cls(datetime(value.year, value.month, value.day))

    @property
    def today(self) -> date:
        return self.moment.date()

    @property
    def this_week(self) -> date:
        """Monday of the week still in progress."""
        return self.today - timedelta(days=self.today.weekday())

    @property
    def last_week(self) -> date:
        """Monday of the newest complete week."""
        return self.this_week - timedelta(days=7)

    @property
    def week_before_last(self) -> date:
        return self.this_week - timedelta(days=14)

    def midnight_ago(self, days: int) -> date:
        return self.today - timedelta(days=days)

    def ago(self, days: int) -> datetime:
        return self.moment - timedelta(days=days)


def week_of(ts: Column | str) -> Column:
    """Monday of the row's week, as a DATE."""
    return F.trunc(_col(ts).cast("date"), "week")


def day_of(ts: Column | str) -> Column:
    return _col(ts).cast("date")


def hour_of(ts: Column | str) -> Column:
    return F.date_trunc("hour", _col(ts))


def first_week_after(day: date) -> date:
    """First Monday strictly later than ``day``."""
    return day + timedelta(days=7 - day.weekday())


def moment_literal(moment: datetime) -> Column:
    """A zone-free literal that folds to the type of the column it meets."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def before(df: DataFrame, ts: str, day: date) -> DataFrame:
    """Rows earlier than midnight of ``day``.

    The bare column is compared, so the predicate reaches the Parquet scan; on a
    table laid out by week, whole directories are pruned as well.
    """
    kept = df.filter(F.col(ts) < F.lit(day))
    if PARTITION_WEEK in df.columns:
        kept = kept.filter(F.col(PARTITION_WEEK) < F.lit(day))
    return kept


def since(df: DataFrame, ts: str, day: date) -> DataFrame:
    """Rows at or after midnight of ``day``; prunes like :func:`before`."""
    kept = df.filter(F.col(ts) >= F.lit(day))
    if PARTITION_WEEK in df.columns:
        monday = day - timedelta(days=day.weekday())
        kept = kept.filter(F.col(PARTITION_WEEK) >= F.lit(monday))
    return kept


def up_to(df: DataFrame, ts: str, moment: datetime) -> DataFrame:
    """Rows not later than ``moment``; rows without a time stay, as no cutoff can place them.

    Prunes like :func:`before`.
    """
    kept = df.filter((F.col(ts) <= moment_literal(moment)) | F.col(ts).isNull())
    if PARTITION_WEEK in df.columns:
        kept = kept.filter((F.col(PARTITION_WEEK) <= F.lit(moment.date())) | F.col(PARTITION_WEEK).isNull())
    return kept


def minute_boundaries(start: Column | str, end: Column | str) -> Column:
    """Minute marks crossed from ``start`` to ``end``; negative when end is earlier."""
    return F.timestamp_diff(
        "MINUTE", F.date_trunc("minute", _col(start)), F.date_trunc("minute", _col(end))
    )


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value
