"""A maintained index of users: weekly figures without reading the fact tables' history.

Two Parquet tables below one folder. ``ids`` has one row for each (source, entity) with a number
and its debut week; ``weeks`` has the users of each week as bitmaps over the numbers. A
refresh reads only facts from some week on and one row for each earlier user. Figures
of a week are bit counts, and the distinct users of any span of weeks follow from the same bitmaps
by a bitwise or, which no weekly count allows.

Both tables are laid out by ``since``, the week from which a refresh started. A refresh from
a week replaces all that refreshes from that week on have written, so rows that arrive late are
taken in by refreshing from their week, and a refresh that failed is simply run again.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainmetrics.functions.timeops import AsOf, before, since, week_of
from chainmetrics.plans.users import user_rows
from chainmetrics.sources.tables import Sources

IDS = "source string, entity string, id bigint, debut date, since date"
WEEKS = "week date, bucket bigint, bits binary, since date"

#: Stands for the start of a refresh of everything.
WHOLE_HISTORY = date(1900, 1, 1)
#: Numbers of one refresh are those of its tasks, each with a range of its own.
TASK_BITS = 33


class UserIndex:
    """The index below ``folder``, which all executors share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def ids(self) -> DataFrame:
        """``(source, entity, id, debut, since)``."""
        return self._table("ids", IDS)

    def weeks(self) -> DataFrame:
        """``(week, bucket, bits, since)``."""
        return self._table("weeks", WEEKS)

    def refresh(self, src: Sources, as_of: AsOf, start: date | None = None) -> None:
        """Take in all complete weeks from ``start`` (a Monday) on; without it, the whole history.

        Rows without a user are no users; rows without a time are in no week and are left out.
        """

        def dated(df: DataFrame) -> DataFrame:
            df = before(df, "block_timestamp", as_of.this_week)
            return since(df, "block_timestamp", start) if start else df.filter(F.col("block_timestamp").isNotNull())

        src = src.until(as_of)
        rows = user_rows(dated(src.transaction_actors), dated(src.evm_transactions))
        seen = rows.filter(F.col("entity").isNotNull()).select("source", "entity", week_of("ts").alias("week")).distinct()

        start = start or WHOLE_HISTORY
        self._forget(start)
        known = self.ids()
        last = known.agg(F.max("id")).first()[0]
        base = 0 if last is None else ((last >> TASK_BITS) + 1) << TASK_BITS
        fresh = seen.groupBy("source", "entity").agg(F.min("week").alias("debut")).join(known, ["source", "entity"], "left_anti")
        fresh.withColumn("id", F.lit(base) + F.monotonically_increasing_id()).select("source", "entity", "id", "debut").write.parquet(
            f"{self.folder}/ids/since={start}"
        )
        # Numbers are read from the table: they are fixed once they are written.
        numbered = seen.join(self.ids().select("source", "entity", "id"), ["source", "entity"])
        bitmaps = numbered.groupBy("week", F.bitmap_bucket_number("id").alias("bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits")
        )
        bitmaps.write.parquet(f"{self.folder}/weeks/since={start}")

    def weekly(self) -> DataFrame:
        """``(week, active_users, new_users)``, as :func:`chainmetrics.plans.users.users_weekly` has them."""
        active = self.weeks().groupBy("week").agg(F.sum(F.bitmap_count("bits")).alias("active_users"))
        new = self.ids().groupBy(F.col("debut").alias("week")).agg(F.count("*").alias("new_users"))
        return active.join(new, "week", "left").select("week", "active_users", "new_users")

    def active_between(self, first: date, last: date) -> int:
        """Distinct users of the weeks from ``first`` to ``last``, both included."""
        spans = self.weeks().filter((F.col("week") >= F.lit(first)) & (F.col("week") <= F.lit(last)))
        merged = spans.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        return merged.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0))).first()[0]

    def _files(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), place

    def _starts(self, table: str) -> list[date]:
        files, place = self._files(f"{self.folder}/{table}")
        names = [status.getPath().getName() for status in files.listStatus(place)] if files.exists(place) else []
        return [date.fromisoformat(name.removeprefix("since=")) for name in names if name.startswith("since=")]

    def _table(self, table: str, schema: str) -> DataFrame:
        if not self._starts(table):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{table}")

    def _forget(self, start: date) -> None:
        """Drops what refreshes from ``start`` on have written."""
        for table in ("weeks", "ids"):
            for old in self._starts(table):
                if old >= start:
                    files, place = self._files(f"{self.folder}/{table}/since={old}")
                    files.delete(place, True)
