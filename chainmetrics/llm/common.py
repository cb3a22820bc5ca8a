"""What the operators share: reading, written intermediate tables, batches."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What str.split() and the contracts call white space: space and \t \n \v \f \r.
SPACE = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of our own only where none is named."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        folder = tempfile.mkdtemp(prefix="chainmetrics-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    Cuts lineage and survives the loss of any executor; unlike ``checkpoint()``
    the rows are computed once and stored by column.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, within: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, from 0 in ascending ``order`` among rows of equal ``within``, and their number ``total``.

    Rows are dealt out by range and numbered within their partition; only one row for each
    partition and group is then summed up. Equal rows are spread too, so no group and no
    value is gathered in one task. ``rows`` should be a written table, as it is sampled first.
    """
    keys = [*within, *order]
    placed = staged(
        rows.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
        .repartitionByRange(*keys, "_tie")
        .sortWithinPartitions(*keys, "_tie")
        .drop("_tie")
        .withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", 33)
    group = [F.col(name).alias(f"_of_{name}") for name in within]
    runs = placed.groupBy(part.alias("_part"), *group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    of_group = Window.partitionBy(*[f"_of_{name}" for name in within])
    earlier = of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = staged(
        runs.select(
            "_part",
            *[f"_of_{name}" for name in within],
            (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
            F.sum("_n").over(of_group).alias("total"),
        )
    )
    same = (part == F.col("_part")) if not within else (part == F.col("_part")) & _all_equal(within)
    return placed.join(offsets, same).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("pos"), "total")


def _all_equal(names: list[str]) -> F.Column:
    return reduce(and_, (F.col(name).eqNullSafe(F.col(f"_of_{name}")) for name in names))


def text_key(text) -> F.Column:
    """96 bits of MD5: the identity of a whole text. Null counts as empty."""
    return F.substring(F.unhex(F.md5(F.coalesce(text, F.lit("")))), 1, 12)


_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def words_in_parts(raw: bytes, size: int = 1 << 22) -> Iterator[list[bytes]]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, some megabytes of it at a time."""
    at = 0
    while at < len(raw):
        end = at + size
        if end < len(raw):
            blank = _BLANK.search(raw, end)
            end = blank.start() if blank else len(raw)
        yield raw[at:end].split() if at or end < len(raw) else raw.split()
        at = end


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Keeps the batches that Python workers hold small, as texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark
