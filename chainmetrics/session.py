"""Session settings the results rely on, and settings worth having on a cluster."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession

# Results depend on these: buckets are UTC, and bad casts must not pass silently.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}

# Plan shape at scale. AQE coalesces small partitions, splits skewed join
# partitions and turns a join into a broadcast only after it has measured the
# side.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}

# Only accepted when a session starts. Recording the Python call site of every
# column costs more than planning.
AT_START = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def configure(spark: SparkSession) -> SparkSession:
    """Pin the settings that change answers; leave all sizing to the cluster."""
    for key, value in REQUIRED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Apply the recommended settings to a running session."""
    for key, value in RECOMMENDED.items():
        spark.conf.set(key, value)
    return configure(spark)


def local_session(
    app: str = "chainmetrics", cores: str = "8", partitions: int = 8, **conf: str
) -> SparkSession:
    """A session for tests and measurements on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in {**REQUIRED, **RECOMMENDED, **AT_START, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the folder named by ``spark.checkpoint.dir``, read again.

    For a frame that several parts of a plan read: it is computed once, its size is known, and
    a lost executor costs no recomputation. The table goes when the session's JVM ends. Where no
    folder is named, a session on one machine uses a temporary one; on a cluster the
    frame is returned as it is, with a warning, and is recomputed by each reader.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            warnings.warn("spark.checkpoint.dir is not set; a shared frame is computed by each user", stacklevel=2)
            return df
        folder = tempfile.mkdtemp(prefix="chainmetrics-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    table = f"{folder.rstrip('/')}/written-{uuid.uuid4().hex}"
    df.write.parquet(table)
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(table)


def shared(df: DataFrame) -> DataFrame:
    """Compute a frame once for several metrics by a reliable checkpoint.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Where
    none is named the frame is returned as it is, with a warning, and is recomputed
    by each user. A local folder is refused on a cluster: other machines cannot read it.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            warnings.warn("spark.checkpoint.dir is not set; a shared frame is computed by each user", stacklevel=2)
            return df
        local = folder.startswith(("file:", "/")) and not context.master.startswith("local")
        if local and context.getConf().get("spark.hadoop.fs.defaultFS", "file:").startswith("file:"):
            raise ValueError(f"{folder} is a local folder; name one that all executors share")
        context.setCheckpointDir(folder)
    return df.checkpoint()
