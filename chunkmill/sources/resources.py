"""Resources and audits at rest."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder that executors and driver share: below the cluster's checkpoint folder; where none is
    set, a temporary one in a local session (as in tests), else below the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        local = spark.sparkContext.master.split("[")[0] == "local"
        base = tempfile.mkdtemp(prefix="chunkmill-") if local else spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/resources-{uuid.uuid4().hex}"


#: Bytes of an Arrow batch that a task sends to Python (one row at least), where a frame is stored.
BATCH_BYTES = 2 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def keep_batches_small(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """From now on the session sends batches of at most about ``most`` bytes to Python: for frames that whoever calls will write."""
    spark.conf.set(_BATCH_BYTES, str(most))


@contextmanager
def small_batches(spark: SparkSession, most: int = BATCH_BYTES):
    """What is written inside sends batches of at most about ``most`` bytes to Python: Spark's own limits (10,000 rows, 64 MB)
    let a worker and its executor's buffers grow with the rows of a partition. The session's setting is put back."""
    was = spark.conf.get(_BATCH_BYTES, None)
    spark.conf.set(_BATCH_BYTES, str(most))
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(_BATCH_BYTES)
        else:
            spark.conf.set(_BATCH_BYTES, was)


#: How many times as large as its files a table counts, at least, where Spark plans joins, and bytes of rows that are broadcast at most
#: where it has counted them.
FILE_GROWTH, BROADCAST_BYTES = 256, 1 << 20
_FILE_GROWTH, _BROADCAST, _COUNTED = "spark.sql.sources.fileCompressionFactor", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


def _bytes(size: str) -> int:
    """A size as Spark's settings have it: ``10485760b``, ``256k``, ``-1``."""
    number, unit = re.fullmatch(r"(-?\d+)([bkmgtp]?)b?", size.strip().lower()).groups()
    return int(number) << 10 * "bkmgtp".index(unit or "b")


def keep_broadcasts_small(spark: SparkSession) -> None:
    """From now on the session counts a table of files as at least FILE_GROWTH times their size where it plans joins, and broadcasts what it
    has counted up to BROADCAST_BYTES, unless it has settings for less. Parquet holds ids and names in a small part of the memory
    that their rows take, so by its files' size a table of many times the threshold would go through the driver; and a
    recovery's plan has dozens of joins, whose broadcasts the driver holds all at once."""
    if float(spark.conf.get(_FILE_GROWTH, "1.0")) < FILE_GROWTH:
        spark.conf.set(_FILE_GROWTH, str(float(FILE_GROWTH)))
    if _bytes(spark.conf.get(_COUNTED, None) or spark.conf.get(_BROADCAST)) > BROADCAST_BYTES:
        spark.conf.set(_COUNTED, str(BROADCAST_BYTES))


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once into a new shared folder and read again: later steps do not compute it anew,
    and survive lost executors. Joins with it are planned by the size of its rows (``keep_broadcasts_small``)."""
    keep_broadcasts_small(df.sparkSession)
    path = shared_folder(df.sparkSession)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_resources(resources: DataFrame, path: str) -> None:
    """Parquet, a folder a media category; a category is then read without the others."""
    resources.write.mode("errorifexists").partitionBy("media_category").parquet(path)


def load_resources(spark: SparkSession, path: str, category: str | None = None) -> DataFrame:
    found = spark.read.parquet(path)
    return found if category is None else found.where(F.col("media_category") == category)


def export_audit_json(tables: dict[str, DataFrame], path: str) -> None:
    """One JSON folder a table, a row a line; null fields are kept."""
    for name, df in tables.items():
        df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(f"{path}/{name}")
