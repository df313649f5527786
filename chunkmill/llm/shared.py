"""Where jobs may put data that executors and driver both read, and small column helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.resources import small_batches

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words are runs of anything but the ASCII white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where none is set: a temporary one in a local session (as in tests), else
    the warehouse, which driver and executors share."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        local = context.master.split("[")[0] == "local"
        folder = tempfile.mkdtemp(prefix="chunkmill-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch-{uuid.uuid4().hex}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet into the shared folder and read again: it is computed once,
    and later reads survive lost executors."""
    path = new_folder(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the files of ``stored`` frames that no later read needs."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_few(ids: DataFrame, most: int = 1 << 22) -> DataFrame:
    """``ids`` (a stored frame), to be broadcast if it has at most ``most`` rows (for one long column, some 100 MB
    as a hash table); beyond that, left to a shuffled join."""
    return F.broadcast(ids) if ids.count() <= most else ids


def folded(text: Column) -> Column:
    """Null as empty, and A-Z (only) in lower case."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def words(text: Column) -> Column:
    """The words of a folded text, in order."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def crc32_bucket(key: Column, buckets: int) -> Column:
    """crc32 of the key as text, modulo ``buckets``; null keys are in no bucket (null)."""
    return F.crc32(key.cast("string").cast("binary")) % buckets
