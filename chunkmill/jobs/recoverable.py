"""Which sparse downloads can be recovered, and how many bytes of each are missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.layout import recoverable
from ..operators.link import child_rows


def recoverable_downloads(entries: DataFrame, children: DataFrame) -> DataFrame:
    """``cache_dir``, ``url``, ``total_bytes``, ``missing_bytes`` of each sparse entry with children."""
    kids = child_rows(entries, children)
    ranges = kids.select(F.struct("cache_dir", "url").alias("resource_id"), F.col("offset_bytes").alias("range_offset"), F.col("size").alias("range_length"), F.struct("child_id", "file_name", "size").alias("seq"))
    return recoverable(ranges).select("resource_id.cache_dir", "resource_id.url", "total_bytes", "missing_bytes")
