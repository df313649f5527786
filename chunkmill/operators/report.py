"""Inventories, selections, recovery plans and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.media import file_extension, media_category
from ..functions.names import client_name
from .group import HEADER_TYPES
from .spread import numbered

CACHE = "cache_dir"


def cache_inventory(files: DataFrame, with_totals: bool = False) -> DataFrame:
    """Files and bytes of each cache, with its client; ``with_totals`` adds the rolled-up rows."""
    named = files.withColumn("client", client_name(F.col(CACHE)))
    grouped = named.rollup("client", CACHE) if with_totals else named.groupBy("client", CACHE)
    return grouped.agg(F.count(F.lit(1)).alias("file_count"), F.sum("size").alias("total_size"))


def pair_simple_streams(files: DataFrame) -> DataFrame:
    """One row a cache and hash with the sizes of its streams; rows with neither body nor sparse
    stream are left out. Needs ``hash``, ``stream``, ``size``."""
    size = lambda s: F.max(F.when(F.col("stream") == s, F.col("size")))
    out = files.where("hash is not null").groupBy(CACHE, "hash").agg(size("0").alias("body_size"), size("1").alias("side_size"), size("s").alias("sparse_size"))
    return out.where("body_size is not null or sparse_size is not null")


def filter_resources(resources: DataFrame, category: str = "all", query: str = "") -> DataFrame:
    """Resources of a category (or all) whose name holds ``query``, whatever its case."""
    out = resources if category == "all" else resources.where(F.col("media_category") == {"images": "image", "videos": "video"}.get(category, category))
    return out.where(F.lower("display_name").contains(query.lower())) if query else out


def select_resources(resources: DataFrame, which: str) -> DataFrame:
    """Sets ``selected`` to all, none, or the resources of one category; an earlier choice is lost."""
    chosen = F.lit(which == "all") if which in ("all", "none") else F.col("media_category") == which
    return resources.withColumn("selected", chosen)


def sort_resources(resources: DataFrame, newest: bool = True) -> DataFrame:
    """By time (null as 0), input order on ties."""
    at = F.coalesce("modified_at_us", F.lit(0))
    return resources.orderBy(at.desc() if newest else at.asc(), "ord")


def resource_summary(resources: DataFrame) -> DataFrame:
    """Selected resources by category, with the total in a row of category null."""
    return resources.where("selected").rollup("media_category").agg(F.count(F.lit(1)).alias("n"), F.sum("total_size").alias("bytes"))


def metadata_coverage(resources: DataFrame) -> DataFrame:
    """How many resources of a cache have index metadata, and how many CDN facts."""
    return resources.groupBy(CACHE).agg(F.count_if(F.col("index_url").isNotNull() | F.col("index_content_type").isNotNull()).alias("with_metadata"), F.count_if(F.col("cdn_kind").isNotNull()).alias("with_cdn"))


def new_or_changed(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files whose cached result is missing or no longer valid: ``reason`` is new, or changed if the
    path is known with another time or size."""
    known = done.select("path", F.col("size").alias("_s"), F.col("modified_at_us").alias("_m"))
    met = files.join(known, "path", "left")
    reason = F.when(F.col("_s").isNull() & F.col("_m").isNull(), "new").when((F.col("_s") != F.col("size")) | (F.col("_m") != F.col("modified_at_us")), "changed")
    return met.withColumn("reason", reason).where("reason is not null").drop("_s", "_m")


def recovery_plan(resources: DataFrame, convert_webm: bool = False, convert_gif: bool = False, concat_groups: bool = False) -> DataFrame:
    """One row a resource: action, subfolder, sanitised name, extension, output path, conversion,
    and ``collides`` where two resources would be written to one path. Of a group of several files only
    WebM ones are concatenated, of others the first file is copied; ``concat_groups`` concatenates all
    kinds that a media header can begin."""
    kind = F.col("resource_type")
    joined = kind.isin(HEADER_TYPES if concat_groups else ["webm_mkv"])
    action = (
        F.when(kind == "unknown_data", "none").when((kind == "mp4_chunked") & F.col("index_is_sparse"), "index_reassemble").when(kind == "mp4_chunked", "chunk_reassemble")
        .when(joined & (F.col("n_files") > 1), "concat").when(F.col("sparse_stream"), "sparse_copy").otherwise("copy")
    )
    folder = F.concat(media_category(kind), F.lit("s"))
    name = F.regexp_replace("display_name", r"[^a-zA-Z0-9_-]", "_")
    convert = F.when((kind == "webm_mkv") & F.lit(convert_webm), "mp4").when((kind == "gif") & F.lit(convert_gif), "mp4")
    out = resources.withColumns({"action": action, "subfolder": folder, "safe_name": name, "extension": file_extension(kind), "convert_to": convert})
    out = out.withColumn("out_path", F.concat_ws("/", "subfolder", F.concat("safe_name", "extension")))
    same = out.groupBy(CACHE, "out_path").agg((F.count(F.lit(1)) > 1).alias("collides"))
    return out.join(same, [CACHE, "out_path"])


def concat_playlist(resources: DataFrame) -> DataFrame:
    """Videos without error of each cache, oldest first, if there are two or more."""
    videos = resources.where("media_category = 'video' and error is null")
    return numbered(videos, [CACHE], [F.coalesce("modified_at_us", F.lit(0)), "ord"], "place", total="_n").where("_n > 1").drop("_n")


def scan_union(scans: list[DataFrame]) -> DataFrame:
    """Results of several scans in one."""
    return reduce(DataFrame.unionByName, scans)


def display_name(resources: DataFrame, original: str = "original_filename", base: str = "url_name") -> DataFrame:
    """Adds ``display_name``: the original name, else the URL's; an empty one, or one of more than 100
    characters, becomes a label with the resource's ``number`` and, if chunked, its children."""
    found = F.coalesce(F.nullif(F.col(original), F.lit("")), F.col(base), F.lit(""))
    label = F.when(F.col("media_category") == "image", "Image").when(F.col("media_category") == "video", "Video").when(F.col("media_category") == "audio", "Audio").otherwise("File")
    numbered = F.concat(label, F.lit(" "), F.col("number").cast("string"))
    chunked = (F.col("n_files") > 1) | (F.col("index_is_sparse") & (F.col("n_children") > 1))
    made = F.when(chunked, F.concat(numbered, F.lit(" ("), F.col("n_children").cast("string"), F.lit(" chunks)"))).otherwise(numbered)
    return resources.withColumn("display_name", F.when((found == "") | (F.length(found) > 100), made).otherwise(found))
