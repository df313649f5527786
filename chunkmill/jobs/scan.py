"""One scan of many caches: the three recoveries over the files of each cache, and what is told of them as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.headers import content_range_total
from ..operators import group, link, report
from ..operators.spread import numbered
from ..sources import parts as parts_of
from ..sources.resources import kept
from . import recovery

CACHE = "cache_dir"
COLUMNS = "id string, phase int, ord bigint, resource_type string, media_category string, display_name string, index_url string, index_content_type string, total_size bigint, n_children int, index_is_sparse boolean, sparse_stream boolean, authoritative boolean, header_file string, method string, etag string, range_total bigint, file_names array<string>"


def changed_caches(files: DataFrame, done: DataFrame) -> DataFrame:
    """``cache_dir`` of the caches that hold a file that is new or has another time or size than in ``done`` (``cache_dir``, ``name``,
    ``size``, ``modified_at_us``), or that have lost one: the rules go over whole caches, so these are scanned anew."""
    path = F.concat(CACHE, F.lit("/"), "name").alias("path")
    fresh = report.new_or_changed(files.select(CACHE, path, "size", "modified_at_us"), done.select(path, "size", "modified_at_us"))
    lost = done.join(files.select(CACHE, "name"), [CACHE, "name"], "left_anti")
    return fresh.select(CACHE).unionByName(lost.select(CACHE)).distinct()


def entry_facts(indexed: dict[str, DataFrame]) -> DataFrame:
    """What the indexes know of each external file, from its entry: ``url``, ``content_type``, ``original_filename``, ``etag``,
    ``content_range``, ``sparse_entry``, ``entry_children``."""
    counts = indexed["children"].groupBy(CACHE, "ord").agg(F.count(F.lit(1)).cast("int").alias("entry_children"))
    known = link.file_entries(indexed["children"], indexed["streams"]).join(indexed["entries"].drop("url"), [CACHE, "ord"]).join(counts, [CACHE, "ord"], "left")
    header = lambda name: F.try_element_at("headers", F.lit(name))
    return known.select(CACHE, "name", "url", "content_type", "original_filename", header("etag").alias("etag"), header("content-range").alias("content_range"), F.col("is_sparse").alias("sparse_entry"), F.coalesce("entry_children", F.lit(0)).alias("entry_children"))


def _common(rows: DataFrame, tag: str, **columns) -> DataFrame:
    """``rows`` in the columns of all phases: given expressions, else columns of their own, else null."""
    made = [F.col(CACHE), F.concat(F.lit(tag), F.to_json("resource_id")).alias("id")]
    for name, kind in (c.split(" ") for c in COLUMNS.split(", ")[1:]):
        value = columns.get(name, F.col(name) if name in rows.columns else F.lit(None))
        made.append(value.cast(kind).alias(name))
    return rows.select(*made)


def scan(index_files: DataFrame, files: DataFrame, done: DataFrame | None = None) -> dict[str, DataFrame]:
    """All resources of many caches, from their indexes, then Simple files, then what no index claims. Frames by name:

    * ``resources``: in order of the phases, one for each URL of a cache (``group.merge_resources_by_url``), numbered over all phases,
      with their plan (``report.recovery_plan``) and ``id``; ``resource_files``: their files, a row each;
    * ``parts``: their bytes (``id``, ``part``, ``begin``, ``content``); ``videos``: what the index box of an assembled video tells;
    * ``unidentified``: a bucket a cache of chunks that no resource has; ``stats``: nine counters a cache; ``associations``: why each file
      belongs to its resource; ``playlist``: videos in order of time; ``skipped`` and ``errors``, of indexes, plans and files.

    ``files``: ``cache_dir``, ``name``, ``size``, ``modified_at_us``, ``content`` (and ``path``, see ``recovery.recover_simple``); ``index_files`` as of
    ``index.read_index_entries``. With ``done``, the files of an earlier scan, only caches that changed are scanned.
    """
    if done is not None:
        caches = kept(changed_caches(files, done))
        files, index_files = files.join(caches, CACHE, "left_semi"), index_files.join(caches, CACHE, "left_semi")
    block, simple = files.where(F.col("name").startswith("f_")), files.where(~F.col("name").startswith("f_"))
    indexed = recovery.recover_indexed(index_files, block.drop("path", "modified_at_us"))
    facts = kept(entry_facts(indexed))
    loose = block.join(indexed["claimed"], [CACHE, "name"], "left_anti").join(facts.select(CACHE, "name", "etag", "content_range", "content_type"), [CACHE, "name"], "left")
    unclaimed = recovery.recover_unclaimed(loose.drop("path"), facts.drop("etag", "content_range"))
    main = recovery.recover_simple(simple)

    one = indexed["resources"]
    listed = [
        _common(one, "index:", phase=F.lit(0), index_content_type=F.col("content_type"), authoritative=F.col("index_is_sparse") | (F.col("n_children") > 0), method=F.lit("index"), file_names=F.transform("files", lambda f: f["name"])),
        _common(main["resources"], "simple:", phase=F.lit(1), authoritative=F.lit(False), header_file=F.concat("hash", F.when(F.col("sparse_stream"), "_s").otherwise("_0")), file_names=F.array(F.concat("hash", F.when(F.col("sparse_stream"), "_s").otherwise("_0")))),
        _common(unclaimed["resources"], "loose:", total_size=F.lit(None), authoritative=F.coalesce(F.col("index_sparse_entry") | (F.col("index_entry_children") > 0), F.lit(False)), range_total=content_range_total(F.col("content_range"))),
    ]
    rows = listed[0].unionByName(listed[1]).unionByName(listed[2])
    rows = numbered(rows, [CACHE], ["phase", "ord", "id"], "seq")
    own = rows.select(CACHE, F.col("seq").alias("ord"), F.posexplode("file_names").alias("place", "name")).join(files.select(CACHE, "name", "size", "modified_at_us"), [CACHE, "name"])
    own = kept(own)
    sums = own.groupBy(CACHE, F.col("ord").alias("seq")).agg(F.sum("size").alias("bytes"), F.max("modified_at_us").alias("modified_at_us"))
    rows = kept(rows.join(sums, [CACHE, "seq"], "left").withColumn("total_size", F.coalesce("total_size", "bytes", F.lit(0))).drop("bytes", "ord").withColumnRenamed("seq", "ord"))
    kept_rows, merged = group.merge_resources_by_url(rows, own.drop("modified_at_us"))
    merged = kept(merged)
    counts = merged.groupBy(CACHE, "ord").agg(F.count(F.lit(1)).cast("int").alias("n_files"), F.transform(F.sort_array(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("file_names"))
    resources = kept_rows.join(rows.drop("index_url", "total_size", "file_names"), [CACHE, "ord"]).join(counts, [CACHE, "ord"], "left").withColumn("n_files", F.coalesce("n_files", F.lit(0)))
    resources = group.number_resources(resources)
    named = F.regexp_replace(F.col("display_name"), F.lit(r"^(Image|Video|Audio|File) \d+"), F.concat(F.lit("$1 "), F.col("number").cast("string")))
    resources = kept(report.recovery_plan(resources.withColumn("display_name", named)))

    parts = indexed["parts"].select(F.concat(F.lit("index:"), F.to_json("resource_id")).alias("id"), "part", "begin", "content")
    for tag, frame in (("simple:", main), ("loose:", unclaimed)):
        parts = parts.unionByName(frame["parts"].select(F.concat(F.lit(tag), F.to_json("resource_id")).alias("id"), "part", "begin", "content"))
    parts = parts.join(resources.select("id"), "id", "left_semi")
    video = parts.join(resources.where("resource_type in ('mp4_complete', 'mp4_chunked')").select("id"), "id", "left_semi")
    ends = video.groupBy("id").agg(F.max(F.col("begin") + F.octet_length("content")).alias("total"))
    errors = indexed["errors"].select(CACHE, F.lit("index").alias("of"), "error").unionByName(main["errors"].select(CACHE, F.col("hash").alias("of"), "error"))
    errors = errors.unionByName(unclaimed["errors"].select(F.col(f"resource_id.{CACHE}").alias(CACHE), F.to_json("resource_id").alias("of"), "error"))
    return {
        "resources": resources, "resource_files": merged, "parts": parts, "videos": parts_of.video_info(video.join(ends, "id"), ["id"]),
        "unidentified": unclaimed["unidentified"], "skipped": indexed["skipped"], "errors": errors,
        "stats": group.scan_stats(files, resources, indexed["entries"], indexed["claimed"], unclaimed["chunks"], unclaimed["left"]),
        "associations": group.chunk_associations(resources.where("n_files > 0")), "playlist": report.concat_playlist(resources.withColumn("error", F.lit(None).cast("string"))),
    }
