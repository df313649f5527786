"""Linking index entries with their chunks and files. All joins are within one cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import media, urls
from ..functions.names import file_basename
from ..functions.values import parse_child_key

CACHE = "cache_dir"


def with_child_keys(children: DataFrame) -> DataFrame:
    """``children`` with ``parent_url``, ``child_id``, ``offset_bytes`` and ``reject_reason``. The key is cut once a
    row: a generated struct is opaque to the optimizer, which would else copy the cutting into every
    filter and join condition that it infers (most of the time of a join, before)."""
    return children.select("*", F.inline(F.array(parse_child_key(F.col("child_key")))))


def first_parents(entries: DataFrame) -> DataFrame:
    """The sparse entries that get the children of their URL: the first one of each URL by ``ord``."""
    first = Window.partitionBy(CACHE, "url").orderBy("ord")
    return entries.where("is_sparse").withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def child_rows(entries: DataFrame, children: DataFrame) -> DataFrame:
    """Children of each sparse parent, a row each: ``cache_dir``, ``url`` and ``ord`` of the parent, ``child_id``,
    ``offset_bytes``, ``size``, ``file_name``, ``is_external``. Their order is (child_id, file_name, size). Nothing is gathered
    by URL, so a URL may have any number. Needs ``ord`` of the entries."""
    kids = with_child_keys(children).where("reject_reason is null")
    parents = first_parents(entries).select(CACHE, "url", "ord")
    kids = kids.select(CACHE, F.col("parent_url").alias("url"), "child_id", "offset_bytes", "size", "file_name", "is_external")
    return kids.join(parents, [CACHE, "url"]).select(CACHE, "url", "ord", "child_id", "offset_bytes", "size", "file_name", "is_external")


def linked_parents(entries: DataFrame, children: DataFrame) -> DataFrame:
    """The sparse parents with ``n_children``, ``body_size`` (their own, or the sum of the children where that is 0) and
    ``last_offset`` (of the last child; null without any). Children are summed before they are shuffled. Needs
    ``ord`` of the entries; without a ``body_size`` theirs is 0."""
    kids = with_child_keys(children).where("reject_reason is null")
    summed = kids.groupBy(CACHE, F.col("parent_url").alias("url")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("size").alias("_sum"), F.max("offset_bytes").alias("last_offset"))
    linked = first_parents(entries).join(summed, [CACHE, "url"], "left")
    told = F.col("body_size") if "body_size" in entries.columns else F.lit(0)
    own = F.when(told == 0, F.coalesce("_sum", F.lit(0))).otherwise(told)
    return linked.withColumns({"body_size": own, "n_children": F.coalesce("n_children", F.lit(0))}).drop("_sum")


def link_sparse_children(entries: DataFrame, children: DataFrame) -> DataFrame:
    """``linked_parents`` with their ``child_rows`` in one array, ``children`` of (child_id, offset_bytes, size, file_name,
    is_external), for parents of which each fits a row; ``n_children`` is an integer."""
    part = F.struct("child_id", "file_name", "size", "is_external", "offset_bytes")
    grouped = child_rows(entries, children).groupBy(CACHE, "url", "ord").agg(F.sort_array(F.collect_list(part)).alias("_kids"))
    made = F.transform(F.col("_kids"), lambda k: F.struct(*(k[c].alias(c) for c in ("child_id", "offset_bytes", "size", "file_name", "is_external"))))
    none = F.array().cast("array<struct<child_id:bigint,offset_bytes:bigint,size:bigint,file_name:string,is_external:boolean>>")
    linked = linked_parents(entries, children).drop("last_offset").join(grouped, [CACHE, "url", "ord"], "left")
    return linked.withColumn("children", F.coalesce(made, none)).withColumn("n_children", F.col("n_children").cast("int")).drop("_kids")


def orphan_children(entries: DataFrame, children: DataFrame) -> DataFrame:
    """Children whose parent is not there: ``n_children`` by the first 200 characters of its URL."""
    kids = with_child_keys(children).where("reject_reason is null").groupBy(CACHE, F.col("parent_url").alias("url")).agg(F.count(F.lit(1)).alias("n"))
    lost = kids.join(entries.where("is_sparse").select(CACHE, "url"), [CACHE, "url"], "left_anti")
    return lost.groupBy(CACHE, F.substring("url", 1, 200).alias("parent_url")).agg(F.sum("n").alias("n_children"))


def unmatched_parents(entries: DataFrame, children: DataFrame) -> DataFrame:
    """Sparse parents to which no child belongs."""
    kids = with_child_keys(children).where("reject_reason is null").select(CACHE, F.col("parent_url").alias("url"))
    return entries.where("is_sparse").join(kids, [CACHE, "url"], "left_anti").select(CACHE, "url")


def link_stats(entries: DataFrame, children: DataFrame) -> DataFrame:
    """Per cache: children linked, orphan groups, orphan children, parents without children. Children
    are counted by URL before they meet their parents."""
    kids = with_child_keys(children).where("reject_reason is null").groupBy(CACHE, F.col("parent_url").alias("url")).agg(F.count(F.lit(1)).alias("n"))
    parents = entries.where("is_sparse").select(CACHE, "url").distinct().withColumn("there", F.lit(True))
    met = kids.join(parents, [CACHE, "url"], "full")
    there, has = F.col("there").isNotNull(), F.col("n").isNotNull()
    return met.groupBy(CACHE).agg(
        F.coalesce(F.sum(F.when(there & has, F.col("n"))), F.lit(0)).alias("children_linked"), F.count_if(~there).alias("orphan_groups"),
        F.coalesce(F.sum(F.when(~there, F.col("n"))), F.lit(0)).alias("orphan_children"), F.count_if(~has).alias("unmatched_parents"),
    )


def _child_files(kids: DataFrame, *columns: str) -> DataFrame:
    """``columns``, ``place`` (their order) and the base ``name`` of every external child of ``child_rows``, or of the arrays of
    ``link_sparse_children``."""
    if "children" in kids.columns:
        kids = kids.select(CACHE, *columns, F.inline("children"))
    return kids.where("is_external").select(CACHE, *columns, F.struct("child_id", F.col("file_name").alias("file"), "size").alias("place"), file_basename(F.col("file_name")).alias("name"))


def _own_files(entry_streams: DataFrame, *columns: str) -> DataFrame:
    """The same of every external stream of the entries themselves."""
    none = F.struct(F.lit(0).cast("bigint").alias("child_id"), F.lit("").alias("file"), F.lit(0).cast("bigint").alias("size"))
    return entry_streams.where("is_external").select(CACHE, *columns, none.alias("place"), file_basename(F.col("file_name")).alias("name"))


def entry_files(kids: DataFrame, files: DataFrame, entry_streams: DataFrame | None = None) -> DataFrame:
    """Files of each entry, a row each: ``cache_dir``, ``url``, (``ord``), ``place`` (their order: that of the external children),
    ``name``, ``size``; of an entry without children, its stream 1 if that is external. Files that are not there are
    dropped. ``kids`` as of ``child_rows`` (or ``link_sparse_children``).

    ``entry_streams`` has a row for every stream of every entry: ``url``, ``ord``, ``is_sparse`` and
    ``body_size`` of the entry, ``stream_index``, ``file_name``, ``is_external``. With it, ``kids``
    needs ``ord``, and entries of one URL are told apart by it.
    """
    entry = [CACHE, "url"] if entry_streams is None else [CACHE, "url", "ord"]
    refs = _child_files(kids, *entry[1:])
    if entry_streams is not None:
        having = kids.where(F.size("children") > 0) if "children" in kids.columns else kids
        bodies = entry_streams.where("stream_index = 1").join(having.select(*entry), entry, "left_anti")
        refs = refs.unionByName(_own_files(bodies, *entry[1:]))
    return refs.join(files.select(CACHE, "name", "size"), [CACHE, "name"]).select(*entry, "place", "name", "size")


def match_entry_files(kids: DataFrame, files: DataFrame, entry_streams: DataFrame | None = None) -> DataFrame:
    """``entry_files`` in one array an entry, ``files`` of (name, size), and ``n_files``; for entries of which each fits a row."""
    found = entry_files(kids, files, entry_streams)
    entry = [c for c in found.columns if c not in ("place", "name", "size")]
    ordered = F.sort_array(F.collect_list(F.struct("place", "name", "size")))
    return found.groupBy(*entry).agg(F.transform(ordered, lambda x: F.struct(x["name"].alias("name"), x["size"].alias("size"))).alias("files"), F.count(F.lit(1)).alias("n_files"))


def file_entries(kids: DataFrame, entry_streams: DataFrame | None = None) -> DataFrame:
    """The entry (``url``, ``ord``) of each external file, a child's or (with ``entry_streams``, as in
    ``entry_files``) any stream's: the last one, by ``ord``, of those with a body or sparse."""
    refs = _child_files(kids, "url", "ord")
    if entry_streams is not None:
        refs = refs.unionByName(_own_files(entry_streams.where("is_sparse or body_size > 0"), "url", "ord"))
    return refs.groupBy(CACHE, "name").agg(F.max(F.struct("ord", "url")).alias("e")).select(CACHE, "name", "e.url", "e.ord")


def file_entry_map(kids: DataFrame, entry_streams: DataFrame | None = None) -> DataFrame:
    """``file_entries`` without ``ord``: the URL of each external file."""
    return file_entries(kids, entry_streams).drop("ord")


def unclaimed_files(files: DataFrame, kids: DataFrame, resource_files: DataFrame, entry_streams: DataFrame | None = None) -> DataFrame:
    """Files that neither a sparse entry's external children or streams (``kids`` and ``entry_streams``, as in
    ``entry_files``) nor a created resource has taken."""
    taken = _child_files(kids).select(CACHE, "name").union(resource_files.select(CACHE, "name"))
    if entry_streams is not None:
        taken = taken.union(_own_files(entry_streams.where("is_sparse")).select(CACHE, "name"))
    return files.join(taken, [CACHE, "name"], "left_anti")


def merge_path_lists(auto: DataFrame, custom: DataFrame) -> DataFrame:
    """All automatic paths, and the custom ones that are not among them."""
    extra = custom.select("path").distinct().join(auto.select("path"), "path", "left_anti")
    return auto.select("path", F.lit("auto").alias("origin")).unionByName(extra.select("path", F.lit("custom").alias("origin")))


def resolve_entry_type(entries: DataFrame) -> DataFrame:
    """Adds ``file_type`` and ``resource_type``: by MIME, else by first bytes, else, for a sparse entry
    with children, by URL (a video by default); with several children an MP4 is chunked."""
    parent = F.col("is_sparse") & (F.col("n_children") > 0)
    by_url = F.coalesce(urls.url_file_type(urls.strip_cache_key_prefix(F.col("url"))), F.lit("mp4_complete"))
    kind = F.coalesce(media.mime_to_file_type(F.col("content_type")), F.col("magic_type"), F.when(parent, by_url))
    chunked = F.col("is_sparse") & (F.col("n_children") > 1) & F.col("file_type").isin("mp4_complete", "mp4_header_only", "mp4_chunked")
    return entries.withColumn("file_type", kind).withColumn("resource_type", F.when(chunked, "mp4_chunked").otherwise(F.col("file_type")))


def classify_entries(entries: DataFrame) -> DataFrame:
    """Adds ``skip_reason``, null for entries that become resources."""
    return entries.withColumn(
        "skip_reason",
        F.when((F.col("body_size") == 0) & ~F.col("is_sparse"), "empty-body").when((F.col("n_files") == 0) & ~(F.col("is_sparse") & (F.col("n_children") > 0)), "no-files").when(F.col("file_type").isNull(), "no-file-type"),
    )


def skip_summary(entries: DataFrame) -> DataFrame:
    return entries.groupBy(CACHE, "skip_reason").agg(F.count(F.lit(1)).alias("n"))


def type_simple_entries(entries: DataFrame) -> DataFrame:
    """Type, source and size of each Simple entry: its sparse stream first (by first bytes, if there are
    more than eight, else by the MIME type of the headers), else its body (the same way); entries
    without a type are dropped. A sparse size that is not positive, or below the size on disk, is
    replaced by the reassembled length.

    Needs ``sparse_magic``, ``sparse_head_bytes``, ``sparse_size``, ``sparse_disk_size``,
    ``sparse_length`` (null without a sparse stream), ``body_magic``, ``body_size``, ``content_type``.
    """
    mime = media.mime_to_file_type(F.col("content_type"))
    sparse = F.when(F.col("sparse_disk_size").isNotNull(), F.coalesce(F.when(F.col("sparse_head_bytes") > 8, F.col("sparse_magic")), mime))
    body = F.when(F.col("body_size").isNotNull(), F.coalesce("body_magic", mime))
    told = F.when((F.col("sparse_size") <= 0) | (F.col("sparse_size") < F.col("sparse_disk_size")), F.col("sparse_length")).otherwise(F.col("sparse_size"))
    typed = entries.withColumns({"_s": sparse, "_b": body, "_t": told})
    out = typed.withColumns({"file_type": F.coalesce("_s", "_b"), "source": F.when(F.col("_s").isNotNull(), "sparse").when(F.col("_b").isNotNull(), "body"), "size": F.when(F.col("_s").isNotNull(), F.col("_t")).otherwise(F.col("body_size"))})
    return out.where("file_type is not null").drop("_s", "_b", "_t")
