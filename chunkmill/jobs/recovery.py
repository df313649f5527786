"""The three recoveries end to end: from the files of many caches to resources, plans and bytes.

Each returns frames by name; ``parts`` has the bytes of each resource (``resource_id``, ``part``, ``begin``,
``content``), ready for ``sources.assemble.write_bodies``. Bodies are read to be typed and to be
assembled; all in between are narrow rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.headers import parse_raw_headers, simple_content_type
from ..functions.media import detect_file_type, media_category, mime_to_file_type
from ..functions.names import parse_cache_name
from ..functions.urls import parse_cdn_url, strip_cache_key_prefix, url_basename
from ..functions.values import decode_cache_addr, webkit_us_to_unix
from ..operators import group, layout, link, report
from ..operators.spread import numbered
from ..sources import assemble, bodies, ranged
from ..sources import parts as parts_of
from ..sources.index import read_http_meta, read_index_entries
from ..sources.resources import kept

CACHE = "cache_dir"
HEAD = 256
#: Bytes of a part of a body that is stored to be laid out anew: readers of stored rows hold thousands at once.
STORED_PART = 64 << 10
#: Streams in which the body of a sparse child is looked for, in order. Fixed values.
CHILD_STREAMS = (1, 2, 0, 3)


def index_tables(read: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries, sparse children and streams of every cache's index, of the rows of ``read_index_entries``. Entries have the facts
    of their metadata; streams the file, offset and size of each, and their entry's ``is_sparse`` and ``body_size``."""
    rows = read.where("error is null").withColumns({"is_child": F.col("flags").bitwiseAND(2) != 0, "is_sparse": F.col("flags").bitwiseAND(1) != 0, "body_size": F.greatest(F.col("sizes")[1], F.lit(0))})
    meta = read_http_meta(rows.where("not is_child"), [CACHE, "ord"]).withColumn("h", parse_raw_headers(F.col("raw_headers")))
    meta = meta.select(CACHE, "ord", "request_time_us", "response_time_us", "h.content_type", "h.headers", F.col("h.filename").alias("original_filename"), F.regexp_extract("h.status_line", r"^\S+ (\d{3})", 1).try_cast("int").alias("http_status"))
    entries = rows.where("not is_child").select(CACHE, "ord", "url", "state", "is_sparse", "body_size", webkit_us_to_unix(F.col("creation_time_us")).alias("created_at")).join(meta, [CACHE, "ord"], "left")
    each = rows.select(CACHE, "ord", "url", "is_sparse", "is_child", "body_size", F.posexplode(F.arrays_zip("sizes", "addrs")).alias("stream_index", "s")).where("s.sizes > 0").withColumn("a", decode_cache_addr(F.col("s.addrs"))).where("a.initialised")
    streams = each.select(CACHE, "ord", "url", "is_sparse", "is_child", "body_size", "stream_index", "a.file_name", (F.col("a.file_type") == 0).alias("is_external"), F.coalesce("a.byte_offset", F.lit(0)).alias("offset"), F.col("s.sizes").alias("size"))
    rank = F.array_position(F.array(*map(F.lit, CHILD_STREAMS)), F.col("stream_index"))
    child = streams.where("is_child").groupBy(CACHE, "ord", F.col("url").alias("child_key")).agg(F.min_by(F.struct("file_name", "is_external", "offset", "size"), rank).alias("s")).select(CACHE, "ord", "child_key", "s.*")
    return entries, child, streams.where("not is_child").drop("is_child")


def recover_indexed(index_files: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """Resources that the indexes of blockfile caches name: ``resources`` (one an URL, with their plan), ``skipped``
    (why an entry made none), ``claimed`` (files that are taken), ``errors`` (of indexes and blocks) and ``parts``.

    ``files``: ``cache_dir``, ``name``, ``size``, ``content`` of the external files.
    """
    read = kept(read_index_entries(index_files))
    entries, children, streams = index_tables(read)
    sparse = link.linked_parents(entries, children).drop("last_offset").withColumn("n_children", F.col("n_children").cast("int"))
    rest = entries.join(sparse.select(CACHE, "ord"), [CACHE, "ord"], "left_anti")
    linked = sparse.unionByName(rest.withColumn("n_children", F.lit(0)))
    child_rows = link.child_rows(entries, children)
    matched = link.match_entry_files(child_rows, files, streams)
    first = matched.select(CACHE, "ord", F.col("files")[0]["name"].alias("name"))
    magic = first.join(files.select(CACHE, "name", F.substring("content", 1, HEAD).alias("head")), [CACHE, "name"]).select(CACHE, "ord", F.col("name").alias("header_file"), detect_file_type(F.col("head")).alias("magic_type"))
    facts = linked.join(matched.drop("url"), [CACHE, "ord"], "left").join(magic, [CACHE, "ord"], "left").withColumn("n_files", F.coalesce("n_files", F.lit(0)))
    typed = kept(link.classify_entries(link.resolve_entry_type(facts)))
    made = typed.where("skip_reason is null").withColumns({"media_category": media_category(F.col("resource_type")), "index_is_sparse": F.col("is_sparse"), "phase": F.lit(0), "url_name": url_basename(strip_cache_key_prefix(F.col("url"))), "cdn": parse_cdn_url(F.col("url"), strip_prefix=True)})
    made = report.display_name(group.number_resources(made))
    size = F.when(F.col("body_size") > 0, F.col("body_size")).otherwise(F.aggregate(F.coalesce("files", F.array().cast("array<struct<name:string,size:bigint>>")), F.lit(0).cast("bigint"), lambda a, f: a + f["size"]))
    made = made.withColumns({"index_url": F.col("url"), "total_size": size, "files": F.coalesce("files", F.array().cast("array<struct<name:string,size:bigint>>")), "authoritative": F.col("is_sparse") | (F.col("n_children") > 0)})
    one = group.dedupe_resources_by_url(made.select(CACHE, "ord", "index_url", "files", "total_size", "authoritative"))
    resources = one.join(made.drop("index_url", "files", "total_size", "authoritative", "n_files"), [CACHE, "ord"]).withColumns({"n_files": F.size("files"), "sparse_stream": F.lit(False), "resource_id": F.struct(CACHE, "ord")})
    resources = kept(report.recovery_plan(resources))

    # bytes: sparse ones from their children, others from their first file
    apart = resources.where("action = 'index_reassemble' or n_files = 0").select(CACHE, "url", "resource_id")
    kids = link.with_child_keys(children).where("reject_reason is null").withColumnRenamed("parent_url", "url").join(apart, [CACHE, "url"])
    order = Window.partitionBy("resource_id").orderBy("child_id", "file_name")
    kids = kids.withColumn("seq", F.row_number().over(order).cast("bigint"))
    plan = kids.select("resource_id", "seq", F.col("seq").alias("source"), F.col("offset").alias("src_offset"), F.col("size").alias("length"), F.col("offset_bytes").alias("out_offset"), F.lit(None).cast("binary").alias("literal"))
    held = files.select(CACHE, "name", "content").unionByName(index_files.select(CACHE, "name", "content"))
    pieces = kids.select(CACHE, F.col("file_name").alias("name"), "resource_id", F.col("seq").alias("ord")).join(held, [CACHE, "name"]).select("resource_id", "ord", "content")
    raw = kept(assemble.assemble_plan(plan, pieces, ["resource_id"], STORED_PART, totals=True))
    rebuilt = kept(layout.segment_plan_index(parts_of.piece_facts(raw, ["resource_id"])))
    parts = assemble.assemble_plan(assemble.split_sources(rebuilt, STORED_PART), raw.select("resource_id", F.col("part").alias("ord"), "content"), ["resource_id"])
    copied = resources.where("action <> 'index_reassemble' and n_files > 0").select(CACHE, F.col("files")[0]["name"].alias("name"), "resource_id").join(files.select(CACHE, "name", "content"), [CACHE, "name"])
    zero = F.lit(0).cast("bigint")
    parts = parts.unionByName(copied.select("resource_id", zero.alias("part"), zero.alias("begin"), "content"))
    taken = resources.select(CACHE, F.explode("files.name").alias("name"))
    claimed = files.select(CACHE, "name").join(link.unclaimed_files(files.select(CACHE, "name"), child_rows, taken, streams), [CACHE, "name"], "left_anti")
    return {"resources": resources, "skipped": typed.where("skip_reason is not null"), "claimed": claimed, "entries": entries, "streams": streams, "linked": linked, "children": child_rows, "errors": read.where("error is not null").select(CACHE, "error"), "parts": parts}


def refined(rows: DataFrame, kind: str = "file_type") -> DataFrame:
    """An MP4 stays complete where the top level of its boxes has both moov and mdat (``has_moov``, ``has_mdat``, which are
    dropped), else it is a header only: the rule of ``layout.refine_mp4`` beside the boxes' own row."""
    whole = F.coalesce(F.col("has_moov") & F.col("has_mdat"), F.lit(False))
    return rows.withColumn(kind, F.when((F.col(kind) == "mp4_complete") & ~whole, "mp4_header_only").otherwise(F.col(kind))).drop("has_moov", "has_mdat")


def recover_unclaimed(files: DataFrame, entry_of_file: DataFrame | None = None) -> dict[str, DataFrame]:
    """Resources of blockfile files that no index claims: chunks grouped behind their headers by affinity and position,
    files that stand alone, and one bucket a cache of what is left: ``resources``, ``chunks``, ``left``, ``unidentified`` (the
    buckets; they have no number and no bytes), ``errors`` (of plans) and ``parts``.

    ``files``: ``cache_dir``, ``name``, ``size``, ``content``, ``etag``, ``content_range``, ``content_type`` (of the index, null
    where it knows nothing). ``entry_of_file`` as in ``attach_index_metadata``.
    """
    named = parse_cache_name(files).where("hex_value is not null").withColumn("hex_value", F.col("hex_value").cast("bigint"))
    head = F.substring("content", 1, HEAD)
    typed = named.withColumns({"file_type": detect_file_type(head), "head64": F.substring("content", 1, 64)})
    boxed = bodies.piece_facts(named, [CACHE, "name"]).drop("size")
    known = kept(refined(typed.drop("content").join(boxed, [CACHE, "name"])))
    known = group.dedupe_mp4_headers(known)
    chunks = kept(group.grouped_chunks(known))
    methods = chunks.groupBy(CACHE, F.col("header_file").alias("name")).agg(F.min("method").alias("method"))
    used = chunks.select(CACHE, "name").union(chunks.select(CACHE, F.col("header_file").alias("name"))).distinct()
    heads = known.join(chunks.select(CACHE, F.col("header_file").alias("name")).distinct(), [CACHE, "name"], "left_semi")
    alone = known.join(used, [CACHE, "name"], "left_anti")
    single = alone.where("file_type is not null and file_type not in ('mp4_fragment', 'webm_continuation', 'media_data_chunk', 'riff_unknown')")
    left = alone.join(single.select(CACHE, "name"), [CACHE, "name"], "left_anti")
    grouped = chunks.groupBy(CACHE, F.col("header_file").alias("name")).agg(F.sort_array(F.collect_list(F.struct("hex_value", F.col("name").alias("file")))).alias("behind"))
    kind = F.when((F.col("file_type").isin("mp4_header_only", "mp4_complete")) & F.col("behind").isNotNull(), "mp4_chunked").otherwise(F.col("file_type"))
    made = heads.unionByName(single).join(grouped, [CACHE, "name"], "left").join(methods, [CACHE, "name"], "left").withColumns({"resource_type": kind, "phase": F.when(F.col("behind").isNotNull(), 2).otherwise(3), "ord": F.col("hex_value"), "header_file": F.col("name")})
    made = made.withColumns({"media_category": media_category(F.col("resource_type")), "file_names": F.concat(F.array("name"), F.coalesce(F.transform("behind", lambda b: b["file"]), F.array().cast("array<string>")))})
    made = made.withColumns({"n_files": F.size("file_names"), "n_children": F.size("file_names") - 1, "index_is_sparse": F.lit(False), "index_url": F.lit(None).cast("string"), "original_filename": F.lit(None).cast("string"), "url_name": F.lit(None).cast("string"), "sparse_stream": F.lit(False)})
    made = report.display_name(group.number_resources(made))
    if entry_of_file is not None:
        made = group.attach_index_metadata(made, entry_of_file)
    resources = kept(report.recovery_plan(made.withColumn("resource_id", F.struct(CACHE, "ord"))))

    # bytes: of chunked MP4s by their plan, of other groups and files as their action says
    pieces = resources.where("action = 'chunk_reassemble'").select(CACHE, "resource_id", F.posexplode("file_names").alias("ord", "name")).join(known, [CACHE, "name"]).withColumns({"ord": F.col("ord").cast("bigint"), "is_header": F.col("ord") == 0})
    pieces = kept(pieces)
    plan = kept(layout.segment_plan_chunks(pieces.drop("cache_dir", "file_type", "head64"), "resource_id"))
    held = named.select(CACHE, "name", "content")
    parts = assemble.assemble_plan(plan.where("error is null"), pieces.select(CACHE, "name", "resource_id", "ord").join(held, [CACHE, "name"]), ["resource_id"])
    joined = resources.where("action in ('copy', 'concat')").select(CACHE, "resource_id", F.posexplode(F.when(F.col("action") == "concat", F.col("file_names")).otherwise(F.slice("file_names", 1, 1))).alias("ord", "name")).withColumn("ord", F.col("ord").cast("bigint")).join(known.select(CACHE, "name", "size"), [CACHE, "name"])
    order = Window.partitionBy("resource_id").orderBy("ord")
    line = joined.select("resource_id", F.col("ord").alias("seq"), F.col("ord").alias("source"), F.lit(0).cast("bigint").alias("src_offset"), F.col("size").alias("length"), F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("out_offset"), F.lit(None).cast("binary").alias("literal"))
    parts = parts.unionByName(assemble.assemble_plan(line, joined.select(CACHE, "name", "resource_id", "ord").join(held, [CACHE, "name"]), ["resource_id"]))
    stamped = left if "modified_at_us" in left.columns else left.withColumn("modified_at_us", F.lit(None).cast("bigint"))
    errors = plan.where("error is not null").select("resource_id", "error")
    return {"resources": resources, "chunks": chunks, "left": left, "unidentified": group.unidentified_bucket(stamped), "errors": errors, "parts": parts}


def _opens(files: DataFrame) -> bool:
    """Whether the files have paths that tasks can open by themselves (some stores are read by Spark only)."""
    one = files.select("path").limit(1).collect() if "path" in files.columns else []
    try:
        for row in one:
            ranged.opened(row.path).close()
    except (OSError, ValueError, NotImplementedError):
        return False
    return bool(one)


def recover_simple(files: DataFrame) -> dict[str, DataFrame]:
    """Resources of Simple caches: a file's sparse stream if it has a type, else its body: ``resources``, ``parts`` and ``errors``
    (files that could not be read).

    ``files``: ``cache_dir``, ``name``, ``size``, ``content``. With ``path`` too (``bodies.list_cache_files``), if it can be opened, main files are
    typed by ranges of their bytes, and ``content`` is read only where a body is wanted.
    """
    key, by_range = [CACHE, "hash"], _opens(files)
    named = parse_cache_name(files).where("hash is not null").select(CACHE, "hash", "stream", "size", "content", *["path"] * by_range)
    named = named if by_range else kept(named)
    sizes = report.pair_simple_streams(named)
    main = named.where("stream = '0'")
    cut = lambda a, b: F.expr(f"substring(content, cast({a} + 1 as int), cast({b} - {a} as int))")
    if by_range:
        facts = kept(ranged.file_facts(main, key, ("head", "headers", "boxes"), HEAD))
        errors, facts = facts.where("error is not null").select(*key, "error"), facts.where("error is null")
        lay = main.select(*key, "content").join(facts.select(*key, "body_start", "body_end"), key)
        facts = facts.withColumns({"n": F.col("body_end") - F.col("body_start"), "raw": F.col("headers")}).withColumn("head", F.expr("substring(head, 1, cast(least(n, length(head)) as int))"))
    else:
        lay = bodies.unwrap_simple(main, [*key, "content"])
        body = lay.select(*key, cut("body_start", "body_end").alias("content"), F.when(F.col("headers_start").isNotNull(), cut("headers_start", "headers_end")).alias("raw"))
        # boxes tell complete MP4s from headers; no other body is walked
        kind = F.coalesce(detect_file_type(F.substring("content", 1, HEAD)), mime_to_file_type(simple_content_type(F.decode("raw", "ISO-8859-1"))))
        tops = bodies.piece_facts(body.where(kind == "mp4_complete"), key).select(*key, "has_moov", "has_mdat")
        facts = body.select(*key, F.octet_length("content").cast("bigint").alias("n"), F.substring("content", 1, HEAD).alias("head"), "raw").join(tops, key, "left")
        errors = facts.limit(0).select(*key, F.lit("").alias("error"))
    # headers in any bytes; names and types are ASCII
    body = facts.select(*key, F.col("n").alias("body_size"), detect_file_type(F.col("head")).alias("body_magic"), simple_content_type(F.decode("raw", "ISO-8859-1")).alias("content_type"), "has_moov", "has_mdat")
    sparse = named.where("stream = 's'").select(*key, F.lit(0).cast("bigint").alias("ord"), "content")
    ranges = kept(bodies.sparse_ranges(sparse, key))
    plan = assemble.sparse_pieces(sparse, ranges, key)
    parts = kept(assemble.assemble_plan(plan, sparse, key, totals=True))
    length = plan.groupBy(*key).agg(F.max(F.col("out_offset") + F.col("length")).alias("sparse_length"))
    heads = parts.where("part = 0").select(*key, detect_file_type(F.substring("content", 1, HEAD)).alias("sparse_magic"), F.least(F.octet_length("content"), F.lit(HEAD)).alias("sparse_head_bytes"))
    video = parts.join(heads.where("sparse_magic = 'mp4_complete'").select(*key), key, "left_semi")
    tops = parts_of.piece_facts(video, key).select(*key, F.col("has_moov").alias("s_moov"), F.col("has_mdat").alias("s_mdat"))
    told = layout.sparse_size(ranges.withColumn("resource_id", F.struct(*key))).select("resource_id.*", F.col("sparse_size"))
    facts = sizes.select(*key, F.col("sparse_size").alias("sparse_disk_size"))
    for own in (body, told, length, heads, tops):
        facts = facts.join(own, key, "left")
    facts = facts.withColumn("sparse_head_bytes", F.coalesce("sparse_head_bytes", F.lit(0)))
    typed = link.type_simple_entries(facts)
    # of a sparse stream that has its type from its headers, boxes are not asked
    own = lambda body, sparse: F.when(F.col("source") == "body", F.col(body)).when(F.col("sparse_magic") == "mp4_complete", F.col(sparse)).otherwise(F.lit(True))
    typed = refined(typed.withColumns({"has_moov": own("has_moov", "s_moov"), "has_mdat": own("has_mdat", "s_mdat")})).drop("s_moov", "s_mdat")
    made = numbered(typed, [CACHE], ["hash"], "ord").withColumns({"resource_type": F.col("file_type"), "total_size": F.col("size"), "phase": F.lit(1), "n_files": F.lit(1), "n_children": F.lit(0), "index_is_sparse": F.lit(False), "media_category": media_category(F.col("file_type")), "original_filename": F.lit(None).cast("string"), "url_name": F.lit(None).cast("string"), "sparse_stream": F.col("source") == "sparse"})
    resources = kept(report.recovery_plan(report.display_name(group.number_resources(made)).withColumn("resource_id", F.struct(*key))))
    zero = F.lit(0).cast("bigint")
    plain = lay.join(resources.where("not sparse_stream").select(*key, "resource_id"), key).select("resource_id", zero.alias("part"), zero.alias("begin"), cut("body_start", "body_end").alias("content"))
    own = parts.join(resources.where("sparse_stream").select(*key, "resource_id"), key).select("resource_id", "part", "begin", "content")
    return {"resources": resources, "parts": plain.unionByName(own), "errors": errors}
