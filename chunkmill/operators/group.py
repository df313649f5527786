"""Grouping files that no index claims: affinity by response metadata, then position."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.headers import content_range_total
from ..functions.media import is_known_non_media
from ..functions.urls import strip_cache_key_prefix, url_basename
from .spread import beside, numbered

CACHE = "cache_dir"
#: Positions of a bucket: a cache is walked in buckets, so that one large cache is many tasks.
BUCKET = 4096
#: Bytes of a sparse block, and how far a chunk may lie behind its header. Fixed values.
CHUNK_BYTES, HEX_GAP = 1 << 20, 50
#: Types that begin a group, and types that may continue one. Fixed values.
HEADER_TYPES = ["webm_mkv", "avi", "flv", "mpeg_ts", "mov", "mp3", "ogg", "aac", "flac", "wav", "opus", "wma", "m4a"]
CONTINUATION_TYPES = ["mp4_fragment", "webm_continuation", "media_data_chunk"]


def dedupe_mp4_headers(files: DataFrame) -> DataFrame:
    """Of MP4 headers with the same first 64 bytes, all but the first by ``hex_value`` lose their type."""
    header = F.col("file_type").isin("mp4_header_only", "mp4_complete")
    same = Window.partitionBy(CACHE, header, "head64").orderBy("hex_value")
    ranked = files.withColumn("_r", F.when(header, F.row_number().over(same)))
    return ranked.withColumns({"demoted": F.coalesce(F.col("_r") > 1, F.lit(False)), "file_type": F.when(F.coalesce(F.col("_r"), F.lit(1)) == 1, F.col("file_type"))}).drop("_r")


def _affinity(files: DataFrame, key: Column, name: str) -> DataFrame:
    keyed = files.withColumn(name, key).where(F.col(name).isNotNull())
    first = [F.min_by("url", F.struct("hex_value", "name")).alias("first_url")] if "url" in files.columns else []
    grouped = keyed.groupBy(CACHE, name).agg(F.count(F.lit(1)).alias("members"), F.min("hex_value").alias("first_hex"), F.max("hex_value").alias("last_hex"), F.sum("size").alias("bytes"), *first)
    return grouped.where("members > 1")


def affinity_by_etag(files: DataFrame) -> DataFrame:
    """Groups of files with one etag: members, bytes, the first and last position, and (with a column
    ``url``) the URL of the first."""
    return _affinity(files, F.col("etag"), "etag")


def affinity_by_range_total(files: DataFrame) -> DataFrame:
    """Groups of files whose Content-Range names one total."""
    return _affinity(files, content_range_total(F.col("content_range")), "range_total")


def affinity_files(files: DataFrame) -> DataFrame:
    """The files of the groups, a row each, as a common etag may have any number: ``cache_dir``, ``method`` (etag or
    content-range-total), ``key``, ``hex_value`` (their order) and ``name``."""
    known = with_affinity(files)
    one = lambda method, key, members: known.where(F.col(members).isNotNull()).select(CACHE, F.lit(method).alias("method"), key.alias("key"), "hex_value", "name")
    return one("etag", F.col("etag"), "etag_members").unionByName(one("content-range-total", F.concat(F.col("range_total").cast("string"), F.lit(" bytes")), "range_members"))


def with_affinity(files: DataFrame) -> DataFrame:
    """Adds ``range_total``, ``etag_members`` and ``range_members``. A common etag or total is summed before it is shuffled, and
    its files get the sum from a broadcast of the frequent ones; null keys are not gathered."""
    keyed = files.withColumn("range_total", content_range_total(F.col("content_range")))
    etags = affinity_by_etag(files).select(CACHE, "etag", F.col("members").alias("etag_members"))
    totals = affinity_by_range_total(files).select(CACHE, "range_total", F.col("members").alias("range_members"))
    return beside(beside(keyed, [CACHE, "etag"], etags, "etag_members"), [CACHE, "range_total"], totals, "range_members")


def affinity_gate(candidates: DataFrame) -> DataFrame:
    """``candidates`` (chunk columns, and those of its header with ``h_``) that pass the header's gate:
    its etag group, else its range-total group, else no restriction; adds ``method``."""
    by_etag, by_total = F.col("h_etag_members").isNotNull(), F.col("h_range_members").isNotNull()
    method = F.when(by_etag, "etag").when(by_total, "content-range").otherwise("hex-proximity")
    same = F.when(by_etag, F.col("etag") == F.col("h_etag")).when(by_total, F.col("range_total") == F.col("h_range_total")).otherwise(F.lit(True))
    return candidates.withColumn("method", method).where(F.coalesce(same, F.lit(False)))


def sequential_chunks(files: DataFrame) -> DataFrame:
    """Chunks of each media header: every file after it, up to the next header and within HEX_GAP,
    that may continue it. Returns ``cache_dir``, ``name``, ``hex_value``, ``header_file``,
    ``hex_distance``, ``method``. A file named twice counts twice.

    A cache is walked in buckets of positions. As a header reaches HEX_GAP positions at most, the last
    HEX_GAP positions' headers of a bucket are copied into the next one, and the windows of buckets
    see all that matters."""
    known = with_affinity(files)
    kind = F.col("file_type")
    suspect = (kind == "mp4_complete") & (F.col("size") == CHUNK_BYTES)
    header = F.coalesce(kind.isin(HEADER_TYPES) | suspect | (kind == "mp4_header_only"), F.lit(False))
    held = F.struct("hex_value", "name", "etag", "range_total", "etag_members", "range_members", "file_type")
    before = Window.partitionBy(CACHE, "_bucket").orderBy("hex_value", "name").rowsBetween(Window.unboundedPreceding, -1)
    bucket = F.floor(F.col("hex_value") / BUCKET)
    late = header & (F.floor((F.col("hex_value") + HEX_GAP) / BUCKET) > bucket)
    dealt = known.withColumn("_header", header).select("*", F.explode(F.when(late, F.array(bucket, bucket + 1)).otherwise(F.array(bucket))).alias("_bucket"))
    walked = dealt.withColumn("h", F.last(F.when(F.col("_header"), held), ignorenulls=True).over(before))
    own = walked.where(~F.col("_header") & F.col("h").isNotNull() & (F.col("h.file_type") != "mp4_header_only"))
    near = own.where((F.col("hex_value") - F.col("h.hex_value") <= HEX_GAP) & (kind.isNull() | kind.isin(CONTINUATION_TYPES)) & ~is_known_non_media(F.col("content_type")))
    flat = near.select("*", *(F.col(f"h.{c}").alias(f"h_{c}") for c in ("hex_value", "name", "etag", "range_total", "etag_members", "range_members")))
    gated = affinity_gate(flat)
    return gated.select(CACHE, "name", "hex_value", F.col("h_name").alias("header_file"), (F.col("hex_value") - F.col("h_hex_value")).alias("hex_distance"), "method")


def merge_resources_by_url(resources: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One resource for each URL of a cache: the first one that is sparse or has children, else the last. It gets the files
    of the others, its own first, then those of earlier rows from near to far, then those of later rows; a name
    is kept once. Its size is summed anew only if it was 0. Resources without a URL stay as they are.

    ``resources``: ``cache_dir``, ``ord``, ``index_url``, ``total_size``, ``authoritative``; ``files``: ``cache_dir``, ``ord``, ``place``
    (their order), ``name``, ``size``. Returns the resources, with ``merged_rows``, and their files, whose ``place`` is now
    (turn, distance, place). Both stay rows, so a URL may have any number of either.
    """
    urls = resources.where("index_url is not null").groupBy(CACHE, "index_url").agg(F.coalesce(F.min(F.when(F.col("authoritative"), F.col("ord"))), F.max("ord")).alias("keep"), F.count(F.lit(1)).alias("merged_rows"))
    known = beside(resources.select(CACHE, "ord", "index_url", "total_size"), [CACHE, "index_url"], urls, "merged_rows")
    known = known.withColumns({"keep": F.coalesce("keep", "ord"), "merged_rows": F.coalesce("merged_rows", F.lit(1))})
    turn = F.when(F.col("ord") == F.col("keep"), 0).when(F.col("ord") < F.col("keep"), 1).otherwise(2)
    far = F.abs(F.col("ord") - F.col("keep"))
    placed = files.join(known.select(CACHE, "ord", "keep", F.col("index_url").isNotNull().alias("_url"), turn.alias("turn"), far.alias("distance")), [CACHE, "ord"])
    placed = placed.select(CACHE, F.col("keep").alias("ord"), "_url", F.struct("turn", "distance", "place").alias("place"), "name", "size")
    first = F.min(F.struct("place", "size")).alias("_f")
    once = placed.where("_url").groupBy(CACHE, "ord", "name").agg(first).select(CACHE, "ord", "_f.place", "name", "_f.size")
    merged = once.unionByName(placed.where("not _url").drop("_url"))
    summed = merged.groupBy(CACHE, "ord").agg(F.sum("size").alias("_sum"))
    one = known.where("ord = keep").join(summed, [CACHE, "ord"], "left")
    total = F.when((F.col("total_size") == 0) & F.col("index_url").isNotNull(), F.coalesce("_sum", F.lit(0))).otherwise(F.col("total_size"))
    return one.select(CACHE, "index_url", "ord", total.alias("total_size"), "merged_rows"), merged


def dedupe_resources_by_url(resources: DataFrame) -> DataFrame:
    """``merge_resources_by_url`` for resources with an array ``files`` of (name, size), for files of which each resource's fit a row."""
    files = resources.select(CACHE, "ord", F.posexplode("files").alias("place", "f")).select(CACHE, "ord", "place", "f.name", "f.size")
    one, merged = merge_resources_by_url(resources, files)
    held = merged.groupBy(CACHE, "ord").agg(F.sort_array(F.collect_list(F.struct("place", "name", "size"))).alias("_f"))
    listed = F.transform("_f", lambda x: F.struct(x["name"].alias("name"), x["size"].alias("size")))
    out = one.join(held, [CACHE, "ord"], "left")
    return out.select(CACHE, "index_url", "ord", F.coalesce(listed, F.array().cast(resources.schema["files"].dataType)).alias("files"), "total_size", F.col("merged_rows").cast("int").alias("merged_rows"))


def unidentified_bucket(leftovers: DataFrame) -> DataFrame:
    """One resource a cache of all chunks that are left: count, bytes, latest time, name."""
    out = leftovers.groupBy(CACHE).agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("total_size"), F.max("modified_at_us").alias("modified_at_us"))
    return out.withColumn("display_name", F.concat(F.lit("Unidentified chunks ("), F.col("n_files").cast("string"), F.lit(")")))


def unidentified_files(leftovers: DataFrame) -> DataFrame:
    """The files of those resources, a row each, with the ``display_name`` of their resource."""
    return leftovers.join(unidentified_bucket(leftovers).select(CACHE, "display_name"), CACHE)


def number_resources(resources: DataFrame) -> DataFrame:
    """Running ``number`` within a cache, by phase and order; the unknown bucket has none. A cache may have any number."""
    unknown = resources.withColumn("_unknown", F.coalesce(F.col("resource_type") == "unknown_data", F.lit(False)))
    out = numbered(unknown, [CACHE, "_unknown"], ["phase", "ord"], "number")
    return out.withColumn("number", F.when(~F.col("_unknown"), F.col("number"))).drop("_unknown")


def chunk_gaps(chunks: DataFrame) -> DataFrame:
    """Missing chunks before each chunk of a group (``header_hex``): ``gap``, from the previous chunk's
    position (the header's for the first), less one if the tail's lies between; with ``modal_size``, also
    ``zero_bytes``, what stands for them."""
    order = Window.partitionBy(CACHE, "header_hex").orderBy("hex_value")
    previous = F.coalesce(F.lag("hex_value").over(order), F.col("header_hex"))
    between = F.coalesce((F.col("tail_hex") > previous) & (F.col("tail_hex") < F.col("hex_value")), F.lit(False))
    out = chunks.withColumn("gap", F.greatest(F.col("hex_value") - previous - 1 - between.cast("int"), F.lit(0)))
    return out.withColumn("zero_bytes", F.col("gap") * F.col("modal_size")) if "modal_size" in chunks.columns else out


def _mp4_reach(files: DataFrame) -> DataFrame:
    """Adds ``max_chunks`` and ``reach`` (how far in position its chunks may lie) of MP4 headers."""
    length, begin, declared = F.col("size"), F.col("mdat_offset"), F.col("mdat_size")
    to_end = begin + declared >= length
    need = F.when(to_end, declared - (length - begin)).otherwise(declared + length)
    most = F.ceil(need / CHUNK_BYTES) + 5
    header = (F.col("file_type") == "mp4_header_only") & declared.isNotNull()
    return files.withColumns({"max_chunks": F.when(header, most), "reach": F.when(header, F.when(to_end, most + 10).otherwise(most * 2))})


def _claims(batches):
    """Greedy claims, island by island: headers in order, each takes the first free chunks it may. Batches are
    sorted by cache, island and position."""
    held = []
    names = ["cache_dir", "name", "hex_value", "header_file", "hex_distance", "method"]
    kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())

    def told(table: pa.Table) -> pa.RecordBatch:
        column = {c: table.column(c).to_pylist() for c in ("cache_dir", "island", "is_header", "name", "etag", "range_total", "etag_members", "range_members", "max_chunks", "reach")}
        place = table.column("hex_value").to_numpy()
        if not table.num_rows:
            return pa.RecordBatch.from_arrays([pa.array([], t) for t in kinds], names)
        ends = [i for i in range(1, table.num_rows) if column["island"][i] != column["island"][i - 1] or column["cache_dir"][i] != column["cache_dir"][i - 1]]
        out = []
        for a, b in zip([0, *ends], [*ends, table.num_rows], strict=True):
            chunks = [i for i in range(a, b) if not column["is_header"][i]]
            position, free = place[chunks], [True] * len(chunks)
            for h in (i for i in range(a, b) if column["is_header"][i]):
                first, last = np.searchsorted(position, [place[h] + 1, place[h] + column["reach"][h] + 1]).tolist()
                key, method = ("etag", "etag") if column["etag_members"][h] is not None else ("range_total", "content-range") if column["range_members"][h] is not None else (None, "hex-proximity")
                left = column["max_chunks"][h]
                for n in range(first, last):
                    if not left:
                        break
                    if free[n] and (key is None or column[key][chunks[n]] == column[key][h]):
                        free[n], left, i = False, left - 1, chunks[n]
                        out.append((column["cache_dir"][i], column["name"][i], int(place[i]), column["name"][h], int(place[i] - place[h]), method))
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(kinds)], names)

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        # only the new rows are looked at, so a long island costs no more than its length
        keys = list(zip(batch.column("cache_dir").to_pylist(), batch.column("island").to_pylist(), strict=True))
        cut = next((i for i in range(len(keys) - 1, 0, -1) if keys[i] != keys[i - 1]), 0)
        if held and (cut or keys[0] != last):
            yield told(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        elif cut:
            yield told(pa.Table.from_batches([batch.slice(0, cut)]))
        held.append(batch.slice(cut))
        last = keys[-1]
    if held:
        yield told(pa.Table.from_batches(held))


def _running_max(rows: DataFrame, value: Column, name: str, own_too: bool) -> DataFrame:
    """Adds the largest ``value`` of a cache up to each row, by position and name (the row's own counts if
    ``own_too``): a window a bucket, and the maxima of the buckets before, of which a cache has few."""
    order = Window.partitionBy(CACHE, "_bucket").orderBy("hex_value", "name")
    rows = rows.withColumn("_bucket", F.floor(F.col("hex_value") / BUCKET)).withColumn("_v", value)
    tops = rows.groupBy(CACHE, "_bucket").agg(F.max("_v").alias("_top"))
    tops = tops.withColumn("_before", F.max("_top").over(Window.partitionBy(CACHE).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))).drop("_top")
    inside = F.max("_v").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow if own_too else -1))
    return rows.withColumn("_in", inside).join(tops, [CACHE, "_bucket"]).withColumn(name, F.greatest("_in", "_before")).drop("_in", "_before", "_v", "_bucket")


def mp4_header_chunks(files: DataFrame) -> DataFrame:
    """Chunks that MP4 headers claim, in header order: an earlier header keeps a chunk that a later
    one could use too. A chunk lies behind its header by ``reach`` at most, may continue an MP4, is no
    known non-media file and passes the header's affinity gate; a header takes ``max_chunks``.

    Claims depend on each other only where the reaches of headers overlap, so each cache is split
    into islands of overlapping reaches, named by where they begin, and the order-dependent fold runs
    once an island. Headers without chunks, or without ``mdat_size``, give no rows.
    """
    known = _mp4_reach(with_affinity(files))
    kind = F.col("file_type")
    header = F.col("reach").isNotNull()
    eligible = (kind.isNull() | kind.isin("mp4_fragment", "media_data_chunk")) & ~is_known_non_media(F.col("content_type"))
    marked = known.where(header | eligible).withColumn("is_header", header)
    marked = _running_max(marked, F.when(F.col("is_header"), F.col("hex_value") + F.col("reach")), "_end", own_too=False)
    outside = F.col("_end").isNull() | (F.col("hex_value") > F.col("_end"))
    begun = _running_max(marked, F.when(F.col("is_header") & outside, F.col("hex_value")), "island", own_too=True)
    islands = begun.where(F.col("is_header") | ~outside)
    columns = [CACHE, "island", "is_header", "name", "hex_value", "etag", "range_total", "etag_members", "range_members", "max_chunks", "reach"]
    schema = "cache_dir string, name string, hex_value bigint, header_file string, hex_distance bigint, method string"
    return islands.select(*columns).repartition(CACHE, "island").sortWithinPartitions(CACHE, "island", "hex_value", "name").mapInArrow(_claims, schema)


def grouped_chunks(files: DataFrame) -> DataFrame:
    """The whole walk: claims of MP4 headers, and sequential chunks of the other headers without those
    an MP4 header before them has taken."""
    claimed = mp4_header_chunks(files)
    return claimed.unionByName(sequential_chunks(files).join(claimed.select(CACHE, "name"), [CACHE, "name"], "left_anti"))


def attach_index_metadata(resources: DataFrame, entry_of_file: DataFrame) -> DataFrame:
    """Index columns of each resource without any: those of the first file that the index knows, the
    header file first, then the files in order. Needs ``ord``, ``header_file``, ``file_names``.

    ``entry_of_file``: ``cache_dir``, ``name``, ``url`` and any other facts of the entry (content type, status,
    times, headers ...); fact ``x`` becomes ``index_x``, and is null where nothing was attached and the resource
    has no such column. With ``display_name``, a name that is missing or only a running number (``Video 3``) gives
    way to the entry's ``original_filename``, else to the last part of its URL of at most 100 characters.
    """
    facts = [c for c in entry_of_file.columns if c not in (CACHE, "name")]
    bare = resources.where("index_url is null").select(CACHE, "ord", F.posexplode(F.concat(F.array("header_file"), "file_names")).alias("pos", "name"))
    hit = bare.join(entry_of_file, [CACHE, "name"]).groupBy(CACHE, "ord").agg(F.min_by(F.struct(*facts), "pos").alias("_e"))
    out = resources.join(hit, [CACHE, "ord"], "left")
    if "display_name" in resources.columns:
        base = url_basename(strip_cache_key_prefix(F.col("_e.url")))
        found = F.when((base != "") & (F.length(base) <= 100), base)
        if "original_filename" in facts:
            found = F.coalesce(F.nullif(F.col("_e.original_filename"), F.lit("")), found)
        weak = F.coalesce(F.col("display_name"), F.lit("")).rlike("^$|^Video |^Audio ")
        out = out.withColumn("display_name", F.when(weak, F.coalesce(found, "display_name")).otherwise(F.col("display_name")))
    known = lambda c: [F.col(f"index_{c}")] if f"index_{c}" in resources.columns else []
    return out.withColumns({f"index_{c}": F.coalesce(*known(c), F.col(f"_e.{c}")) for c in facts}).drop("_e")


def chunk_associations(resources: DataFrame) -> DataFrame:
    """One row a file of each resource: its position, and its distance from the header's; ``method``, and ``etag`` and
    ``range_total`` of the group that gated it, if the resources have these columns."""
    gate = [c for c in ("etag", "range_total") if c in resources.columns]
    each = resources.select(CACHE, "ord", "header_file", "method", *gate, F.posexplode("file_names").alias("pos", "name"))
    place = lambda c: F.when(F.col(c).rlike("^f_[0-9a-fA-F]{6}$"), F.conv(F.substring(c, 3, 6), 16, 10).cast("bigint"))
    return each.withColumns({"hex_value": F.coalesce(place("name"), F.lit(0).cast("bigint")), "hex_distance": place("name") - place("header_file")})


def scan_stats(files: DataFrame, resources: DataFrame, entries: DataFrame | None = None, index_claimed: DataFrame | None = None, heuristic_grouped: DataFrame | None = None, unclaimed: DataFrame | None = None) -> DataFrame:
    """Per cache: all files, blockfile files and Simple entries (distinct hashes); resources, and those with
    metadata; and the rows of the other frames (``cache_dir``), each 0 if not given: ``index_entries``,
    ``index_claimed``, ``heuristic_grouped``, ``unclaimed``."""
    layouts = files.groupBy(CACHE).agg(F.count(F.lit(1)).alias("total_files"), F.count_if(F.col("name").startswith("f_")).alias("blockfile_files"), F.count_distinct(F.when(F.col("name").rlike("^[0-9a-fA-F]{16}_"), F.lower(F.substring("name", 1, 16)))).alias("simple_files"))
    made = resources.groupBy(CACHE).agg(F.count(F.lit(1)).alias("resources"), F.count_if(F.col("index_url").isNotNull() | F.col("index_content_type").isNotNull()).alias("with_metadata"))
    out = layouts.join(made, CACHE, "left")
    counters = {"index_entries": entries, "index_claimed": index_claimed, "heuristic_grouped": heuristic_grouped, "unclaimed": unclaimed}
    for name, rows in counters.items():
        out = out.withColumn(name, F.lit(0).cast("bigint")) if rows is None else out.join(rows.groupBy(CACHE).agg(F.count(F.lit(1)).alias(name)), CACHE, "left")
    return out.na.fill(0, ["resources", "with_metadata", *counters])


def resource_modified_at(resources: DataFrame) -> DataFrame:
    """Adds ``modified_at``: the entry's creation time, else the latest file time, else 0."""
    return resources.withColumn("modified_at", F.coalesce("creation_time_us", F.array_max("file_times"), F.lit(0)))
