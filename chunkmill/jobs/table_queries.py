"""Queries of the table operators, over the fixtures, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.media import CATEGORIES, EXTENSIONS, media_category
from ..operators import group, layout, link, report, spread
from .column_queries import _sql_map
from .fixtures import ORACLE, fixture
from .recoverable import recoverable_downloads
from ..sources.resources import export_audit_json, load_resources, shared_folder, write_resources

QUERIES, SQL = {}, {}


def query(fixtures: str, sql: str | None):
    """Register a function of the named fixture frames with the SQL over views of the same names."""
    wanted = fixtures.split()

    def wrap(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*(fixture(spark, sf_dir, n) for n in wanted))
        if sql:
            SQL[f.__name__] = "WITH " + ", ".join(f"{n} AS ({ORACLE[n]})" for n in wanted) + sql
        return f

    return wrap


_KIDS = """, kids AS (SELECT cache_dir, regexp_extract(child_key, '^Range_(.*):[0-9a-f]{16}:[0-9a-f]+$', 1) AS url, CAST('0x' || regexp_extract(child_key, ':([0-9a-f]+)$', 1) AS BIGINT) AS child_id, size, file_name, is_external FROM fx_children),
sparse AS (SELECT DISTINCT cache_dir, url FROM fx_entries WHERE is_sparse)"""


@query("fx_entries fx_children", _KIDS + """ SELECT s.cache_dir, s.url, count(k.url) AS n_children, CAST(CASE WHEN max(e.body_size) > 0 THEN max(e.body_size) ELSE coalesce(sum(k.size), 0) END AS BIGINT) AS body_size, coalesce(max(k.child_id) * 1048576, -1) AS last_offset FROM sparse s JOIN fx_entries e USING (cache_dir, url) LEFT JOIN kids k ON k.cache_dir = s.cache_dir AND k.url = s.url GROUP BY ALL""")
def j1_link_sparse_children(entries, children):
    out = link.linked_parents(entries, children)
    return out.select("cache_dir", "url", "n_children", "body_size", F.coalesce("last_offset", F.lit(-1)).alias("last_offset"))


@query("fx_entries fx_children", _KIDS + """ SELECT cache_dir, substr(url, 1, 200) AS parent_url, count(*) AS n_children FROM kids ANTI JOIN sparse USING (cache_dir, url) GROUP BY ALL""")
def j2_orphan_children(entries, children):
    return link.orphan_children(entries, children)


@query("fx_entries fx_children", _KIDS + """ SELECT cache_dir, url FROM sparse ANTI JOIN kids USING (cache_dir, url)""")
def j3_unmatched_parents(entries, children):
    return link.unmatched_parents(entries, children)


@query("fx_entries fx_children fx_files", _KIDS + """ SELECT k.cache_dir, k.url, count(*) AS n_files, CAST(sum(f.size) AS BIGINT) AS bytes FROM kids k JOIN sparse USING (cache_dir, url) JOIN fx_files f ON f.cache_dir = k.cache_dir AND f.name = k.file_name WHERE k.is_external GROUP BY ALL""")
def j4_match_entry_files(entries, children, files):
    out = link.entry_files(link.child_rows(entries, children), files)
    return out.groupBy("cache_dir", "url").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("bytes"))


@query("fx_entries fx_children", _KIDS + """ SELECT k.cache_dir, file_name AS name, arg_max(k.url, e.ord) AS url FROM kids k JOIN fx_entries e ON e.cache_dir = k.cache_dir AND e.url = k.url WHERE e.is_sparse AND is_external GROUP BY ALL""")
def j5_file_entry_map(entries, children):
    return link.file_entry_map(link.child_rows(entries, children))


@query("fx_entries fx_children fx_files", _KIDS + """ SELECT cache_dir, name, size FROM fx_files f WHERE file_type IS DISTINCT FROM 'jpeg' AND NOT EXISTS (SELECT 1 FROM kids k JOIN sparse USING (cache_dir, url) WHERE is_external AND k.cache_dir = f.cache_dir AND k.file_name = f.name)""")
def j6_unclaimed_files(entries, children, files):
    made = files.where("file_type = 'jpeg'")
    return link.unclaimed_files(files, link.child_rows(entries, children), made).select("cache_dir", "name", "size")


# two streams an entry: headers (0) and body (1), the body in the file that comes before the children's
_STREAMS = """, numbered AS (SELECT cache_dir, url, is_sparse, CAST(regexp_extract(url, '([0-9]+)[.]mp4$', 1) AS BIGINT) AS ord FROM fx_entries),
streams AS (SELECT cache_dir, url, is_sparse, ord, ord % 7 AS body_size, 1 AS stream_index, 'f_' || lpad(lower(to_hex(ord * 8)), 6, '0') AS file_name, ord % 3 <> 0 AS is_external FROM numbered
UNION ALL SELECT cache_dir, url, is_sparse, ord, ord % 7, 0, 'f_' || lpad(lower(to_hex(ord * 4)), 6, '0'), ord % 5 = 0 FROM numbered)"""


def _entry_streams(entries):
    """Entries with ``ord``, and a row for each of their streams."""
    entries = entries.withColumn("ord", F.regexp_extract("url", "([0-9]+)[.]mp4$", 1).cast("bigint"))
    n = F.col("ord")
    both = [F.struct(F.lit(i).alias("stream_index"), F.concat(F.lit("/c/d/f_"), F.lpad(F.lower(F.hex(n * by)), 6, "0")).alias("file_name"), external.alias("is_external")) for i, by, external in ((1, 8, n % 3 != 0), (0, 4, n % 5 == 0))]
    return entries, entries.select("cache_dir", "url", "ord", "is_sparse", (n % 7).alias("body_size"), F.inline(F.array(*both)))


@query("fx_entries fx_children fx_files", _KIDS + _STREAMS + """, refs AS (SELECT k.cache_dir, k.url, k.file_name FROM kids k JOIN sparse USING (cache_dir, url) WHERE k.is_external
UNION ALL SELECT cache_dir, url, file_name FROM streams s WHERE stream_index = 1 AND is_external AND NOT (is_sparse AND EXISTS (SELECT 1 FROM kids k WHERE k.cache_dir = s.cache_dir AND k.url = s.url)))
SELECT r.cache_dir, r.url, count(*) AS n_files, CAST(sum(f.size) AS BIGINT) AS bytes FROM refs r JOIN fx_files f ON f.cache_dir = r.cache_dir AND f.name = r.file_name GROUP BY ALL""")
def j4_match_stream_files(entries, children, files):
    entries, streams = _entry_streams(entries)
    out = link.entry_files(link.child_rows(entries, children), files, streams)
    return out.groupBy("cache_dir", "url").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("bytes"))


@query("fx_entries fx_children", _KIDS + _STREAMS + """, refs AS (SELECT k.cache_dir, k.url, n.ord, k.file_name AS name FROM kids k JOIN numbered n USING (cache_dir, url) WHERE k.is_external AND n.is_sparse
UNION ALL SELECT cache_dir, url, ord, file_name FROM streams WHERE is_external AND (is_sparse OR body_size > 0)) SELECT cache_dir, name, arg_max(url, ord) AS url FROM refs GROUP BY ALL""")
def j5_stream_entry_map(entries, children):
    entries, streams = _entry_streams(entries)
    return link.file_entry_map(link.child_rows(entries, children), streams)


@query("fx_entries fx_children fx_files", _KIDS + _STREAMS + """ SELECT cache_dir, name, size FROM fx_files f WHERE file_type IS DISTINCT FROM 'jpeg' AND NOT EXISTS (SELECT 1 FROM kids k JOIN sparse USING (cache_dir, url) WHERE is_external AND k.cache_dir = f.cache_dir AND k.file_name = f.name)
AND NOT EXISTS (SELECT 1 FROM streams s WHERE is_sparse AND is_external AND s.cache_dir = f.cache_dir AND s.file_name = f.name)""")
def j6_unclaimed_stream_files(entries, children, files):
    entries, streams = _entry_streams(entries)
    made = files.where("file_type = 'jpeg'")
    return link.unclaimed_files(files, link.child_rows(entries, children), made, streams).select("cache_dir", "name", "size")


_HEADER = f"(coalesce(file_type IN ({', '.join(repr(t) for t in group.HEADER_TYPES)}), false) OR coalesce(file_type = 'mp4_complete' AND size = 1048576, false) OR coalesce(file_type = 'mp4_header_only', false))"
_AFFINITY = """, t AS (SELECT *, CASE WHEN TRY_CAST(regexp_extract(content_range, '/([0-9]+)$', 1) AS BIGINT) > 0 THEN CAST(regexp_extract(content_range, '/([0-9]+)$', 1) AS BIGINT) END AS range_total FROM fx_files),
a AS (SELECT *, CASE WHEN etag IS NOT NULL THEN count(*) OVER (PARTITION BY cache_dir, etag) END AS em, CASE WHEN range_total IS NOT NULL THEN count(*) OVER (PARTITION BY cache_dir, range_total) END AS rm FROM t)"""


@query(
    "fx_files",
    _AFFINITY
    + f""", w AS (SELECT *, {_HEADER} AS is_header, last_value(CASE WHEN {_HEADER} THEN {{'x': hex_value, 'n': name, 'e': etag, 'r': range_total, 'em': em, 'rm': rm, 't': file_type}} END IGNORE NULLS)
        OVER (PARTITION BY cache_dir ORDER BY hex_value, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM a)
    SELECT cache_dir, name, hex_value, h.n AS header_file, hex_value - h.x AS hex_distance, CASE WHEN h.em > 1 THEN 'etag' WHEN h.rm > 1 THEN 'content-range' ELSE 'hex-proximity' END AS method
    FROM w WHERE NOT is_header AND h IS NOT NULL AND h.t <> 'mp4_header_only' AND hex_value - h.x <= 50 AND (file_type IS NULL OR file_type IN ('mp4_fragment', 'webm_continuation', 'media_data_chunk'))
    AND NOT coalesce(regexp_matches(trim(split_part(lower(content_type), ';', 1)), '^(font/|text/|application/javascript|application/json|application/xml|application/wasm|application/x-font|application/font|application/octet-stream)'), false)
    AND coalesce(CASE WHEN h.em > 1 THEN etag = h.e WHEN h.rm > 1 THEN range_total = h.r ELSE true END, false)""",
)
def j8_sequential_chunks(files):
    return group.sequential_chunks(files)


@query("fx_files", _AFFINITY + """ SELECT cache_dir, name, etag, range_total, CASE WHEN em > 1 THEN em END AS etag_members, CASE WHEN rm > 1 THEN rm END AS range_members FROM a""")
def j9_with_affinity(files):
    return group.with_affinity(files).select("cache_dir", "name", "etag", "range_total", "etag_members", "range_members")


@query("fx_files", """, d AS (SELECT name, size + CASE WHEN hex_value % 5 = 0 THEN 1 ELSE 0 END AS s, modified_at_us AS m FROM fx_files WHERE hex_value % 3 <> 0) SELECT f.name AS path, f.size, f.modified_at_us, CASE WHEN d.name IS NULL THEN 'new' ELSE 'changed' END AS reason FROM fx_files f LEFT JOIN d USING (name) WHERE d.name IS NULL OR d.s <> f.size OR d.m <> f.modified_at_us""")
def j11_new_or_changed(files):
    own = files.select(F.col("name").alias("path"), "size", "modified_at_us", "hex_value")
    done = own.where("hex_value % 3 <> 0").select("path", (F.col("size") + F.when(F.col("hex_value") % 5 == 0, 1).otherwise(0)).alias("size"), "modified_at_us")
    return report.new_or_changed(own.drop("hex_value"), done)


@query("fx_files", """, a AS (SELECT DISTINCT name AS path FROM fx_files WHERE hex_value % 2 = 0), c AS (SELECT DISTINCT name AS path FROM fx_files WHERE hex_value % 3 = 0) SELECT path, 'auto' AS origin FROM a UNION ALL SELECT path, 'custom' AS origin FROM c ANTI JOIN a USING (path)""")
def j12_merge_path_lists(files):
    return link.merge_path_lists(files.where("hex_value % 2 = 0").select(F.col("name").alias("path")), files.where("hex_value % 3 = 0").select(F.col("name").alias("path")))


@query("fx_files", """ SELECT 'Custom' AS client, cache_dir, count(*) AS file_count, CAST(sum(size) AS BIGINT) AS total_size FROM fx_files GROUP BY cache_dir""")
def a1_cache_inventory(files):
    return report.cache_inventory(files)


_SIMPLE = """, s AS (SELECT cache_dir, lpad(lower(to_hex(hex_value // 3)), 16, '0') AS hash, ['0', '1', 's'][hex_value % 3 + 1] AS stream, size FROM fx_files WHERE hex_value % 7 <> 0)"""


@query("fx_files", _SIMPLE + """ SELECT cache_dir, hash, max(size) FILTER (stream = '0') AS body_size, max(size) FILTER (stream = '1') AS side_size, max(size) FILTER (stream = 's') AS sparse_size FROM s GROUP BY ALL HAVING body_size IS NOT NULL OR sparse_size IS NOT NULL""")
def a2_pair_simple_streams(files):
    hash_ = F.lpad(F.lower(F.hex(F.floor(F.col("hex_value") / 3))), 16, "0")
    stream = F.element_at(F.array(F.lit("0"), F.lit("1"), F.lit("s")), (F.col("hex_value") % 3 + 1).cast("int"))
    return report.pair_simple_streams(files.where("hex_value % 7 <> 0").select("cache_dir", hash_.alias("hash"), stream.alias("stream"), "size"))


@query("fx_files", """, s AS (SELECT cache_dir, CASE WHEN hex_value % 11 <> 0 THEN lpad(lower(to_hex(hex_value // 3)), 16, '0') END AS hash, CASE WHEN hex_value % 7 = 0 THEN '1' ELSE ['0', '1', 's'][hex_value % 3 + 1] END AS stream, size FROM fx_files)
SELECT cache_dir, hash, max(size) FILTER (stream = '0') AS body_size, max(size) FILTER (stream = '1') AS side_size, max(size) FILTER (stream = 's') AS sparse_size FROM s WHERE hash IS NOT NULL GROUP BY ALL HAVING body_size IS NOT NULL OR sparse_size IS NOT NULL""")
def a2_pair_simple_streams_all(files):
    n = F.col("hex_value")
    hash_ = F.when(n % 11 != 0, F.lpad(F.lower(F.hex(F.floor(n / 3))), 16, "0"))
    stream = F.when(n % 7 == 0, "1").otherwise(F.element_at(F.array(F.lit("0"), F.lit("1"), F.lit("s")), (n % 3 + 1).cast("int")))
    return report.pair_simple_streams(files.select("cache_dir", hash_.alias("hash"), stream.alias("stream"), "size"))


@query("fx_files", _AFFINITY + """ SELECT cache_dir, 'etag' AS method, etag AS key, hex_value, name FROM a WHERE em > 1 UNION ALL SELECT cache_dir, 'content-range-total', CAST(range_total AS VARCHAR) || ' bytes', hex_value, name FROM a WHERE rm > 1""")
def a3_affinity_files(files):
    return group.affinity_files(files)


@query("fx_files", """ SELECT cache_dir, etag, count(*) AS members, min(hex_value) AS first_hex, max(hex_value) AS last_hex, CAST(sum(size) AS BIGINT) AS bytes, arg_min('u' || name, hex_value) AS first_url FROM fx_files WHERE etag IS NOT NULL GROUP BY ALL HAVING count(*) > 1""")
def a3_affinity_by_etag(files):
    return group.affinity_by_etag(files.withColumn("url", F.concat(F.lit("u"), F.col("name"))))


@query("fx_files", _AFFINITY + """ SELECT cache_dir, range_total, count(*) AS members, min(hex_value) AS first_hex, max(hex_value) AS last_hex, CAST(sum(size) AS BIGINT) AS bytes FROM a WHERE range_total IS NOT NULL GROUP BY ALL HAVING count(*) > 1""")
def a4_affinity_by_range_total(files):
    return group.affinity_by_range_total(files)


@query(
    "fx_entries fx_children",
    _KIDS
    + """, c AS (SELECT cache_dir, url, count(*) AS n FROM kids GROUP BY ALL), m AS (SELECT coalesce(c.cache_dir, s.cache_dir) AS cache_dir, c.n, c.url AS cu, s.url AS su FROM c FULL JOIN sparse s ON c.cache_dir = s.cache_dir AND c.url = s.url)
    SELECT cache_dir, CAST(coalesce(sum(n) FILTER (su IS NOT NULL AND cu IS NOT NULL), 0) AS BIGINT) AS children_linked, count(*) FILTER (su IS NULL) AS orphan_groups, CAST(coalesce(sum(n) FILTER (su IS NULL), 0) AS BIGINT) AS orphan_children, count(*) FILTER (cu IS NULL) AS unmatched_parents FROM m GROUP BY cache_dir""",
)
def a5_link_stats(entries, children):
    return link.link_stats(entries, children)


_ENTRY = """, e AS (SELECT cache_dir, name AS url, hex_value % 2 = 0 AS is_sparse, hex_value % 4 AS n_children, hex_value % 3 AS n_files, CASE WHEN hex_value % 5 = 0 THEN 0 ELSE size END AS body_size, content_type,
CASE WHEN hex_value % 9 < 4 THEN file_type END AS magic_type FROM fx_files)"""
_MIME = "trim(split_part(lower(content_type), ';', 1))"
_KIND = f"coalesce(CASE {_MIME} WHEN 'video/mp4' THEN 'mp4_complete' WHEN 'image/png' THEN 'png' END, magic_type, CASE WHEN is_sparse AND n_children > 0 THEN 'mp4_complete' END)"


def _entries(files):
    n = F.col("hex_value")
    return files.select("cache_dir", F.col("name").alias("url"), (n % 2 == 0).alias("is_sparse"), (n % 4).alias("n_children"), (n % 3).alias("n_files"), F.when(n % 5 == 0, F.lit(0)).otherwise(F.col("size")).alias("body_size"), "content_type", F.when(n % 9 < 4, F.col("file_type")).alias("magic_type"))


@query("fx_files", _ENTRY + f" SELECT url, {_KIND} AS file_type, CASE WHEN is_sparse AND n_children > 1 AND {_KIND} IN ('mp4_complete', 'mp4_header_only', 'mp4_chunked') THEN 'mp4_chunked' ELSE {_KIND} END AS resource_type FROM e")
def p7_resolve_entry_type(files):
    return link.resolve_entry_type(_entries(files)).select("url", "file_type", "resource_type")


_SKIP = f"CASE WHEN body_size = 0 AND NOT is_sparse THEN 'empty-body' WHEN n_files = 0 AND NOT (is_sparse AND n_children > 0) THEN 'no-files' WHEN {_KIND} IS NULL THEN 'no-file-type' END"


@query("fx_files", _ENTRY + f" SELECT url, {_SKIP} AS skip_reason FROM e")
def p10_classify_entries(files):
    return link.classify_entries(link.resolve_entry_type(_entries(files))).select("url", "skip_reason")


@query("fx_files", _ENTRY + f" SELECT cache_dir, {_SKIP} AS skip_reason, count(*) AS n FROM e GROUP BY ALL")
def a7_skip_summary(files):
    return link.skip_summary(link.classify_entries(link.resolve_entry_type(_entries(files))))


_CAT = _sql_map({t: c for c, ts in CATEGORIES.items() for t in ts}, "file_type", "'other'")
_RES = f""", r AS (SELECT cache_dir, hex_value AS ord, coalesce(file_type, 'unknown_data') AS resource_type, {_CAT} AS media_category, 'Clip ' || CAST(hex_value % 50 AS VARCHAR) || '.x' AS display_name, size AS total_size,
CASE WHEN hex_value % 4 <> 0 THEN modified_at_us END AS modified_at_us, hex_value % 3 AS n_files, hex_value % 2 = 0 AS index_is_sparse, hex_value % 6 AS n_children, etag AS index_url, content_type AS index_content_type, CASE WHEN hex_value % 8 = 0 THEN 'attachment' END AS cdn_kind, CASE WHEN hex_value % 10 = 0 THEN 'bad' END AS error FROM fx_files)"""


def _resources(files):
    n = F.col("hex_value")
    return files.select(
        "cache_dir", n.alias("ord"), F.coalesce("file_type", F.lit("unknown_data")).alias("resource_type"), media_category(F.col("file_type")).alias("media_category"), F.concat(F.lit("Clip "), (n % 50).cast("string"), F.lit(".x")).alias("display_name"),
        F.col("size").alias("total_size"), F.when(n % 4 != 0, F.col("modified_at_us")).alias("modified_at_us"), (n % 3).alias("n_files"), (n % 2 == 0).alias("index_is_sparse"), (n % 6).alias("n_children"), F.col("etag").alias("index_url"),
        F.col("content_type").alias("index_content_type"), F.when(n % 8 == 0, "attachment").alias("cdn_kind"), F.when(n % 10 == 0, "bad").alias("error"),
    )


@query("fx_files", _RES + " SELECT ord, display_name FROM r WHERE media_category = 'video' AND contains(lower(display_name), 'clip 1')")
def p12_filter_resources(files):
    return report.filter_resources(_resources(files), "videos", "CLIP 1").select("ord", "display_name")


@query("fx_files", _RES + " SELECT ord, media_category = 'audio' AS selected FROM r")
def p13_select_resources(files):
    return report.select_resources(report.select_resources(_resources(files), "all"), "audio").select("ord", "selected")


@query("fx_files", _RES + ", s AS (SELECT * FROM r WHERE media_category <> 'other') SELECT media_category, count(*) AS n, CAST(sum(total_size) AS BIGINT) AS bytes FROM s GROUP BY ROLLUP (media_category)")
def a8_resource_summary(files):
    return report.resource_summary(_resources(files).withColumn("selected", F.col("media_category") != "other"))


@query("fx_files", _RES + " SELECT cache_dir, count(*) FILTER (index_url IS NOT NULL OR index_content_type IS NOT NULL) AS with_metadata, count(*) FILTER (cdn_kind IS NOT NULL) AS with_cdn FROM r GROUP BY cache_dir")
def a9_metadata_coverage(files):
    return report.metadata_coverage(_resources(files))


@query("fx_files", _RES + " SELECT cache_dir, ord, coalesce(modified_at_us, 0) AS shown_at FROM r ORDER BY shown_at DESC, ord")
def o1_sort_resources(files):
    return report.sort_resources(_resources(files)).select("cache_dir", "ord", F.coalesce("modified_at_us", F.lit(0)).alias("shown_at"))


@query("fx_files", _RES + " SELECT cache_dir, ord, row_number() OVER (PARTITION BY cache_dir ORDER BY coalesce(modified_at_us, 0), ord) AS place FROM r WHERE media_category = 'video' AND error IS NULL")
def o2_concat_playlist(files):
    return report.concat_playlist(_resources(files)).select("cache_dir", "ord", F.col("place").cast("bigint").alias("place"))


@query("fx_files", _RES + " SELECT cache_dir, ord FROM r")
def u0_scan_union(files):
    res = _resources(files)
    return report.scan_union([res.where("ord % 3 = 0"), res.where("ord % 3 = 1"), res.where("ord % 3 = 2")]).select("cache_dir", "ord")


_ACTION = "CASE WHEN resource_type = 'unknown_data' THEN 'none' WHEN resource_type = 'mp4_complete' AND n_children > 1 AND index_is_sparse THEN 'index_reassemble' WHEN resource_type = 'mp4_complete' AND n_children > 1 THEN 'chunk_reassemble' WHEN resource_type = 'webm_mkv' AND n_files > 1 THEN 'concat' WHEN n_children = 0 THEN 'sparse_copy' ELSE 'copy' END"
_EXT = _sql_map(EXTENSIONS, "resource_type", "'.bin'")


@query(
    "fx_files",
    _RES
    + f""", p AS (SELECT cache_dir, ord, {_ACTION} AS action, media_category || 's' AS subfolder, regexp_replace(display_name, '[^a-zA-Z0-9_-]', '_', 'g') AS safe_name, {_EXT} AS extension, CASE WHEN resource_type = 'webm_mkv' THEN 'mp4' END AS convert_to FROM r),
    q AS (SELECT *, subfolder || '/' || safe_name || extension AS out_path FROM p) SELECT *, count(*) OVER (PARTITION BY cache_dir, out_path) > 1 AS collides FROM q""",
)
def p15_recovery_plan(files):
    chunked = (F.col("resource_type") == "mp4_complete") & (F.col("n_children") > 1)
    res = _resources(files).withColumns({"resource_type": F.when(chunked, "mp4_chunked").otherwise(F.col("resource_type")), "sparse_stream": F.col("n_children") == 0})
    return report.recovery_plan(res, convert_webm=True).select("cache_dir", "ord", "action", "subfolder", "safe_name", "extension", "convert_to", "out_path", "collides")


@query("fx_files", _RES + f""" SELECT cache_dir, ord, CASE WHEN resource_type = 'unknown_data' THEN 'none' WHEN resource_type IN ({', '.join(repr(t) for t in group.HEADER_TYPES)}) AND n_files > 1 THEN 'concat' ELSE 'copy' END AS action FROM r""")
def p15_recovery_plan_of_groups(files):
    return report.recovery_plan(_resources(files).withColumn("sparse_stream", F.lit(False)), concat_groups=True).select("cache_dir", "ord", "action")


@query(
    "fx_files",
    _RES
    + """, n AS (SELECT *, CASE WHEN resource_type <> 'unknown_data' THEN row_number() OVER (PARTITION BY cache_dir, resource_type = 'unknown_data' ORDER BY n_children, ord) END AS number FROM r),
    l AS (SELECT *, CASE media_category WHEN 'image' THEN 'Image' WHEN 'video' THEN 'Video' WHEN 'audio' THEN 'Audio' ELSE 'File' END || ' ' || CAST(coalesce(number, 0) AS VARCHAR) AS label FROM n)
    SELECT cache_dir, ord, CASE WHEN ord % 3 = 0 THEN display_name WHEN ord % 3 = 1 THEN 'u' || CAST(ord AS VARCHAR) WHEN n_files > 1 OR (index_is_sparse AND n_children > 1) THEN label || ' (' || CAST(n_children AS VARCHAR) || ' chunks)' ELSE label END AS display_name FROM l""",
)
def p14_display_name(files):
    res = group.number_resources(_resources(files).withColumn("phase", F.col("n_children"))).withColumn("number", F.coalesce("number", F.lit(0)))
    named = res.withColumns({"original_filename": F.when(F.col("ord") % 3 == 0, F.col("display_name")).otherwise(""), "url_name": F.when(F.col("ord") % 3 == 1, F.concat(F.lit("u"), F.col("ord").cast("string"))).when(F.col("ord") % 3 == 2, F.repeat(F.lit("x"), 101))})
    return report.display_name(named).select("cache_dir", "ord", "display_name")


@query("fx_files", _RES + " SELECT cache_dir, ord, CASE WHEN resource_type <> 'unknown_data' THEN row_number() OVER (PARTITION BY cache_dir, resource_type = 'unknown_data' ORDER BY n_children, ord) END AS number FROM r")
def w6_number_resources(files):
    return group.number_resources(_resources(files).withColumn("phase", F.col("n_children"))).select("cache_dir", "ord", F.col("number").cast("bigint").alias("number"))


@query("fx_files", """ SELECT cache_dir, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS total_size, max(modified_at_us) AS modified_at_us, 'Unidentified chunks (' || CAST(count(*) AS VARCHAR) || ')' AS display_name FROM fx_files WHERE file_type IS NULL GROUP BY cache_dir""")
def a11_unidentified_bucket(files):
    return group.unidentified_bucket(files.where("file_type is null"))


@query("fx_files", """ SELECT cache_dir, name, size, 'Unidentified chunks (' || CAST(count(*) OVER (PARTITION BY cache_dir) AS VARCHAR) || ')' AS display_name FROM fx_files WHERE file_type IS NULL""")
def a11_unidentified_files(files):
    return group.unidentified_files(files.where("file_type is null")).select("cache_dir", "name", "size", "display_name")


@query(
    "fx_files",
    _RES
    + """, g AS (SELECT *, max(CASE WHEN n_children = 0 THEN -ord END) OVER (PARTITION BY cache_dir, index_url) AS best, max(ord) OVER (PARTITION BY cache_dir, index_url) AS latest FROM r WHERE index_url IS NOT NULL)
    SELECT cache_dir, index_url, coalesce(-max(best), max(latest)) AS ord, count(*) AS merged_rows, count(DISTINCT 'f' || CAST(ord % 40 AS VARCHAR)) AS n_names FROM g GROUP BY cache_dir, index_url""",
)
def a10_dedupe_resources_by_url(files):
    res = _resources(files).where("index_url is not null").withColumn("authoritative", F.col("n_children") == 0)
    own = res.select("cache_dir", "ord", F.lit(0).alias("place"), F.concat(F.lit("f"), (F.col("ord") % 40).cast("string")).alias("name"), F.col("total_size").alias("size"))
    one, merged = group.merge_resources_by_url(res, own)
    return one.join(merged.groupBy("cache_dir", "ord").agg(F.count(F.lit(1)).alias("n_names")), ["cache_dir", "ord"]).select("cache_dir", "index_url", "ord", "merged_rows", "n_names")


@query("fx_ranges", """ SELECT resource_id, max(range_offset + range_length) AS sparse_size FROM fx_ranges GROUP BY resource_id""")
def a12_sparse_size(ranges):
    return layout.sparse_size(ranges)


@query("fx_ranges", """, c AS (SELECT resource_id, range_length // 262144 AS size, count(*) AS n FROM fx_ranges GROUP BY ALL) SELECT resource_id, arg_max(size, (n, size)) AS modal_size, max(size) AS max_size, CAST(sum(n) AS BIGINT) AS n_chunks FROM c GROUP BY resource_id""")
def a13_chunk_size_stats(ranges):
    return layout.chunk_size_stats(ranges.withColumn("size", F.floor(F.col("range_length") / 262144)), "resource_id", "size")


@query("fx_bodies", """, h AS (SELECT doc_id, cache_dir, substr(body_hex, 1, 128) AS head, CASE doc_id % 8 WHEN 4 THEN 'mp4_complete' WHEN 6 THEN 'mp4_header_only' END AS kind FROM fx_bodies), r AS (SELECT *, CASE WHEN kind IS NOT NULL THEN row_number() OVER (PARTITION BY cache_dir, kind IS NOT NULL, head ORDER BY doc_id) END AS n FROM h) SELECT doc_id, CASE WHEN coalesce(n, 1) = 1 THEN kind END AS file_type, coalesce(n > 1, false) AS demoted FROM r""")
def w1_dedupe_mp4_headers(bodies):
    kind = F.when(F.col("doc_id") % 8 == 4, "mp4_complete").when(F.col("doc_id") % 8 == 6, "mp4_header_only")
    rows = bodies.select("cache_dir", F.col("doc_id").alias("hex_value"), F.substring(F.unhex("body_hex"), 1, 64).alias("head64"), kind.alias("file_type"))
    return group.dedupe_mp4_headers(rows).select(F.col("hex_value").alias("doc_id"), "file_type", "demoted")


@query("fx_files", """, c AS (SELECT cache_dir, hex_value // 100 * 100 - 3 AS header_hex, hex_value, CASE WHEN hex_value % 7 = 0 THEN hex_value - 2 END AS tail_hex FROM fx_files), p AS (SELECT *, coalesce(lag(hex_value) OVER (PARTITION BY cache_dir, header_hex ORDER BY hex_value), header_hex) AS prev FROM c) SELECT cache_dir, header_hex, hex_value, greatest(hex_value - prev - 1 - CASE WHEN tail_hex > prev AND tail_hex < hex_value THEN 1 ELSE 0 END, 0) AS gap, gap * 4096 AS zero_bytes FROM p""")
def w2_chunk_gaps(files):
    rows = files.select("cache_dir", (F.floor(F.col("hex_value") / 100) * 100 - 3).alias("header_hex"), "hex_value", F.when(F.col("hex_value") % 7 == 0, F.col("hex_value") - 2).alias("tail_hex"), F.lit(4096).cast("bigint").alias("modal_size"))
    return group.chunk_gaps(rows).select("cache_dir", "header_hex", "hex_value", "gap", "zero_bytes")


_PLAN = """, o AS (SELECT *, lead(range_offset) OVER w AS nxt, coalesce(max(range_offset + range_length) OVER (PARTITION BY resource_id ORDER BY range_offset, range_length, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach, row_number() OVER w AS rank, range_offset + range_length AS e FROM (SELECT * FROM fx_ranges WHERE range_length > 0) WINDOW w AS (PARTITION BY resource_id ORDER BY range_offset, range_length, seq)),
plan AS (SELECT resource_id, rank, 'data' AS kind, range_offset AS out_offset, least(range_length, coalesce(nxt - range_offset, range_length)) AS length FROM o
UNION ALL SELECT resource_id, rank, 'zero', reach, range_offset - reach FROM o WHERE range_offset > reach
UNION ALL SELECT resource_id, rank, 'earlier', e, least(reach, coalesce(nxt, reach)) - e FROM o WHERE reach > e)"""


@query("fx_ranges", _PLAN + " SELECT * FROM plan WHERE length > 0")
def w4_segment_plan_sparse(ranges):
    return layout.segment_plan_sparse(ranges).withColumn("rank", F.col("rank").cast("bigint"))


@query("fx_entries fx_children", _KIDS + """, g AS (SELECT s.cache_dir, s.url, child_id * 1048576 AS a, child_id * 1048576 + size AS b FROM sparse s JOIN kids USING (cache_dir, url) WHERE size > 0),
o AS (SELECT *, coalesce(max(b) OVER (PARTITION BY cache_dir, url ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM g) SELECT cache_dir, url, max(b) AS total_bytes, CAST(sum(greatest(a - reach, 0)) AS BIGINT) AS missing_bytes FROM o GROUP BY ALL""")
def recoverable_downloads_summary(entries, children):
    return recoverable_downloads(entries, children)


@query("fx_ranges", """, c AS (SELECT resource_id, seq AS ord, range_length AS size, 524288 AS modal_size, seq % 5 = 0 AS has_moov FROM fx_ranges) SELECT resource_id, arg_min(ord, (CASE WHEN size >= modal_size THEN 1 ELSE 0 END, ord)) AS tail_ord FROM c WHERE has_moov GROUP BY resource_id""")
def w5_pick_tail(ranges):
    return layout.pick_tail(ranges.select("resource_id", F.col("seq").alias("ord"), F.col("range_length").alias("size"), F.lit(524288).alias("modal_size"), (F.col("seq") % 5 == 0).alias("has_moov")))


_CHUNKS = """, c AS (SELECT resource_id, row_number() OVER (PARTITION BY resource_id ORDER BY range_offset, seq, range_length) AS ord, range_length AS size, 524288 AS modal_size, seq % 5 = 0 AS has_moov, seq % 3 = 0 AS standalone FROM fx_ranges),
t AS (SELECT *, arg_min(ord, (CASE WHEN size >= modal_size THEN 1 ELSE 0 END, ord)) FILTER (has_moov) OVER (PARTITION BY resource_id) AS tail_ord FROM c)"""


@query("fx_ranges", _CHUNKS + """ SELECT resource_id, ord, CASE WHEN ord = tail_ord THEN 'tail' WHEN has_moov AND size <> modal_size THEN 'duplicate' WHEN standalone AND size < modal_size THEN 'foreign' ELSE 'middle' END AS role FROM t""")
def w5_chunk_roles(ranges):
    order = Window.partitionBy("resource_id").orderBy("range_offset", "seq", "range_length")
    chunks = ranges.select("resource_id", F.row_number().over(order).cast("bigint").alias("ord"), F.col("range_length").alias("size"), F.lit(524288).alias("modal_size"), (F.col("seq") % 5 == 0).alias("has_moov"), (F.col("seq") % 3 == 0).alias("standalone"))
    return layout.chunk_roles(chunks).select("resource_id", "ord", "role")


# pieces of chunked videos: the first line of an order is its header, the others are chunks
_PIECES = """, p AS (SELECT resource_id, row_number() OVER (PARTITION BY resource_id ORDER BY range_offset, seq, range_length) - 1 AS ord, range_offset // 1048576 AS place, range_length AS n, seq FROM fx_ranges),
pieces AS (SELECT resource_id, ord, CASE WHEN seq % 11 <> 0 THEN place * 2 + seq % 2 END AS hex_value, CASE WHEN ord > 0 AND seq % 3 <> 0 THEN 700000 ELSE n END AS size, CASE WHEN seq % 13 <> 0 THEN 24 END AS mdat_offset, n * (seq % 9) + 16 AS mdat_size, CASE WHEN seq % 2 = 0 THEN 16 ELSE 8 END AS mdat_head, CASE WHEN ord > 0 AND seq % 4 = 0 THEN n // 2 END AS moov_offset, seq % 7 = 0 AS standalone FROM p)"""
_CHUNK_PLAN = _PIECES + """, h AS (SELECT * FROM pieces WHERE ord = 0), cnt AS (SELECT resource_id, size, count(*) AS k FROM pieces WHERE ord > 0 GROUP BY ALL), m AS (SELECT resource_id, arg_max(size, (k, size)) AS modal FROM cnt GROUP BY ALL),
t AS (SELECT c.*, modal, arg_min(ord, (CASE WHEN size >= modal THEN 1 ELSE 0 END, ord)) FILTER (moov_offset IS NOT NULL) OVER (PARTITION BY resource_id) AS tail_ord FROM pieces c JOIN m USING (resource_id) WHERE ord > 0),
r AS (SELECT *, CASE WHEN ord = tail_ord THEN 'tail' WHEN moov_offset IS NOT NULL AND size <> modal THEN 'duplicate' WHEN standalone AND size < modal THEN 'foreign' ELSE 'middle' END AS role FROM t),
l AS (SELECT resource_id, ord, size, moov_offset, 0 AS phase, NULL AS hex_value FROM h WHERE mdat_offset IS NOT NULL UNION ALL SELECT r.resource_id, r.ord, r.size, r.moov_offset, CASE role WHEN 'tail' THEN 2 ELSE 1 END, r.hex_value FROM r JOIN h USING (resource_id) WHERE h.mdat_offset IS NOT NULL AND (role = 'tail' OR role = 'middle' AND NOT (r.standalone AND r.size <> modal))),
o AS (SELECT *, coalesce(sum(size) OVER w, 0) AS pos, sum(size) OVER (PARTITION BY resource_id) AS whole, row_number() OVER (PARTITION BY resource_id ORDER BY phase, hex_value NULLS LAST, ord) AS seq FROM l WINDOW w AS (PARTITION BY resource_id ORDER BY phase, hex_value NULLS LAST, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT resource_id FROM o GROUP BY resource_id HAVING max(pos + moov_offset) > any_value(whole) // 2),
mid AS (SELECT r.resource_id, r.ord, r.size, r.hex_value, modal, coalesce(last_value(r.hex_value IGNORE NULLS) OVER w, h.hex_value) AS prev, (SELECT x.hex_value FROM r x WHERE x.resource_id = r.resource_id AND x.role = 'tail') AS t_hex, row_number() OVER (PARTITION BY r.resource_id ORDER BY r.hex_value NULLS LAST, r.ord) AS nth FROM r JOIN h USING (resource_id) JOIN s USING (resource_id) WHERE role = 'middle' WINDOW w AS (PARTITION BY r.resource_id ORDER BY r.hex_value NULLS LAST, r.ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
seg AS (SELECT resource_id, 0 AS ph, 0 AS nth, 0 AS sub, 'prefix' AS kind, ord AS source, 0 AS src_offset, 24 AS length FROM h JOIN s USING (resource_id)
UNION ALL SELECT resource_id, 1, 0, 0, 'mdat head', NULL, NULL, mdat_head FROM h JOIN s USING (resource_id)
UNION ALL SELECT resource_id, 2, 0, 0, 'media', ord, 24 + mdat_head, size - 24 - mdat_head FROM h JOIN s USING (resource_id)
UNION ALL SELECT resource_id, 3, nth, 0, 'zero', NULL, NULL, coalesce(greatest(greatest(hex_value - prev - 1, 0) - CASE WHEN t_hex > prev AND t_hex < hex_value THEN 1 ELSE 0 END, 0), 0) * modal FROM mid
UNION ALL SELECT resource_id, 3, nth, 1, 'data', ord, 0, size FROM mid
UNION ALL SELECT resource_id, 4, 0, 0, 'tail', ord, 0, moov_offset FROM r JOIN s USING (resource_id) WHERE role = 'tail'),
pl AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY resource_id ORDER BY ph, nth, sub ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS out_offset FROM seg WHERE length > 0),
e AS (SELECT resource_id, sum(length) AS ending, any_value(h.mdat_size) AS declared FROM pl JOIN h USING (resource_id) GROUP BY resource_id),
f AS (SELECT *, CASE WHEN ending - 24 > 2 * declared THEN ending - 24 ELSE declared END AS final FROM e),
cut AS (SELECT pl.resource_id, ph, nth, sub, kind, source, src_offset, CASE WHEN ph < 2 THEN length ELSE least(length, 24 + final - out_offset) END AS length, out_offset FROM pl JOIN f USING (resource_id)
UNION ALL SELECT resource_id, 5, 0, 0, 'zero', NULL, NULL, 24 + declared - ending, ending FROM f WHERE 24 + declared > ending
UNION ALL SELECT f.resource_id, 6, 0, 0, 'moov', r.ord, moov_offset, 600, 24 + final FROM f JOIN r USING (resource_id) WHERE role = 'tail'),
plan AS (SELECT resource_id, row_number() OVER (PARTITION BY resource_id ORDER BY ph, nth, sub) AS seq, kind, source, src_offset, length, out_offset, NULL AS error FROM cut WHERE length > 0
UNION ALL SELECT resource_id, seq, 'data', ord, 0, size, pos, NULL FROM o WHERE size > 0 AND resource_id NOT IN (SELECT resource_id FROM s)
UNION ALL SELECT resource_id, 0, NULL, NULL, NULL, NULL, NULL, 'no mdat box' FROM h WHERE mdat_offset IS NULL)"""


@query("fx_ranges", _CHUNK_PLAN + """ SELECT resource_id, seq, kind, CAST(source AS BIGINT) AS source, CAST(src_offset AS BIGINT) AS src_offset, CAST(length AS BIGINT) AS length, CAST(out_offset AS BIGINT) AS out_offset, CAST(error AS VARCHAR) AS error FROM plan""")
def w3_segment_plan_chunks(ranges):
    order = Window.partitionBy("resource_id").orderBy("range_offset", "seq", "range_length")
    p = spread.dealt(ranges, ["resource_id"]).withColumn("ord", F.row_number().over(order).cast("bigint") - 1)
    n, seq, later = F.col("range_length"), F.col("seq"), F.col("ord") > 0
    none = F.lit(None).cast("bigint")
    pieces = p.select(
        "resource_id", "ord", (~later).alias("is_header"), F.when(seq % 11 != 0, F.floor(F.col("range_offset") / 1048576) * 2 + seq % 2).alias("hex_value"), F.when(later & (seq % 3 != 0), F.lit(700000)).otherwise(n).cast("bigint").alias("size"),
        F.lit(0).cast("bigint").alias("ftyp_offset"), F.lit(24).cast("bigint").alias("ftyp_size"), F.when(seq % 13 != 0, F.lit(24)).cast("bigint").alias("mdat_offset"), (n * (seq % 9) + 16).alias("mdat_size"), F.when(seq % 2 == 0, 16).otherwise(8).cast("bigint").alias("mdat_head"),
        F.when(later & (seq % 4 == 0), F.floor(n / 2)).alias("moov_offset"), F.lit(600).cast("bigint").alias("moov_size"), none.alias("cut_offset"), none.alias("cut_size"), (seq % 7 == 0).alias("standalone"),
    )
    return layout.segment_plan_chunks(pieces, by_key=True).drop("literal")


@query("fx_boxes", """, n AS (SELECT *, sum(CASE WHEN box_type = 'moov' THEN 1 ELSE 0 END) OVER w AS nth, CAST(sum(CASE WHEN box_type = 'moov' THEN 1 ELSE 0 END) OVER (PARTITION BY file_id) AS BIGINT) AS moov_found FROM fx_boxes WINDOW w AS (PARTITION BY file_id ORDER BY box_offset, tie, box_size, box_type ROWS UNBOUNDED PRECEDING)),
k AS (SELECT * FROM n WHERE box_type <> 'moov' OR nth = 1) SELECT file_id, box_offset, tie, box_size, box_type, moov_found, CAST(coalesce(sum(box_size) OVER (PARTITION BY file_id ORDER BY box_offset, tie, box_size, box_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS new_offset FROM k""")
def w7_strip_duplicate_moov(boxes):
    return layout.strip_duplicate_moov(boxes)


@query("fx_boxes", """ SELECT file_id, max(box_offset) AS box_offset, max_by(box_size, (box_offset, box_size)) AS box_size FROM fx_boxes WHERE box_type = 'moov' AND box_size BETWEEN 500 AND 2000000 GROUP BY file_id""")
def w8_last_valid_moov(boxes):
    return layout.last_valid_moov(boxes)


@query("fx_boxes", """ SELECT file_id, CASE WHEN bool_or(box_type = 'moov') AND bool_or(box_type = 'mdat') THEN 'mp4_complete' ELSE 'mp4_header_only' END AS file_type FROM fx_boxes GROUP BY file_id""")
def p8_refine_mp4(boxes):
    return layout.refine_mp4(boxes)


@query("fx_files", """, g AS (SELECT cache_dir, name, CASE WHEN hex_value % 11 <> 0 THEN hex_value END AS hex_value FROM fx_files) SELECT cache_dir, name, row_number() OVER (PARTITION BY cache_dir ORDER BY hex_value NULLS LAST, name) AS place FROM g""")
def o3_order_chunks(files):
    rows = files.select("cache_dir", "name", F.when(F.col("hex_value") % 11 != 0, F.col("hex_value")).alias("hex_value"))
    return layout.order_chunks(rows, "cache_dir").select("cache_dir", "name", F.col("place").cast("bigint").alias("place"))


@query("fx_files", None)
def j7_mp4_header_chunks(files):
    return group.mp4_header_chunks(files)


@query("fx_files", None)
def grouped_chunks(files):
    return group.grouped_chunks(files)


@query("fx_files fx_media_urls", """, r AS (SELECT cache_dir, hex_value AS ord, CASE WHEN hex_value % 4 = 0 THEN etag END AS index_url, CASE hex_value % 3 WHEN 0 THEN 'Video ' || CAST(hex_value AS VARCHAR) WHEN 1 THEN 'my clip' ELSE '' END AS display_name, name AS header_file, ['f_' || printf('%06x', hex_value + 1), 'f_' || printf('%06x', hex_value + 2)] AS names FROM fx_files),
m AS (SELECT cache_dir, name, url, content_type, size AS content_length, hex_value % 2 = 0 AS is_sparse, CASE WHEN hex_value % 10 = 0 THEN 'o' || CAST(hex_value AS VARCHAR) ELSE '' END AS original_filename, 'my clip ' || CAST(hex_value AS VARCHAR) || '.mp4' AS base FROM fx_files JOIN fx_media_urls ON event_id = hex_value WHERE content_range IS NOT NULL),
e AS (SELECT cache_dir, ord, unnest(list_concat([header_file], names)) AS name, unnest([0, 1, 2]) AS pos FROM r WHERE index_url IS NULL),
h AS (SELECT e.cache_dir, ord, arg_min({'url': url, 'type': content_type, 'length': content_length, 'sparse': is_sparse, 'original': original_filename, 'base': base}, pos) AS x FROM e JOIN m USING (cache_dir, name) GROUP BY ALL)
SELECT r.cache_dir, r.ord, coalesce(index_url, x.url) AS index_url, x.type AS index_content_type, x.length AS index_content_length, x.sparse AS index_is_sparse, x.original AS index_original_filename,
CASE WHEN x IS NOT NULL AND (display_name = '' OR starts_with(display_name, 'Video ')) THEN CASE WHEN x.original <> '' THEN x.original ELSE x.base END ELSE display_name END AS display_name FROM r LEFT JOIN h ON r.cache_dir = h.cache_dir AND r.ord = h.ord""")
def j10_attach_index_metadata(files, urls):
    n = F.col("hex_value")
    names = F.array(F.format_string("f_%06x", n + 1), F.format_string("f_%06x", n + 2))
    shown = F.when(n % 3 == 0, F.concat(F.lit("Video "), n.cast("string"))).when(n % 3 == 1, "my clip").otherwise("")
    res = files.select("cache_dir", n.alias("ord"), F.when(n % 4 == 0, F.col("etag")).alias("index_url"), shown.alias("display_name"), F.col("name").alias("header_file"), names.alias("file_names"))
    known = files.where("content_range is not null").join(urls, F.col("event_id") == n)
    facts = known.select("cache_dir", "name", "url", "content_type", F.col("size").alias("content_length"), (n % 2 == 0).alias("is_sparse"), F.when(n % 10 == 0, F.concat(F.lit("o"), n.cast("string"))).otherwise("").alias("original_filename"))
    return group.attach_index_metadata(res, facts).drop("header_file", "file_names")


@query("fx_files", _AFFINITY + """, r AS (SELECT cache_dir, hex_value AS ord, etag, range_total, name AS header_file, unnest([0, 1]) AS pos, unnest([name, CASE WHEN hex_value % 9 = 0 THEN 'x' ELSE 'f_' || printf('%06x', hex_value + 7) END]) AS name, hex_value FROM a)
SELECT cache_dir, ord, CAST(pos AS BIGINT) AS pos, name, header_file, CASE WHEN ord % 2 = 0 THEN 'index' ELSE 'etag' END AS method, etag, range_total, CASE WHEN name = 'x' THEN 0 ELSE hex_value + 7 * pos END AS hex_value, CASE WHEN name <> 'x' THEN CAST(7 * pos AS BIGINT) END AS hex_distance FROM r""")
def w9_chunk_associations(files):
    n = F.col("hex_value")
    names = F.array("name", F.when(n % 9 == 0, "x").otherwise(F.format_string("f_%06x", n + 7)))
    res = group.with_affinity(files).select("cache_dir", n.alias("ord"), "etag", "range_total", F.col("name").alias("header_file"), F.when(n % 2 == 0, "index").otherwise("etag").alias("method"), names.alias("file_names"))
    return group.chunk_associations(res).withColumn("pos", F.col("pos").cast("bigint"))


@query("fx_files fx_entries", _RES + """, f AS (SELECT cache_dir, count(*) AS total_files, count(*) AS blockfile_files, CAST(0 AS BIGINT) AS simple_files, count(*) FILTER (file_type IS NULL AND hex_value % 7 <> 0) AS unclaimed, count(*) FILTER (etag IS NOT NULL AND file_type IS NULL) AS heuristic_grouped, count(*) FILTER (content_range IS NOT NULL) AS index_claimed FROM fx_files GROUP BY cache_dir),
e AS (SELECT cache_dir, count(*) AS index_entries FROM fx_entries GROUP BY cache_dir)
SELECT f.*, coalesce(index_entries, 0) AS index_entries, count(r.ord) AS resources, count(*) FILTER (index_url IS NOT NULL OR index_content_type IS NOT NULL) AS with_metadata FROM f LEFT JOIN e USING (cache_dir) LEFT JOIN r ON r.cache_dir = f.cache_dir GROUP BY ALL""")
def a6_scan_stats(files, entries):
    return group.scan_stats(files, _resources(files), entries, files.where("content_range is not null"), files.where("etag is not null and file_type is null"), files.where("file_type is null and hex_value % 7 <> 0"))


@query("fx_entries fx_children", """ SELECT url, CASE WHEN creation_time_us % 5 <> 0 THEN creation_time_us WHEN creation_time_us % 3 = 0 THEN 0 ELSE 9 END AS modified_at FROM fx_entries""")
def p17_resource_modified_at(entries, children):
    t = F.col("creation_time_us")
    rows = entries.select("url", F.when(t % 5 != 0, t).alias("creation_time_us"), F.when(t % 3 != 0, F.array(F.lit(4), F.lit(9)).cast("array<bigint>")).alias("file_times"))
    return group.resource_modified_at(rows).select("url", "modified_at")


@query("fx_files", """, e AS (SELECT name, content_type, hex_value AS n, CASE WHEN hex_value % 3 <> 0 THEN size END AS disk, CASE WHEN hex_value % 4 <> 0 THEN size END AS body, file_type FROM fx_files),
k AS (SELECT *, CASE trim(split_part(lower(content_type), ';', 1)) WHEN 'video/mp4' THEN 'mp4_complete' WHEN 'image/png' THEN 'png' END AS mime FROM e),
t AS (SELECT *, CASE WHEN disk IS NOT NULL THEN coalesce(CASE WHEN n % 12 > 8 THEN file_type END, mime) END AS s, CASE WHEN body IS NOT NULL THEN coalesce(CASE WHEN n % 2 = 0 THEN file_type END, mime) END AS b FROM k)
SELECT name, coalesce(s, b) AS file_type, CASE WHEN s IS NOT NULL THEN 'sparse' ELSE 'body' END AS source, CASE WHEN s IS NULL THEN body WHEN n % 5 = 0 THEN n ELSE disk + n % 7 END AS size FROM t WHERE coalesce(s, b) IS NOT NULL""")
def p9_type_simple_entries(files):
    n = F.col("hex_value")
    disk = F.when(n % 3 != 0, F.col("size"))
    rows = files.select(
        "name", "content_type", F.col("file_type").alias("sparse_magic"), (n % 12).alias("sparse_head_bytes"), F.when(n % 5 == 0, F.lit(0)).otherwise(disk + n % 7).alias("sparse_size"),
        disk.alias("sparse_disk_size"), n.alias("sparse_length"), F.when(n % 2 == 0, F.col("file_type")).alias("body_magic"), F.when(n % 4 != 0, F.col("size")).alias("body_size"),
    )
    return link.type_simple_entries(rows).select("name", "file_type", "source", "size")


@query("fx_files", _RES + " SELECT cache_dir, ord, resource_type FROM r WHERE media_category = 'audio'")
def s6_load_resources(files):
    path = shared_folder(files.sparkSession)
    write_resources(_resources(files), path)
    return load_resources(files.sparkSession, path, "audio").select("cache_dir", "ord", "resource_type")


@query("fx_files", _RES + """ SELECT cache_dir, ord, json_object('cache_dir', cache_dir, 'ord', ord, 'error', error)::VARCHAR AS line FROM r""")
def s7_export_audit_json(files):
    path = shared_folder(files.sparkSession)
    export_audit_json({"resources": _resources(files).select("cache_dir", "ord", "error")}, path)
    lines = files.sparkSession.read.text(f"{path}/resources")
    return lines.select(F.get_json_object("value", "$.cache_dir").alias("cache_dir"), F.get_json_object("value", "$.ord").cast("bigint").alias("ord"), F.col("value").alias("line"))
