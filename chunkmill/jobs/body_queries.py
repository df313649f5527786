"""Queries of the byte operators, over files that Spark builds from the texts of ``documents``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import webkit_us_to_unix
from ..sources import assemble, bodies, index, ranged
from ..sources.resources import kept, shared_folder
from . import caches, recovery, scan
from .caches import CACHE, const as _const, little as _le

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def wrap(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/documents.parquet"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return wrap


def _eof(size: Column) -> Column:
    return F.concat(_const(bodies.EOF_MAGIC, 8), _const(0, 8), _le(size, 4), _const(0, 4))


def _head(key: Column) -> Column:
    return F.concat(_const(bodies.FILE_MAGIC, 8), _const(5, 4), _le(F.octet_length(key), 4), _const(0, 8), key)


def simple_files(docs: DataFrame) -> DataFrame:
    """A Simple ``_0`` file of each document: the text as body, its language as headers."""
    text, key = F.encode(F.coalesce("text", F.lit("")), "UTF-8"), F.encode(F.concat(F.lit("1/0/https://x.org/"), F.col("doc_id").cast("string")), "UTF-8")
    headers = F.encode(F.coalesce("lang", F.lit("")), "UTF-8")
    return docs.select("doc_id", F.concat(_head(key), text, _eof(F.octet_length(text)), headers, _eof(F.octet_length(headers))).alias("content"))


def sparse_files(docs: DataFrame) -> DataFrame:
    """A sparse file of each document: its text twice, the second time 1,000 bytes behind the first."""
    text, key = F.encode(F.coalesce("text", F.lit("")), "UTF-8"), F.encode(F.col("doc_id").cast("string"), "UTF-8")
    size = F.octet_length(text).cast("bigint")
    span = lambda offset: F.concat(_const(bodies.RANGE_MAGIC, 8), _le(offset, 8), _le(size, 8), _const(0, 8), text)
    return docs.select("doc_id", F.concat(_head(key), span(size + 1000), span(F.lit(0).cast("bigint"))).alias("content"))


def mp4_files(docs: DataFrame) -> DataFrame:
    """A container of each document: ftyp, moov with mvhd and trak, mdat with the text."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    size = lambda n: F.unhex(F.lpad(F.hex(n), 8, "0"))
    moov = (616).to_bytes(4, "big") + b"moov" + (600).to_bytes(4, "big") + b"mvhd" + bytes(592) + (8).to_bytes(4, "big") + b"trak"
    return docs.select("doc_id", F.concat(F.lit((16).to_bytes(4, "big") + b"ftypmp42\0\0\0\0" + moov), size(F.octet_length(text).cast("bigint") + 8), F.lit(b"mdat"), text).alias("content"))


def tracked_files(docs: DataFrame) -> DataFrame:
    """An index box of each document: a picture and a sound track, and as many milliseconds as its text has bytes."""

    def box(kind: bytes, body: bytes) -> bytes:
        return (len(body) + 8).to_bytes(4, "big") + kind + body

    def track(handler: bytes, codec: bytes) -> bytes:
        sample = bytes(8) + (36).to_bytes(4, "big") + codec + bytes(16) + (640).to_bytes(2, "big") + (360).to_bytes(2, "big") + bytes(8)
        return box(b"trak", box(b"mdia", box(b"hdlr", bytes(8) + handler + bytes(12)) + box(b"minf", box(b"stbl", box(b"stsd", sample)))))

    rest = bytes(300) + track(b"vide", b"avc1") + track(b"soun", b"mp4a")
    whole = 8 + 28 + len(rest)
    length = F.unhex(F.lpad(F.hex(F.octet_length(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).cast("bigint")), 8, "0"))
    head = whole.to_bytes(4, "big") + b"moov" + (328).to_bytes(4, "big") + b"mvhd" + bytes(12) + (1000).to_bytes(4, "big")
    return docs.select("doc_id", F.concat(F.lit(head), length, F.lit(rest)).alias("content"))


_TEXT = "octet_length(encode(coalesce(text, '')))"
_KEY = "24 + length('1/0/https://x.org/' || CAST(doc_id AS VARCHAR))"


@query(f"SELECT doc_id, {_KEY} AS body_start, {_KEY} + {_TEXT} AS body_end, {_KEY} + {_TEXT} + 24 AS headers_start, {_KEY} + {_TEXT} + 24 + length(lang) AS headers_end FROM documents")
def s3_unwrap_simple(docs):
    return bodies.unwrap_simple(simple_files(docs), ["doc_id"])


@query(f"SELECT doc_id, lower(hex(encode(coalesce(text, '')))[1:16]) AS head FROM documents WHERE {_TEXT} >= 8")
def s2_file_heads(docs):
    files = simple_files(docs)
    layout = bodies.unwrap_simple(files, ["doc_id", "content"])
    return layout.where("body_end - body_start >= 8").select("doc_id", F.lower(F.hex(bodies.file_head(F.col("content"), F.col("body_start"), 8))).alias("head"))


def _swapped(n: str) -> str:
    """SQL: an integer as four bytes in hex, least significant first."""
    return " || ".join(f"substr(lpad(to_hex({n}), 8, '0'), {i}, 2)" for i in (7, 5, 3, 1))


def _eof_sql(n: str) -> str:
    return f"'{bodies.EOF_MAGIC.to_bytes(8, 'little').hex()}' || repeat('0', 16) || {_swapped(n)} || repeat('0', 8)"


_HEADS = f"""WITH t AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h, {_TEXT} AS n, lower(hex(encode(coalesce(lang, '')))) AS k, octet_length(encode(coalesce(lang, ''))) AS m FROM documents)
SELECT doc_id, lower(substr(h || {_eof_sql('n')} || k || {_eof_sql('m')}, 1, 512)) AS head FROM t"""


@query(_HEADS)
def s2_file_heads_all(docs):
    layout = bodies.unwrap_simple(simple_files(docs), ["doc_id", "content"])
    return layout.select("doc_id", F.lower(F.hex(bodies.file_head(F.col("content"), F.col("body_start")))).alias("head"))


def _written(docs: DataFrame) -> DataFrame:
    """The listing of ``simple_files``, written as files of caches, with ``doc_id``."""
    folder = shared_folder(docs.sparkSession)
    files = simple_files(docs.where("doc_id is not null").dropDuplicates(["doc_id"]))
    zero = F.lit(0).cast("bigint")
    parts = files.select("doc_id", zero.alias("part"), zero.alias("begin"), "content")
    path = F.concat(caches.cache_of(F.col("doc_id")), F.lit("/"), F.lpad(F.lower(F.hex("doc_id")), 16, "0"), F.lit("_0"))
    assemble.write_bodies(parts, files.select("doc_id", path.alias("out_path"), F.col("doc_id").alias("ord"), F.octet_length("content").cast("bigint").alias("total")), ["doc_id"], folder)
    listed = bodies.list_cache_files(docs.sparkSession, [folder])
    return listed.withColumn("doc_id", F.conv(F.substring("name", 1, 16), 16, 10).cast("bigint"))


@query(_HEADS + " WHERE doc_id IS NOT NULL")
def s2_file_heads_ranged(docs):
    return ranged.file_heads(_written(docs), ["doc_id"]).select("doc_id", F.lower(F.hex("head")).alias("head"))


@query(f"SELECT doc_id, {_KEY} AS body_start, {_KEY} + {_TEXT} AS body_end, {_KEY} + {_TEXT} + 24 AS headers_start, {_KEY} + {_TEXT} + 24 + length(lang) AS headers_end FROM documents WHERE doc_id IS NOT NULL")
def s3_unwrap_files(docs):
    return ranged.unwrap_files(_written(docs), ["doc_id"]).drop("error")


@query(f"""SELECT doc_id, {_TEXT} + 1000 AS range_offset, {_TEXT} AS range_length, 24 + length(CAST(doc_id AS VARCHAR)) + 32 AS data_pos FROM documents
UNION ALL SELECT doc_id, 0, {_TEXT}, 24 + length(CAST(doc_id AS VARCHAR)) + 64 + {_TEXT} FROM documents""")
def u1_sparse_ranges(docs):
    return bodies.sparse_ranges(sparse_files(docs), ["doc_id"])


@query("SELECT doc_id, md5(CASE WHEN coalesce(text, '') = '' THEN repeat(chr(0), 1000) ELSE text || repeat(chr(0), 1000) || text END) AS md5, CAST(NULL AS VARCHAR) AS error FROM documents")
def u5_assemble_sparse(docs):
    return bodies.assemble_sparse(sparse_files(docs), ["doc_id"]).select("doc_id", F.md5("content").alias("md5"), "error")


@query(f"""SELECT doc_id, o AS box_offset, CASE WHEN t = 'mdat' THEN {_TEXT} + 8 ELSE s END AS box_size, 8 AS header_size, t AS box_type, d AS depth
FROM documents, (VALUES (0, 16, 'ftyp', 0), (16, 616, 'moov', 0), (24, 600, 'mvhd', 1), (624, 8, 'trak', 1), (632, 0, 'mdat', 0)) b(o, s, t, d)""")
def u2_mp4_boxes(docs):
    return bodies.mp4_boxes(mp4_files(docs), ["doc_id"])


@query("SELECT doc_id, 16 AS box_offset, 616 AS box_size FROM documents")
def u3_moov_hits(docs):
    return bodies.find_moov(mp4_files(docs), ["doc_id"])


@query("SELECT source AS cache_dir, doc_id // 50 AS part, md5(string_agg(coalesce(text, ''), '' ORDER BY doc_id)) AS md5 FROM documents GROUP BY ALL")
def u6_concat_bodies(docs):
    rows = docs.select(F.col("source").alias("cache_dir"), F.floor(F.col("doc_id") / 50).alias("part"), "doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("body"))
    return bodies.concat_bodies(rows, ["cache_dir", "part"], "doc_id", "body").select("cache_dir", "part", F.md5("content").alias("md5"))


@query(f"SELECT doc_id, 640 AS width, 360 AS height, 'avc1' AS video_codec, 'mp4a' AS audio_codec, {_TEXT} / CAST(1000 AS DOUBLE) AS duration FROM documents")
def u4_video_info(docs):
    return bodies.video_info(tracked_files(docs), ["doc_id"])


def _text():
    return F.encode(F.coalesce("text", F.lit("")), "UTF-8")


_HEX = "lower(hex(encode(coalesce(text, ''))))"


@query(f"""WITH t AS (SELECT doc_id, {_HEX} AS h, {_TEXT} AS n FROM documents), w AS (SELECT doc_id, repeat('00', 50) || '6d646174' || repeat('00', 46) || CASE WHEN n <= 5 THEN h || repeat('00', 5 - CAST(n AS INTEGER)) || h ELSE substr(h, 1, 10) || substr(h, 1, 2 * CAST(least(n, 10) AS INTEGER)) || substr(h, 11 + 2 * CAST(least(n, 10) AS INTEGER)) END AS body FROM t)
SELECT doc_id, CAST(i AS BIGINT) AS part, md5(substr(body, CAST(i AS INTEGER) * 8192 + 1, 8192)) AS md5 FROM w, generate_series(0, 100) g(i) WHERE i * 8192 < length(body)""")
def u7_assemble_plan(docs):
    """A literal after 50 zeros, the text after 100 bytes, and its first ten bytes over it again at byte 105."""
    pieces = docs.select("doc_id", F.lit(0).cast("bigint").alias("ord"), _text().alias("content"))
    n = F.octet_length("content").cast("bigint")
    zero = F.lit(0).cast("bigint")
    row = lambda seq, source, length, out, literal: F.struct(F.lit(seq).cast("bigint").alias("seq"), source.cast("bigint").alias("source"), zero.alias("src_offset"), length.cast("bigint").alias("length"), F.lit(out).cast("bigint").alias("out_offset"), literal.cast("binary").alias("literal"))
    plan = pieces.select("doc_id", F.inline(F.array(row(1, zero, n, 100, F.lit(None)), row(2, F.lit(None), F.lit(4), 50, F.lit(b"mdat")), row(3, zero, F.least(n, F.lit(10)), 105, F.lit(None)))))
    parts = assemble.assemble_plan(plan, pieces, ["doc_id"], part_bytes=4096)
    return parts.select("doc_id", "part", F.md5(F.lower(F.hex("content"))).alias("md5"))


@query(f"""WITH p AS (SELECT source || '/' || CAST(doc_id % 300 AS VARCHAR) || '.txt' AS out_path, arg_max({_HEX}, doc_id) AS h FROM documents WHERE doc_id IS NOT NULL GROUP BY 1) SELECT out_path, CAST(length(h) // 2 AS BIGINT) AS bytes, md5(h) AS md5, CAST(NULL AS VARCHAR) AS error FROM p""")
def s8_write_bodies(docs):
    """Every text as a file; of those with one path the last stays. The files are read again."""
    folder = shared_folder(docs.sparkSession)
    rows = docs.where("doc_id is not null")
    zero = F.lit(0).cast("bigint")
    parts = rows.select("doc_id", zero.alias("part"), zero.alias("begin"), _text().alias("content"))
    targets = rows.select("doc_id", F.concat("source", F.lit("/"), (F.col("doc_id") % 300).cast("string"), F.lit(".txt")).alias("out_path"), F.col("doc_id").alias("ord"), F.octet_length(_text()).cast("bigint").alias("total"))
    written = kept(assemble.write_bodies(parts, targets, ["doc_id"], folder))
    back = bodies.all_files(docs.sparkSession, [folder], with_content=True, with_empty=True)
    back = back.select(F.regexp_extract("path", "([^/]*/[^/]*)$", 1).alias("out_path"), F.md5(F.lower(F.hex("content"))).alias("md5"))
    return written.join(back, "out_path").select("out_path", "bytes", "md5", "error")


@query("SELECT 'dir' || CAST(doc_id // 500 AS VARCHAR) AS cache_dir, 'f_' || printf('%06x', doc_id) AS name, any_value(octet_length(encode(coalesce(text, '')))) AS size FROM documents WHERE doc_id IS NOT NULL AND doc_id % 10 <> 3 GROUP BY ALL")
def s1_list_cache_files(docs):
    """A file of each document, a tenth of them under names that no cache has; then the listing. Names of files have room for
    six hex digits of an id; the rest of a larger one is told by its cache."""
    folder = shared_folder(docs.sparkSession)
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    name = F.format_string("%s_%06x", F.when(F.col("doc_id") % 10 == 3, "x").otherwise("f"), F.col("doc_id") % 0x1000000)
    zero = F.lit(0).cast("bigint")
    parts = rows.select("doc_id", zero.alias("part"), zero.alias("begin"), _text().alias("content"))
    targets = rows.select("doc_id", F.concat(caches.cache_of(F.col("doc_id")), F.lit("/"), name).alias("out_path"), F.col("doc_id").alias("ord"), F.octet_length(_text()).cast("bigint").alias("total"))
    assemble.write_bodies(parts, targets, ["doc_id"], folder).count()
    found = bodies.list_cache_files(docs.sparkSession, [folder], with_empty=True).withColumn(CACHE, F.element_at(F.split(CACHE, "/"), -1))
    first = F.substring(CACHE, 4, 20).cast("bigint") * caches.DOCUMENTS
    number = first + F.pmod(F.conv(F.substring("name", 3, 6), 16, 10).cast("bigint") - first, F.lit(0x1000000))
    return found.select(CACHE, F.format_string("f_%06x", number).alias("name"), F.col("size").cast("int").alias("size"))


_ENTRIES = """WITH e AS (SELECT doc_id, 0 AS sub, CASE WHEN doc_id % 20 = 1 THEN 1 ELSE 0 END AS flags, CASE WHEN doc_id % 20 = 1 THEN '1/0/https://x.org/v/' || doc_id || '.mp4' ELSE '1/0/https://x.org/a/' || doc_id || '.png' END AS url FROM documents
UNION ALL SELECT doc_id, s, 2, 'Range_1/0/https://x.org/v/' || doc_id || '.mp4:00000000000a1b2c:' || (s - 1) FROM documents, (VALUES (1), (2)) c(s) WHERE doc_id % 20 = 1)"""


@query(_ENTRIES + """ SELECT 'dir' || CAST(doc_id // 500 AS VARCHAR) AS cache_dir, row_number() OVER (PARTITION BY doc_id // 500 ORDER BY doc_id, sub) - 1 AS ord, url, CAST(0 AS BIGINT) AS state, CAST(flags AS BIGINT) AS flags, CAST(doc_id % 1000 AS DOUBLE) + CAST(0.5 AS DOUBLE) AS created_at, CAST(NULL AS VARCHAR) AS error FROM e""")
def s4_read_index_entries(docs):
    found = index.read_index_entries(caches.indexed_caches(docs)[0])
    return found.select("cache_dir", "ord", "url", "state", "flags", F.round(webkit_us_to_unix(F.col("creation_time_us")), 3).alias("created_at"), "error")


@query(_ENTRIES + """ SELECT 'dir' || CAST(doc_id // 500 AS VARCHAR) AS cache_dir, row_number() OVER (PARTITION BY doc_id // 500 ORDER BY doc_id, sub) - 1 AS ord, CAST(CASE WHEN sub = 0 THEN doc_id END AS BIGINT) AS request_time_us, CAST(CASE WHEN sub = 0 THEN doc_id + 7 END AS BIGINT) AS response_time_us,
CASE WHEN sub = 0 THEN 'HTTP/1.1 200 OK' || chr(0) || 'content-type: ' || CASE doc_id % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'video/mp4' WHEN 2 THEN 'text/html' ELSE 'audio/ogg' END || chr(0) || chr(0) END AS raw_headers FROM e""")
def s5_read_http_meta(docs):
    return index.read_http_meta(index.read_index_entries(caches.indexed_caches(docs)[0]), ["cache_dir", "ord"])


_KIND = "CASE doc_id % 4 WHEN 0 THEN 'png' WHEN 1 THEN CASE WHEN doc_id % 20 = 1 THEN 'mp4_chunked' ELSE 'mp4_complete' END WHEN 3 THEN 'ogg' END"


@query(f"""WITH t AS (SELECT doc_id, {_HEX} AS h, CAST({_TEXT} AS BIGINT) AS n, 'dir' || CAST(doc_id // 500 AS VARCHAR) AS cache_dir, {_KIND} AS kind FROM documents)
SELECT cache_dir, doc_id, kind AS resource_type, CASE WHEN kind = 'mp4_chunked' THEN 'index_reassemble' ELSE 'copy' END AS action, CASE WHEN kind = 'mp4_chunked' THEN 2 ELSE 0 END AS n_children, CASE WHEN kind = 'mp4_chunked' THEN 2 * n ELSE n END AS total_size,
CASE WHEN kind = 'png' THEN 'image' WHEN kind = 'ogg' THEN 'audio' ELSE 'video' END || 's/' || doc_id || CASE kind WHEN 'mp4_chunked' THEN '_mp4.mp4' WHEN 'mp4_complete' THEN '_png.mp4' WHEN 'png' THEN '_png.png' ELSE '_png.ogg' END AS out_path,
md5(CASE WHEN kind = 'mp4_chunked' THEN h || repeat('00', 1048576 - CAST(n AS INTEGER)) || h ELSE h END) AS md5 FROM t WHERE kind IS NOT NULL AND n > 0""")
def job_recover_indexed(docs):
    """Index-first recovery of the caches built from the texts: resources, plan and the bytes of each."""
    got = recovery.recover_indexed(*caches.indexed_caches(docs))
    body = got["parts"].select("resource_id", F.md5(F.lower(F.hex("content"))).alias("md5"))
    number = F.regexp_extract("url", "/([0-9]+)[.]", 1).cast("bigint").alias("doc_id")
    return got["resources"].join(body, "resource_id").select("cache_dir", number, "resource_type", "action", "n_children", "total_size", "out_path", "md5")


@query(f"""SELECT 'dir' || CAST(doc_id // 500 AS VARCHAR) AS cache_dir, doc_id, CASE WHEN doc_id % 3 = 0 THEN 'sparse' ELSE 'body' END AS source, CASE WHEN doc_id % 3 = 0 THEN 'sparse_copy' ELSE 'copy' END AS action, CAST(CASE WHEN doc_id % 3 = 0 THEN 1000 + {_TEXT} ELSE {_TEXT} END AS BIGINT) AS n_bytes,
md5(CASE WHEN doc_id % 3 = 0 THEN repeat('00', 1000) ELSE '' END || {_HEX}) AS md5 FROM documents WHERE {_TEXT} > 0 AND doc_id IS NOT NULL""")
def job_recover_simple(docs):
    """Recovery of Simple caches built from the texts; a third have a sparse stream, a text behind a hole."""
    got = recovery.recover_simple(caches.simple_caches(docs))
    body = got["parts"].select("resource_id", F.octet_length("content").cast("bigint").alias("n_bytes"), F.md5(F.lower(F.hex("content"))).alias("md5"))
    return got["resources"].join(body, "resource_id").select("cache_dir", F.conv("hash", 16, 10).cast("bigint").alias("doc_id"), "source", "action", "n_bytes", "md5")


@query(None)
def job_recover_unclaimed(docs):
    """Heuristic recovery of files without an index, cut from the texts: resources and the bytes of each."""
    got = recovery.recover_unclaimed(caches.loose_files(docs))
    body = got["parts"].groupBy("resource_id").agg(F.sum(F.octet_length("content")).alias("n_bytes"), F.max(F.md5("content")).alias("md5"))
    return got["resources"].join(body, "resource_id").select("cache_dir", "header_file", "resource_type", "action", "n_files", "n_bytes", "md5")


@query(f"""WITH t AS (SELECT DISTINCT ON (doc_id) doc_id, 'dir' || CAST(doc_id // 500 AS VARCHAR) AS cache_dir, {_TEXT} > 0 AS used, {_TEXT} > 0 AND {_KIND} IS NOT NULL AS made FROM documents WHERE doc_id IS NOT NULL)
SELECT cache_dir, count(*) + count(*) FILTER (used) + count(*) FILTER (used AND doc_id % 3 = 0) AS total_files, count(*) AS blockfile_files, count(*) FILTER (used) AS simple_files, count(*) FILTER (made) + count(*) FILTER (used) AS resources, count(*) FILTER (made) AS with_metadata,
count(*) AS index_entries, count(*) FILTER (made) AS index_claimed, CAST(0 AS BIGINT) AS heuristic_grouped, count(*) FILTER (NOT made) AS unclaimed FROM t GROUP BY cache_dir""")
def job_scan_stats(docs):
    """One scan of caches that have an index and Simple files, built from the texts: its counters."""
    index_files, files = caches.indexed_caches(docs)
    both = files.unionByName(caches.simple_caches(docs)).withColumn("modified_at_us", F.lit(0).cast("bigint"))
    return scan.scan(index_files, both)["stats"]
