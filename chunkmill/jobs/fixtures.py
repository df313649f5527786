"""Deterministic projections of the given tables into the library's input schemas.

Each is a SELECT in Spark SQL, with its twin for the SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK = {
    "fx_files": r"""
SELECT concat('dir', CAST(user_id % 4 AS STRING)) AS cache_dir, event_id AS hex_value,
 concat('f_', lpad(lower(hex(event_id)),6,'0')) AS name,
 CASE WHEN event_id % 3 <> 0 THEN CAST(1048576 AS BIGINT) ELSE CAST(floor(value*1000) AS BIGINT)+1 END AS size,
 unix_micros(CAST(ts AS TIMESTAMP)) AS modified_at_us,
 CASE event_type WHEN 'signup' THEN CASE WHEN event_id % 4 = 0 THEN 'mp4_header_only' ELSE 'webm_continuation' END
   WHEN 'purchase' THEN CASE event_id % 3 WHEN 0 THEN 'webm_mkv' WHEN 1 THEN 'mp4_complete' ELSE 'jpeg' END
   WHEN 'view' THEN CASE WHEN event_id % 5 = 0 THEN 'mp3' ELSE 'mp4_fragment' END
   ELSE NULL END AS file_type,
 CASE WHEN event_id % 2 = 0 THEN concat('"k', get_json_object(props,'$.k'), '"') END AS etag,
 CASE WHEN event_id % 5 = 0 THEN concat('bytes 0-1048575/', get_json_object(props,'$.k'), '00000') END AS content_range,
 CASE event_id % 6 WHEN 0 THEN 'video/mp4' WHEN 1 THEN 'Text/CSS; charset=utf-8' WHEN 2 THEN 'application/octet-stream' WHEN 3 THEN 'image/png' END AS content_type,
 CASE WHEN event_type = 'signup' AND event_id % 4 = 0 THEN CAST(event_id % 40 + 1 AS BIGINT) * 262144 END AS mdat_size, CAST(32 AS BIGINT) AS mdat_offset FROM events""",
    "fx_entries": r"""
SELECT concat('dir', CAST(o_custkey % 4 AS STRING)) AS cache_dir, concat('1/0/https://cdn.example.org/v/', CAST(o_orderkey AS STRING), '.mp4') AS url,
 o_orderstatus <> 'F' AS is_sparse, unix_micros(CAST(o_orderdate AS TIMESTAMP)) AS creation_time_us, CAST(o_orderkey AS BIGINT) AS ord, CAST(CASE WHEN o_orderkey % 5 = 0 THEN 777 ELSE 0 END AS BIGINT) AS body_size FROM orders WHERE o_orderkey % 11 <> 0""",
    "fx_children": r"""
SELECT concat('dir', CAST(o_custkey % 4 AS STRING)) AS cache_dir,
 concat('Range_1/0/https://cdn.example.org/v/', CAST(l_orderkey AS STRING), '.mp4:', lpad(lower(hex(l_partkey+65536)),16,'0'), ':', lower(hex(CAST(l_linenumber-1 AS BIGINT)))) AS child_key,
 CAST(l_quantity*20971 AS BIGINT) AS size, concat('f_', lpad(lower(hex(l_orderkey*8+l_linenumber)),6,'0')) AS file_name,
 l_returnflag <> 'R' AS is_external
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "fx_bodies": r"""
SELECT doc_id, source AS cache_dir, CASE doc_id % 8 WHEN 0 THEN '89504e470d0a1a0a' WHEN 1 THEN 'ffd8ffe0' WHEN 2 THEN '524946460000000057454250'
 WHEN 3 THEN '1a45dfa3' WHEN 4 THEN '0000001c667479706d703432' WHEN 5 THEN '00000100' WHEN 6 THEN '00000200' || '6d6f6f66' ELSE '' END || lower(hex(encode(text,'UTF-8'))) AS body_hex FROM documents""",
    "fx_media_urls": r"""
SELECT event_id, concat(CASE event_id % 3 WHEN 0 THEN 'https://cdn.discordapp.com' WHEN 1 THEN 'https://media.discordapp.net' ELSE 'https://img.example.org' END,
 CASE event_type WHEN 'click' THEN '/attachments/' WHEN 'view' THEN '/ephemeral-attachments/' WHEN 'signup' THEN '/avatars/' WHEN 'purchase' THEN '/emojis/' ELSE '/external/' END,
 CAST(((unix_millis(CAST(ts AS TIMESTAMP))) - 1420070400000) * 4194304 + user_id AS STRING), '/', CAST(((unix_millis(CAST(ts AS TIMESTAMP))) - 1420070400000) * 4194304 + event_id AS STRING), '/my%20clip%20', CAST(event_id AS STRING), '.mp4?ex=', lower(hex(1704067200 + event_id)), '&is=', lower(hex(1704000000 + event_id)), '&hm=abc') AS url FROM events""",
    "fx_raw_headers": r"""
SELECT page_id, url, concat('HTTP/1.1 200 OK', chr(0), 'Content-Type: ', CASE page_id % 3 WHEN 0 THEN 'video/mp4' WHEN 1 THEN 'image/PNG; q=1' ELSE 'text/html' END, chr(0), 'content-length: ', CAST(length(html) AS STRING), chr(0),
 CASE page_id % 4 WHEN 0 THEN 'Content-Disposition: attachment; filename="a b.mp4"' WHEN 1 THEN 'Content-Disposition: inline; filename*=UTF-8''''na%20me.png; x=1' WHEN 2 THEN 'Content-Disposition: attachment; filename=plain.gif' ELSE 'ETag: "p"' END, chr(0), chr(0)) AS raw_headers FROM pages""",
    "fx_ranges": r"""
SELECT l_orderkey AS resource_id, CAST(l_linenumber-1 AS BIGINT) * 1048576 AS range_offset, CAST(l_quantity*20971 AS BIGINT) AS range_length, l_partkey AS seq FROM lineitem""",
    "fx_boxes": r"""
SELECT l_orderkey AS file_id, CAST(l_linenumber AS BIGINT) * 65536 + l_partkey % 65536 AS box_offset, l_suppkey AS tie, CAST(l_quantity*100 AS BIGINT) AS box_size, CASE l_returnflag WHEN 'R' THEN 'moov' WHEN 'A' THEN 'mdat' ELSE 'free' END AS box_type FROM lineitem""",
}

ORACLE = {
    "fx_files": r"""
SELECT concat('dir', CAST(user_id % 4 AS STRING)) AS cache_dir, event_id AS hex_value,
 concat('f_', lpad(lower(to_hex(event_id)),6,'0')) AS name,
 CASE WHEN event_id % 3 <> 0 THEN CAST(1048576 AS BIGINT) ELSE CAST(floor(value*1000) AS BIGINT)+1 END AS size,
 epoch_us(ts) AS modified_at_us,
 CASE event_type WHEN 'signup' THEN CASE WHEN event_id % 4 = 0 THEN 'mp4_header_only' ELSE 'webm_continuation' END
   WHEN 'purchase' THEN CASE event_id % 3 WHEN 0 THEN 'webm_mkv' WHEN 1 THEN 'mp4_complete' ELSE 'jpeg' END
   WHEN 'view' THEN CASE WHEN event_id % 5 = 0 THEN 'mp3' ELSE 'mp4_fragment' END
   ELSE NULL END AS file_type,
 CASE WHEN event_id % 2 = 0 THEN concat('"k', json_extract_string(props,'$.k'), '"') END AS etag,
 CASE WHEN event_id % 5 = 0 THEN concat('bytes 0-1048575/', json_extract_string(props,'$.k'), '00000') END AS content_range,
 CASE event_id % 6 WHEN 0 THEN 'video/mp4' WHEN 1 THEN 'Text/CSS; charset=utf-8' WHEN 2 THEN 'application/octet-stream' WHEN 3 THEN 'image/png' END AS content_type,
 CASE WHEN event_type = 'signup' AND event_id % 4 = 0 THEN CAST(event_id % 40 + 1 AS BIGINT) * 262144 END AS mdat_size, CAST(32 AS BIGINT) AS mdat_offset FROM events""",
    "fx_entries": r"""
SELECT concat('dir', CAST(o_custkey % 4 AS STRING)) AS cache_dir, concat('1/0/https://cdn.example.org/v/', CAST(o_orderkey AS STRING), '.mp4') AS url,
 o_orderstatus <> 'F' AS is_sparse, epoch_us(o_orderdate) AS creation_time_us, CAST(o_orderkey AS BIGINT) AS ord, CAST(CASE WHEN o_orderkey % 5 = 0 THEN 777 ELSE 0 END AS BIGINT) AS body_size FROM orders WHERE o_orderkey % 11 <> 0""",
    "fx_children": r"""
SELECT concat('dir', CAST(o_custkey % 4 AS STRING)) AS cache_dir,
 concat('Range_1/0/https://cdn.example.org/v/', CAST(l_orderkey AS STRING), '.mp4:', lpad(lower(to_hex(l_partkey+65536)),16,'0'), ':', lower(to_hex(CAST(l_linenumber-1 AS BIGINT)))) AS child_key,
 CAST(l_quantity*20971 AS BIGINT) AS size, concat('f_', lpad(lower(to_hex(l_orderkey*8+l_linenumber)),6,'0')) AS file_name,
 l_returnflag <> 'R' AS is_external
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "fx_bodies": r"""
SELECT doc_id, source AS cache_dir, CASE doc_id % 8 WHEN 0 THEN '89504e470d0a1a0a' WHEN 1 THEN 'ffd8ffe0' WHEN 2 THEN '524946460000000057454250'
 WHEN 3 THEN '1a45dfa3' WHEN 4 THEN '0000001c667479706d703432' WHEN 5 THEN '00000100' WHEN 6 THEN '00000200' || '6d6f6f66' ELSE '' END || lower(hex(encode(text))) AS body_hex FROM documents""",
    "fx_media_urls": r"""
SELECT event_id, concat(CASE event_id % 3 WHEN 0 THEN 'https://cdn.discordapp.com' WHEN 1 THEN 'https://media.discordapp.net' ELSE 'https://img.example.org' END,
 CASE event_type WHEN 'click' THEN '/attachments/' WHEN 'view' THEN '/ephemeral-attachments/' WHEN 'signup' THEN '/avatars/' WHEN 'purchase' THEN '/emojis/' ELSE '/external/' END,
 CAST((((epoch_us(ts) // 1000)) - 1420070400000) * 4194304 + user_id AS STRING), '/', CAST((((epoch_us(ts) // 1000)) - 1420070400000) * 4194304 + event_id AS STRING), '/my%20clip%20', CAST(event_id AS STRING), '.mp4?ex=', lower(to_hex(1704067200 + event_id)), '&is=', lower(to_hex(1704000000 + event_id)), '&hm=abc') AS url FROM events""",
    "fx_raw_headers": r"""
SELECT page_id, url, concat('HTTP/1.1 200 OK', chr(0), 'Content-Type: ', CASE page_id % 3 WHEN 0 THEN 'video/mp4' WHEN 1 THEN 'image/PNG; q=1' ELSE 'text/html' END, chr(0), 'content-length: ', CAST(length(html) AS STRING), chr(0),
 CASE page_id % 4 WHEN 0 THEN 'Content-Disposition: attachment; filename="a b.mp4"' WHEN 1 THEN 'Content-Disposition: inline; filename*=UTF-8''''na%20me.png; x=1' WHEN 2 THEN 'Content-Disposition: attachment; filename=plain.gif' ELSE 'ETag: "p"' END, chr(0), chr(0)) AS raw_headers FROM pages""",
    "fx_ranges": r"""
SELECT l_orderkey AS resource_id, CAST(l_linenumber-1 AS BIGINT) * 1048576 AS range_offset, CAST(l_quantity*20971 AS BIGINT) AS range_length, l_partkey AS seq FROM lineitem""",
    "fx_boxes": r"""
SELECT l_orderkey AS file_id, CAST(l_linenumber AS BIGINT) * 65536 + l_partkey % 65536 AS box_offset, l_suppkey AS tie, CAST(l_quantity*100 AS BIGINT) AS box_size, CASE l_returnflag WHEN 'R' THEN 'moov' WHEN 'A' THEN 'mdat' ELSE 'free' END AS box_type FROM lineitem""",
}

_TABLES = {"fx_files": ["events"], "fx_entries": ["orders"], "fx_children": ["lineitem", "orders"], "fx_bodies": ["documents"], "fx_media_urls": ["events"], "fx_raw_headers": ["pages"], "fx_ranges": ["lineitem"], "fx_boxes": ["lineitem"]}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One projection over the tables of ``sf_dir``."""
    query = SPARK[name]
    frames = {}
    for table in _TABLES[name]:
        query = _named(query, table)
        frames[table] = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spark.sql(query, **frames)


def _named(query: str, table: str) -> str:
    for word in ("FROM", "JOIN"):
        query = query.replace(f"{word} {table}", f"{word} {{{table}}}")
    return query
