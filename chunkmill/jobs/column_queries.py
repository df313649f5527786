"""Queries of the column functions, over the fixtures, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import headers, media, names, urls, values
from .fixtures import ORACLE, fixture

QUERIES, SQL = {}, {}


def _sql_map(table: dict[str, str], key: str, default: str = "NULL") -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {default} END"


def query(fx: str, sql: str):
    """Register a function of (fixture frame) with the SQL over ``fx``."""

    def wrap(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(fixture(spark, sf_dir, fx))
        SQL[f.__name__] = f"WITH fx AS ({ORACLE[fx]}) {sql}"
        return f

    return wrap


@query("fx_files", "SELECT name, CAST(regexp_full_match(name, 'f_[0-9a-fA-F]{6}|[0-9a-fA-F]{16}_[01s]') AS BOOLEAN) AS is_cache, regexp_full_match(name || 'x', 'f_[0-9a-fA-F]{6}|[0-9a-fA-F]{16}_[01s]') AS other FROM fx")
def p1_is_cache_file(fx):
    return fx.select("name", names.is_cache_file(F.col("name")).alias("is_cache"), names.is_cache_file(F.concat("name", F.lit("x"))).alias("other"))


@query(
    "fx_files",
    """, n AS (SELECT hex_value, CASE WHEN hex_value % 3 = 0 THEN name ELSE lpad(lower(to_hex(hex_value)), 16, '0') || CASE hex_value % 3 WHEN 1 THEN '_0' ELSE '_s' END END AS name FROM fx)
    SELECT name, CASE WHEN name LIKE 'f#_%' ESCAPE '#' THEN 'blockfile' ELSE 'simple' END AS layout,
    CASE WHEN name LIKE 'f#_%' ESCAPE '#' THEN hex_value END AS hex_value,
    CASE WHEN name NOT LIKE 'f#_%' ESCAPE '#' THEN substr(name, 1, 16) END AS hash, CASE WHEN name NOT LIKE 'f#_%' ESCAPE '#' THEN substr(name, 18, 1) END AS stream FROM n""",
)
def p2_parse_cache_name(fx):
    simple = F.concat(F.lpad(F.lower(F.hex("hex_value")), 16, "0"), F.when(F.col("hex_value") % 3 == 1, "_0").otherwise("_s"))
    return names.parse_cache_name(fx.select(F.when(F.col("hex_value") % 3 == 0, F.col("name")).otherwise(simple).alias("name")))


@query(
    "fx_bodies",
    """, h AS (SELECT doc_id, body_hex, upper(substr(body_hex, 1, 32)) AS h, upper(substr(body_hex, 377, 2)) AS again FROM fx),
    b AS (SELECT *, CASE WHEN length(h) >= 8 THEN TRY_CAST('0x' || substr(h, 1, 8) AS BIGINT) END AS size, substr(h, 9, 8) AS box FROM h)
    SELECT doc_id, CASE """
    + " ".join(
        f"WHEN h LIKE '{p}%' THEN "
        + ("CASE substr(h, 17, 8) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in media.RIFF_FORMS.items()) + " ELSE 'riff_unknown' END" if t == "riff" else "CASE WHEN again = '47' THEN 'mpeg_ts' END" if t == "mpeg_ts" else f"'{t}'")
        for p, t in media.SIGNATURES
    )
    + """ WHEN regexp_matches(h, '^FFF[2-7A-F]') THEN 'aac'
    WHEN length(h) >= 24 AND box = '66747970' AND size BETWEEN 8 AND 512 THEN CASE substr(h, 17, 8) WHEN '61766966' THEN 'avif' WHEN '61766973' THEN 'avif' WHEN '68656963' THEN 'heic' WHEN '68657663' THEN 'heic' WHEN '6D696631' THEN 'heic' WHEN '6D736631' THEN 'heic' ELSE 'mp4_complete' END
    WHEN length(h) >= 16 AND box IN ('73747970', '6D6F6F66', '73696478', '6D646174') AND size BETWEEN 8 AND 50000000 THEN 'mp4_fragment'
    WHEN h LIKE '1F43B675%' THEN 'webm_continuation' END AS file_type FROM b""",
)
def p3_detect_file_type(fx):
    return fx.select("doc_id", media.detect_file_type(F.unhex("body_hex")).alias("file_type"))


@query("fx_files", f"SELECT name, {_sql_map(media.MIME_TYPES, chr(39).join(['trim(split_part(lower(content_type), ', ';', ', 1))']))} AS kind FROM fx")
def p4_mime_to_file_type(fx):
    return fx.select("name", media.mime_to_file_type(F.col("content_type")).alias("kind"))


@query(
    "fx_files",
    f"""SELECT name, {_sql_map({t: c for c, ts in media.CATEGORIES.items() for t in ts}, "file_type", "'other'")} AS category,
    {_sql_map(media.EXTENSIONS, "file_type", "'.bin'")} AS extension FROM fx""",
)
def p5_category_and_extension(fx):
    return fx.select("name", media.media_category(F.col("file_type")).alias("category"), media.file_extension(F.col("file_type")).alias("extension"))


@query("fx_media_urls", "SELECT event_id, CASE WHEN regexp_matches(url, '/my%20clip%20[0-9]+[.]mp4[?]') THEN 'mp4_complete' END AS kind FROM fx")
def p6_url_file_type(fx):
    return fx.select("event_id", urls.url_file_type(F.col("url")).alias("kind"))


@query(
    "fx_files",
    """SELECT name, coalesce(regexp_matches(trim(split_part(lower(content_type), ';', 1)),
    '^(font/|text/|application/javascript|application/json|application/xml|application/wasm|application/x-font|application/font|application/octet-stream)'), false) AS non_media FROM fx""",
)
def p11_is_known_non_media(fx):
    return fx.select("name", media.is_known_non_media(F.col("content_type")).alias("non_media"))


_PATHS = "CASE hex_value % 6 WHEN 0 THEN '/home/u/.config/discord/Cache' WHEN 1 THEN 'C:\\U\\Google\\Chrome\\Profile 2\\Cache' WHEN 2 THEN '/x/BraveSoftware/Profile 7/Cache' WHEN 3 THEN '/y/discordcanary/Cache' WHEN 4 THEN '/z/microsoft-edge/Default' ELSE '/tmp/opera' END"


@query(
    "fx_files",
    f""", p AS (SELECT name, {_PATHS} AS path FROM fx) SELECT name, CASE WHEN path LIKE '%discordcanary%' THEN 'Discord Canary' WHEN path LIKE '%discord/%' THEN 'Discord'
    WHEN path LIKE '%Brave%' THEN 'Brave (Profile 7)' WHEN path LIKE '%Google%' THEN 'Chrome (Profile 2)' WHEN path LIKE '%edge%' THEN 'Edge' ELSE 'Opera' END AS client,
    CASE WHEN path LIKE '%Cache' THEN 'Cache' WHEN path LIKE '%Default' THEN 'Default' ELSE 'opera' END AS base FROM p""",
)
def p16_client_name(fx):
    path = F.expr(_PATHS.replace("\\", "\\\\"))
    return fx.select("name", names.client_name(path).alias("client"), names.file_basename(path).alias("base"))


@query("fx_entries", "SELECT url, CASE WHEN creation_time_us % 7 = 0 THEN NULL ELSE CAST(creation_time_us + 11644473600000000 AS DOUBLE) / 1e6 - 11644473600.0 END AS unix_s FROM fx")
def f1_webkit_us_to_unix(fx):
    return fx.select("url", values.webkit_us_to_unix(F.when(F.col("creation_time_us") % 7 == 0, F.lit(0)).otherwise(F.col("creation_time_us") + 11644473600000000)).alias("unix_s"))


@query(
    "fx_media_urls",
    """, s AS (SELECT event_id, split_part(split_part(url, '?', 1), '/', 6) AS id FROM fx)
    SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE (CAST(id AS BIGINT) >> 22) + 1420070400000 END AS ms FROM s""",
)
def f2_snowflake_to_ms(fx):
    part = F.element_at(F.split(F.substring_index("url", "?", 1), "/"), 6)
    return fx.select("event_id", urls.snowflake_to_ms(F.when(F.col("event_id") % 5 == 0, F.lit("nope")).otherwise(part)).alias("ms"))


@query("fx_entries", "SELECT url, substr(url, 5) AS stripped FROM fx")
def f3_strip_cache_key_prefix(fx):
    return fx.select("url", urls.strip_cache_key_prefix(F.col("url")).alias("stripped"))


@query(
    "fx_children",
    """SELECT child_key, regexp_extract(child_key, '^Range_(.*):[0-9a-f]{16}:[0-9a-f]+$', 1) AS parent_url,
    CAST('0x' || regexp_extract(child_key, ':([0-9a-f]+)$', 1) AS BIGINT) AS child_id, CAST('0x' || regexp_extract(child_key, ':([0-9a-f]+)$', 1) AS BIGINT) * 1048576 AS offset_bytes, CAST(NULL AS VARCHAR) AS reject_reason FROM fx""",
)
def f4_parse_child_key(fx):
    return fx.select("child_key", values.parse_child_key(F.col("child_key")).alias("k")).select("child_key", "k.*")


@query("fx_files", "SELECT name, CASE WHEN TRY_CAST(regexp_extract(content_range, '/([0-9]+)$', 1) AS BIGINT) > 0 THEN CAST(regexp_extract(content_range, '/([0-9]+)$', 1) AS BIGINT) END AS total FROM fx")
def f5_content_range_total(fx):
    return fx.select("name", headers.content_range_total(F.col("content_range")).alias("total"))


_NAME_SQL = "CASE page_id % 4 WHEN 0 THEN 'a b.mp4' WHEN 1 THEN 'na me.png' WHEN 2 THEN 'plain.gif' END"
_TYPE_SQL = "CASE page_id % 3 WHEN 0 THEN 'video/mp4' WHEN 1 THEN 'image/PNG; q=1' ELSE 'text/html' END"


@query("fx_raw_headers", f"SELECT page_id, 'HTTP/1.1 200 OK' AS status_line, {_TYPE_SQL} AS content_type, CAST(regexp_extract(raw_headers, 'content-length: ([0-9]+)', 1) AS BIGINT) AS content_length, {_NAME_SQL} AS filename FROM fx")
def f6_parse_raw_headers(fx):
    return fx.select("page_id", headers.parse_raw_headers(F.col("raw_headers")).alias("h")).select("page_id", "h.status_line", "h.content_type", "h.content_length", "h.filename")


@query("fx_raw_headers", f"SELECT page_id, {_NAME_SQL} AS filename FROM fx")
def f7_disposition_filename(fx):
    return fx.select("page_id", headers.disposition_filename(F.regexp_extract("raw_headers", "Content-Disposition: ([^\\x00]*)", 1)).alias("filename"))


@query("fx_media_urls", "SELECT event_id, replace(url, '%20', ' ') AS decoded, CAST(event_id AS VARCHAR) || '% 100%zz+' AS odd FROM fx")
def f8_percent_decode(fx):
    return fx.select("event_id", urls.lenient_decode(F.col("url")).alias("decoded"), urls.lenient_decode(F.concat(F.col("event_id").cast("string"), F.lit("%25 100%zz+"))).alias("odd"))


@query("fx_raw_headers", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'video/mp4' WHEN 1 THEN 'image/png' ELSE 'text/html' END AS content_type FROM fx")
def f9_simple_content_type(fx):
    return fx.select("page_id", headers.simple_content_type(F.col("raw_headers")).alias("content_type"))


@query(
    "fx_media_urls",
    """, s AS (SELECT event_id, url, split_part(url, '/', 3) AS host, split_part(split_part(url, '?', 1), '/', 4) AS first, split_part(split_part(url, '?', 1), '/', 5) AS a, split_part(split_part(url, '?', 1), '/', 6) AS b,
        event_id AS e FROM fx),
    k AS (SELECT *, first IN ('attachments', 'ephemeral-attachments') AS att FROM s WHERE host IN ('cdn.discordapp.com', 'media.discordapp.net'))
    SELECT event_id, CASE first WHEN 'attachments' THEN 'attachment' WHEN 'ephemeral-attachments' THEN 'ephemeral_attachment' WHEN 'avatars' THEN 'avatar' WHEN 'emojis' THEN 'emoji' WHEN 'external' THEN 'external_proxy' ELSE 'other' END AS kind,
    CASE WHEN att THEN 'my clip ' || CAST(e AS VARCHAR) || '.mp4' END AS filename, CASE WHEN att THEN a END AS channel_id, CASE WHEN first = 'avatars' THEN a END AS user_id,
    CASE WHEN att THEN b WHEN first IN ('avatars', 'emojis') THEN a END AS resource_id,
    CASE WHEN att THEN (CAST(b AS BIGINT) >> 22) + 1420070400000 WHEN first IN ('avatars', 'emojis') THEN (CAST(a AS BIGINT) >> 22) + 1420070400000 END AS uploaded_at,
    CASE WHEN att THEN (CAST(a AS BIGINT) >> 22) + 1420070400000 END AS channel_created_at,
    CASE WHEN att THEN (1704067200 + e) * 1000 END AS expires_at, CASE WHEN att THEN (1704000000 + e) * 1000 END AS issued_at,
    host = 'media.discordapp.net' OR first = 'external' AS is_media_proxy, replace(url, '&hm=abc', '') AS clean_url FROM k""",
)
def f10_parse_cdn_url(fx):
    return fx.select("event_id", urls.parse_cdn_url(F.col("url")).alias("c")).where("c is not null").select("event_id", "c.*")


@query("fx_media_urls", "SELECT event_id, 'my clip ' || CAST(event_id AS VARCHAR) || '.mp4' AS base FROM fx")
def f11_url_basename(fx):
    return fx.select("event_id", urls.url_basename(F.col("url")).alias("base"))


@query("fx_files", "SELECT name, name AS base, 'b' AS base2 FROM fx")
def f12_file_basename(fx):
    return fx.select("name", names.file_basename(F.concat(F.lit("/c/d\\"), F.col("name"))).alias("base"), names.file_basename(F.lit("C:\\a/b")).alias("base2"))


@query(
    "fx_files",
    """, s AS (SELECT name, size * (hex_value % 5000 + 1) AS size, CAST(hex_value % 9000 AS BIGINT) AS seconds FROM fx),
    u AS (SELECT *, CASE WHEN size < 1024 THEN 0 WHEN size < 1048576 THEN 1 WHEN size < 1073741824 THEN 2 ELSE 3 END AS i FROM s)
    SELECT name, regexp_replace(printf('%.2f', round(size / CAST(1::BIGINT << (10 * i) AS DOUBLE), 2)), '[.]?0+$', '') || ' ' || ['B', 'KB', 'MB', 'GB'][i + 1] AS bytes,
    CASE WHEN seconds <= 0 THEN '0:00' WHEN seconds >= 3600 THEN printf('%d:%02d:%02d', seconds // 3600, seconds % 3600 // 60, seconds % 60) ELSE printf('%d:%02d', seconds // 60, seconds % 60) END AS duration FROM u""",
)
def f13_format(fx):
    return fx.select("name", values.format_bytes(F.col("size") * (F.col("hex_value") % 5000 + 1)).alias("bytes"), values.format_duration(F.col("hex_value") % 9000).alias("duration"))


@query(
    "fx_files",
    """, a AS (SELECT name, ((hex_value * 2654435761) & 4294967295) AS a FROM fx),
    d AS (SELECT name, (a & 2147483648) <> 0 AS initialised, (a >> 28) & 7 AS file_type, a & 268435455 AS number, (a >> 16) & 255 AS sel, a & 65535 AS start, ((a >> 24) & 3) + 1 AS n FROM a)
    SELECT name, initialised, file_type, CASE WHEN file_type = 0 THEN number END AS file_no, CASE WHEN file_type <> 0 THEN sel END AS selector, CASE WHEN file_type <> 0 THEN start END AS start_block,
    CASE WHEN file_type <> 0 THEN n END AS block_count, CASE WHEN initialised THEN CASE WHEN file_type = 0 THEN 'f_' || printf('%06x', number) ELSE 'data_' || CAST(sel AS VARCHAR) END END AS file_name,
    CASE WHEN file_type <> 0 THEN start * [36, 256, 1024, 4096, 8, 104, 48][file_type] + 8192 END AS byte_offset FROM d""",
)
def f14_decode_cache_addr(fx):
    addr = (F.col("hex_value") * F.lit(2654435761).cast("bigint")).bitwiseAND(F.lit(4294967295))
    return fx.select("name", values.decode_cache_addr(addr).alias("d")).select("name", "d.*")


@query("fx_files", "SELECT name, strftime(make_timestamp(modified_at_us // 1000000 * 1000000), '%Y-%m-%d %H:%M:%S') AS formatted FROM fx")
def f15_epoch_format(fx):
    return fx.select("name", values.epoch_format(F.floor(F.col("modified_at_us") / 1000000)).alias("formatted"))


@query("fx_bodies", f"SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN 'data:image/png;base64,' || to_base64(unhex(body_hex)) WHEN doc_id % 8 = 1 THEN 'data:image/jpeg;base64,' || to_base64(unhex(body_hex)) WHEN doc_id % 8 = 2 THEN 'data:image/webp;base64,' || to_base64(unhex(body_hex)) WHEN doc_id % 8 = 5 THEN 'data:image/x-icon;base64,' || to_base64(unhex(body_hex)) END AS data_url FROM fx WHERE doc_id % 8 IN (0, 1, 2, 3, 5)")
def u8_inline_image(fx):
    body = F.unhex("body_hex")
    return fx.where("doc_id % 8 IN (0, 1, 2, 3, 5)").select("doc_id", media.inline_image(media.detect_file_type(body), body).alias("data_url"))


# the type of every body, as p3_detect_file_type has it
_TYPED = SQL["p3_detect_file_type"].replace("SELECT doc_id, CASE", "SELECT doc_id, body_hex, CASE")


@query("fx_bodies", f", t AS ({_TYPED}), m AS (SELECT *, {_sql_map(media.IMAGE_MIME, 'file_type')} AS mime FROM t) SELECT doc_id, 'data:' || mime || ';base64,' || to_base64(unhex(body_hex)) AS data_url FROM m")
def u8_inline_image_all(fx):
    body = F.unhex("body_hex")
    return fx.select("doc_id", media.inline_image(media.detect_file_type(body), body).alias("data_url"))
