"""URLs of cache entries and of a signed media CDN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .media import URL_SUFFIXES

#: First instant of the ids that carry a time (2015-01-01, ms), and the CDN's hosts. Fixed values.
SNOWFLAKE_EPOCH_MS = 1_420_070_400_000
CDN_HOST, PROXY_HOST = "cdn.discordapp.com", "media.discordapp.net"


def strip_cache_key_prefix(key: Column) -> Column:
    """The URL of a cache key such as ``1/0/https://...``; other keys are left as they are."""
    url = F.regexp_extract(key, r"^\d+/\d+/(https?://.+)$", 1)
    return F.when(url != "", url).otherwise(key)


def path_segments(url: Column) -> Column:
    return F.filter(F.split(F.try_parse_url(url, F.lit("PATH")), "/"), lambda s: s != "")


def lenient_decode(text: Column) -> Column:
    """Percent decoding that leaves malformed escapes and plus signs as they are."""
    safe = F.regexp_replace(F.regexp_replace(text, r"%(?![0-9a-fA-F]{2})", "%25"), r"\+", "%2B")
    return F.coalesce(F.try_url_decode(safe), text)


def url_basename(url: Column) -> Column:
    """Last non-empty segment of the path, decoded; null without one."""
    return lenient_decode(F.try_element_at(path_segments(url), F.lit(-1)))


def url_file_type(url: Column) -> Column:
    path = F.lower(F.try_parse_url(url, F.lit("PATH")))
    out = None
    for suffixes, kind in URL_SUFFIXES:
        hit = path.rlike(rf"\.({suffixes})$")
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


def snowflake_to_ms(text: Column) -> Column:
    """Epoch milliseconds of an id that carries its time; null if it is no integer or not of 2015..2030."""
    ms = F.shiftrightunsigned(text.try_cast("bigint"), 22) + SNOWFLAKE_EPOCH_MS
    return F.when(F.year(F.timestamp_millis(ms)).between(2015, 2030), ms)


def _hex_ms(params: Column, name: str) -> Column:
    value = F.try_element_at(F.filter(params, lambda p: p.startswith(f"{name}=")), F.lit(1))
    return F.conv(F.regexp_extract(value, "^[^=]*=([0-9a-fA-F]+)", 1), 16, 10).cast("bigint") * 1000


def parse_cdn_url(key: Column, strip_prefix: bool = False) -> Column:
    """What a CDN URL says, as a struct (null for other hosts): ``kind``, ``filename``, ``channel_id``,
    ``user_id``, ``resource_id``, ``uploaded_at``, ``channel_created_at``, ``expires_at``,
    ``issued_at`` (epoch ms), ``is_media_proxy`` and ``clean_url`` (without its signature).
    The URL is cut once, and only where its host is one of the two."""
    url = strip_cache_key_prefix(key) if strip_prefix else key
    host = F.lower(F.substring_index(F.split_part(F.substring_index(F.substring_index(url, "#", 1), "?", 1), F.lit("/"), F.lit(3)), ":", 1))
    known = (url.startswith("https://") | url.startswith("http://")) & host.isin(CDN_HOST, PROXY_HOST)
    return F.when(known, F.element_at(F.transform(F.array(url), lambda u: F.element_at(F.transform(F.array(_cut(u)), _told), 1)), 1))


def _cut(url: Column) -> Column:
    """``base`` (before query and fragment), ``host``, ``parts`` of the path and ``params`` of the query."""
    bare = F.substring_index(url, "#", 1)
    base = F.substring_index(bare, "?", 1)
    pieces = F.filter(F.split(base, "/"), lambda s: s != "")
    params = F.filter(F.split(F.substr(bare, F.length(base) + 2), "&"), lambda p: p != "")
    return F.struct(base.alias("base"), F.lower(F.element_at(pieces, 2)).alias("host"), F.slice(pieces, 3, 8).alias("parts"), params.alias("params"))


def _told(cut: Column) -> Column:
    at = lambda i: F.try_element_at(cut["parts"], F.lit(i))
    first = at(1)
    attached = first.isin("attachments", "ephemeral-attachments")
    kind = (
        F.when(first == "attachments", "attachment").when(first == "ephemeral-attachments", "ephemeral_attachment").when(first == "avatars", "avatar")
        .when(first == "emojis", "emoji").when(first == "stickers", "sticker").when(first == "external", "external_proxy").otherwise("other")
    )
    resource = F.when(attached, at(3)).when(first == "avatars", at(2)).when(first.isin("emojis", "stickers"), F.element_at(F.split(at(2), r"\."), 1))
    query = F.filter(cut["params"], lambda p: ~(p.startswith("hm=") | (p == "hm")))
    clean = F.when(F.size(query) > 0, F.concat(cut["base"], F.lit("?"), F.array_join(query, "&"))).otherwise(cut["base"])
    proxied = F.substring_index(cut["host"], ":", 1) == PROXY_HOST
    return F.struct(
        kind.alias("kind"), F.when(attached, lenient_decode(at(4))).alias("filename"), F.when(attached, at(2)).alias("channel_id"),
        F.when(first == "avatars", at(2)).alias("user_id"), resource.alias("resource_id"), snowflake_to_ms(resource).alias("uploaded_at"),
        F.when(attached, snowflake_to_ms(at(2))).alias("channel_created_at"), F.when(attached, _hex_ms(cut["params"], "ex")).alias("expires_at"),
        F.when(attached, _hex_ms(cut["params"], "is")).alias("issued_at"), (proxied | F.coalesce(first == "external", F.lit(False))).alias("is_media_proxy"), clean.alias("clean_url"),
    )
