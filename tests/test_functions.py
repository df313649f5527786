"""Column functions on single values: signature order, lenient decoding, edge cases."""

import pytest
from pyspark.sql import functions as F

from chunkmill.functions import headers, media, names, urls, values

HEADS = [
    (b"\x89PNG\r\n\x1a\n", "png"), (b"\xff\xd8\xff\xe0", "jpeg"), (b"GIF89a", "gif"), (b"GIF88a", None), (b"BM", "bmp"), (b"\xff\xfe<\x00", "mp3"),
    (b"\xff\xf1\x50\x80", None), (b"\xff\xf6", "aac"), (b"\xff\xfb\x90", "mp3"), (b"RIFF\x00\x00\x00\x00WAVE", "wav"), (b"RIFF\x00\x00", "riff_unknown"),
    (b"G" + b"\x00" * 187 + b"G", "mpeg_ts"), (b"G" + b"\x00" * 200, None), (b"G\x00\x00\x1cftypmp42", None), (b"\x00\x00\x00\x1cftypM4A ", "mp4_complete"), (b"\x00\x00\x00\x1cftypqt  ", "mp4_complete"),
    (b"\x00\x00\x00\x1cftypavif", "avif"), (b"\x00\x00\x00\x1cftypheic", "heic"), (b"\x00\x00\x02\x01ftypmp42", None), (b"\x00\x00\x00\x07ftypmp42", None), (b"\x00\x00\x00\x10moof", "mp4_fragment"),
    (b"\x7f\x00\x00\x10mdat", None), (b"\x00\x00\x00\x10mdat", "mp4_fragment"), (b"\x1f\x43\xb6\x75", "webm_continuation"), (b"\x1a\x45\xdf\xa3", "webm_mkv"), (b"", None), (b"\x00", None), (None, None), (b"0&\xb2u\x8ef\xcf\x11\xa6\xd9\x00\xaa\x00b\xcel", "wma"),
]


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first().r


def test_detect_file_type(spark):
    df = spark.createDataFrame([(i, bytearray(h) if h is not None else None) for i, (h, _) in enumerate(HEADS)], "i int, h binary")
    got = {r.i: r.t for r in df.select("i", media.detect_file_type(F.col("h")).alias("t")).collect()}
    assert [got[i] for i in range(len(HEADS))] == [t for _, t in HEADS]
    assert one(spark, bytearray(b"\x00\x00\x00\x1cftypM4A "), "binary", lambda c: media.detect_file_type(c, strict_brands=True)) == "m4a"


@pytest.mark.parametrize(
    ("text", "want"), [("a%20b", "a b"), ("100%", "100%"), ("%zz+x", "%zz+x"), ("%C3%A9", "é"), ("", ""), (None, None)]
)
def test_lenient_decode(spark, text, want):
    assert one(spark, text, "string", urls.lenient_decode) == want


@pytest.mark.parametrize(
    ("key", "want"),
    [
        ("Range_http://a/b:00ff:1f", ("http://a/b", 31, 31 << 20, None)), ("Range_http://a/b:zz:3", ("http://a/b:zz", 3, 3 << 20, None)), ("Range_x:abc:q", ("x:abc", 0, 0, None)),
        ("nope", (None, None, None, "no-prefix")), ("Range_nocolon", (None, None, None, "no-colon")),
    ],
)
def test_child_keys(spark, key, want):
    assert tuple(one(spark, key, "string", values.parse_child_key)) == want


def test_headers(spark):
    raw = "HTTP/1.1 206\0Content-Type: a/B\0content-type: c/D; x\0Content-Length: many\0bad line\0Content-Disposition: x; filename*=UTF-8''a%20b; filename=\"c\"\0\0"
    h = one(spark, raw, "string", headers.parse_raw_headers)
    assert (h.status_line, h.content_type, h.content_length, h.filename) == ("HTTP/1.1 206", "c/D; x", None, "a b")
    assert one(spark, raw, "string", headers.simple_content_type) == "a/b"
    assert one(spark, "", "string", headers.parse_raw_headers).status_line is None
    assert one(spark, None, "string", headers.simple_content_type) is None
    for text, want in (("bytes 0-1/20", 20), ("bytes 0-1/0", None), ("bytes */*", None), (None, None)):
        assert one(spark, text, "string", headers.content_range_total) == want


def test_cdn_urls(spark):
    assert one(spark, "1/0/https://cdn.discordapp.com/emojis/175928847299117063.png", "string", urls.parse_cdn_url) is None
    c = one(spark, "1/0/https://cdn.discordapp.com/emojis/175928847299117063.png?x=1&hm=2", "string", lambda k: urls.parse_cdn_url(k, strip_prefix=True))
    assert (c.kind, c.resource_id, c.uploaded_at, c.clean_url) == ("emoji", "175928847299117063", 1462015105796, "https://cdn.discordapp.com/emojis/175928847299117063.png?x=1")
    assert one(spark, "https://cdn.discordapp.com/attachments/", "string", urls.parse_cdn_url).resource_id is None
    assert one(spark, "https://elsewhere.org/a", "string", urls.parse_cdn_url) is None


@pytest.mark.parametrize(("size", "want"), [(0, "0 B"), (1023, "1023 B"), (1024, "1 KB"), (1536, "1.5 KB"), (1 << 20, "1 MB"), ((1 << 40) * 3, "3 TB"), (None, None)])
def test_format_bytes(spark, size, want):
    assert one(spark, size, "bigint", values.format_bytes) == want


def test_names(spark):
    for name, want in (("f_00ABcd", True), ("f_00abc", False), ("0123456789abcdef_s", True), ("0123456789abcdef_2", False)):
        assert one(spark, name, "string", names.is_cache_file) is want
    assert one(spark, "C:\\a\\b/c.bin", "string", names.file_basename) == "c.bin"
