"""File types by leading bytes, by MIME type and by URL; categories and extensions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Leading bytes and type, in the order in which they are tried. Fixed values.
SIGNATURES = [
    ("89504E470D0A1A0A", "png"), ("FFD8FF", "jpeg"), ("474946383761", "gif"), ("474946383961", "gif"),
    ("424D", "bmp"), ("49492A00", "tiff"), ("4D4D002A", "tiff"), ("00000100", "ico"), ("52494646", "riff"),
    ("1A45DFA3", "webm_mkv"), ("464C5601", "flv"), ("47", "mpeg_ts"), ("494433", "mp3"), ("FFFB", "mp3"),
    ("FFF3", "mp3"), ("FFF2", "mp3"), ("FFFE", "mp3"), ("4F676753", "ogg"), ("664C6143", "flac"),
    ("3026B2758E66CF11A6D900AA0062CE6C", "wma"),
]
#: Forms of RIFF files, brands of ISO media files (also the ones that need all four bytes), boxes of fragments. Fixed values.
RIFF_FORMS = {"57454250": "webp", "41564920": "avi", "57415645": "wav"}
BRANDS = {"avif": "avif", "avis": "avif", "heic": "heic", "hevc": "heic", "mif1": "heic", "msf1": "heic"}
STRICT_BRANDS = {"M4A ": "m4a", "m4a ": "m4a", "M4B ": "m4a", "M4P ": "m4a", "qt  ": "mov"}
FRAGMENT_BOXES = ("styp", "moof", "sidx", "mdat")

#: MIME type to file type. Fixed values.
MIME_TYPES = {
    "video/mp4": "mp4_complete", "video/webm": "webm_mkv", "video/x-matroska": "webm_mkv", "video/x-flv": "flv",
    "video/x-msvideo": "avi", "video/quicktime": "mov", "video/mp2t": "mpeg_ts",
    "audio/mpeg": "mp3", "audio/mp3": "mp3", "audio/aac": "aac", "audio/ogg": "ogg", "audio/flac": "flac",
    "audio/wav": "wav", "audio/x-wav": "wav", "audio/mp4": "m4a", "audio/x-m4a": "m4a", "audio/x-ms-wma": "wma",
    "image/png": "png", "image/jpeg": "jpeg", "image/gif": "gif", "image/webp": "webp", "image/bmp": "bmp",
    "image/tiff": "tiff", "image/x-icon": "ico", "image/vnd.microsoft.icon": "ico", "image/avif": "avif",
    "image/heic": "heic", "image/heif": "heic",
}

#: Types of each category, and the extension of each type. Fixed values.
CATEGORIES = {
    "image": ["png", "jpeg", "gif", "webp", "bmp", "tiff", "ico", "avif", "heic"],
    "video": ["mp4_complete", "mp4_chunked", "mp4_header_only", "webm_mkv", "avi", "flv", "mpeg_ts", "wmv", "mov", "mp4_fragment", "webm_continuation"],
    "audio": ["mp3", "aac", "ogg", "flac", "wav", "opus", "wma", "m4a"],
}
EXTENSIONS = {
    "png": ".png", "jpeg": ".jpg", "gif": ".gif", "webp": ".webp", "bmp": ".bmp", "tiff": ".tiff", "ico": ".ico",
    "avif": ".avif", "heic": ".heic", "mp4_complete": ".mp4", "mp4_chunked": ".mp4", "mp4_header_only": ".mp4",
    "mp4_fragment": ".mp4", "webm_mkv": ".webm", "webm_continuation": ".webm", "avi": ".avi", "flv": ".flv",
    "mpeg_ts": ".ts", "wmv": ".wmv", "mov": ".mov", "mp3": ".mp3", "aac": ".aac", "ogg": ".ogg", "flac": ".flac",
    "wav": ".wav", "opus": ".opus", "wma": ".wma", "m4a": ".m4a",
}
IMAGE_MIME = {
    "png": "image/png", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp",
    "tiff": "image/tiff", "ico": "image/x-icon", "avif": "image/avif", "heic": "image/heic",
}
#: Content types of files that are no media, and suffixes of URL paths with their types. Fixed values.
NON_MEDIA_PREFIXES = (
    "font/", "text/", "application/javascript", "application/json", "application/xml",
    "application/wasm", "application/x-font", "application/font", "application/octet-stream",
)
URL_SUFFIXES = [("mp4|m4v", "mp4_complete"), ("webm|mkv", "webm_mkv"), ("gif", "gif"), ("png", "png"), ("jpg|jpeg", "jpeg"), ("webp", "webp")]


def lookup(table: dict[str, str], key: Column) -> Column:
    """The value of ``key`` in a small fixed table, null if it has none."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def detect_file_type(head: Column, strict_brands: bool = False) -> Column:
    """Type of a file by its first bytes (at least 189 of them decide a transport stream). The first
    rule that holds decides; a first byte 47 without the repeated sync byte is null at once.
    ``strict_brands`` also tells audio and QuickTime brands, which are ``mp4_complete`` otherwise."""
    h = F.hex(F.substring(head, 1, 16))
    out = None
    for prefix, kind in SIGNATURES:
        if kind == "riff":
            value = F.coalesce(lookup(RIFF_FORMS, F.substring(h, 17, 8)), F.lit("riff_unknown"))
        elif kind == "mpeg_ts":
            value = F.when(F.hex(F.substring(head, 189, 1)) == "47", kind)
        else:
            value = F.lit(kind)
        hit = h.startswith(prefix)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    out = out.when(h.rlike("^FFF[2-7A-F]"), "aac")
    size = F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")
    box = F.substring(h, 9, 8)
    brand = F.substring(h, 17, 8)

    def as_hex(text: str) -> str:
        return text.encode("latin-1").hex().upper()

    brands = BRANDS | (STRICT_BRANDS if strict_brands else {})
    out = out.when((F.length(h) >= 24) & (box == as_hex("ftyp")) & size.between(8, 512), F.coalesce(lookup({as_hex(k): v for k, v in brands.items()}, brand), F.lit("mp4_complete")))
    out = out.when((F.length(h) >= 16) & box.isin([as_hex(b) for b in FRAGMENT_BOXES]) & size.between(8, 50_000_000), "mp4_fragment")
    return out.when(h.startswith("1F43B675"), "webm_continuation")


def bare_mime(mime: Column) -> Column:
    """A MIME type in lower case, without parameters."""
    return F.trim(F.element_at(F.split(F.lower(mime), ";"), 1))


def mime_to_file_type(mime: Column) -> Column:
    return lookup(MIME_TYPES, bare_mime(mime))


def media_category(kind: Column) -> Column:
    return F.coalesce(lookup({t: c for c, types in CATEGORIES.items() for t in types}, kind), F.lit("other"))


def file_extension(kind: Column) -> Column:
    return F.coalesce(lookup(EXTENSIONS, kind), F.lit(".bin"))


def is_known_non_media(content_type: Column) -> Column:
    """Whether the index says that a file is no media, so that it can be no chunk."""
    bare = bare_mime(content_type)
    hit = F.lit(False)
    for p in NON_MEDIA_PREFIXES:
        hit = hit | bare.startswith(p)
    return F.coalesce(hit, F.lit(False))


def inline_image(kind: Column, body: Column) -> Column:
    """A body of one of nine image types as a data URL, else null."""
    return F.concat(F.lit("data:"), lookup(IMAGE_MIME, kind), F.lit(";base64,"), F.regexp_replace(F.base64(body), "[\\r\\n]", ""))
