"""Times, sizes, cache addresses and child keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds from 1601-01-01 to 1970-01-01, and bytes of a sparse child. Fixed values.
WEBKIT_OFFSET_S = 11_644_473_600
CHILD_BYTES = 1 << 20


def webkit_us_to_unix(micros: Column) -> Column:
    """Unix seconds of microseconds since 1601; null unless positive."""
    return F.when(micros > 0, micros / F.lit(1e6) - F.lit(float(WEBKIT_OFFSET_S)))


def epoch_format(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss")


def format_bytes(size: Column) -> Column:
    """A size in units of 1024, with at most two decimals."""
    out = F.when(size == 0, "0 B")
    for i, unit in enumerate(("B", "KB", "MB", "GB", "TB")):
        hit = size < F.lit(1 << (10 * (i + 1)))
        value = F.regexp_replace(F.format_string("%.2f", F.round(size / F.lit(float(1 << (10 * i))), 2)), r"\.?0+$", "")
        text = F.concat(value, F.lit(" " + unit))
        out = out.when(hit if i < 4 else size.isNotNull(), text)
    return out


def format_duration(seconds: Column) -> Column:
    """h:mm:ss, or m:ss below an hour; 0:00 unless positive."""
    h, m, s = F.floor(seconds / 3600), F.floor((seconds % 3600) / 60), F.floor(seconds % 60)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    long = F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(s))
    return F.when(seconds <= 0, "0:00").when(h > 0, long).otherwise(F.concat(m.cast("string"), F.lit(":"), two(s)))


def _all_hex(text: Column, least: int, most: int) -> Column:
    return F.length(text).between(least, most) & (F.translate(text, "0123456789abcdefABCDEF", "") == "")


def parse_child_key(key: Column) -> Column:
    """Struct of ``parent_url``, ``child_id`` (hex after the last colon, bad: 0), ``offset_bytes``,
    ``reject_reason`` (no prefix, no colon, or an id whose offset passes 64 bits and is null). The signature before the id is
    dropped if it has four hex digits or more. Cuts at the last colons by length, without patterns."""
    rest = F.substr(key, F.lit(7))
    tail = F.substring_index(rest, ":", -1)
    body = F.left(rest, F.length(rest) - F.length(tail) - 1)
    signature = F.substring_index(body, ":", -1)
    signed = F.contains(body, F.lit(":")) & _all_hex(signature, 4, 1 << 30)
    parent = F.when(signed, F.left(body, F.length(body) - F.length(signature) - 1)).otherwise(body)
    child = F.when(_all_hex(tail, 1, 15), F.conv(tail, 16, 10).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    reason = F.when(~key.startswith("Range_"), "no-prefix").when(~F.contains(rest, F.lit(":")), "no-colon")
    ok, far = reason.isNull(), child >= (1 << 63) // CHILD_BYTES
    return F.struct(
        F.when(ok, parent).alias("parent_url"), F.when(ok, child).alias("child_id"), F.when(ok & ~far, child * CHILD_BYTES).alias("offset_bytes"), reason.when(far, "offset-overflow").alias("reject_reason")
    )


#: Bytes of a block by file type of an address (1..7). Fixed values.
BLOCK_BYTES = {1: 36, 2: 256, 3: 1024, 4: 4096, 5: 8, 6: 104, 7: 48}


def decode_cache_addr(addr: Column) -> Column:
    """Struct of an unsigned 32-bit address: ``initialised``, ``file_type``, ``file_no`` (of an
    external file) or ``selector``, ``start_block``, ``block_count``, ``file_name``, ``byte_offset``
    (after the 8,192-byte head of a block file)."""
    a = addr.cast("bigint")
    on = a.bitwiseAND(F.lit(0x80000000)) != 0
    kind = F.shiftright(a, 28).bitwiseAND(F.lit(7))
    external = kind == 0
    number = a.bitwiseAND(F.lit(0x0FFFFFFF))
    selector = F.shiftright(a, 16).bitwiseAND(F.lit(0xFF))
    start, count = a.bitwiseAND(F.lit(0xFFFF)), F.shiftright(a, 24).bitwiseAND(F.lit(3)) + 1
    size = F.lit(None).cast("bigint")
    for k, n in BLOCK_BYTES.items():
        size = F.when(kind == k, F.lit(n).cast("bigint")).otherwise(size)
    name = F.when(external, F.format_string("f_%06x", number)).otherwise(F.concat(F.lit("data_"), selector.cast("string")))
    return F.struct(
        on.alias("initialised"), kind.alias("file_type"), F.when(external, number).alias("file_no"), F.when(~external, selector).alias("selector"),
        F.when(~external, start).alias("start_block"), F.when(~external, count).alias("block_count"), F.when(on, name).alias("file_name"), F.when(~external, start * size + 8192).alias("byte_offset"),
    )


def little_endian(raw: Column, at: int, n: int = 4) -> Column:
    """An unsigned integer of ``n`` bytes of ``raw`` from ``at`` on, least significant first."""
    return F.conv(F.concat(*(F.hex(F.substring(raw, at + i + 1, 1)) for i in reversed(range(n)))), 16, 10).cast("bigint")
